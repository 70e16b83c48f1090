from __future__ import annotations

import random

from duelframe.llm import mixing as M
from helpers import DOC, documents, tuples
from pyspark.sql import functions as F


def water(sizes, weights=(3, 1, 2), budget=1.5, most=2.0):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full, open_ = budget * sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(full.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > most * sizes[s]]
        if not over:
            break
        for s in over:
            full[s] = most * sizes[s]
            open_.discard(s)
    return {s: full.get(s, level * weight[s] if s in open_ else 0) for s in names}


def corpus(seed=1, n=400):
    r = random.Random(seed)
    rows = [(i, "w " * r.randrange(0, 90), r.choice(["a", "a", "a", "b", "c", "é", "Z", None])) for i in range(n)]
    return [*rows, (n, None, "a"), (n + 1, "", "only empty"), (n + 2, "x " * 30_000, "long"), (5, rows[5][1], rows[5][2]), (None, "no id here", "b")]


def check(rows, plan, slack):
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water(sizes)
    got = {}
    for r in plan:
        assert 0 <= r["taken"] <= 2 * r["size"]
        got.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    for s, target in want.items():
        if sizes[s]:
            near = [k for k in got if k[0] == sizes[s] and abs(k[1] - target) < 1e-6]
            same = sum(sizes[o] == sizes[s] and abs(t - target) < 1e-6 for o, t in want.items())  # sources alike in both
            assert len(near) == 1 and abs(sum(got[near[0]]) - same * target) <= same * slack, s


def test_targets_and_taken_words(spark):
    rows = corpus()
    df = documents(spark, rows)
    plan = M.mix_plan(df, block=8, shard_words=500).collect()
    assert len(plan) == len(rows)
    check(rows, plan, 8 * 140)  # at most a block or so for each of a source's shards
    check(rows, M.mix_plan(df, block=8).collect(), 20)
    again = M.mix_plan(df.repartition(7), block=8, shard_words=500)
    columns = ("id", "size", "source_size", "target", "taken")
    assert tuples(again, *columns) == sorted((tuple(r[c] for c in columns) for r in plan), key=repr)


def test_mix_agrees_with_its_plan(spark):
    rows = corpus(2, 150)
    df = documents(spark, rows).withColumns({c: F.lit(1) for c in ("id", "size", "row", "shard", "number", "passes", "words", "weight")})
    plan = M.mix_plan(df, block=8, shard_words=500)
    out = M.mix(df, block=8, shard_words=500)
    assert out.columns == df.columns
    want = {}
    for r in plan.collect():
        want[r["id"]] = want.get(r["id"], 0) + r["taken"]
    got = dict.fromkeys(want, 0)
    text = {}
    for i, t, _ in rows:
        text.setdefault(i, []).append((t or "").split())
    for r in out.collect():
        words = r["text"].split()
        got[r["doc_id"]] += len(words)
        assert any(words == t[i:i + len(words)] for t in text[r["doc_id"]] for i in range(len(t) - len(words) + 1))
    assert got == want


def test_apportionment_by_highest_quotients(spark):
    r = random.Random(6)
    rows = [(g, k, r.choice([0, 1, 5, 50, 500]) * r.randrange(1, 30), r.randrange(0, 200)) for g in range(6) for k in range(r.randrange(1, 25))]
    seats = {g: next(x[3] for x in rows if x[0] == g) for g in range(6)}
    rows = [(g, k, w, seats[g]) for g, k, w, _ in rows]
    got = {(x["g"], x["key"]): x["quota"] for x in M.apportion(
        spark.createDataFrame(rows, "g int, key int, w bigint, seats bigint"), "g", "w", "seats").collect()}
    for g in range(6):
        own = {k: w for gg, k, w, _ in rows if gg == g}
        won = dict.fromkeys(own, 0)
        for _ in range(seats[g] if any(own.values()) else 0):
            best = max(own, key=lambda k: (own[k] / (2 * won[k] + 1), -k))
            won[best] += 1
        assert {k: got[g, k] for k in own} == won, g


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOC)
    assert M.mix_plan(empty).count() == 0 and M.mix(empty).count() == 0
    blank = documents(spark, [(1, "", "a"), (2, None, None)])
    assert tuples(M.mix_plan(blank), "id", "taken", "target") == [(1, 0, 0.0), (2, 0, 0.0)] and M.mix(blank).count() == 0


def test_small_sources_meet_their_targets(spark):
    sizes = {"a big": 6000, "b rest": 9000, **{f"tail {i:02}": n for i, n in enumerate([1, 2, 3, 9, 15, 16, 31, 65, 70, 79, 100, 129] * 3)}}
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())]
    want, got = water(sizes), {}
    for r in M.mix_plan(documents(spark, rows)).collect():
        got[rows[r["id"]][2]] = r["taken"]
    assert all(abs(got[s] - want[s]) <= 1 for s in sizes)
    assert all(got[s] == 2 * sizes[s] for s in sizes if want[s] == 2 * sizes[s])
    assert abs(sum(got.values()) - 1.5 * sum(sizes.values())) <= 1
