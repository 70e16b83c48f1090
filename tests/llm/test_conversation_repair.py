from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest
from duelframe.llm import conversation_repair as R
from duelframe.llm.queries import ORACLES, QUERIES
from pyspark.sql import functions as F

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def cheapest(symbols):
    """Least (cost, audit) by a plain search over whole edit strings, state by state."""
    best = {0: (0, "")}

    def inserts(states):
        out = dict(states)
        for _ in range(3):
            for p, (c, a) in list(out.items()):
                q = 3 if p == 2 else 2
                if q not in out or (c + 2, a + "I") < out[q]:
                    out[q] = (c + 2, a + "I")
        return out

    for k in symbols:
        states, best = inserts(best), {}
        for p, (c, a) in states.items():
            moves = [(p, 3, "D")]
            if k != R.GONE:
                late, q = k // 4, 3 if p == 2 else 2
                moves.append((q, 2 + late, "R"))
                if k % 4 == 0 and p == 0:
                    moves.append((1, late, "K"))
                if k % 4 == 1 and p != 2 or k % 4 == 2 and p == 2:
                    moves.append((q, late, "K"))
            for q, cost, e in moves:
                if q not in best or (c + cost, a + e) < best[q]:
                    best[q] = (c + cost, a + e)
    return min(v for q, v in inserts(best).items() if q in (0, 3))


def brute(rows):
    """conv -> result tuple, from (conv, turn, role, text) after damage; a None text marks a conversation without rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv and r[3] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, symbols, counts, faults = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0), []
        for _, _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            if fault:
                counts[fault] += 1
            symbols.append(8 if fault in ("blank", "duplicate") else {"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + 4 * (fault == "truncated"))
        cost, audit = cheapest(symbols) if own else (0, "")
        lines, at, need = [], 0, "u"
        for e in audit:
            role, text = ("", "") if e == "I" else own[at][2:]
            at += e != "I"
            if e == "D":
                continue
            if e == "K":
                need = {"s": "u", "u": "a", "a": "u"}[role[:1]]
            else:
                role, need = ("user", "a") if need == "u" else ("assistant", "u")
            lines.append(f"{role}:{text}")
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            out.append((conv, turn, role, None))
            continue
        text = "" if code == 1 else text.translate({ord(c): None for c in ".!?"}) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def result(df):
    return {r["conv"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))
            for r in df.collect()}


def conversations(seed, n, turns, texts=("yes.", "no!", "why", " \t", "", "ok?", "längere Antwort.  ", None)):
    r = random.Random(seed)
    roles = ["system", "user", "assistant", "tool", "", "unknown", None]
    return [(c, None if r.random() < 0.05 else k * r.choice((1, 1, 1, 3)), r.choices(roles, (1, 6, 6, 1, 1, 1, 1))[0],
             f"{r.randrange(99)} {r.choice(texts)}" if r.random() < 0.7 else r.choice(texts))
            for c in range(n) for k in range(r.randrange(1, turns + 1))]


def test_products_equal_the_plain_search():
    r = random.Random(3)
    sequences = [bytes(r.choices(range(9), k=r.randrange(1, 30))) for _ in range(300)] + [bytes([8]) * 700, bytes([1, 2]) * 900, bytes([0]) * 301]
    matrices = R.transfer(sequences)
    for s in sequences:
        cost, rope = R.closed(matrices[s][0])
        assert (cost, R.flat(rope)) == cheapest(s)
    every = [bytes(x) for n in range(1, 5) for x in itertools.product(range(9), repeat=n)]
    matrices = R.transfer(every)
    assert all((e[0], R.flat(e[1])) == cheapest(s) for s in every for e in [R.closed(matrices[s][0])])


def test_grammar_spells_its_sequences_and_leaves_no_pair_twice():
    r = random.Random(5)
    sequences = [np.array(r.choices(range(4), k=r.randrange(0, 60)), np.uint8) for _ in range(80)]
    rules, tops = R.repair_rules(sequences)

    def spelled(k):
        return [k] if k <= R.GONE else spelled(rules[k - R.GONE - 1][0]) + spelled(rules[k - R.GONE - 1][1])

    assert len(rules) > 10 and [sum((spelled(k) for k in t.tolist()), []) for t in tops] == [s.tolist() for s in sequences]
    pairs = [p for t in tops for p in itertools.pairwise(t.tolist())]
    assert len({p for p in pairs if p[0] != p[1]}) == sum(p[0] != p[1] for p in pairs)


def test_whole_conversations_and_pieces_against_brute_force(spark, monkeypatch):
    rows = conversations(1, 60, 12) + [(None, 1, "user", "hi."), (None, None, None, None), (77, 5, "user", "only"), (77, 5, "user", "only")]
    rows += [(500, k, "user" if k % 2 else "assistant", f"{k % 7}{'.' if k % 3 else ''}") for k in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("conv", "piece", "absent", "seen", "rows", "head")})
    for bound in (R.MAX_ROWS, 7):
        monkeypatch.setattr(R, "MAX_ROWS", bound)
        got = R.repair_conversations(R.inject_faults(df), absent=F.col("absent"))
        assert result(R.whole_digests(got)) == brute(damaged(rows))
        pieces = {r["conv"]: r["pieces"] for r in got.collect()}
        assert pieces[500] >= (50 if bound == 7 else 1)


def test_two_ways_agree(spark):
    rows = damaged(conversations(9, 30, 9))
    there = spark.createDataFrame([r if r[3] is not None else (*r[:3], "") for r in rows], SCHEMA).toDF("conv", "turn", "role", "text")
    there = there.withColumn("absent", F.lit(False))
    by_pieces = R.whole_digests(R._across_ranges(there))
    rows = [(r["conv"], r["turn"], r["role"], r["text"]) for r in there.collect()]
    assert result(by_pieces) == brute(rows)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert R.whole_digests(R.repair_conversations(R.inject_faults(empty))).count() == 0
    dropped = next(c for c in range(999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    kept = next(c for c in range(999) if zlib.crc32(f"{c}:0".encode()) % 20 > 4)
    rows = [(dropped, 0, "user", "gone."), (kept, 0, "user", "x" * 5_000_000), (kept, 0, "assistant", "é.  ")]
    got = result(R.whole_digests(R.repair_conversations(R.inject_faults(spark.createDataFrame(rows, SCHEMA)), absent=F.col("absent"))))
    assert got == brute(damaged(rows))
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    far = [(1, -(1 << 63), "user", "a."), (1, (1 << 63) - 1, "assistant", "b.")]
    one = R.repair_conversations(spark.createDataFrame(far, SCHEMA))
    assert result(R.whole_digests(one))[1][0] == R.LARGEST
    turns = [tuple(t) for t in one.first()["turns"]]
    assert turns == [("K", "user", "a."), ("K", "assistant", "b.")]


@pytest.mark.parametrize("seed", [4])
def test_sql_on_odd_rows(spark, tmp_path, seed):
    rows = [r for r in conversations(seed, 50, 8) if r[2] != ""]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        want = db.execute(ORACLES["op13_structure_repair"])
        columns = [c[0] for c in want.description]
        got = [tuple(r) for r in QUERIES["op13_structure_repair"](spark, str(tmp_path)).select(*columns).collect()]
        assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr)
