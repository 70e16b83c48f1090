from __future__ import annotations

import random

import duelframe.llm.ngram_join as N
import numpy as np
from duelframe.llm.components import components
from helpers import documents, edited, prose, tuples
from pyspark.sql import functions as F


def sets_of(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        k = find(i)
        least[k] = d if least.get(k) is None else min(least[k], d if d is not None else least[k])
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def got(docs):
    return tuples(N.similar_documents(docs), "id", "n_tokens", "component")


def corpus():
    rows, n = [], 0
    for family in range(6):
        base = prose(family, 30 + 25 * family)
        for copy in range(14):
            rows.append((n, edited(base, 1000 * family + copy, copy % 5)))
            n += 1
    passage = prose(99, 60)  # shared by many documents that are not alike
    rows += [(n + i, prose(500 + i, 12 + 2 * i) + " " + passage) for i in range(20)]
    n += 20
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one two"), (n + 4, "ONE two"), (n + 5, "a b c d e"), (n + 6, "a b c d e f"),
             (n + 7, "a\u00a0b c d e"), (n + 8, "la " * 3000), (n + 9, "la " * 2000), (n + 10, prose(3, 6000)), (None, prose(3, 6000) + " end"),
             (3, prose(0, 30)), (3, prose(0, 30)), (n + 11, "ÀB c D e f g"), (n + 12, "àb C d E F g")]
    random.Random(1).shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    assert got(documents(spark, rows)) == brute(rows)


def test_with_frequent_tokens_and_small_flushes(spark, monkeypatch):
    """Token pairs are the keys of most documents here, and keys meet across flushes."""
    monkeypatch.setattr(N, "FREQUENT", 3)
    monkeypatch.setattr(N, "FLUSH", 500)
    monkeypatch.setattr(N, "BEST", 1)
    monkeypatch.setattr(N, "ROUNDS", 1)
    rows = corpus()
    assert got(documents(spark, rows).repartition(5)) == brute(rows)


def test_prefix_keys_meet_for_every_linked_pair():
    rng = np.random.default_rng(5)
    for case in range(150):
        size = int(rng.integers(4, 120))
        base = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        drop = rng.random(len(base)) < rng.uniform(0, 0.2)
        other = np.unique(np.r_[base[~drop], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + size // 6)), dtype=np.uint64)])
        both = len(np.intersect1d(base, other))
        if 100 * both < 80 * (len(base) + len(other) - both):
            continue
        often = np.unique(np.r_[base, other])[rng.random(len(np.union1d(base, other))) < rng.uniform(0, 1)]
        slots = np.unique(N._slot(often))
        make = N.Prefixes(slots, rng.integers(16, 30, len(slots)))
        keys, reach, owner = make.keys(np.r_[base, other], np.array([0, len(base), len(base) + len(other)]))
        one = {k: r for k, r, o in zip(keys.tolist(), reach.tolist(), owner.tolist(), strict=True) if o == 0}
        two = {k: r for k, r, o in zip(keys.tolist(), reach.tolist(), owner.tolist(), strict=True) if o == 1}
        assert any(len(other) <= one[k] and len(base) <= two[k] for k in one.keys() & two.keys()), case
        bits = [np.frombuffer(b, np.uint64) for b in N.parities(np.r_[base, other], np.array([0, len(base), len(base) + len(other)]))]
        assert 9 * int(np.bitwise_count(bits[0] ^ bits[1]).sum()) <= len(base) + len(other)


def test_keep_one_and_clashing_names(spark):
    rows = corpus()
    df = documents(spark, rows).withColumns({c: F.lit(1) for c in ("id", "row", "node", "component", "maybe", "part")})
    out = N.keep_one_of_similar(df)
    assert out.columns == df.columns
    want = sorted((repr(d) for d, _, least in brute(rows) if d == least))
    assert sorted(repr(r["doc_id"]) for r in out.collect()) == want


def test_empty_table(spark):
    assert got(documents(spark, []).limit(0)) == []


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, None), (7, 7)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[100 + i] == 100 for i in range(30))
