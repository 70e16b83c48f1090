from __future__ import annotations

import math
import random

import numpy as np
import pytest
from duelframe.llm import topk as K
from pyspark.sql import functions as F


def brute(rows, k, every):
    sound = [(i, [math.floor(256 * x) if abs(x) < 1e300 else 256 * int(x) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in sound:
        if q % every:
            continue
        scored = sorted((-min(max(sum(a * b for a, b in zip(v, w)), -2**63 + 1), 2**63 - 1), c) for c, w in sound if c != q)[:k]
        out += [(q, rank, c, -s) for rank, (s, c) in enumerate(scored, 1)]
    return sorted(out)


def got(df, k, every, **more):
    return sorted(tuple(r) for r in K.top_k(df, F.col("vec_id") % every == 0, k, **more).collect())


def vectors(n=300):
    r = random.Random(8)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(16)]) for i in range(n)]
    rows += [(n + i, [0.5] * 16) for i in range(120)]  # one very common vector
    rows += [(n + 200, None), (n + 201, [None] * 16), (n + 202, [float("nan")] * 16), (n + 203, [float("inf")] * 16), (None, [1.0] * 16),
             (n + 210, []), (n + 220, [0.3, -0.2]), (n + 230, [-1.0] * 20)]
    return rows


@pytest.mark.parametrize("group_rows", [17, 2048])
def test_against_brute_force(spark, group_rows):
    rows = vectors()
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<double>, block string, g int").repartition(3)
    assert got(df, 5, 10, group_rows=group_rows) == brute(rows, 5, 10)


def test_few_candidates_repeats_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert got(df, 5, 2) == [(0, 1, 1, 65536), (0, 2, 1, 65536)]
    assert got(df.limit(0), 5, 2) == []
    assert got(df.where("vec_id = 0"), 5, 2) == []


def test_large_components_stay_exact(spark):
    rows = [(0, [1e7, 3e9, -2e8]), (2, [12345678.25, -1e9, 5e8]), (4, [1e300, 0.0, 1.0]), (6, [2.0**40 + 1, 2.0**30, -(2.0**41)]), (8, [-1e305, 1e306, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert got(df, 3, 2) == brute(rows, 3, 2)


def test_the_threshold_never_loses_an_entry():
    rng = np.random.default_rng(3)
    for _ in range(40):
        q, c = rng.normal(size=(6, 12)), rng.normal(size=(90, 12))
        parts = K.partial_scores(q, c)
        own = np.zeros((6, 90), bool)
        total = sum(parts).astype(np.int64)
        cutoff = np.sort(total, 1)[:, -5]
        ids = rng.permutation(90).astype(np.int64)
        found, scores = K.sufficient(parts, own, ids, cutoff, 5)
        assert (scores == -np.sort(-total, 1)[:, :5]).all()
        lists, first = K.first_lists(parts, own, ids, 5)
        assert (first[:, -1] <= cutoff).all()
