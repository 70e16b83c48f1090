"""Statistics of all folds from one pass against fits per fold."""

from __future__ import annotations

import random
import statistics
from collections import Counter

import pytest
from duelframe.operators.split import cv_folds
from duelframe.plans.foldstats import fold_class_weights, fold_modes, fold_moments
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    data = [(i, None if r.random() < 0.1 else 1e6 + r.gauss(0, 3), float("nan") if r.random() < 0.1 else r.random() + i / 50, 5.0,
             r.choice(["a", "b", "c", None]), None, r.choice([0, 0, 1, 2])) for i in range(97)]
    df = spark.createDataFrame(data, "row_idx bigint, x double, y double, k double, cat string, none string, label int").repartition(6)
    return data, cv_folds(df.withColumn("n", F.lit(97)), 4, size="n")


def test_equal_to_fits_per_fold(rows):
    data, folds = rows
    t = 97 // 5
    parts = [[d for d in data if d[0] < 97 - (4 - i) * t] for i in range(4)] + [data]
    moments = {(r["fold"], r["col"]): r for r in fold_moments(folds, ["x", "y", "k"], 4).collect()}
    modes = {(r["fold"], r["col"]): r["mode"] for r in fold_modes(folds, ["cat", "none"], 4).collect()}
    weights = {(r["fold"], r["label"]): (r["n_class"], r["weight"]) for r in fold_class_weights(folds, "label", 4).collect()}
    assert len(moments) == 15
    for i, part in enumerate(parts):
        for c, place in (("x", 1), ("y", 2), ("k", 3)):
            values = [0.0 if d[place] is None or d[place] != d[place] else d[place] for d in part]
            got = moments[i, c]
            sd = statistics.pstdev(values)
            assert got["n"] == len(part) and abs(got["mean"] - statistics.fmean(values)) < 1e-9 * max(1, abs(got["mean"]))
            assert abs(got["std"] - (sd or 1.0)) < 1e-9 * max(1, got["std"])
        counts = Counter(d[4] for d in part if d[4])
        assert modes[i, "cat"] == min(counts, key=lambda v: (-counts[v], v)) and (i, "none") not in modes
        own = Counter(d[6] for d in part)
        assert {k: weights[i, k] for k in own} == {k: (n, pytest.approx(len(part) / (len(own) * n))) for k, n in own.items()}
