"""Isotonic calibration over binned scores."""

from __future__ import annotations

import random

from duelframe.plans.calibrate import Calibrator, binned_scores, pool_adjacent_violators
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 10)), min_size=1, max_size=12))
def test_pooling_is_the_max_min_of_means(blocks):
    got = pool_adjacent_violators([(w, float(v)) for w, v in blocks])

    def mean(j, k):
        return sum(w * v for w, v in blocks[j : k + 1]) / sum(w for w, _ in blocks[j : k + 1])

    want = [max(min(mean(j, k) for k in range(i, len(blocks))) for j in range(i + 1)) for i in range(len(blocks))]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want)) and got == sorted(got)


def test_overconfident_scores_are_corrected(spark):
    r = random.Random(2)
    rows = []
    for _ in range(4000):
        p = r.random()
        rows.append(("x", p, int(r.random() < 0.25 + 0.5 * p)))  # the score says p, the truth is flatter
    df = spark.createDataFrame([*rows, ("x", None, 1), ("x", float("nan"), 1), ("x", 0.5, None)], "cls string, p double, hit int")
    binned = binned_scores(df, "p", "hit", ["cls"], bins=20)
    assert sum(b["n"] for b in binned.collect()) == 4000
    cal = Calibrator.fit(binned, "cls", bins=20)
    probe = spark.createDataFrame([("x", 0.02), ("x", 0.5), ("x", 0.98), ("x", 1.0), ("new", 0.3)], "cls string, p double")
    got = [x["v"] for x in probe.select(cal.value(F.col("cls"), F.col("p")).alias("v")).collect()]
    assert abs(got[0] - 0.26) < 0.08 and abs(got[1] - 0.5) < 0.08 and abs(got[2] - 0.74) < 0.08 and got[2] <= got[3] and got[4] == 0.3
    after = df.withColumn("q", cal.value(F.col("cls"), F.col("p")))
    gap = binned_scores(after, "q", "hit", bins=20).select(F.sum(F.abs(F.col("rate") - F.col("mean_score")) * F.col("n")) / F.sum("n")).first()[0]
    assert gap < 0.01


def test_class_probabilities_sum_to_one(spark):
    rows = [(c, s / 20, int(s > 10)) for c in range(3) for s in range(20)]
    cal = Calibrator.fit(binned_scores(spark.createDataFrame(rows, "cls int, p double, hit int"), "p", "hit", ["cls"]), "cls")
    probe = spark.createDataFrame([([0.7, 0.2, 0.1],), ([0.1, 0.2, 0.1],)], "p array<double>")
    got = [r["q"] for r in probe.select(cal.probabilities(F.col("p"), range(3)).alias("q")).collect()]
    assert got[0] == [1.0, 0.0, 0.0] and got[1] == [0.1, 0.2, 0.1]
