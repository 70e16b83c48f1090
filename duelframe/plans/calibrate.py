"""Probability calibration by isotonic regression over binned scores.

Scores are binned by a grouping (``BINS`` rows a class whatever the input), the
driver pools adjacent violators over those rows, and the calibrated value of a
score is the pooled rate of its bin, a lookup in a literal array. The same bins,
before and after, are the reliability table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 50


def bin_of(score: Column, bins: int = BINS) -> Column:
    """0-based bin of a score in 0 to 1; null and NaN have none."""
    clean = F.nanvl(score, F.lit(None).cast("double"))
    return F.when(clean.isNotNull(), F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(clean * bins)))).cast("int")


def binned_scores(rows: DataFrame, score: str, hit: str, by: Sequence[str] = (), bins: int = BINS) -> DataFrame:
    """(by, bin, n, mean_score, rate): counts, mean score and share of hits of each bin that has rows."""
    return (rows.where(F.col(score).isNotNull() & F.col(hit).isNotNull()).withColumn("bin", bin_of(F.col(score), bins)).where(F.col("bin").isNotNull())
            .groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(hit).cast("double")).alias("rate")))


def pool_adjacent_violators(blocks: Sequence[tuple[float, float]]) -> list[float]:
    """Non-decreasing values of least weighted squares for (weight, value) in order."""
    stack: list[list[float]] = []  # [weight, value, members]
    for weight, value in blocks:
        stack.append([weight, value, 1])
        while len(stack) > 1 and stack[-2][1] >= stack[-1][1]:
            w, v, m = stack.pop()
            last = stack[-1]
            last[1] = (last[0] * last[1] + w * v) / (last[0] + w)
            last[0], last[2] = last[0] + w, last[2] + m
    return [v for _, v, m in stack for _ in range(m)]


class Calibrator:
    """Pooled rate per class and bin; bins without rows take the value of the nearest bin below, else above."""

    def __init__(self, bins: int, values: dict):
        self.bins, self.values = bins, values

    @classmethod
    def fit(cls, binned: DataFrame, by: str, bins: int = BINS) -> Calibrator:
        """From ``binned_scores`` with one grouping column; bins x classes rows reach the driver."""
        rows: dict = {}
        for r in binned.select(by, "bin", "n", "rate").orderBy(by, "bin").collect():
            rows.setdefault(r[by], []).append((r["bin"], r["n"], r["rate"]))
        values = {}
        for key, own in rows.items():
            pooled = pool_adjacent_violators([(n, rate) for _, n, rate in own])
            known = dict(zip((b for b, _, _ in own), pooled, strict=True))
            full, last = [], pooled[0]
            for b in range(bins):
                last = known.get(b, last)
                full.append(last)
            values[key] = full
        return cls(bins, values)

    def value(self, key: Column, score: Column) -> Column:
        """Calibrated score of a class; the score itself for a class that was never seen."""
        out = score
        for k, full in self.values.items():
            table = F.array(*[F.lit(float(v)) for v in full])
            out = F.when(key == F.lit(k), F.element_at(table, bin_of(score, self.bins) + 1)).otherwise(out)
        return out

    def probabilities(self, probability: Column, classes: Sequence) -> Column:
        """Array of class probabilities, each calibrated, summing to 1; the uncalibrated ones where all are 0."""
        parts = F.array(*[self.value(F.lit(c), F.element_at(probability, i + 1)) for i, c in enumerate(classes)])
        total = F.aggregate(parts, F.lit(0.0), lambda a, p: a + p)
        return F.when(total > 0, F.transform(parts, lambda p: p / total)).otherwise(probability)
