"""Preprocessing statistics of all expanding-window folds from one pass.

Fold i learns from the rows whose ``train_from_fold`` is at most i, so its counts,
moments, value counts and class counts are running sums over blocks of rows. One
grouping by block gives them; the sums then run over at most splits + 1 rows a
column (or value), and every fold's means, deviations, modes and weights follow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "train_from_fold"


def _folds(n_splits: int):
    return F.explode(F.sequence(F.lit(0), F.lit(n_splits))).alias("fold")


def fold_moments(rows: DataFrame, cols: Sequence[str], n_splits: int) -> DataFrame:
    """(fold, col, n, mean, std): moments of 0-imputed columns over each fold's training rows; fold ``n_splits`` is all rows.

    Sums are taken around the column's mean over the first block, so large offsets cost no digits; std is the
    population's, and 1 where a column doesn't vary.
    """
    clean = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0)) for c in cols}
    base = rows.where(F.col(BLOCK) == 0).agg(*[F.avg(v).alias(c) for c, v in clean.items()]).first()  # one number a column
    around = {c: float(base[c] or 0.0) for c in cols}
    each = F.array(*[F.struct(F.lit(c).alias("col"), (v - F.lit(around[c])).alias("x"), F.lit(around[c]).alias("around")) for c, v in clean.items()])
    blocks = (rows.select(BLOCK, F.explode(each).alias("e")).groupBy(BLOCK, "e.col", "e.around")
              .agg(F.count(F.lit(1)).alias("n"), F.sum("e.x").alias("s"), F.sum(F.col("e.x") * F.col("e.x")).alias("q")))
    out = (blocks.select("*", _folds(n_splits)).where(F.col(BLOCK) <= F.col("fold")).groupBy("fold", "col", "around")
           .agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")))
    mean, spread = F.col("s") / F.col("n"), F.col("q") / F.col("n")
    std = F.sqrt(F.greatest(F.lit(0.0), spread - mean * mean))
    return out.select("fold", "col", "n", (F.col("around") + mean).alias("mean"), F.when(std > 1e-12, std).otherwise(1.0).alias("std"))


def fold_modes(rows: DataFrame, cols: Sequence[str], n_splits: int) -> DataFrame:
    """(fold, col, mode): the most frequent value of each fold's training rows, ties to the smallest; no row for a column without values."""
    each = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("v")) for c in cols])
    counts = (rows.select(BLOCK, F.explode(each).alias("e")).where("e.v IS NOT NULL").groupBy(BLOCK, "e.col", "e.v").agg(F.count(F.lit(1)).alias("n")))
    run = counts.select("col", "v", BLOCK, "n", _folds(n_splits)).where(F.col(BLOCK) <= F.col("fold"))
    totals = run.groupBy("fold", "col", "v").agg(F.sum("n").alias("n"))
    return totals.groupBy("fold", "col").agg(F.min_by("v", F.struct(-F.col("n"), "v")).alias("mode"))


def fold_class_weights(rows: DataFrame, label: str, n_splits: int) -> DataFrame:
    """(fold, label, n_class, weight): balanced weights n / (classes x n_class) of each fold's training rows."""
    counts = rows.groupBy(BLOCK, F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    run = counts.select("label", BLOCK, "n", _folds(n_splits)).where(F.col(BLOCK) <= F.col("fold"))
    totals = run.groupBy("fold", "label").agg(F.sum("n").alias("n_class"))
    every = Window.partitionBy("fold")  # over classes
    return totals.select("fold", "label", "n_class", (F.sum("n_class").over(every) / (F.count(F.lit(1)).over(every) * F.col("n_class"))).alias("weight"))
