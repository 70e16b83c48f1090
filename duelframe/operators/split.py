"""Time-ordered splits and label encoding.

The global ordinal comes from ``sequence_ordinal`` with no key: a running total
over one count per range gives offsets, and ``row_number`` runs inside a range.
No window covers the whole table, and the table size ``n`` rides along with the
offsets.
"""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequence import sequence_ordinal

TRAIN_FRACTION = 0.80
CV_SPLITS = 5


def with_global_ordinal(df: DataFrame, order: tuple[str, ...] = ("ts", "match_id"),
                        name: str = "row_idx", size_col: str = "n_rows") -> DataFrame:
    """0-based position in the total order plus the table's row count."""
    return sequence_ordinal(df, [], order=order, name=name, size_name=size_col)


def temporal_split(df: DataFrame, fraction: float = TRAIN_FRACTION, **kw) -> DataFrame:
    """``role`` = train for the first ``int(n * fraction)`` rows in time order, else test."""
    d = with_global_ordinal(df, **kw)
    cut = F.floor(F.col("n_rows") * F.lit(fraction))
    return d.withColumn("role", F.when(F.col("row_idx") < cut, "train").otherwise("test"))


def cv_folds(df: DataFrame, n_splits: int = CV_SPLITS, idx: str = "row_idx",
             size: str = "n_rows") -> DataFrame:
    """Expanding-window folds: test size ``n // (n_splits + 1)``, train = all earlier rows.

    Adds ``test_fold`` (fold whose test block holds the row, else NULL) and
    ``train_from_fold`` (first fold whose training set holds the row).
    """
    t = F.floor(F.col(size) / F.lit(n_splits + 1))
    start = F.col(size) - F.lit(n_splits) * t
    rel = F.col(idx) - start
    fold = F.when(rel >= 0, F.floor(rel / t)).cast("int")
    train_from = F.when(rel < 0, F.lit(0)).otherwise(fold + 1).cast("int")
    return df.withColumn("test_fold", fold).withColumn("train_from_fold", train_from)


def cv_long(df: DataFrame, n_splits: int = CV_SPLITS) -> DataFrame:
    """(fold, role, row) form: one row per fold membership."""
    folds = F.sequence(F.lit(0), F.lit(n_splits - 1))
    d = df.withColumn("fold", F.explode(folds))
    role = F.when(F.col("test_fold") == F.col("fold"), "test") \
        .when(F.col("fold") >= F.col("train_from_fold"), "train")
    return d.withColumn("role", role).where(F.col("role").isNotNull())


def label_indexer(label: str = "ftr", output: str = "label") -> StringIndexer:
    """Alphabetical label codes (A=0, D=1, H=2), fitted on all rows before the split."""
    return StringIndexer(inputCol=label, outputCol=output, stringOrderType="alphabetAsc")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights ``n / (k * n_class)`` as a small per-class table."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    w = Window.partitionBy()
    return per.select(label, "n_class",
                      (F.sum("n_class").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_class")))
                      .alias("weight"))
