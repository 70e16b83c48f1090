"""Left enrichment joins and coverage.

The enrichment side is collapsed to one row per join key *before* the join,
so duplicate provider rows can never multiply contests (D2). The collapse
is a partial aggregation (``max_by``), which combines map-side before the
shuffle even when one key holds a third of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedupe_latest(df: DataFrame, keys: Sequence[str], tie: str | None = None) -> DataFrame:
    """One row per ``keys``: the row with the largest ``tie`` value.

    Without ``tie`` the largest row by value (struct ordering) is kept, which
    is deterministic whatever the input order.
    """
    keys = list(keys)
    vals = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in vals])
    pick = F.max_by(packed, F.col(tie)) if tie else F.max(packed)
    return df.groupBy(*keys).agg(pick.alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in vals])


def enrich_left(df: DataFrame, enrichment: DataFrame, keys: Sequence[str],
                columns: Sequence[str] | None = None, tie: str | None = None) -> DataFrame:
    """Left-join provider columns on ``keys``; unmatched rows keep NULLs.

    Only columns present in the provider table are taken (older files may
    lack newer columns, P6). Row count of ``df`` is preserved.
    """
    keys = list(keys)
    wanted = [c for c in (enrichment.columns if columns is None else columns) if c in enrichment.columns and c not in keys]
    right = enrichment.select(*keys, *wanted, *([tie] if tie and tie not in wanted else []))
    right = dedupe_latest(right, keys, tie)
    if tie and tie not in wanted:
        right = right.drop(tie)
    return df.join(right, keys, "left")


def coverage(df: DataFrame, column: str) -> DataFrame:
    """Rows with a non-null ``column`` over all rows (A2)."""
    return df.agg(F.count(column).alias("n_covered"), F.count(F.lit(1)).alias("n_total")) \
        .select("n_covered", "n_total",
                (F.col("n_covered") / F.col("n_total")).alias("coverage"))
