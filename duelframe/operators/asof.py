"""As-of merge: for every left row the latest right row of its key strictly before it.

Left and right rows are laid out together in sampled ranges of (key, time), so a
range holds a bounded number of rows whatever the key's share or the clustering
of times. Inside a range a running last value finds the right row; the last right
row of each (key, range) is carried into the key's later ranges by a window over
one row per (key, range), and stands there before the range's own rows, so the
ranges are exchanged once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequence import in_ranges


def asof_latest(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], ts: str = "ts",
                tie: str = "match_id", prefix: str = "") -> DataFrame:
    """``left`` with ``values`` of the latest row of ``right`` with the same keys and a smaller ``ts``; null where there is none.

    Of right rows at one time the one with the largest ``tie`` counts. Null keys match each other, rows without a
    time match nothing. Columns of ``left`` are kept as they are; a value is named ``prefix`` + its name.
    """
    keys = list(keys)
    own = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    found = F.struct(*[F.col(f"`{c}`") for c in values])
    names = [F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]
    ks = [f"_k{i}" for i in range(len(keys))]
    rows = left.select(*names, F.col(ts).alias("_ts"), F.lit(0).alias("_kind"), F.xxhash64(own).alias("_tie"), own.alias("_left"),
                       F.lit(None).alias("_right"))
    rows = rows.unionByName(right.where(F.col(ts).isNotNull()).select(
        *names, F.col(ts).alias("_ts"), F.lit(1).alias("_kind"), F.col(tie).cast("bigint").alias("_tie"), F.lit(None).alias("_left"), found.alias("_right")))
    # at one time fixtures come before results, so they never see them
    order = ["_ts", "_kind", "_tie"]
    laid = in_ranges(rows, ks, order)
    # one row per (key, range): its last right row, and then the last one of earlier ranges
    last = laid.groupBy(*ks, "_range").agg(F.max_by("_right", F.when(F.col("_kind") == 1, F.struct("_ts", "_tie"))).alias("_last"))
    earlier = Window.partitionBy(*ks).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("_right", F.last("_last", ignorenulls=True).over(earlier)).where(F.col("_right").isNotNull())
    carried = carried.select(*ks, "_range", F.lit(-1).alias("_kind"), "_right")  # without a time, so it comes first
    before = Window.partitionBy(*ks, "_range").orderBy("_ts", "_kind", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    out = laid.unionByName(carried, allowMissingColumns=True).withColumn("_found", F.last("_right", ignorenulls=True).over(before))
    out = out.where(F.col("_kind") == 0)
    got = F.when(F.col("_ts").isNotNull(), F.col("_found"))
    return out.withColumn("_got", got).select("_left.*", *[F.col("_got").getField(v).alias(prefix + v) for v in values])
