"""Ordered per-key sequences without putting a whole key group in one task.

Every feature in this package reads "the rows of this entity before this
contest". The direct form, ``Window.partitionBy(entity).orderBy(ts)``, sends a
whole entity's history to one task; with a hot entity holding a third of all
rows that task is the job. Here rows are range-partitioned by (key, order) and
written once, with the number of their range: Spark's sampled splitters make the
ranges even whatever the skew, so a hot key is simply spread over many ranges and
a range holds whole stretches of the order. On those ranges

1. ``with_halo`` is a segmented scan for frames: the last rows of a (key, range)
   that frames of later ranges reach back to (at most the frame's length, found
   by one grouping and a limited window) are copied there, flagged ``_halo``.
   A ROWS frame is then exact inside ``partitionBy(key, _range)``; several
   frames, also of finer keys, share the one exchange by (key, range).
2. ``running_before`` gives exclusive running sums over an unbounded frame
   (season-to-date totals) as sums inside the range plus per-range offsets.
3. ``sequence_ordinal`` gives each row its 0-based position in its key group:
   ``row_number`` inside (key, range) plus offsets.

Offsets are running sums over one row per (key, range), at most keys + ranges
rows, whatever the timestamps and ids look like.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

ORDER = ("ts", "match_id")
ROWS = 100_000  # of a range, and of a task that sorts wide rows


def _tasks(df: DataFrame) -> tuple[int, ...]:
    """Arguments of a repartitioning that gives a task about ``ROWS`` rows; none for few rows.

    Adaptive execution sizes tasks by compressed bytes, down to one a core: narrow numbers compress so well that a
    task's rows, wide again in its sorts, would grow with the table.
    """
    n = -(-df.count() // ROWS)
    return (n,) if n > df.sparkSession.sparkContext.defaultParallelism else ()


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ORDER, counted: bool = False) -> DataFrame:
    """``df`` written in sampled ranges of (keys, order), with the number of each row's ``_range``.

    With ``counted`` the rows are counted first and a range holds about ``ROWS`` of them at most.
    """
    return stored(df.repartitionByRange(*(_tasks(df) if counted else ()), *keys, *order).withColumn("_range", F.spark_partition_id()))


def _reached(laid: DataFrame, keys: list[str], halo: int, order: Sequence[str]) -> DataFrame:
    """Rows that a frame of ``halo`` rows in a later range of their key reaches, once for each such range."""
    names = [c for c in laid.columns if c != "_range"]
    by_range = Window.partitionBy(*keys).orderBy("_range")
    spans = (laid.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
             .select(*keys, "_range", "_n", F.coalesce(F.sum("_n").over(by_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
                     F.lead("_range").over(by_range).isNotNull().alias("_more")))
    ending = spans.where("_more").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), "_n", "_before")
    at = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        at = at & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    last = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*[F.desc(o) for o in order]))
    tails = laid.join(ending, at).withColumn("_last", last).where(F.col("_last") <= halo)
    into = spans.select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)], F.col("_range").alias("_to"), F.col("_before").alias("_from"))
    reach = (F.col("_to") > F.col("_range")) & (F.col("_before") + F.col("_n") - F.col("_last") >= F.col("_from") - halo)
    for i, k in enumerate(keys):
        reach = reach & F.col(k).eqNullSafe(F.col(f"_t{i}"))
    return tails.join(into, reach).select(*names, F.col("_to").alias("_range"))


def with_halo(laid: DataFrame, frames: Sequence[tuple[Sequence[str], int]], order: Sequence[str] = ORDER) -> DataFrame:
    """Rows of ``in_ranges`` plus, flagged ``_halo``, those that frames reach in earlier ranges.

    ``frames`` lists (keys, rows reached back); every key list begins with the first one's. The result is
    partitioned by the first list and ``_range``, so windows over ``partitionBy(keys, "_range")`` need no
    further exchange, and halo rows of one frame never come between the rows of another.
    """
    base = list(frames[0][0])
    rows = laid.withColumn("_halo", F.lit(False))
    halos = None
    for keys, reach in frames:
        part = _reached(laid, list(keys), reach, order)
        halos = part if halos is None else halos.unionByName(part)
    if len(frames) > 1:
        halos = halos.dropDuplicates([*base, *[k for k in frames[-1][0] if k not in base], *order, "_range"])
    return rows.unionByName(halos.withColumn("_halo", F.lit(True))).repartition(*_tasks(laid), *base, "_range")


def sequence_ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ORDER,
                     name: str = "k", sub_keys: Sequence[str] = (), sub_name: str | None = None,
                     size_name: str | None = None) -> DataFrame:
    """Add ``name`` = 0-based position of the row in its ``keys`` group by ``order``.

    With ``sub_keys`` a second ordinal ``sub_name`` is added for the finer
    group ``keys + sub_keys`` from the same ranges. With ``size_name`` the
    group's row count is added too. Without keys the whole table is one group.
    """
    keys, fine = list(keys), [*keys, *sub_keys]
    laid = in_ranges(df, keys, order)
    counts = laid.groupBy(*fine, "_range").agg(F.count(F.lit(1)).alias("_n"))

    def offsets(group: Sequence[str], off: str, size: str | None = None) -> DataFrame:
        per = counts.groupBy(*group, "_range").agg(F.sum("_n").alias("_n"))
        earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        total = [F.sum("_n").over(Window.partitionBy(*group)).alias(size)] if size else []
        return per.select(*group, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias(off), *total)

    def place(group: Sequence[str], off: str, out: str) -> Column:
        inside = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order))
        return (F.col(off) + inside - 1).cast("bigint").alias(out)

    d = laid.join(offsets(keys, "_off", size_name), [*keys, "_range"])
    out = [place(keys, "_off", name)]
    if sub_keys:
        d = d.join(offsets(fine, "_soff"), [*fine, "_range"])
        out.append(place(fine, "_soff", sub_name or f"{name}_sub"))
    return d.select(*df.columns, *([size_name] if size_name else []), *out)


def running_before(df: DataFrame, keys: Sequence[str], values: dict[str, Column], order: Sequence[str] = ORDER) -> DataFrame:
    """Exclusive running sums over ``keys`` on rows of ``with_halo``.

    ``keys`` may be finer than the ranges' keys (e.g. add ``season``); halo rows never count. Result columns are
    named like ``values``; a row with no earlier row in its group gets 0.
    """
    keys = list(keys)
    core = ~F.col("_halo")
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = df.select("*", *[F.sum(F.when(core, v)).over(inside).alias(f"_in_{n}") for n, v in values.items()])
    tot = df.where(core).groupBy(*keys, "_range").agg(*[F.sum(v).alias(f"_t_{n}") for n, v in values.items()])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"),
                      *[F.sum(f"_t_{n}").over(earlier).alias(f"_o_{n}") for n in values])
    at = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        at = at & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return d.join(offs, at, "left").select(*[F.col(c) for c in df.columns], *[
        (F.coalesce(F.col(f"_in_{n}"), F.lit(0)) + F.coalesce(F.col(f"_o_{n}"), F.lit(0))).alias(n) for n in values])
