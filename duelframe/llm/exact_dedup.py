"""Exact duplicate removal by content sort (DataFrame operations only).

Rows are range-partitioned by sampled splitters over their normalised text,
each partition is sorted externally so equal texts lie next to each other,
and a window over the sorted rows compares neighbours on the whole text.

* The splitter key is a bounded head of the text followed by its SHA-256, so
  the sample that Spark sends to the driver stays small however long the texts
  are. Equal texts share it; texts that differ are told apart by the window,
  which compares the whole text.
* A text with very many copies would fill one range. Digests counted above a
  threshold get about sqrt(copies) salts, are sorted per (text, salt), and only
  the first row of each run is sorted again. The threshold is at least
  rows / ``MAX_HOT``, so at most ``MAX_HOT`` digests exceed it and their
  broadcast is bounded at every input size.

Defined results: a null text counts as empty; a row with a null identifier
stays only where no copy has one; of rows repeated in identifier and text exactly one is kept;
an empty table gives an empty result; other columns are carried untouched,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD_CHARS = 32  # of the splitter key
HOT_ROWS = 256  # copies of one text above which it is salted
MAX_HOT = 100_000  # salted texts at most


def _rows(docs: DataFrame, id_col: str, text_col: str, normalise) -> DataFrame:
    """(row, id, body, head, digest): ``row`` holds every input column, so no name can clash."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(f"`{id_col}`").alias("id"), (normalise(text) if normalise else text).alias("body"))
    return rows.select("*", F.substring("body", 1, HEAD_CHARS).alias("head"),
                       F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("digest"))


def _split_hot(rows: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary texts, and salted rows of the texts with very many copies."""
    limit = max(hot_rows, -(-rows.count() // MAX_HOT))
    hot = (rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
           .select("digest", F.ceil(F.sqrt("n")).alias("salts")))
    rows = rows.join(F.broadcast(hot), "digest", "left")
    salted = rows.where(F.col("salts").isNotNull()).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")))
    return rows.where(F.col("salts").isNull()).drop("salts"), salted.drop("salts")


def _content_sort(rows: DataFrame, keep: str, salted: bool = False) -> DataFrame:
    """Range-partition, sort and compare neighbours: place in the run of equal texts, and the run's best id."""
    keys = ["head", "digest", *(["salt"] if salted else [])]
    best = F.col("id").desc_nulls_last() if keep == "max" else F.col("id").asc_nulls_last()
    run = Window.partitionBy(*keys, "body").orderBy(best)
    return (rows.repartitionByRange(*keys)
            .withColumns({"place": F.row_number().over(run), "run_keep": F.first("id").over(run)}))


def group_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                 normalise: Callable[[Column], Column] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    ``keep`` is "min" or "max": which identifier of equal texts stays.
    """
    rows = _rows(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), id_col, text_col, normalise).drop("row")
    cold, hot = _split_hot(rows, hot_rows)
    whole = Window.partitionBy("head", "digest", "body")
    out = ["id", "keep_id", "group_size", "kept", "digest"]
    few = (_content_sort(cold, keep)
           .withColumns({"group_size": F.count(F.lit(1)).over(whole), "keep_id": F.col("run_keep"),
                         "kept": F.col("place") == 1}).select(*out))
    # salted texts: a run per (text, salt), then the first rows of the runs once more
    run = Window.partitionBy("head", "digest", "salt", "body")
    runs = _content_sort(hot, keep, salted=True).withColumn("run_size", F.count(F.lit(1)).over(run))
    heads = (_content_sort(runs.where("place = 1").select("id", "body", "head", "digest", "salt", "run_size"), keep)
             .select(F.col("digest").alias("d"), F.col("salt").alias("s"), F.col("run_keep").alias("keep_id"),
                     F.sum("run_size").over(whole).alias("group_size"), (F.col("place") == 1).alias("top")))
    many = (runs.join(heads, (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s")))
            .withColumn("kept", F.col("top") & (F.col("place") == 1)).select(*out))
    return few.unionAll(many).withColumn("digest", F.lower(F.hex("digest"))).withColumnRenamed("digest", "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                normalise: Callable[[Column], Column] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows that stay, with every input column and no other."""
    cold, hot = _split_hot(_rows(docs, id_col, text_col, normalise), hot_rows)
    few = _content_sort(cold, keep).where("place = 1").select("row")
    heads = _content_sort(hot, keep, salted=True).where("place = 1").select("row", "id", "body", "head", "digest")
    many = _content_sort(heads, keep).where("place = 1").select("row")
    return few.unionAll(many).select("row.*")
