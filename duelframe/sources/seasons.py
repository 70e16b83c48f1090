"""Season files: scan, header check, union by name and mapping to a contest table.

Files with different headers must not be read by one CSV scan (columns would
be matched by position, T1). The first lines of all files come from one Spark job,
grouped by header, whatever the number of files; the driver gets the headers with
their file names, a listing. Files sharing a header are read by one ``spark.read.csv``
over all of them; the header groups are then combined with
``unionByName(allowMissingColumns)``. The number of scans is the number of distinct
headers, not of files.
"""

from __future__ import annotations

import csv
import posixpath
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import parse_day_first
from ..functions.columns import require_columns
from ..operators.sequence import sequence_ordinal

# Required season-file columns and the header -> canonical name map.
REQUIRED_COLUMNS = ["Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "FTR"]
SEASON_COLUMNS = {
    "Date": "date_text", "HomeTeam": "home", "AwayTeam": "away", "FTHG": "hg", "FTAG": "ag",
    "FTR": "ftr", "HS": "hs", "AS": "as_", "HST": "hst", "AST": "ast_", "HC": "hc", "AC": "ac",
    "HF": "hf", "AF": "af", "HY": "hy", "AY": "ay", "HR": "hr", "AR": "ar",
    "B365H": "odd_h", "B365D": "odd_d", "B365A": "odd_a", "AvgH": "avg_h", "AvgD": "avg_d",
    "AvgA": "avg_a",
}
INT_COLUMNS = {"hg", "ag", "hs", "as_", "hst", "ast_", "hc", "ac", "hf", "af", "hy", "ay", "hr", "ar"}
DOUBLE_COLUMNS = {"odd_h", "odd_d", "odd_a", "avg_h", "avg_d", "avg_a"}
ENRICHMENT_FILE = "understat_raw.csv"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_season_files(spark: SparkSession, data_dir: str, exclude: tuple[str, ...] = (ENRICHMENT_FILE,)) -> list[str]:
    """Every ``*.csv`` in the folder, by name, except the enrichment file (O2)."""
    fs, p = _fs(spark, data_dir)
    names = sorted(str(st.getPath().toString()) for st in fs.listStatus(p)
                   if st.isFile() and st.getPath().getName().endswith(".csv")
                   and st.getPath().getName() not in exclude)
    if not names:
        raise FileNotFoundError(f"{data_dir} holds no season file (*.csv)")
    return names


def _names(line: str) -> tuple[str, ...]:
    """Column names of a header line: blank ones (trailing commas) are named by their place, repeated ones after it."""
    names: list[str] = []
    for i, h in enumerate(next(csv.reader([line.lstrip("\ufeff")]), [])):
        name = h.strip() or f"_blank{i}"
        names.append(name if name not in names else f"{name}_{i}")
    return tuple(names)


def file_headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(line, files): the distinct first lines and the files that begin with them, by one job.

    Only the split at a file's start holds its first line; inside it the first row is found by a partial minimum.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
                                          F.monotonically_increasing_id().alias("place"), "value")
    first = lines.where("at = 0").groupBy("file").agg(F.min_by("value", "place").alias("line"))
    return first.groupBy("line").agg(F.array_sort(F.collect_list("file")).alias("files"))


def read_season_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All files as string columns plus ``source_file`` (the season key)."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for r in file_headers(spark, paths).collect():  # file names, as in a listing
        groups.setdefault(_names(r["line"]), []).extend(unquote(f) for f in r["files"])
    if not groups:
        raise ValueError("the season files are empty")
    parts = []
    for header, files in sorted(groups.items(), key=lambda g: min(g[1])):
        schema = T.StructType([T.StructField(h, T.StringType()) for h in header])
        df = (spark.read.option("header", True).option("encoding", "UTF-8").option("escape", "\"").schema(schema)
              .option("enforceSchema", True).csv(files))
        parts.append(df.withColumn("source_file", F.col("_metadata.file_name")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    require_columns(out, REQUIRED_COLUMNS)
    return out


def load_season_dir(spark: SparkSession, data_dir: str) -> DataFrame:
    return read_season_files(spark, list_season_files(spark, posixpath.join(data_dir, "")))


def to_contests(raw: DataFrame, pool: str = "default", keep_bad: bool = False) -> DataFrame:
    """Canonical contest table from season-file columns.

    Dates are parsed day-first (4-digit year, then 2-digit); rows whose date,
    teams or result is missing are dropped (P2); with ``keep_bad=True`` they
    are returned instead (the quarantine side). ``match_id`` is the row's place
    in the order of (date, file, all columns), so it is unique even when one
    pair meets twice on a day or a line is repeated; ``season`` is the file name.
    """
    present = {c: SEASON_COLUMNS[c] for c in raw.columns if c in SEASON_COLUMNS}
    cols = []
    for src, dst in present.items():
        c = F.col(f"`{src}`")
        if dst in INT_COLUMNS:
            c = F.nanvl(c.try_cast("double"), F.lit(None).cast("double")).cast("int")
        elif dst in DOUBLE_COLUMNS:
            c = F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))
        cols.append(c.alias(dst))
    d = raw.select(*cols, "source_file")
    d = d.withColumn("ts", parse_day_first("date_text").cast("timestamp_ntz"))
    ok = (F.col("ts").isNotNull() & F.col("home").isNotNull() & F.col("away").isNotNull()
          & F.col("ftr").isNotNull())
    d = d.where(~ok if keep_bad else ok)
    rest = [c for c in d.columns if c not in ("ts", "source_file")]
    d = sequence_ordinal(d, [], order=["ts", "source_file", *rest], name="match_id")
    return d.select(
        "match_id", "ts", F.col("source_file").alias("season"), F.lit(pool).alias("pool"),
        *[c for c in rest if c != "date_text"],
    )
