"""Enrichment file scan and merge onto contests.

A missing enrichment file is not an error: contests pass through with the
enrichment columns present as typed NULLs, so every later operator takes
its "no enrichment" fallback path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import with_optional
from ..operators.enrich import enrich_left
from ..schema import OPTIONAL_TYPES

# Provider column -> canonical contest column.
ENRICHMENT_RENAMES = {
    "date": "ts", "home_team": "home", "away_team": "away",
    "us_home_xg": "xg_h", "us_away_xg": "xg_a",
    "us_home_npxg": "npxg_h", "us_away_npxg": "npxg_a",
    "us_home_ppda": "ppda_h", "us_away_ppda": "ppda_a",
    "us_home_deep": "deep_h", "us_away_deep": "deep_a",
    "us_home_xpts": "xpts_h", "us_away_xpts": "xpts_a",
    "us_forecast_w": "fc_w", "us_forecast_d": "fc_d", "us_forecast_l": "fc_l",
}
KEYS = ["ts", "home", "away"]


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_enrichment(spark: SparkSession, path: str) -> DataFrame | None:
    """Provider table with canonical names and types; ``None`` if the file is absent."""
    if not _exists(spark, path):
        return None
    reader = spark.read.option("header", True)
    df = reader.csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    present = {k: v for k, v in ENRICHMENT_RENAMES.items() if k in df.columns}
    df = df.withColumnsRenamed(present)  # P5
    casts = {c: F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double"))
             for c in present.values() if c not in KEYS}
    return df.withColumns(casts).withColumn("ts", F.to_timestamp(F.col("ts").cast("string")).cast("timestamp_ntz"))


def merge_enrichment(contests: DataFrame, enrichment: DataFrame | None, keys: list[str] | None = None) -> DataFrame:
    """Left-join provider columns (deduped on key); absent provider -> typed NULL columns.

    A contest's own value wins; where it is null the provider's is taken.
    """
    keys = keys or KEYS
    if enrichment is None:
        return with_optional(contests, OPTIONAL_TYPES)
    wanted = [c for c in ENRICHMENT_RENAMES.values() if c not in keys and c in enrichment.columns]
    both = [c for c in wanted if c in contests.columns]
    provider = enrichment.withColumnsRenamed({c: f"_provider_{c}" for c in both})
    merged = enrich_left(contests, provider, keys, columns=[f"_provider_{c}" if c in both else c for c in wanted])
    merged = merged.withColumns({c: F.coalesce(F.col(c), F.col(f"_provider_{c}")) for c in both})
    return with_optional(merged.drop(*[f"_provider_{c}" for c in both]), OPTIONAL_TYPES)
