"""Entity-name standardisation with pass-through default."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Provider spelling -> season-file spelling, as the reference ships them.
TEAM_NAME_MAP = {
    "Manchester City": "Man City",
    "Manchester United": "Man United",
    "Newcastle United": "Newcastle",
    "Wolverhampton Wanderers": "Wolves",
    "Nottingham Forest": "Nott'm Forest",
    "Leeds United": "Leeds",
    "Leicester City": "Leicester",
    "Luton Town": "Luton",
    "Sheffield United": "Sheffield United",
}


def name_map_table(spark: SparkSession, mapping: dict[str, str] | None = None) -> DataFrame:
    rows = list((mapping or TEAM_NAME_MAP).items())
    return spark.createDataFrame(rows, "from_name string, to_name string")


def standardize_names(df: DataFrame, col: str, mapping: DataFrame, out: str | None = None) -> DataFrame:
    """Replace ``col`` by its mapped spelling; unmapped names pass through.

    The mapping side is deduplicated on ``from_name``; the join strategy is
    left to adaptive execution, which measures that side.
    """
    m = mapping.groupBy("from_name").agg(F.max("to_name").alias("_to"))
    j = df.join(m, df[col] == m["from_name"], "left")
    return j.withColumn(out or col, F.coalesce(F.col("_to"), df[col])).drop("from_name", "_to")
