"""Table profiles: entity lists, coverage, spans, per-season counts, previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entities(df: DataFrame, home: str = "home", away: str = "away", pool: str | None = "pool") -> DataFrame:
    """Distinct entities from both sides (UNION DISTINCT of two columns)."""
    keys = [pool] if pool else []
    h = df.select(*keys, F.col(home).alias("team"))
    a = df.select(*keys, F.col(away).alias("team"))
    return h.union(a).distinct()


def date_span(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Row count and first/last timestamp (A3)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first_ts"),
                  F.max(ts).alias("last_ts"))


def split_summary(split: DataFrame, ts: str = "ts", role: str = "role") -> DataFrame:
    """Per-role row counts and date spans (A3)."""
    return split.groupBy(role).agg(F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first_ts"),
                                   F.max(ts).alias("last_ts"))


def season_counts(df: DataFrame, season: str = "season") -> DataFrame:
    """Contests per season (A4)."""
    return df.groupBy(season).agg(F.count(F.lit(1)).alias("n_matches"))


def preview(df: DataFrame, cols: list[str], order: list[str], n: int = 8) -> DataFrame:
    """First ``n`` rows by ``order`` (O4): a top-k, not a full sort."""
    return df.select(*cols).orderBy(*order).limit(n)
