"""Column helpers for optional, nullable and NaN-carrying inputs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_optional(df: DataFrame, types: Mapping[str, T.DataType]) -> DataFrame:
    """Add every missing column as a typed NULL; existing columns are cast."""
    present = set(df.columns)
    cols = [F.col(c) for c in df.columns]
    missing = [F.lit(None).cast(t).alias(c) for c, t in types.items() if c not in present]
    return df.select(*cols, *missing)


def select_existing(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Project only the wanted columns that exist, in the wanted order."""
    present = set(df.columns)
    return df.select(*[c for c in wanted if c in present])


def nan_to_null(c: Column | str) -> Column:
    """Missing values arrive as NaN from some writers; SQL aggregates skip NULL only."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def count_or_zero(c: Column | str) -> Column:
    """Count statistic: missing or null reads as 0 (P10)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("int"), F.lit(0))


def numeric_or_null(c: Column | str) -> Column:
    """Measured statistic: unparseable, NaN and null all become NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return nan_to_null(c.try_cast("double"))


def require_columns(df: DataFrame, required: Iterable[str]) -> None:
    """Raise before any job runs when required columns are absent."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
