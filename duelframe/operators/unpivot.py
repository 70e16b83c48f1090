"""Contest row <-> per-side entry rows.

``entries`` turns each contest into two rows, one per side, with the side's
own numbers first (scored/conceded, xg/xga, forecast win/loss swapped for
the away side). ``repivot`` folds per-side feature rows back into one row per
contest with ``home_``/``away_`` prefixes: one join of the home rows to the
away rows on ``match_id``, not one join per statistic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import count_or_zero, nan_to_null, with_optional
from ..functions.outcomes import points


def normalize_contests(matches: DataFrame) -> DataFrame:
    """Add every optional canonical column (typed NULL) so operators can rely on it."""
    return with_optional(matches, S.OPTIONAL_TYPES)


def entries(matches: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One row per (contest, side): ``team``, ``opp``, ``side`` in {'h','a'} and metrics."""
    m = normalize_contests(matches)

    def side_struct(side: str):
        h = side == "h"
        own, other = (0, 1) if h else (1, 0)
        fw, fd, fl = S.FORECAST if h else (S.FORECAST[2], S.FORECAST[1], S.FORECAST[0])
        fields = [
            F.lit(side).alias("side"),
            F.col(S.HOME if h else S.AWAY).alias("team"),
            F.col(S.AWAY if h else S.HOME).alias("opp"),
            points(S.FTR, side).alias("points"),
            F.col(S.HG if h else S.AG).cast("int").alias("scored"),
            F.col(S.AG if h else S.HG).cast("int").alias("conceded"),
            *[count_or_zero(pair[own]).alias(name) for name, pair in S.COUNT_STATS.items()],
            nan_to_null(S.XG[own]).alias("xg"),
            nan_to_null(S.XG[other]).alias("xga"),
            *[nan_to_null(pair[own]).alias(name) for name, pair in S.ENRICH_SIDE.items()],
            nan_to_null(fw).alias("fw"), nan_to_null(fd).alias("fd"), nan_to_null(fl).alias("fl"),
        ]
        return F.struct(*fields)

    base = [S.MATCH_ID, S.TS, S.SEASON, S.POOL, *carry]
    tm = (m.select(*base, F.explode(F.array(side_struct("h"), side_struct("a"))).alias("_e"))
          .select(*base, "_e.*"))
    scored, conceded = F.col("scored"), F.col("conceded")
    return tm.select(
        "*",
        F.coalesce(conceded == 0, F.lit(False)).cast("int").alias("clean_sheet"),
        F.coalesce(scored > 0, F.lit(False)).cast("int").alias("scored_any"),
        (scored - conceded).alias("goal_diff"),
        F.when(F.col("sot") > 0, scored / F.col("sot")).otherwise(F.lit(0.0)).alias("shot_conv"),
        (scored - F.col("xg")).alias("xg_op"),
        F.when(F.col("points") == 3, 1).when(F.col("points") == 0, -1).otherwise(0).alias("res"),
        (F.col("points") == 3).cast("int").alias("win"),
    )


def repivot(per_side: DataFrame, value_cols: Sequence[str], key: str = S.MATCH_ID,
            side_col: str = "side") -> DataFrame:
    """(key, side, v...) -> (key, home_v..., away_v...) by one aggregation.

    A contest has one row per side. Each side's values travel as one struct,
    so the upstream pipeline runs once and a group has two rows. Rows are dealt out by
    key before they are grouped: a task holds few contests whole, and sorting its wide
    rows for a partial aggregation would make none fewer.
    """
    values = F.struct(*[F.col(c) for c in value_cols])
    sides = per_side.select(key, side_col, *value_cols).repartition(key).groupBy(key).agg(*[F.first(F.when(F.col(side_col) == s, values), ignorenulls=True).alias(s) for s in ("h", "a")])
    return sides.select(key, *[F.col(f"{s}.{c}").alias(f"{name}_{c}") for s, name in (("h", "home"), ("a", "away")) for c in value_cols])
