"""Latest per-entity snapshots and fixture rows for scoring.

``latest_snapshot`` keeps, per (pool, entity, venue), the most recent feature
row where the entity played at that venue. The last time and id of each key are
found first, by hash aggregations over the order's columns alone; wide rows are only
read where they match it, so none but the latest is ever sorted or shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import is_weekend, month
from ..session import stored, stored_result
from .asof import asof_latest

# Fixed fallback values that must equal the reference's (stat -> (column stem, fallback)).
SNAPSHOT_STATS = {
    "form_points": ("form_points", 7.0),
    "avg_scored": ("avg_goals_scored", 1.3),
    "avg_conceded": ("avg_goals_conceded", 1.2),
    "avg_shots": ("avg_shots", 12.0),
    "avg_sot": ("avg_sot", 4.5),
    "avg_corners": ("avg_corners", 5.0),
    "avg_fouls": ("avg_fouls", 11.0),
    "avg_yellows": ("avg_yellows", 1.5),
    "elo": ("elo", 1500.0),
    "venue_form": ("venue_form", 6.0),
    "venue_scored": ("venue_scored", 1.3),
    "venue_conceded": ("venue_conceded", 1.2),
    "clean_sheet_pct": ("clean_sheet_pct", 0.2),
    "scoring_pct": ("scoring_pct", 0.7),
    "avg_goal_diff": ("avg_goal_diff", 0.0),
}
# Fixed constants of the scoring row the reference fills in.
SCORING_DEFAULTS = {"avg_reds": 0.05, "h2h_home_win_rate": 0.5, "rest_days": 7, "is_weekend": 1}


def _last_rows(features: DataFrame, keys: list[str], order: tuple[str, ...]) -> DataFrame:
    """The rows of ``features`` that stand last in their key's order: one a key, more if the whole order repeats.

    One column of the order after the other is narrowed down to its maximum. The maxima have one row a key and are
    stored, so their size is known when they are joined.
    """
    def at_last(rows: DataFrame, last: DataFrame, cols: list[str]) -> DataFrame:
        names = {c: f"_l{i}" for i, c in enumerate(cols)}
        on = [rows[c].eqNullSafe(F.col(n)) for c, n in names.items()]
        return rows.join(last.select(*[F.col(c).alias(n) for c, n in names.items()]), on, "left_semi")

    narrow, done = features.select(*keys, *order), list(keys)
    for c in order:
        rows = narrow if c == order[0] else at_last(narrow, last, done)
        done.append(c)
        last = stored(rows.groupBy(*done[:-1]).agg(F.max(c).alias(c)))
    return at_last(features, last, done)


def latest_snapshot(features: DataFrame, pool: str = "pool", home: str = "home", away: str = "away",
                    order: tuple[str, ...] = ("ts", "match_id")) -> DataFrame:
    """(pool, team, venue, stats...) from each entity's latest row at that venue."""
    parts = []
    for venue, ent, prefix in (("home", home, "home_"), ("away", away, "away_")):
        stats = F.struct(*[F.col(prefix + stem).cast("double").alias(name)
                           for name, (stem, _) in SNAPSHOT_STATS.items()])
        parts.append(_last_rows(features, [pool, ent], order).select(F.col(pool).alias("pool"), F.col(ent).alias("team"),
                                     F.lit(venue).alias("venue"), stats.alias("s"),
                                     F.struct(*order).alias("o")))
    both = parts[0].unionByName(parts[1])
    last = both.groupBy("pool", "team", "venue").agg(F.max_by("s", "o").alias("s"))
    return last.select("pool", "team", "venue", *[
        F.coalesce(F.nanvl(F.col(f"s.{name}"), F.lit(None).cast("double")), F.lit(fb)).alias(name)
        for name, (_, fb) in SNAPSHOT_STATS.items()])


def opponent_candidates(entities: DataFrame, chosen: DataFrame, team: str = "team",
                        pool: str = "pool") -> DataFrame:
    """Every entity of the pool except the chosen one (P20); ``chosen`` is (pool, team)."""
    c = chosen.select(F.col(pool).alias("_p"), F.col(team).alias("_chosen"))
    return (entities.join(c, entities[pool] == c["_p"])
            .where(F.col(team) != F.col("_chosen"))
            .select(pool, F.col("_chosen").alias("chosen"), F.col(team).alias("opponent")))


def _latest(features: DataFrame, keys: dict[str, str], values: list[str],
            order: tuple[str, ...] = ("ts", "match_id")) -> DataFrame:
    """(keys as named, values) of the latest row of each key."""
    last = _last_rows(features, list(keys), order).groupBy(*[F.col(k).alias(n) for k, n in keys.items()]).agg(
        F.max_by(F.struct(*values), F.struct(*order)).alias("_v"))
    return last.select(*keys.values(), *[F.col(f"_v.{v}").alias(v) for v in values])


def _wanted(columns: list[str] | None) -> tuple[list[str], list[tuple[str, str, str]], list[tuple[list[str], list[str]]]]:
    """(model inputs, differences that they are or are made of, (keys, values) of each merge that brings what they are made of)."""
    from ..plans.features import BASE_NUMERIC_COLS, DIFFS, ODDS_COLS
    diffs = [*DIFFS, ("elo_diff", "home_elo", "away_elo"), ("venue_elo_diff", "home_elo_home", "away_elo_away")]
    inputs = [c for c in (*BASE_NUMERIC_COLS, *ODDS_COLS) if columns is None or c in columns]
    needed = set(inputs) | {x for o, h, a in diffs if o in inputs for x in (h, a)}
    merges = [(["pool", side], [c for c in BASE_NUMERIC_COLS if c.startswith(f"{side}_") and c in needed]) for side in ("home", "away")]
    merges.append((["pool", "home", "away"], [c for c in ("h2h_home_win_rate", "h2h_draw_rate") if c in needed]))
    return inputs, [d for d in diffs if d[0] in needed], [m for m in merges if m[1]]


def columns_read(columns: list[str] | None = None) -> list[str]:
    """Columns of the feature table that ``fixture_rows`` makes the inputs of."""
    return ["match_id", "ts", "pool", "home", "away", *[v for _, values in _wanted(columns)[2] for v in values]]


def _as_they_stood(fixtures: DataFrame, features: DataFrame, merges: list[tuple[list[str], list[str]]]) -> DataFrame:
    """``fixtures`` with the values of all merges. Each merge's ranges are deleted when its result is written, so one merge's files are there at a time."""
    if not merges:
        return fixtures
    *earlier, (keys, values) = merges
    return stored_result(fixtures.sparkSession, lambda: asof_latest(_as_they_stood(fixtures, features, earlier), features, keys, values))


def fixture_rows(fixtures: DataFrame, features: DataFrame, as_of: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Every model input (or only those named in ``columns``), under its own name, for fixtures (pool, home, away) that are still to come.

    The home side brings all ``home_`` columns of its latest contest at home,
    the away side all ``away_`` columns of its latest one away, the pair its
    latest head-to-head rates; differences are computed anew. A side without
    such a contest gets the fallbacks, and null where there is none (models
    impute 0). ``ts`` and odds columns of ``fixtures`` are used if they are
    there; without ``ts`` the contest is on a weekend. With ``as_of`` only
    contests strictly before the fixture's ``ts`` count, so past fixtures can
    be scored as they stood; a fixture without ``ts`` then has no state. Values
    that no wanted input is made of aren't carried through the merges.
    """
    from ..plans.features import ODDS_COLS
    inputs, diffs, merges = _wanted(columns)
    needed = {*inputs, *[v for _, values in merges for v in values]}
    out = fixtures
    if as_of:
        out = _as_they_stood(out, features, merges)
    else:
        for keys, values in merges:
            out = out.join(_latest(features, {k: k for k in keys}, values), keys, "left")
    fallback = {f"{side}_{stem}": value for side in ("home", "away") for stem, value in SNAPSHOT_STATS.values()}
    fallback |= {"h2h_home_win_rate": SCORING_DEFAULTS["h2h_home_win_rate"], "home_rest_days": SCORING_DEFAULTS["rest_days"],
                 "away_rest_days": SCORING_DEFAULTS["rest_days"], "home_avg_reds": SCORING_DEFAULTS["avg_reds"],
                 "away_avg_reds": SCORING_DEFAULTS["avg_reds"]}
    out = out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v).cast("double")) for c, v in fallback.items() if c in needed})
    has_ts = "ts" in fixtures.columns
    made = {o: F.col(h).cast("double") - F.col(a).cast("double") for o, h, a in diffs}
    made["is_weekend"] = is_weekend("ts") if has_ts else F.lit(SCORING_DEFAULTS["is_weekend"])
    made["month"] = month("ts") if has_ts else F.lit(None).cast("int")
    made |= {c: F.lit(None).cast("double") for c in ODDS_COLS if c not in fixtures.columns}
    out = out.withColumns(made)
    rest = [c for c in fixtures.columns if c not in ODDS_COLS]
    return out.select(*rest, *[F.col(c).cast("double").alias(c) for c in inputs])
