"""The full pre-contest feature table (E4, §2.10 column list, P14, P15).

Plan shape (one pass per concern, no self-joins per statistic):

    contests ──entries──> per-side rows (2 per contest)
        └─ sampled ranges of (pool, team, ts, match_id), written once  [shuffle]
        └─ rows + halos by (pool, team, range)                         [shuffle]
             venue frames      partitionBy(pool, team, side, range)
             all-venue frames  partitionBy(pool, team, range)
             rolling w=5 (full), w=3/10/19 (multi), lag(ts), season totals
        └─ repivot groupBy(match_id)                                   [shuffle]
    contests ──pair frames partitionBy(pool, home, away, range)──> h2h, odds, calendar
    contests ──by (pool, component of entities) + ordered fold──> Elo
    join the three on match_id.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.calendar import is_weekend, month
from ..functions.odds import implied_probs
from ..operators.elo import elo_ratings
from ..operators.history import head_to_head, prev_ts_column, rest_days, season_totals
from ..operators.rolling import (ALL_METRICS, MULTI_WINDOW_METRICS, VENUE_METRICS,
                                 read_columns, rolling_columns)
from ..operators.sequence import ORDER, in_ranges, with_halo
from ..operators.unpivot import entries, normalize_contests, repivot
from ..session import stored

EXTRA_WINDOWS = (3, 10, 19)
DEFAULT_WINDOW = 5

# Output names of the per-side metrics (reference names, fixed).
SIDE_RENAME = {
    "form_points": "form_points", "avg_scored": "avg_goals_scored",
    "avg_conceded": "avg_goals_conceded", "avg_goal_diff": "avg_goal_diff",
    "avg_shots": "avg_shots", "avg_shots_on_target": "avg_sot", "xg_proxy": "xg_proxy",
    "shot_conversion": "shot_conversion", "avg_real_xg": "avg_real_xg",
    "avg_real_xga": "avg_real_xga", "avg_xg_overperf": "xg_overperf", "avg_npxg": "avg_npxg",
    "avg_ppda": "avg_ppda", "avg_deep": "avg_deep", "avg_xpts": "avg_xpts",
    "avg_forecast_win": "avg_forecast_w", "avg_corners": "avg_corners",
    "avg_fouls": "avg_fouls", "avg_yellows": "avg_yellows", "avg_reds": "avg_reds",
    "clean_sheet_pct": "clean_sheet_pct", "scoring_pct": "scoring_pct", "streak": "streak",
}

BASE_NUMERIC_COLS = [
    "home_form_points", "away_form_points", "form_diff",
    "home_avg_goals_scored", "away_avg_goals_scored",
    "home_avg_goals_conceded", "away_avg_goals_conceded",
    "goal_scored_diff", "goal_conceded_diff",
    "home_avg_goal_diff", "away_avg_goal_diff",
    "home_avg_shots", "away_avg_shots",
    "home_avg_sot", "away_avg_sot", "sot_diff",
    "home_xg_proxy", "away_xg_proxy", "xg_proxy_diff",
    "home_shot_conversion", "away_shot_conversion",
    "home_avg_real_xg", "away_avg_real_xg", "real_xg_diff",
    "home_avg_real_xga", "away_avg_real_xga",
    "home_xg_overperf", "away_xg_overperf", "xg_overperf_diff",
    "home_avg_npxg", "away_avg_npxg",
    "home_avg_ppda", "away_avg_ppda",
    "home_avg_deep", "away_avg_deep",
    "home_avg_xpts", "away_avg_xpts",
    "home_avg_forecast_w", "away_avg_forecast_w",
    "home_avg_corners", "away_avg_corners",
    "home_avg_fouls", "away_avg_fouls",
    "home_avg_yellows", "away_avg_yellows",
    "home_avg_reds", "away_avg_reds",
    "home_clean_sheet_pct", "away_clean_sheet_pct",
    "home_scoring_pct", "away_scoring_pct",
    "home_streak", "away_streak", "streak_diff",
    "home_venue_form", "away_venue_form",
    "home_venue_scored", "away_venue_scored",
    "home_venue_conceded", "away_venue_conceded",
    "home_venue_xg", "away_venue_xg",
    "home_elo", "away_elo", "elo_diff",
    "home_elo_home", "away_elo_away", "venue_elo_diff",
    "h2h_home_win_rate", "h2h_draw_rate",
    "home_rest_days", "away_rest_days", "rest_diff",
    "home_season_pts", "away_season_pts", "season_pts_diff",
    "home_team_season_win_rate", "away_team_season_win_rate",
    "is_weekend", "month",
    "home_form_pts_w3", "away_form_pts_w3",
    "home_form_pts_w10", "away_form_pts_w10",
    "home_form_pts_w19", "away_form_pts_w19",
    "home_avg_xg_w3", "away_avg_xg_w3", "xg_diff_w3",
    "home_avg_xg_w10", "away_avg_xg_w10", "xg_diff_w10",
    "home_avg_xg_w19", "away_avg_xg_w19", "xg_diff_w19",
    "home_avg_ppda_w3", "away_avg_ppda_w3",
    "home_avg_ppda_w10", "away_avg_ppda_w10",
    "home_avg_ppda_w19", "away_avg_ppda_w19",
]
ODDS_COLS = ["b365_prob_h", "b365_prob_d", "b365_prob_a", "avg_prob_h", "avg_prob_d", "avg_prob_a"]
CAT_COLS = ["home", "away"]
ID_COLS = ["match_id", "ts", "season", "pool", "home", "away", "ftr"]

# Home - away difference columns, (output, home column, away column)
DIFFS = [
    ("form_diff", "home_form_points", "away_form_points"),
    ("goal_scored_diff", "home_avg_goals_scored", "away_avg_goals_scored"),
    ("goal_conceded_diff", "home_avg_goals_conceded", "away_avg_goals_conceded"),
    ("sot_diff", "home_avg_sot", "away_avg_sot"),
    ("xg_proxy_diff", "home_xg_proxy", "away_xg_proxy"),
    ("real_xg_diff", "home_avg_real_xg", "away_avg_real_xg"),
    ("xg_overperf_diff", "home_xg_overperf", "away_xg_overperf"),
    ("streak_diff", "home_streak", "away_streak"),
    ("rest_diff", "home_rest_days", "away_rest_days"),
    ("season_pts_diff", "home_season_pts", "away_season_pts"),
    *[(f"xg_diff_w{w}", f"home_avg_xg_w{w}", f"away_avg_xg_w{w}") for w in EXTRA_WINDOWS],
]


# metrics of the default window that reach the output (forecast draw/loss never do)
FEATURE_METRICS = tuple(m for m in ALL_METRICS if m in SIDE_RENAME)


def _multi_name(metric: str, w: int) -> str:
    return {"form_points": f"form_pts_w{w}", "avg_real_xg": f"avg_xg_w{w}",
            "avg_ppda": f"avg_ppda_w{w}"}[metric]


def side_features(matches: DataFrame, window: int = DEFAULT_WINDOW,
                  extra_windows: tuple[int, ...] = EXTRA_WINDOWS) -> DataFrame:
    """Per-side pre-contest features: one row per (match_id, side)."""
    return _side_frames(matches, {window: FEATURE_METRICS, **{w: MULTI_WINDOW_METRICS for w in extra_windows}}, VENUE_METRICS, window)


def _side_frames(matches: DataFrame, windows: dict[int, Sequence[str]], venue: Sequence[str], window: int) -> DataFrame:
    """The metrics of ``windows``, those of ``venue`` over the side's own contests, rest days and season totals."""
    keys = [S.POOL, "team"]
    vk = [*keys, "side"]
    # ranges hold what the frames and season totals read, no other entry columns
    read = read_columns([*venue, *[m for metrics in windows.values() for m in metrics]])
    tm = entries(matches).select(S.MATCH_ID, S.TS, S.SEASON, S.POOL, "side", "team", *dict.fromkeys(["points", "win", *read]))
    # one exchange by (pool, team, range) serves the frames of both key lists
    c = with_halo(in_ranges(tm, keys, counted=True), [(keys, max(windows)), (vk, window)])

    # season sums first: their sort (by season inside the range) then carries
    # narrow rows, before the wide window aggregates are added
    c = season_totals(c, keys)
    # venue split: the side's own earlier contests at the same venue
    vb, vd, vh = rolling_columns({window: venue}, vk, name=lambda m, w: f"_venue_{m}")
    c = c.select("*", *vb).select("*", *vd).drop(*vh)
    # all venues: default window (all metrics) + extra windows, rest
    bcols, dcols, helpers = rolling_columns(
        windows, keys, name=lambda m, w: SIDE_RENAME.get(m, m) if w == window else _multi_name(m, w))
    frame = Window.partitionBy(*keys, "_range").orderBy(*ORDER)
    c = c.select("*", *bcols, prev_ts_column(frame)).where(~F.col("_halo"))
    return c.select("*", *dcols, rest_days().alias("rest_days")).drop(*helpers, "_prev_ts", "_range", "_halo")


VENUE_RENAME = {"form_points": "venue_form", "avg_scored": "venue_scored", "avg_conceded": "venue_conceded", "xg_proxy": "venue_xg"}

SIDE_OUTPUT = [
    *[SIDE_RENAME[m] for m in FEATURE_METRICS],
    *VENUE_RENAME.values(),
    "rest_days", "season_pts", "team_season_win_rate",
    *[_multi_name(m, w) for w in EXTRA_WINDOWS for m in MULTI_WINDOW_METRICS],
]


def pivoted_side_features(matches: DataFrame, window: int = DEFAULT_WINDOW,
                          extra_windows: tuple[int, ...] = EXTRA_WINDOWS, wanted: Collection[str] | None = None) -> DataFrame:
    """Both sides' features in a contest's row, or only those that the columns ``wanted`` are or are made of."""
    made = {o: (h, a) for o, h, a in DIFFS}
    stems = None if wanted is None else {x.split("_", 1)[1] for c in wanted for x in made.get(c, [c]) if x.startswith(("home_", "away_"))}

    def kept(metrics, name):
        return [m for m in metrics if stems is None or name(m) in stems]

    windows = {window: kept(FEATURE_METRICS, SIDE_RENAME.get), **{w: kept(MULTI_WINDOW_METRICS, lambda m, w=w: _multi_name(m, w)) for w in extra_windows}}
    venue = kept(VENUE_METRICS, VENUE_RENAME.get)
    sf = _side_frames(matches, windows, venue, window).withColumnRenamed("season_win_rate", "team_season_win_rate")
    sf = sf.withColumnsRenamed({f"_venue_{m}": VENUE_RENAME[m] for m in venue})
    other = kept(["rest_days", "season_pts", "team_season_win_rate"], str)
    cols = [*[SIDE_RENAME[m] for m in windows[window]], *[VENUE_RENAME[m] for m in venue], *other,
            *[_multi_name(m, w) for w in extra_windows for m in windows[w]]]
    return repivot(sf, cols)


def match_level_features(matches: DataFrame, wanted: Collection[str] | None = None) -> DataFrame:
    """Pair rates, implied odds and calendar columns: one row per contest. With ``wanted`` only the books that it names are read."""
    m = normalize_contests(matches)
    books = {b: cols for b, cols in S.ODDS_BOOKS.items() if wanted is None or any(c.startswith(f"{b}_prob_") for c in wanted)}
    h2h = head_to_head(m.select(*ID_COLS, *[c for b in books.values() for c in b]))
    probs = []
    for book, cols in books.items():
        ph, pd_, pa = implied_probs(*cols)
        probs += [ph.alias(f"{book}_prob_h"), pd_.alias(f"{book}_prob_d"), pa.alias(f"{book}_prob_a")]
    return h2h.select(*ID_COLS, "h2h_home_win_rate", "h2h_draw_rate",
                      is_weekend(S.TS).alias("is_weekend"), month(S.TS).alias("month"), *probs)


def build_features(matches: DataFrame, window: int = DEFAULT_WINDOW,
                   extra_windows: tuple[int, ...] = EXTRA_WINDOWS, materialize: bool = True,
                   columns: Sequence[str] | None = None) -> DataFrame:
    """The full leakage-free feature table: ids + 101 numeric + 6 odds columns.

    The input is read by three independent passes (per-side frames, pair
    frames, Elo). With ``materialize`` it is written once to the session's
    checkpoint folder so its upstream joins and aggregations run once. With
    ``columns`` the table has the same rows and only the columns named; what no
    such column is made of is not carried through ranges and exchanges.
    """
    if materialize:
        matches = stored(matches)
    side = pivoted_side_features(matches, window, extra_windows, columns)
    level = match_level_features(matches, columns)
    elo = elo_ratings(matches)
    j = level.join(side, "match_id").join(elo, "match_id")
    diffs = [(F.col(h) - F.col(a)).alias(o) for o, h, a in DIFFS if columns is None or o in columns]
    j = j.select("*", *diffs)
    return j.select(*ID_COLS, *BASE_NUMERIC_COLS, *ODDS_COLS) if columns is None else j.select(*columns)


def feature_columns(use_odds: bool = True, available: list[str] | None = None) -> tuple[list[str], list[str]]:
    """Model inputs: 101 numeric (+ 6 odds when enabled) and the categorical pair.

    With ``available`` only columns that exist are kept (older inputs may lack some, P6).
    """
    numeric = BASE_NUMERIC_COLS + (ODDS_COLS if use_odds else [])
    if available is not None:
        have = set(available)
        numeric = [c for c in numeric if c in have]
    return numeric, list(CAT_COLS)
