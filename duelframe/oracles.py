"""DuckDB SQL oracles for the registered queries.

Each oracle restates the operator's semantics in plain SQL over the driver
tables (window frames, joins, recursive CTEs), written independently of
the Spark code. Doubles are compared after rounding to 6 places.
"""

from __future__ import annotations

from .sources.tables import CONTEST_SQL, ENRICH_SQL

# per-side rows of the contest view (DuckDB form)
TM_SQL = """
enrich_one AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY pool, ts, home, away ORDER BY src_id DESC) AS rn
    FROM enrich) WHERE rn = 1
),
cx AS (
  SELECT c.*, e.npxg_h, e.npxg_a, e.ppda_h, e.ppda_a, e.deep_h, e.deep_a, e.xpts_h, e.xpts_a,
         e.fc_w, e.fc_d, e.fc_l
  FROM contest c LEFT JOIN enrich_one e
    ON c.pool = e.pool AND c.ts = e.ts AND c.home = e.home AND c.away = e.away
),
tm AS (
  SELECT match_id, ts, season, pool, home AS team, away AS opp, 'h' AS side,
         CASE ftr WHEN 'H' THEN 3 WHEN 'D' THEN 1 ELSE 0 END AS points,
         hg AS scored, ag AS conceded, coalesce(hs, 0) AS shots, coalesce(hst, 0) AS sot,
         coalesce(hc, 0) AS corners, coalesce(hf, 0) AS fouls, coalesce(hy, 0) AS yellows, coalesce(hr, 0) AS reds,
         xg_h AS xg, xg_a AS xga, npxg_h AS npxg, ppda_h AS ppda, deep_h AS deep, xpts_h AS xpts,
         fc_w AS fw, fc_d AS fd, fc_l AS fl
  FROM cx
  UNION ALL
  SELECT match_id, ts, season, pool, away, home, 'a',
         CASE ftr WHEN 'A' THEN 3 WHEN 'D' THEN 1 ELSE 0 END,
         ag, hg, coalesce(as_, 0), coalesce(ast_, 0), coalesce(ac, 0), coalesce(af, 0), coalesce(ay, 0), coalesce(ar, 0),
         xg_a, xg_h, npxg_a, ppda_a, deep_a, xpts_a, fc_l, fc_d, fc_w
  FROM cx
),
tmx AS (
  SELECT *, CASE WHEN conceded = 0 THEN 1 ELSE 0 END AS clean_sheet,
         CASE WHEN scored > 0 THEN 1 ELSE 0 END AS scored_any,
         scored - conceded AS goal_diff, scored - xg AS xg_overperf,
         CASE WHEN points = 3 THEN 1 WHEN points = 0 THEN -1 ELSE 0 END AS res
  FROM tm
)"""


def with_tm(body: str) -> str:
    return f"WITH {CONTEST_SQL},\n{ENRICH_SQL},\n{TM_SQL},\n{body}"


def with_contest(body: str) -> str:
    return f"WITH {CONTEST_SQL},\n{body}"


def _frame(w: int, part: str = "pool, team") -> str:
    return f"(PARTITION BY {part} ORDER BY ts, match_id ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"


def roll_sql(name: str, w: int, part: str = "pool, team", source: str = "tmx") -> str:
    """Base window aggregates of one frame length, as CTE ``name``."""
    f = _frame(w, part)
    return f"""
{name} AS (
  SELECT match_id, side, team,
    count(*) OVER {f} AS n,
    CAST(sum(points) OVER {f} AS INTEGER) AS s_pts,
    sum(scored) OVER {f} AS s_sc, count(scored) OVER {f} AS c_sc, avg(scored) OVER {f} AS a_sc,
    count(conceded) OVER {f} AS c_co, avg(conceded) OVER {f} AS a_co,
    avg(shots) OVER {f} AS a_shots, sum(sot) OVER {f} AS s_sot,
    avg(corners) OVER {f} AS a_corners, avg(fouls) OVER {f} AS a_fouls,
    avg(yellows) OVER {f} AS a_yellows, avg(reds) OVER {f} AS a_reds,
    avg(clean_sheet) OVER {f} AS a_cs, avg(scored_any) OVER {f} AS a_sa,
    avg(goal_diff) OVER {f} AS a_gd, count(goal_diff) OVER {f} AS c_gd,
    avg(xg) OVER {f} AS a_xg, count(xg) OVER {f} AS c_xg,
    avg(xga) OVER {f} AS a_xga, count(xga) OVER {f} AS c_xga,
    avg(xg_overperf) OVER {f} AS a_xgo, count(xg_overperf) OVER {f} AS c_xgo,
    avg(npxg) OVER {f} AS a_npxg, count(npxg) OVER {f} AS c_npxg,
    avg(ppda) OVER {f} AS a_ppda, count(ppda) OVER {f} AS c_ppda,
    avg(deep) OVER {f} AS a_deep, count(deep) OVER {f} AS c_deep,
    avg(xpts) OVER {f} AS a_xpts, count(xpts) OVER {f} AS c_xpts,
    avg(fw) OVER {f} AS a_fw, count(fw) OVER {f} AS c_fw,
    avg(fd) OVER {f} AS a_fd, count(fd) OVER {f} AS c_fd,
    avg(fl) OVER {f} AS a_fl, count(fl) OVER {f} AS c_fl
  FROM {source}
)"""


# metric expressions over a roll CTE's columns (n = rows in frame)
_CONV = "(CASE WHEN s_sot > 0 THEN (CASE WHEN c_sc < n THEN NULL ELSE s_sc / CAST(s_sot AS DOUBLE) END) ELSE 0.0 END)"
_PROXY = f"((s_sot / CAST(n AS DOUBLE)) * {_CONV})"
_RXG = f"(CASE WHEN c_xg > 0 THEN a_xg ELSE {_PROXY} END)"
_RXGA = f"(CASE WHEN c_xga > 0 THEN a_xga ELSE {_PROXY} END)"


def _e(expr: str) -> str:
    return f"CASE WHEN n = 0 THEN 0.0 ELSE {expr} END"


METRIC_SQL = {
    "form_points": "CAST(CASE WHEN n = 0 THEN 0 ELSE s_pts END AS INTEGER)",
    "avg_goals_scored": _e("CASE WHEN c_sc < n THEN NULL ELSE a_sc END"),
    "avg_goals_conceded": _e("CASE WHEN c_co < n THEN NULL ELSE a_co END"),
    "avg_goal_diff": _e("CASE WHEN c_gd < n THEN NULL ELSE a_gd END"),
    "avg_shots": _e("a_shots"),
    "avg_sot": _e("s_sot / CAST(n AS DOUBLE)"),
    "avg_corners": _e("a_corners"), "avg_fouls": _e("a_fouls"),
    "avg_yellows": _e("a_yellows"), "avg_reds": _e("a_reds"),
    "clean_sheet_pct": _e("a_cs"), "scoring_pct": _e("a_sa"),
    "shot_conversion": _e(_CONV),
    "xg_proxy": _e(_PROXY),
    "avg_real_xg": _e(_RXG),
    "avg_real_xga": _e(_RXGA),
    "xg_overperf": _e("CASE WHEN c_xgo > 0 THEN a_xgo ELSE 0.0 END"),
    "avg_npxg": _e(f"CASE WHEN c_npxg > 0 THEN a_npxg ELSE {_RXG} END"),
    "avg_ppda": _e("CASE WHEN c_ppda > 0 THEN a_ppda ELSE 10.0 END"),
    "avg_deep": _e("CASE WHEN c_deep > 0 THEN a_deep ELSE 5.0 END"),
    "avg_xpts": _e(f"CASE WHEN c_xpts > 0 THEN a_xpts WHEN {_RXG} > {_RXGA} THEN 1.3 ELSE 1.0 END"),
    "avg_forecast_w": _e("CASE WHEN c_fw > 0 THEN a_fw ELSE 0.33 END"),
    "avg_forecast_d": _e("CASE WHEN c_fd > 0 THEN a_fd ELSE 0.33 END"),
    "avg_forecast_l": _e("CASE WHEN c_fl > 0 THEN a_fl ELSE 0.33 END"),
}


def pivot_sql(src: str, cols: list[str], diffs: list[tuple[str, str]] = ()) -> str:
    """SELECT joining the home and away rows of ``src`` per match."""
    sel = ["h.match_id AS match_id"]
    for c in cols:
        sel += [f"h.{c} AS home_{c}", f"a.{c} AS away_{c}"]
    for out, c in diffs:
        sel.append(f"h.{c} - a.{c} AS {out}")
    return (f"SELECT {', '.join(sel)} FROM {src} h JOIN {src} a "
            f"ON h.match_id = a.match_id AND h.side = 'h' AND a.side = 'a'")


def side_metrics_sql(metrics: dict[str, str], w: int = 5, part: str = "pool, team",
                     diffs: list[tuple[str, str]] = ()) -> str:
    """Full oracle: per-side metrics over a w-frame, pivoted per match.

    ``metrics`` maps output column -> METRIC_SQL key.
    """
    sel = ", ".join(f"{METRIC_SQL[k]} AS {out}" for out, k in metrics.items())
    body = (roll_sql("r", w, part) + f",\nm AS (SELECT match_id, side, {sel} FROM r)\n"
            + pivot_sql("m", list(metrics), list(diffs)))
    return with_tm(body)


def multi_metrics_sql(spec: dict[int, dict[str, str]], part: str = "pool, team",
                      diffs: list[tuple[str, str]] = ()) -> str:
    """Several frame lengths: ``spec`` maps w -> {output: METRIC_SQL key}."""
    ctes, sels, joins = [], [], []
    for i, (w, metrics) in enumerate(spec.items()):
        ctes.append(roll_sql(f"r{w}", w, part))
        sel = ", ".join(f"{METRIC_SQL[k]} AS {out}" for out, k in metrics.items())
        ctes.append(f"m{w} AS (SELECT match_id, side, {sel} FROM r{w})")
        sels += list(metrics)
        if i:
            first = next(iter(spec))
            joins.append(f"JOIN m{w} USING (match_id, side)")
    first = next(iter(spec))
    ctes.append(f"mm AS (SELECT * FROM m{first} {' '.join(joins)})")
    return with_tm(",\n".join(ctes) + "\n" + pivot_sql("mm", sels, list(diffs)))


STREAK_SQL = """
s1 AS (SELECT match_id, side, pool, team, res,
              row_number() OVER (PARTITION BY pool, team ORDER BY ts, match_id) AS rn FROM tmx),
s2 AS (SELECT *, rn - row_number() OVER (PARTITION BY pool, team, res ORDER BY rn) AS grp FROM s1),
s3 AS (SELECT *, row_number() OVER (PARTITION BY pool, team, res, grp ORDER BY rn) AS runlen FROM s2),
s4 AS (SELECT match_id, side, lag(res) OVER (PARTITION BY pool, team ORDER BY rn) AS pres,
              lag(runlen) OVER (PARTITION BY pool, team ORDER BY rn) AS plen FROM s3),
sk AS (SELECT match_id, side,
              CAST(CASE WHEN pres IS NULL OR pres = 0 THEN 0 ELSE pres * least(plen, {w}) END AS INTEGER)
              AS streak FROM s4)"""


def streak_sql(w: int = 5) -> str:
    return with_tm(STREAK_SQL.format(w=w) + "\n" + pivot_sql("sk", ["streak"], [("streak_diff", "streak")]))


SEASON_SQL = """
sh AS (
  SELECT match_id, side, ts,
    CAST(coalesce(sum(points) OVER ws, 0) AS INTEGER) AS season_pts,
    coalesce(sum(CASE WHEN points = 3 THEN 1 ELSE 0 END) OVER ws, 0) AS wins,
    coalesce(count(*) OVER ws, 0) AS games,
    lag(ts) OVER (PARTITION BY pool, team ORDER BY ts, match_id) AS prev_ts
  FROM tmx
  WINDOW ws AS (PARTITION BY pool, team, season ORDER BY ts, match_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
shx AS (
  SELECT match_id, side, season_pts,
    CASE WHEN games > 0 THEN wins / CAST(games AS DOUBLE) ELSE 0.33 END AS team_season_win_rate,
    CAST(CASE WHEN prev_ts IS NULL THEN 7
              ELSE floor((epoch(ts) - epoch(prev_ts)) / 86400.0) END AS INTEGER) AS rest_days
  FROM sh
)"""


def season_sql(cols: list[str], diffs: list[tuple[str, str]] = ()) -> str:
    return with_tm(SEASON_SQL + "\n" + pivot_sql("shx", cols, list(diffs)))


H2H_SQL = """
hh AS (
  SELECT match_id, count(*) OVER wp AS n,
         avg(CASE WHEN ftr = 'H' THEN 1 ELSE 0 END) OVER wp AS hw,
         avg(CASE WHEN ftr = 'D' THEN 1 ELSE 0 END) OVER wp AS dr
  FROM contest
  WINDOW wp AS (PARTITION BY pool, home, away ORDER BY ts, match_id
                ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)
),
h2h AS (
  SELECT match_id, CASE WHEN n = 0 THEN 0.5 ELSE hw END AS h2h_home_win_rate,
         CASE WHEN n = 0 THEN 0.27 ELSE dr END AS h2h_draw_rate
  FROM hh
)"""

# Elo as a recursive CTE carrying three MAP states per pool.
ELO_SQL = """
seq AS (SELECT pool, row_number() OVER (PARTITION BY pool ORDER BY ts, match_id) AS rn,
               match_id, home, away,
               CASE ftr WHEN 'H' THEN 1.0e0 WHEN 'A' THEN 0.0e0 ELSE 0.5e0 END AS sh
        FROM contest),
elo_rec AS (
  SELECT pool, rn, match_id, rh, ra, rhh, raa,
         MAP {home: rh + 20 * (sh - eh), away: ra + 20 * ((1 - sh) - (1 - eh))} AS m_all,
         MAP {home: rhh + 24 * (sh - ehh)} AS m_home,
         MAP {away: raa + 16 * ((1 - sh) - (1 - ehh))} AS m_away
  FROM (SELECT *, 1500.0e0 AS rh, 1500.0e0 AS ra, 1500.0e0 AS rhh, 1500.0e0 AS raa,
               0.5e0 AS eh, 0.5e0 AS ehh FROM seq WHERE rn = 1) b
  UNION ALL
  SELECT pool, rn, match_id, rh, ra, rhh, raa,
         map_concat(m_all, MAP {home: rh + 20 * (sh - eh), away: ra + 20 * ((1 - sh) - (1 - eh))}),
         map_concat(m_home, MAP {home: rhh + 24 * (sh - ehh)}),
         map_concat(m_away, MAP {away: raa + 16 * ((1 - sh) - (1 - ehh))})
  FROM (
    SELECT y.*, 1 / (1 + pow(10, (ra - rh) / 400)) AS eh, 1 / (1 + pow(10, (raa - rhh) / 400)) AS ehh
    FROM (
      SELECT s.pool, s.rn, s.match_id, s.home, s.away, s.sh,
             coalesce(r.m_all[s.home], 1500.0e0) AS rh, coalesce(r.m_all[s.away], 1500.0e0) AS ra,
             coalesce(r.m_home[s.home], 1500.0e0) AS rhh, coalesce(r.m_away[s.away], 1500.0e0) AS raa,
             r.m_all, r.m_home, r.m_away
      FROM elo_rec r JOIN seq s ON s.pool = r.pool AND s.rn = r.rn + 1
    ) y
  ) x
),
elo AS (
  SELECT match_id, rh AS home_elo, ra AS away_elo, rh - ra AS elo_diff,
         rhh AS home_elo_home, raa AS away_elo_away, rhh - raa AS venue_elo_diff
  FROM elo_rec
)"""


def elo_sql(cols: list[str]) -> str:
    return "WITH RECURSIVE " + CONTEST_SQL + ",\n" + ELO_SQL + f"\nSELECT match_id, {', '.join(cols)} FROM elo"


ODDS_SQL = """
odds AS (
  SELECT match_id,
    CASE WHEN odd_h > 0 AND odd_d > 0 AND odd_a > 0
         THEN (1 / odd_h) / ((1 / odd_h) + (1 / odd_d) + (1 / odd_a)) END AS b365_prob_h,
    CASE WHEN odd_h > 0 AND odd_d > 0 AND odd_a > 0
         THEN (1 / odd_d) / ((1 / odd_h) + (1 / odd_d) + (1 / odd_a)) END AS b365_prob_d,
    CASE WHEN odd_h > 0 AND odd_d > 0 AND odd_a > 0
         THEN (1 / odd_a) / ((1 / odd_h) + (1 / odd_d) + (1 / odd_a)) END AS b365_prob_a,
    CASE WHEN avg_h > 0 AND avg_d > 0 AND avg_a > 0
         THEN (1 / avg_h) / ((1 / avg_h) + (1 / avg_d) + (1 / avg_a)) END AS avg_prob_h,
    CASE WHEN avg_h > 0 AND avg_d > 0 AND avg_a > 0
         THEN (1 / avg_d) / ((1 / avg_h) + (1 / avg_d) + (1 / avg_a)) END AS avg_prob_d,
    CASE WHEN avg_h > 0 AND avg_d > 0 AND avg_a > 0
         THEN (1 / avg_a) / ((1 / avg_h) + (1 / avg_d) + (1 / avg_a)) END AS avg_prob_a
  FROM contest
)"""

FEATURE_SIDE_5 = ["form_points", "avg_goals_scored", "avg_goals_conceded", "avg_goal_diff",
                  "avg_shots", "avg_sot", "xg_proxy", "shot_conversion", "avg_real_xg",
                  "avg_real_xga", "xg_overperf", "avg_npxg", "avg_ppda", "avg_deep", "avg_xpts",
                  "avg_forecast_w", "avg_corners", "avg_fouls", "avg_yellows", "avg_reds",
                  "clean_sheet_pct", "scoring_pct"]


def features_sql(id_cols: list[str], numeric_cols: list[str], odds_cols: list[str],
                 diffs: list[tuple[str, str, str]]) -> str:
    """The whole feature table as one SQL statement (recursive for Elo)."""
    ctes = [CONTEST_SQL, ENRICH_SQL, TM_SQL]
    ctes.append(roll_sql("r5", 5))
    ctes.append("m5 AS (SELECT match_id, side, "
                + ", ".join(f"{METRIC_SQL[c]} AS {c}" for c in FEATURE_SIDE_5) + " FROM r5)")
    ctes.append(roll_sql("rv", 5, "pool, team, side"))
    ctes.append("mv AS (SELECT match_id, side, " + ", ".join(
        f"{METRIC_SQL[k]} AS {o}" for o, k in (("venue_form", "form_points"),
                                                ("venue_scored", "avg_goals_scored"),
                                                ("venue_conceded", "avg_goals_conceded"),
                                                ("venue_xg", "xg_proxy"))) + " FROM rv)")
    for w in (3, 10, 19):
        ctes.append(roll_sql(f"r{w}", w))
        ctes.append(f"m{w} AS (SELECT match_id, side, {METRIC_SQL['form_points']} AS form_pts_w{w}, "
                    f"{METRIC_SQL['avg_real_xg']} AS avg_xg_w{w}, "
                    f"{METRIC_SQL['avg_ppda']} AS avg_ppda_w{w} FROM r{w})")
    ctes.append(STREAK_SQL.format(w=5).strip())
    ctes.append(SEASON_SQL.strip())
    ctes.append("side_all AS (SELECT * FROM m5 JOIN mv USING (match_id, side) "
                "JOIN m3 USING (match_id, side) JOIN m10 USING (match_id, side) "
                "JOIN m19 USING (match_id, side) JOIN sk USING (match_id, side) "
                "JOIN shx USING (match_id, side))")
    side_cols = (FEATURE_SIDE_5 + ["venue_form", "venue_scored", "venue_conceded", "venue_xg",
                                   "streak", "season_pts", "team_season_win_rate", "rest_days"]
                 + [f"{p}_w{w}" for w in (3, 10, 19) for p in ("form_pts", "avg_xg", "avg_ppda")])
    ctes.append("piv AS (" + pivot_sql("side_all", side_cols) + ")")
    ctes.append(H2H_SQL.strip())
    ctes.append(ELO_SQL.strip())
    ctes.append(ODDS_SQL.strip())
    diff_map = {o: f"(piv.{h} - piv.{a})" for o, h, a in diffs}
    special = {
        "is_weekend": "CAST(CASE WHEN isodow(c.ts) >= 6 THEN 1 ELSE 0 END AS INTEGER)",
        "month": "CAST(month(c.ts) AS INTEGER)",
    }
    elo_cols = {"home_elo", "away_elo", "elo_diff", "home_elo_home", "away_elo_away", "venue_elo_diff"}
    sel = [f"c.{c} AS {c}" for c in id_cols]
    for col in numeric_cols:
        if col in diff_map:
            sel.append(f"{diff_map[col]} AS {col}")
        elif col in special:
            sel.append(f"{special[col]} AS {col}")
        elif col in elo_cols:
            sel.append(f"elo.{col} AS {col}")
        elif col.startswith("h2h_"):
            sel.append(f"h2h.{col} AS {col}")
        else:
            sel.append(f"piv.{col} AS {col}")
    sel += [f"odds.{c} AS {c}" for c in odds_cols]
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\nSELECT " + ",\n  ".join(sel)
            + "\nFROM contest c JOIN piv USING (match_id) JOIN h2h USING (match_id) "
              "JOIN elo USING (match_id) JOIN odds USING (match_id)")


FEED_SQL = """
names AS (SELECT n.n_nationkey AS k,
                 CASE WHEN r.r_name LIKE 'A%' THEN n.n_name ELSE lower(n.n_name) END AS title
          FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
mx AS (SELECT c.*, e.npxg_h, e.npxg_a, e.ppda_h, e.ppda_a, e.deep_h, e.deep_a, e.xpts_h, e.xpts_a,
              e.fc_w, e.fc_d, e.fc_l,
              c.pool || '/' || strftime(c.ts, '%Y-%m-%d') || '/' || CAST(c.match_id // 100000 AS VARCHAR) AS doc_id
       FROM contest c JOIN enrich e ON e.src_id = c.match_id),
ent AS (SELECT doc_id, match_id, home AS team, coalesce(npxg_h, 0.0) AS npxg, coalesce(ppda_h, 0.0) AS ppda,
               deep_h AS deep, xpts_h AS xpts FROM mx
        UNION ALL
        SELECT doc_id, match_id, away, coalesce(npxg_a, 0.0), coalesce(ppda_a, 0.0), deep_a, xpts_a FROM mx),
last AS (SELECT * EXCLUDE (rn) FROM (
           SELECT *, row_number() OVER (PARTITION BY doc_id, team ORDER BY match_id DESC) AS rn FROM ent)
         WHERE rn = 1)"""


def feed_sql(select: str) -> str:
    return f"WITH {CONTEST_SQL},\n{ENRICH_SQL},\n{FEED_SQL}\n{select}"
