"""Hand-computed cases (FIXTURES.md §6) for each operator family."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import make_contests
from duelframe.functions.calendar import is_weekend, month, whole_days
from duelframe.functions.odds import implied_probs
from duelframe.operators.elo import elo_ratings
from duelframe.operators.enrich import enrich_left
from duelframe.plans.features import build_features


def _feat(spark, rows, **kw):
    return {r["match_id"]: r.asDict() for r in build_features(make_contests(spark, rows), materialize=False, **kw).collect()}


def test_elo_first_match(spark):
    c = make_contests(spark, [
        dict(ts="2021-08-13", home="A", away="B", hg=1, ag=0, ftr="H"),
        dict(ts="2021-08-20", home="A", away="B", hg=0, ag=0, ftr="D"),
    ])
    e = {r.match_id: r for r in elo_ratings(c).collect()}
    assert (e[1].home_elo, e[1].away_elo) == (1500.0, 1500.0)
    assert e[2].home_elo == pytest.approx(1510.0) and e[2].away_elo == pytest.approx(1490.0)
    assert e[2].home_elo_home == pytest.approx(1512.0) and e[2].away_elo_away == pytest.approx(1492.0)


def test_elo_unknown_outcome_is_no_change_and_zero_points(spark):
    rows = [dict(ts="2021-08-13", home="A", away="B", hg=1, ag=1, ftr="X"),
            dict(ts="2021-08-20", home="A", away="B", hg=0, ag=0, ftr="D")]
    e = {r.match_id: r for r in elo_ratings(make_contests(spark, rows)).collect()}
    assert e[2].home_elo == pytest.approx(1500.0) and e[2].away_elo == pytest.approx(1500.0)
    f = _feat(spark, rows)
    assert f[2]["home_form_points"] == 0 and f[2]["away_form_points"] == 0


def test_odds(spark):
    df = spark.createDataFrame([(2.0, 4.0, 4.0), (2.0, None, 4.0), (0.0, 3.0, 3.0)], "h double, d double, a double")
    ph, pd_, pa = implied_probs("h", "d", "a")
    got = [tuple(r) for r in df.select(ph, pd_, pa).collect()]
    assert got[0] == pytest.approx((0.5, 0.25, 0.25))
    assert got[1] == (None, None, None)
    assert got[2] == (None, None, None)


def test_empty_history_defaults(spark):
    f = _feat(spark, [dict(ts="2021-08-13", home="A", away="B", hg=1, ag=0, ftr="H")])[1]
    for c in ("home_form_points", "home_avg_goals_scored", "home_avg_ppda", "home_avg_real_xg",
              "home_streak", "home_venue_form", "home_avg_xg_w19", "home_avg_forecast_w"):
        assert f[c] == 0
    assert f["home_rest_days"] == 7 and f["away_rest_days"] == 7
    assert f["home_team_season_win_rate"] == pytest.approx(0.33)
    assert f["h2h_home_win_rate"] == 0.5 and f["h2h_draw_rate"] == 0.27


def test_history_without_enrichment(spark):
    rows = [dict(ts="2021-08-13", home="A", away="B", hg=2, ag=0, ftr="H", hst=4, ast_=1),
            dict(ts="2021-08-20", home="A", away="C", hg=0, ag=0, ftr="D")]
    f = _feat(spark, rows)[2]
    assert f["home_xg_proxy"] == pytest.approx(2.0)
    assert f["home_avg_real_xg"] == pytest.approx(2.0)
    assert f["home_avg_real_xga"] == pytest.approx(2.0)
    assert f["home_avg_npxg"] == pytest.approx(2.0)
    assert f["home_avg_ppda"] == 10.0 and f["home_avg_deep"] == 5.0
    assert f["home_avg_xpts"] == 1.0 and f["home_avg_forecast_w"] == pytest.approx(0.33)


def test_history_sot_zero(spark):
    rows = [dict(ts="2021-08-13", home="A", away="B", hg=1, ag=0, ftr="H", hst=0),
            dict(ts="2021-08-20", home="A", away="C", hg=0, ag=0, ftr="D")]
    f = _feat(spark, rows)[2]
    assert f["home_shot_conversion"] == 0 and f["home_xg_proxy"] == 0


@pytest.mark.parametrize("results,expected", [("WWLWW", 2), ("WWD", 0), ("WLL", -2)])
def test_streak(spark, results, expected):
    rows = []
    for i, r in enumerate(results):
        ftr = {"W": "H", "L": "A", "D": "D"}[r]
        rows.append(dict(ts=f"2021-08-{10 + i:02d}", home="A", away=f"O{i}", hg=1, ag=1, ftr=ftr))
    rows.append(dict(ts="2021-09-01", home="A", away="Z", hg=0, ag=0, ftr="D"))
    f = _feat(spark, rows)[len(rows)]
    assert f["home_streak"] == expected


def test_rest_and_calendar(spark):
    df = spark.createDataFrame([("2021-08-13 00:00:00", "2021-08-21 00:00:00"),
                                ("2021-08-13 23:00:00", "2021-08-14 01:00:00")], "a string, b string") \
        .select(F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    got = [r[0] for r in df.select(whole_days("a", "b")).collect()]
    assert got == [8, 0]
    r = df.select(is_weekend(F.lit("2021-08-14").cast("date")).alias("w"), month(F.lit("2021-08-14").cast("date")).alias("m")).first()
    assert (r.w, r.m) == (1, 8)


def test_ordered_h2h(spark):
    rows = [dict(ts="2021-08-13", home="A", away="B", hg=1, ag=0, ftr="H"),
            dict(ts="2021-08-20", home="B", away="A", hg=0, ag=0, ftr="D")]
    f = _feat(spark, rows)[2]
    assert f["h2h_home_win_rate"] == 0.5 and f["h2h_draw_rate"] == 0.27


def test_season_reset_keeps_rolling_and_elo(spark):
    rows = [dict(ts="2021-08-13", home="A", away="B", hg=1, ag=0, ftr="H", season="s1"),
            dict(ts="2022-08-13", home="A", away="B", hg=1, ag=0, ftr="H", season="s2")]
    f = _feat(spark, rows)[2]
    assert f["home_season_pts"] == 0 and f["home_team_season_win_rate"] == pytest.approx(0.33)
    assert f["home_form_points"] == 3 and f["home_elo"] == pytest.approx(1510.0)


def test_duplicate_enrichment_key_keeps_count(spark):
    c = make_contests(spark, [dict(ts="2021-08-13", home="A", away="B", hg=1, ag=0, ftr="H")])
    e = spark.createDataFrame([("p", "2021-08-13", "A", "B", 1.0, 1), ("p", "2021-08-13", "A", "B", 2.0, 2)],
                              "pool string, d string, home string, away string, npxg_h double, src int") \
        .withColumn("ts", F.col("d").cast("timestamp_ntz")).drop("d")
    out = enrich_left(c, e, ["pool", "ts", "home", "away"], tie="src").collect()
    assert len(out) == 1 and out[0].npxg_h == 2.0


def test_symmetric_h2h(spark):
    from duelframe.operators.history import head_to_head
    c = make_contests(spark, [dict(ts="2021-08-13", home="A", away="B", hg=1, ag=0, ftr="H"),
                              dict(ts="2021-08-20", home="B", away="A", hg=0, ag=0, ftr="D"),
                              dict(ts="2021-08-27", home="B", away="A", hg=0, ag=1, ftr="A")])
    h = {r.match_id: r for r in head_to_head(c, symmetric=True).collect()}
    assert h[2].h2h_home_win_rate == 0.0 and h[2].h2h_draw_rate == 0.0  # B lost the only meeting
    assert h[3].h2h_home_win_rate == 0.0 and h[3].h2h_draw_rate == 0.5
    o = {r.match_id: r for r in head_to_head(c).collect()}
    assert o[2].h2h_home_win_rate == 0.5 and o[3].h2h_draw_rate == 1.0
