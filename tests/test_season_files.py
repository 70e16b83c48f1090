"""Season files as they come: headers, dates, repeated contests; scoring rows for fixtures."""

from __future__ import annotations

import pytest
from conftest import SF_SMALL
from duelframe.functions.calendar import parse_day_first
from duelframe.operators.enrich import enrich_left
from duelframe.operators.snapshot import fixture_rows
from duelframe.plans.features import BASE_NUMERIC_COLS, ODDS_COLS, build_features
from duelframe.registry import feature_table
from duelframe.sources.enrichment import merge_enrichment
from duelframe.sources.seasons import load_season_dir, to_contests
from pyspark.sql import functions as F


def _files(tmp_path, **files):
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_headers_with_blanks_quotes_and_repeats(spark, tmp_path):
    folder = _files(tmp_path, a='Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR,"x, y",,\n13/08/2021,A,B,1,0,H,"1, 2",,\n',
                    b="﻿FTR,Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR\nD,2021-08-14,B,A,2,2,x\n")
    got = to_contests(load_season_dir(spark, folder)).orderBy("ts").collect()
    assert [(str(r.ts)[:10], r.home, r.away, r.hg, r.ag, r.ftr) for r in got] == [
        ("2021-08-13", "A", "B", 1, 0, "H"), ("2021-08-14", "B", "A", 2, 2, "D")]


def test_date_texts(spark):
    texts = {"13/08/2021": "2021-08-13", "13/08/21": "2021-08-13", "2021-08-13": "2021-08-13", "13-08-2021": "2021-08-13",
             "13/08/2021 15:00": "2021-08-13", "2021-08-13T15:00:00": "2021-08-13", "4/3/95": "1995-03-04", "13/08/70": "1970-08-13",
             "1/1/68": "2068-01-01", "13.08.21": "2021-08-13", "31/02/2021": None, "soon": None, "": None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_day_first("t").cast("string").alias("d")).collect()
    assert {r.t: r.d for r in rows} == texts


def test_two_contests_of_a_pair_on_one_day(spark, tmp_path):
    folder = _files(tmp_path, s="Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR\n13/08/2021,A,B,1,0,H\n13/08/2021,A,B,0,2,A\n13/08/2021,A,B,0,2,A\n20/08/2021,A,B,1,1,D\n")
    contests = to_contests(load_season_dir(spark, folder))
    assert contests.select("match_id").distinct().count() == contests.count() == 4
    feats = build_features(contests).orderBy("ts", "match_id").collect()
    assert len(feats) == 4
    points = [{"H": 3, "D": 1, "A": 0}[r.ftr] for r in feats]
    assert [r.home_form_points for r in feats] == [sum(points[:i]) for i in range(4)]


def test_provider_columns(spark):
    contests = spark.createDataFrame([(1, "p", "A", "B", None, 0.5), (2, "p", "B", "A", 1.5, None)],
                                     "ts int, pool string, home string, away string, xg_h double, xg_a double")
    provider = spark.createDataFrame([(1, "p", "A", "B", 2.0, 9.0), (2, "p", "B", "A", 3.0, 8.0)], contests.schema)
    out = merge_enrichment(contests, provider, ["ts", "pool", "home", "away"]).orderBy("ts").collect()
    assert [(r.xg_h, r.xg_a) for r in out] == [(2.0, 0.5), (1.5, 8.0)]
    assert enrich_left(contests, provider, ["ts", "pool", "home", "away"], columns=[]).columns.count("xg_h") == 1


def test_fixture_rows_carry_every_model_input(spark):
    feats = feature_table(spark, SF_SMALL)
    some = feats.select("pool", "home", "away").distinct().orderBy("pool", "home", "away").limit(5)
    other = some.limit(1).select("pool", F.lit(-1).cast(feats.schema["home"].dataType).alias("home"), "away")
    rows = fixture_rows(some.unionAll(other), feats).collect()
    assert len(rows) == 6 and set(BASE_NUMERIC_COLS + ODDS_COLS) <= set(rows[0].asDict())
    new = next(r for r in rows if r.home == -1)
    assert (new.home_elo, new.home_form_points, new.h2h_home_win_rate, new.is_weekend) == (1500.0, 7.0, 0.5, 1.0)
    for r in rows:
        assert r.elo_diff == pytest.approx(r.home_elo - r.away_elo)
        if r.home != -1:
            last = feats.where((F.col("pool") == r.pool) & (F.col("home") == r.home)).orderBy(F.desc("ts"), F.desc("match_id")).first()
            assert r.home_streak == last.home_streak and r.home_avg_xg_w19 == pytest.approx(last.home_avg_xg_w19)
    dated = some.withColumns({"ts": F.lit("2024-05-01").cast("timestamp_ntz"), "b365_prob_h": F.lit(0.4)})
    assert {(r.is_weekend, r.month, r.b365_prob_h) for r in fixture_rows(dated, feats).collect()} == {(0.0, 5.0, 0.4)}
