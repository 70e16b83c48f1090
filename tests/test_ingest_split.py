"""Season-file ingest, splits and folds."""

from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from duelframe.operators.split import cv_folds, cv_long, temporal_split
from duelframe.sources.seasons import load_season_dir, to_contests


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_mixed_headers_and_bad_dates(spark):
    d = tempfile.mkdtemp(prefix="duelframe-csv-")
    _write(os.path.join(d, "E0_2021.csv"),
           "﻿Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR,HS\n13/08/2021,A,B,2,1,H,9\n99/99/2020,A,C,1,1,D,3\n")
    _write(os.path.join(d, "E0_2022.csv"),
           "Date,HomeTeam,AwayTeam,HS,FTHG,FTAG,FTR,B365H\n14/08/22,B,A,12,0,0,D,2.5\n15/08/22,C,A,4,1,,A,\n")
    _write(os.path.join(d, "understat_raw.csv"), "date,home_team\n2021-08-13,A\n")
    raw = load_season_dir(spark, d)
    assert set(raw.columns) >= {"Date", "FTR", "HS", "B365H", "source_file"}
    c = {r.home + r.away: r for r in to_contests(raw).collect()}
    assert len(c) == 3  # bad date dropped, no exception
    assert c["AB"].hs == 9 and c["AB"].ftr == "H" and c["AB"].season == "E0_2021.csv"
    assert c["BA"].hs == 12 and c["BA"].ftr == "D" and c["BA"].odd_h == 2.5
    assert str(c["BA"].ts.date()) == "2022-08-14"
    assert c["CA"].ag is None  # goals are not in the drop list
    bad = to_contests(raw, keep_bad=True).collect()
    assert len(bad) == 1


def test_missing_required_column_raises(spark):
    d = tempfile.mkdtemp(prefix="duelframe-csv-")
    _write(os.path.join(d, "x.csv"), "Date,HomeTeam,AwayTeam,FTR\n13/08/2021,A,B,H\n")
    with pytest.raises(ValueError, match="FTHG"):
        load_season_dir(spark, d)


def _fourteen(spark):
    return spark.createDataFrame([(i, f"2021-08-{i + 1:02d}") for i in range(14)], "match_id long, d string") \
        .withColumn("ts", F.col("d").cast("timestamp_ntz"))


def test_temporal_split_fourteen(spark):
    s = {r.match_id: r for r in temporal_split(_fourteen(spark)).collect()}
    assert [s[i].role for i in range(14)] == ["train"] * 11 + ["test"] * 3
    assert [s[i].row_idx for i in range(14)] == list(range(14))


def test_expanding_cv_fourteen(spark):
    s = temporal_split(_fourteen(spark))
    f = {r.match_id: r for r in cv_folds(s).collect()}
    tests = {}
    for i, r in f.items():
        if r.test_fold is not None:
            tests.setdefault(r.test_fold, []).append(i)
    assert tests == {0: [4, 5], 1: [6, 7], 2: [8, 9], 3: [10, 11], 4: [12, 13]}
    long = cv_long(cv_folds(s)).where("fold = 2 AND role = 'train'").select("match_id").collect()
    assert sorted(r.match_id for r in long) == list(range(8))
