"""Enrichment file merge, feed files, sinks and name standardisation."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import functions as F

from conftest import make_contests
from duelframe.functions.names import name_map_table, standardize_names
from duelframe.operators.snapshot import latest_snapshot
from duelframe.plans.features import build_features, feature_columns
from duelframe.plans.training import ordinal_encode
from duelframe.sources.artifacts import load_feature_table, load_results, save_entities, save_feature_table, save_results
from duelframe.sources.enrichment import merge_enrichment, read_enrichment
from duelframe.sources.feed import cut_feed, feed_enrichment, finished_match_rows, flatten_team_history, parse_feed, read_feed_files, write_enrichment


def test_enrichment_file_absent_and_present(spark):
    c = make_contests(spark, [dict(ts="2021-08-13", home="Man City", away="Leeds", hg=1, ag=0, ftr="H")])
    d = tempfile.mkdtemp(prefix="duelframe-enr-")
    missing = merge_enrichment(c, read_enrichment(spark, os.path.join(d, "understat_raw.csv")))
    assert missing.count() == 1 and missing.first().npxg_h is None
    p = os.path.join(d, "understat_raw.csv")
    with open(p, "w") as f:
        f.write("date,home_team,away_team,us_home_xg,us_away_xg,us_home_npxg\n"
                "2021-08-13,Man City,Leeds,2.5,0.4,2.1\n2021-08-13,Man City,Leeds,2.5,0.4,2.2\n")
    e = read_enrichment(spark, p)
    out = merge_enrichment(c.drop("xg_h", "xg_a"), e).collect()
    assert len(out) == 1 and out[0].xg_h == 2.5 and out[0].npxg_h == 2.2


def test_feed_files_flatten_and_sink(spark):
    d = tempfile.mkdtemp(prefix="duelframe-feed-")
    doc = {"matches": [
        {"isResult": True, "datetime": "2021-08-13 20:00:00", "h": {"title": "Manchester City"},
         "a": {"title": "Leeds United"}, "xG": {"h": "2.5", "a": "0.4"}, "forecast": {"w": "0.7", "l": "0.1"}},
        {"isResult": False, "datetime": "2021-08-20 20:00:00", "h": {"title": "Leeds United"},
         "a": {"title": "Manchester City"}, "xG": {"h": "1", "a": "1"}},
        {"isResult": True, "datetime": "2021-08-21 20:00:00", "h": {"title": "Leeds United"},
         "a": {"title": "Everton"}, "xG": {"h": "oops", "a": "1"}}],
        "teams": {"1": {"title": "Manchester City", "history": [
            {"date": "2021-08-13 20:00:00", "ppda": {"att": "100", "def": "10"}, "xpts": "2.1", "npxG": "2.0", "deep": "9"},
            {"date": "2021-08-13 20:00:00", "ppda": {"att": "50"}, "xpts": "2.2", "npxG": "1.9", "deep": "8"}]},
            "2": {"title": "Leeds United", "history": [
                {"date": "2021-08-13 20:00:00", "xpts": "0.5", "deep": "2"}]}}}
    for season in (2021, 2022):
        with open(os.path.join(d, f"feed_{season}.json"), "w") as f:
            json.dump(doc if season == 2021 else {"matches": [], "teams": {}}, f)
    docs = read_feed_files(spark, [os.path.join(d, "feed_2021.json"), os.path.join(d, "feed_2022.json")])
    out = feed_enrichment(parse_feed(docs), ["doc_id"], name_map_table(spark)).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.home_team, r.away_team) == ("Man City", "Leeds")
    assert r.us_home_ppda == 50.0 and r.us_home_xpts == 2.2  # later entry overwrites; def -> 1
    assert r.us_away_ppda == 0.0 and r.us_away_npxg == 0.0  # missing ppda -> 0/1 -> 0
    assert (r.us_forecast_w, r.us_forecast_d, r.us_forecast_l) == (0.7, 0.0, 0.1)
    target = os.path.join(d, "out")
    assert write_enrichment(spark.createDataFrame(out), target)
    assert not write_enrichment(spark.createDataFrame(out).limit(0), os.path.join(d, "none"))
    assert spark.read.parquet(target).count() == 1


def test_name_map_pass_through(spark):
    df = spark.createDataFrame([("Manchester United",), ("Arsenal",)], "t string")
    got = sorted(r.t for r in standardize_names(df, "t", name_map_table(spark)).collect())
    assert got == ["Arsenal", "Man United"]


def test_feature_sink_round_trip_and_snapshot(spark):
    rows = [dict(ts=f"2021-08-{10 + i:02d}", home="A" if i % 2 == 0 else "B",
                 away="B" if i % 2 == 0 else "A", hg=i % 3, ag=1, ftr="H" if i % 3 == 2 else "A" if i % 3 == 0 else "D")
            for i in range(6)]
    f = build_features(make_contests(spark, rows), materialize=False)
    d = tempfile.mkdtemp(prefix="duelframe-sink-")
    save_feature_table(f, os.path.join(d, "features"))
    back = load_feature_table(spark, os.path.join(d, "features"))
    assert back.count() == 6 and set(feature_columns()[0]) <= set(back.columns)
    assert load_feature_table(spark, os.path.join(d, "nothing")).count() == 0
    save_entities(f, os.path.join(d, "teams"))
    assert sorted(r.team for r in spark.read.parquet(os.path.join(d, "teams")).collect()) == ["A", "B"]
    snap = {(r.team, r.venue): r for r in latest_snapshot(back).collect()}
    assert set(snap) == {("A", "home"), ("A", "away"), ("B", "home"), ("B", "away")}


def test_results_round_trip_and_absent(spark):
    base = tempfile.mkdtemp()
    absent = load_results(spark, os.path.join(base, "absent"))
    assert absent.columns == ["model", "test_acc", "cv_mean"] and absent.count() == 0
    rows = [("a", 0.4, 0.5, 0.1), ("b", 0.6, 0.3, 0.2)]
    save_results(spark.createDataFrame(rows, "model string, test_acc double, cv_mean double, cv_std double"), f"{base}/r")
    assert [tuple(r) for r in load_results(spark, f"{base}/r").collect()] == [rows[1], rows[0]]


def test_ordinal_encode_unseen(spark):
    fit = spark.createDataFrame([("b",), ("a",)], "t string")
    df = spark.createDataFrame([("a",), ("b",), ("z",)], "t string")
    got = {r.t: r.t_ord for r in ordinal_encode(df, ["t"], fit_on=fit).collect()}
    assert got == {"a": 0, "b": 1, "z": -1}


def _large_feed(seed, spaces):
    import random
    r = random.Random(seed)
    names = [f"Team {k}" for k in range(12)] + ['Quo"ted \\\\ é', "Empty", "Single"]

    def entry():
        e = {"date": f"2021-0{r.randrange(1, 10)}-{r.randrange(10, 29)} 20:00:00", "ppda": {"att": str(r.randrange(300)), "def": str(r.randrange(20))},
             "xpts": str(r.random()), "npxG": r.choice(["0.5", "n/a", None]), "deep": str(r.randrange(9))}
        return {k: v for k, v in e.items() if r.random() > 0.1 or k == "date"}

    def match():
        m = {"isResult": r.random() > 0.1, "datetime": f"2021-0{r.randrange(1, 10)}-{r.randrange(10, 29)} 20:00:00", "h": {"title": r.choice(names)},
             "a": {"title": r.choice(names)}, "xG": {"h": str(r.random()), "a": r.choice(["1", "oops"])}}
        return m | ({"forecast": {"w": "0.5", "l": "0.2"}} if r.random() > 0.3 else {})

    teams = {str(k): {"title": n, "history": [entry() for _ in range(0 if n == "Empty" else 1 if n == "Single" else r.randrange(2, 40))]} for k, n in enumerate(names)}
    doc = {"matches": [match() for _ in range(200)], "teams": teams}
    if seed % 2:
        doc = dict(reversed(doc.items()))
    return json.dumps(doc, ensure_ascii=False, separators=(", ", ": ") if spaces else (",", ":"))


def test_one_large_document_is_cut_into_many_tasks(spark):
    d = tempfile.mkdtemp(prefix="duelframe-large-")
    for spaces in (False, True):
        paths = [os.path.join(d, f"{spaces}-{seed}.json") for seed in (1, 2)] + [os.path.join(d, f"{spaces}-none.json")]
        for path, text in zip(paths, (_large_feed(1, spaces), _large_feed(2, spaces), '{"matches":[],"teams":{}}'), strict=True):
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)
        whole = parse_feed(read_feed_files(spark, paths))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            cut = cut_feed(spark, paths, "}, {" if spaces else "},{")
            assert spark.read.option("lineSep", "},{").text(paths).rdd.getNumPartitions() > 15
            results = [[sorted(map(repr, f(feed).collect())) for f in (lambda x: finished_match_rows(x).drop("pos"), flatten_team_history, feed_enrichment)]
                       for feed in (whole, cut)]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert results[0] == results[1] and all(len(x) > 50 for x in results[0])
