"""Work that must not grow faster than its rows: tasks of bounded size, narrow merges, one collection a document."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from duelframe.operators import sequence, snapshot
from duelframe.operators.rolling import ALL_METRICS, read_columns, rolling
from duelframe.operators.unpivot import entries, repivot
from pyspark.sql import functions as F

from conftest import make_contests


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranges_and_tasks_hold_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(sequence, "ROWS", 50)
    t0 = datetime(2020, 1, 1)
    rows = [{"ts": t0 + timedelta(hours=i), "home": "hot", "away": f"b{i % 40}", "hg": i % 3, "ag": 1, "ftr": "HDA"[i % 3]} for i in range(400)]
    tm = entries(make_contests(spark, rows))
    laid = sequence.in_ranges(tm, ["pool", "team"], counted=True)
    sizes = [r["count"] for r in laid.groupBy("_range").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 150 and sum(sizes) == 800
    assert sequence.with_halo(laid, [(["pool", "team"], 5)]).rdd.getNumPartitions() == 16
    small = rolling(tm, {5: ["form_points"]}).select("match_id", "side", "form_points").collect()
    monkeypatch.setattr(sequence, "ROWS", 10**6)
    assert sorted(small) == sorted(rolling(tm, {5: ["form_points"]}).select("match_id", "side", "form_points").collect())


def test_columns_read_make_every_metric(spark):
    rows = [{"ts": f"2020-01-{i + 1:02d}", "home": "ab"[i % 2], "away": "ba"[i % 2], "hg": i % 3, "ag": i % 2, "ftr": "HDA"[i % 3], "hst": i, "ast_": 2} for i in range(12)]
    tm = entries(make_contests(spark, rows))
    narrow = tm.select("match_id", "ts", "side", "pool", "team", *read_columns(ALL_METRICS))
    out = ["match_id", "side", *ALL_METRICS]
    assert sorted(map(str, rolling(narrow, {5: ALL_METRICS}).select(out).collect())) == sorted(map(str, rolling(tm, {5: ALL_METRICS}).select(out).collect()))
    assert read_columns(["avg_ppda"]) == ["ppda"]


def test_repivot_does_not_sort_before_the_exchange(spark):
    df = spark.range(50).select((F.col("id") / 2).cast("long").alias("match_id"), F.when(F.col("id") % 2 == 0, "h").otherwise("a").alias("side"), F.col("id").alias("v"))
    out = repivot(df, ["v"])
    text = plan(out)
    assert "Sort" not in text[text.index("Exchange"):]
    assert sorted(map(tuple, out.collect())) == [(i, 2 * i, 2 * i + 1) for i in range(25)]


@pytest.mark.parametrize("null", [False, True])
def test_last_rows_only(spark, null):
    t = datetime(2020, 1, 1)
    rows = [("p", "a", t, 1, 1.0), ("p", "a", t + timedelta(1), 2, 2.0), ("p", "a", t + timedelta(1), 3, 3.0), (None, "a", t, 4, 4.0), ("p", "b", None, 5, 5.0),
            ("p", "b", None, None if null else 4, 6.0)]
    df = spark.createDataFrame(rows, "pool string, home string, ts timestamp_ntz, match_id long, x double")
    got = snapshot._last_rows(df, ["pool", "home"], ("ts", "match_id"))
    assert sorted(r["x"] for r in got.collect()) == [3.0, 4.0, 5.0]
    assert "SortAggregate" not in plan(got)


def test_asof_fixtures_carry_only_what_is_wanted(spark, monkeypatch):
    from duelframe.plans.features import build_features
    rows = [{"ts": f"2020-01-{i + 1:02d}", "home": "ab"[i % 2], "away": "ba"[i % 2], "hg": i % 3, "ag": i % 2, "ftr": "HDA"[i % 3]} for i in range(9)]
    feats = build_features(make_contests(spark, rows))
    fixtures = feats.select("match_id", "ts", "pool", "home", "away")
    wanted = ["home_elo", "elo_diff", "form_diff", "month", "h2h_draw_rate", "avg_prob_h"]
    carried, plain = [], snapshot.asof_latest
    monkeypatch.setattr(snapshot, "asof_latest", lambda left, right, keys, values: (carried.extend(values), plain(left, right, keys, values))[1])
    few = snapshot.fixture_rows(fixtures, feats, as_of=True, columns=wanted)
    assert sorted(carried) == sorted(["home_elo", "home_form_points", "away_elo", "away_form_points", "h2h_draw_rate"])
    every = snapshot.fixture_rows(fixtures, feats, as_of=True).select(few.columns)
    assert sorted(map(str, few.collect())) == sorted(map(str, every.collect()))


def test_feed_documents_read_the_lines_once(spark):
    from duelframe.sources.tables import feed_documents
    text = plan(feed_documents(spark, "/root/testdata/sf0.001"))
    assert "lineitem" not in text and text.lower().count("collect_list") <= 2


def files(folder):
    return [p for p in folder.rglob("*") if p.is_file()]


def test_ways_to_a_result_leave_no_files(spark, tmp_path):
    """Shuffle files go when a table is stored; tables stored on the way go when the result is."""
    import time
    from pathlib import Path

    from duelframe.session import SHUFFLE_CLEANUP, shared_folder, stored, stored_result
    shuffled = {p for block in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs() for p in files(Path(str(block)))}
    kept = set(files(Path(shared_folder(spark))))
    df = spark.range(20_000).withColumn("k", F.col("id") % 7000)

    def make():
        part = stored(df.repartition(3, "k"))
        inner = stored_result(spark, lambda: stored(part.repartition(5, "k")).groupBy("k").count())
        return part.join(inner, "k")

    out = stored_result(spark, make)
    assert out.count() == 20_000
    for _ in range(50):  # shuffle files are deleted behind the query
        left = {p for block in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs() for p in files(Path(str(block)))} - shuffled
        if not [p for p in left if p.name.startswith("shuffle_") and p.stat().st_size > 1000]:
            break
        time.sleep(0.1)
    else:
        raise AssertionError(left)
    folders = {p.parent for p in set(files(Path(shared_folder(spark)))) - kept}
    assert len(folders) == 1 and spark.conf.get(SHUFFLE_CLEANUP) == "false"


def test_feature_table_of_some_columns(spark, monkeypatch):
    """The same rows and values; ranges hold only what the columns are made of."""
    from duelframe.plans import features
    rows = [{"ts": f"2020-01-{i + 1:02d}", "home": "ab"[i % 2], "away": "ba"[i % 2], "hg": i % 3, "ag": i % 2, "ftr": "HDA"[i % 3], "hst": i, "xg_h": i / 2}
            for i in range(9)]
    c = make_contests(spark, rows)
    full = features.build_features(c, materialize=False)
    laid, plain = [], sequence.in_ranges
    for module in (features, features.head_to_head.__globals__):
        (monkeypatch.setitem if isinstance(module, dict) else monkeypatch.setattr)(
            module, "in_ranges", lambda df, *a, **k: laid.append(set(df.columns)) or plain(df, *a, **k))
    for wanted in (["match_id", "home_form_points", "away_elo", "h2h_draw_rate", "home_season_pts"],
                   ["match_id", "form_diff", "home_venue_xg", "xg_diff_w3", "rest_diff", "b365_prob_h", "month", "away_team_season_win_rate", "venue_elo_diff"]):
        some = features.build_features(c, materialize=False, columns=wanted)
        assert some.columns == wanted
        assert sorted(map(str, some.collect())) == sorted(map(str, full.select(wanted).collect()))
    narrow = laid[0]
    assert narrow == {"match_id", "ts", "season", "pool", "side", "team", "points", "win"} and "odd_h" not in laid[1] and "odd_h" in laid[3]


def test_asof_fixture_query_builds_its_columns_only(spark, monkeypatch):
    from duelframe import registry
    built, plain = [], registry.stored_result
    monkeypatch.setattr(registry, "_FEATURES", {})
    monkeypatch.setattr(registry, "stored_result", lambda spark, make: built.append(plain(spark, make)) or built[-1])
    got = registry.q_fixture_asof(spark, "/root/testdata/sf0.001")
    assert len(built[-1].columns) == 13 and got.count() == built[-1].count()
    registry.feature_table(spark, "/root/testdata/sf0.001")
    assert len(built[-1].columns) == 114 and registry.feature_table(spark, "/root/testdata/sf0.001", ["ts", "pool"]).columns == ["ts", "pool"]


def test_asof_exchanges_its_ranges_once(spark):
    from duelframe.operators.asof import asof_latest
    rows = [(i % 3, datetime(2020, 1, 1) + timedelta(hours=i % 50), i, float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz, match_id long, v double")
    text = plan(asof_latest(df.select("k", "ts", "match_id"), df, ["k"], ["v"]))
    assert "Join" not in text
