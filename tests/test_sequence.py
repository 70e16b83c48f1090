"""The ordinal under skew: positions are exact and no task holds a hot key."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from duelframe.operators import sequence
from duelframe.operators.sequence import sequence_ordinal
from pyspark.sql import functions as F


def _rows(n=6000, seed=3):
    r = random.Random(seed)
    t0 = datetime(2020, 1, 1)
    ids = r.sample(range(2**62), n)  # hashed ids, unique timestamps, one key with a third of all rows
    return [(ids[i], t0 + timedelta(seconds=7 * i), "HOT" if i % 3 == 0 else f"k{r.randrange(40)}", r.choice("ha")) for i in range(n)]


def _places(rows, *keys):
    seen, out = {}, {}
    for row in sorted(rows, key=lambda x: (x[1], x[0])):
        group = tuple(row[k] for k in keys)
        out[row[0]] = seen.get(group, 0)
        seen[group] = out[row[0]] + 1
    return out, seen


def test_hot_key_with_unique_times_and_hashed_ids(spark, monkeypatch):
    rows = _rows()
    laid = []
    keep = sequence.stored
    monkeypatch.setattr(sequence, "stored", lambda df: laid.append(keep(df)) or laid[-1])
    df = spark.createDataFrame(rows, "match_id bigint, ts timestamp_ntz, team string, side string").repartition(16)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = sequence_ordinal(df, ["team"], name="k", sub_keys=["side"], sub_name="kv", size_name="n").collect()
        largest = laid[0].groupBy("team", "_range").count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    k, n = _places(rows, 2)
    kv, _ = _places(rows, 2, 3)
    assert len(out) == len(rows)
    assert all((r.k, r.kv, r.n) == (k[r.match_id], kv[r.match_id], n[(r.team,)]) for r in out)
    assert largest < 1000  # of the 2,000 rows of the hot key: ranges cut it, sampled splitters are even


def test_whole_table_and_empty(spark):
    rows = _rows(500)
    df = spark.createDataFrame(rows, "match_id bigint, ts timestamp_ntz, team string, side string").repartition(5)
    k, _ = _places(rows)
    assert all(r.k == k[r.match_id] for r in sequence_ordinal(df, []).collect())
    assert sequence_ordinal(df.limit(0), ["team"]).count() == 0
