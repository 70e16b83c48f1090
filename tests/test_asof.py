"""As-of merge against a plain search, with hot keys, ties and many ranges."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from duelframe.operators.asof import asof_latest

LEFT, RIGHT = "k string, ts timestamp_ntz, x int", "k string, ts timestamp_ntz, match_id bigint, v string"


def rows(seed, n, hot):
    r = random.Random(seed)
    t0 = datetime(2020, 1, 1)

    def key():
        return hot if r.random() < 0.5 else r.choice(["a", "b", "c", None])

    left = [(key(), None if r.random() < 0.05 else t0 + timedelta(hours=r.randrange(200)), i) for i in range(n)]
    right = [(key(), None if r.random() < 0.05 else t0 + timedelta(hours=r.randrange(200)), i, r.choice([None, "u", "v"])) for i in range(n)]
    return left, right


def plain(left, right):
    out = []
    for k, t, x in left:
        found = [q for q in right if q[0] == k and q[1] is not None and t is not None and q[1] < t]
        last = max(found, key=lambda q: (q[1], q[2]), default=None)
        out.append((k, t, x, last and last[3], last and last[2]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("ranges", ["3", "40"])
def test_latest_strictly_before(spark, ranges):
    left, right = rows(3, 400, "hot")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = asof_latest(spark.createDataFrame([*left, left[0]], LEFT).repartition(6), spark.createDataFrame(right, RIGHT).repartition(5), ["k"], ["v", "match_id"], prefix="r_")
        assert got.columns == ["k", "ts", "x", "r_v", "r_match_id"]
        assert sorted(map(tuple, got.collect()), key=repr) == plain([*left, left[0]], right)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_empty_sides(spark):
    left, right = rows(4, 20, "h")
    l, r = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    assert asof_latest(l.limit(0), r, ["k"], ["v"]).count() == 0
    assert [x["v"] for x in asof_latest(l, r.limit(0), ["k"], ["v"]).collect()] == [None] * 20
