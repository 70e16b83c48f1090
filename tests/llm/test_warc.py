from __future__ import annotations

import random

from duelframe.llm import warc as W
from helpers import tuples
from pyspark.sql import functions as F

SCHEMA = "id bigint, type string, ts bigint, url string, headers map<string,string>, payload string, old string, near int"


def records():
    r = random.Random(3)
    rows = []
    for i in range(400):
        url = r.choice(["http://A.example/x", "https://www.a.example:443/x#top", "//a.example/x?utm_source=q", "http://b.example", "http://b.example/?ref=1",
                        "https://c.example/p?b=2&a=1", "https://c.example/p?a=1&b=2&gclid=z", None, "no url"])
        ts = None if r.random() < 0.03 else r.randrange(0, 300)
        tag = r.choice([None, '"1"', '"2"', 'W/"1"'])
        headers = None if r.random() < 0.05 else {k: v for k, v in (("etag", tag), ("last-modified", r.choice([None, "m1", "m2"])),
                                                                     ("date", str(ts)), ("x", f"x{i}")) if v is not None}
        rows.append((i, r.choice(["response", "revisit", "revisit", "request"]), ts, url, headers, f"p{i}", "o", 1))
    hot = [(1000 + i, "revisit" if i % 3 else "response", i, "http://hot.example/", {"etag": '"h"'}, "h", "o", 1) for i in range(900)]
    return rows + hot + [rows[1], rows[2]]


CANON = {"http://A.example/x": "a.example/x", "https://www.a.example:443/x#top": "a.example/x", "//a.example/x?utm_source=q": "a.example/x",
         "http://b.example": "b.example/", "http://b.example/?ref=1": "b.example/?ref=1", "https://c.example/p?b=2&a=1": "c.example/p?a=1&b=2",
         "https://c.example/p?a=1&b=2&gclid=z": "c.example/p?a=1&b=2", None: None, "no url": None, "http://hot.example/": "hot.example/"}


def brute(rows):
    out = []
    for i, kind, ts, url, headers, _, *_ in rows:
        if kind != "revisit":
            continue
        key, new = CANON[url], headers or {}
        old = max((x for x in rows if x[1] == "response" and key and ts is not None and CANON[x[3]] == key and x[2] is not None and x[2] < ts),
                  key=lambda x: (x[2], x[0]), default=None)
        state, merged, payload = "unresolved", None, None
        if old:
            had = old[4] or {}
            pair = next(((new[k], had[k]) for k in ("etag", "last-modified") if k in new and k in had), None)
            state = "unverified" if pair is None else "resolved" if pair[0].removeprefix("W/") == pair[1].removeprefix("W/") else "mismatch"
            if state != "mismatch":
                merged = had | {k: v for k, v in new.items() if k in W.PERMITTED}
                payload = old[5]
        out.append((i, key, state, old and old[0], payload, merged and "\n".join(f"{k}: {v}" for k, v in sorted(merged.items()))))
    return out


def test_against_brute_force(spark):
    rows = records()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = [(*x[:5], x[5] if x[5] or x[2] in ("unresolved", "mismatch") else "") for x in brute(rows)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for ranges in ("1", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out = W.resolve_revisits(df).withColumn("text", W.header_lines(F.col("headers")))
        got = tuples(out, "id", "url", "state", "response_id", "payload", "text")
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert got == sorted(want, key=repr)


def test_empty(spark):
    assert W.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ports_by_scheme(spark):
    urls = {"http://a.b:80/": "a.b/", "https://a.b:80/": "a.b:80/", "https://a.b:443/x": "a.b/x", "http://a.b:443": "a.b:443/", "//a.b:80": "a.b:80/",
            "HTTP://WWW.A.b:80?x": "a.b/?x"}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r["u"]: r["c"] for r in df.select("u", W.canonical_url(F.col("u")).alias("c")).collect()} == urls


def test_the_crawl_needs_the_as_of(spark):
    crawl = W.crawl_records(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).cache()
    out = W.resolve_revisits(crawl).collect()
    firsts = {}
    for r in crawl.where("type = 'response'").select("id", "ts", W.canonical_url(F.col("url")).alias("u")).collect():
        firsts[r["u"]] = min(firsts.get(r["u"], (r["ts"], r["id"])), (r["ts"], r["id"]))
    assert {r["state"] for r in out} == {"resolved", "mismatch", "unverified", "unresolved"}
    other = [r for r in out if r["response_id"] is not None and r["response_id"] != firsts[r["url"]][1] and r["response_id"] // 16 != r["id"] // 16]
    later = [r for r in out if r["response_id"] is not None and r["response_id"] != firsts[r["url"]][1]]
    assert len(other) > len(out) / 10 and len(later) > len(out) / 3
