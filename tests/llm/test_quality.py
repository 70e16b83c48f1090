from __future__ import annotations

import zlib

import numpy as np
from duelframe.llm import quality as Q
from duelframe.llm.queries import QUERIES
from duelframe.llm.tables import table
from helpers import documents, prose
from pyspark.sql import functions as F

MID = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = QUERIES["op4_quality"](spark, MID).join(table(spark, MID, "labels"), "doc_id").where("held_out").collect()
    right = [r["predicted"] == r["quality"] for r in rows]
    good = [r["score"] for r in rows if r["quality"] == 1]
    poor = [r["score"] for r in rows if r["quality"] == 0]
    auc = np.mean([[(g > p) + (g == p) / 2 for p in poor] for g in good])
    assert len(rows) > 80 and np.mean(right) >= 0.95 and auc >= 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def test_statistics_are_finite_and_blind_to_neighbours():
    texts = [b"", b" ", b"\n", b"a", "é".encode(), b"x" * 300_000, b"la " * 5000, prose(1, 400).encode(), b"!!!", bytes(range(1, 128))]
    all_at_once = Q.statistics(texts)
    assert np.isfinite(all_at_once).all() and all_at_once.shape == (len(texts), len(Q.STATISTICS))
    assert np.allclose(all_at_once, np.concatenate([Q.statistics([t]) for t in texts]))


def labelled(spark):
    rows = [(i, prose(i, 20 + i % 40)) for i in range(120)] + [(200 + i, "bad *** $$$ " * (5 + i % 9)) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i < 200)) for i, _ in rows] + [(5, 7), (None, 1), (6, None)], "doc_id bigint, quality int")
    return rows, labels


def test_scores_against_dense_formula(spark):
    rows, labels = labelled(spark)
    got = {r["id"]: r["score"] for r in Q.classify(documents(spark, rows), labels).collect()}
    learn = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    x, y = Q.statistics([t.encode() for _, t in learn]), np.array([int(i < 200) for i, _ in learn])
    n, mean = [(y == k).sum() for k in (0, 1)], [x[y == k].mean(0) for k in (0, 1)]
    cov = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = np.diag((n[0] * cov[0] + n[1] * cov[1]) / len(y))
    target = np.diag(np.maximum(pooled, 1e-6 * pooled.max()))
    every = Q.statistics([t.encode() for _, t in rows])
    log_density = []
    for k in (0, 1):
        c = (1 - Q.SHRINK) * cov[k] + (Q.SHRINK + 1e-9) * target
        d = every - mean[k]
        log_density.append(-0.5 * np.einsum("ij,ij->i", d @ np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1])
    odds = log_density[1] - log_density[0] + np.log((n[1] + 1) / (n[0] + 1))
    want = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
    assert np.allclose([got[i] for i, _ in rows], want, atol=1e-6)


def test_edge_cases(spark):
    rows, labels = labelled(spark)
    more = [*rows, (900, None), (901, ""), (None, "no id"), (3, rows[3][1]), (902, "w " * 100_000)]
    df = documents(spark, more).withColumns({c: F.lit(1) for c in ("id", "score", "statistics", "quality", "label", "row")})
    out = Q.classify(df, labels).collect()
    assert len(out) == len(more) and all(0 <= r["score"] <= 1 for r in out)
    kept = Q.keep_quality(df, labels, 0.5)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sum(i is not None and i < 120 for i in ids) >= 119 and not any(i is not None and 200 <= i < 300 for i in ids)
    assert Q.classify(df.limit(0), labels).count() == 0
    one = Q.classify(documents(spark, rows), labels.where("quality = 1")).select("score").distinct().collect()
    n = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i, _ in rows if i < 200)
    assert len(one) == 1 and abs(one[0][0] - (n + 1) / (n + 2)) < 1e-9
    assert Q.classify(documents(spark, rows[:2]), labels.limit(0)).first()["score"] == 0.5
