from __future__ import annotations

import hashlib

import pytest
from duelframe.llm.exact_dedup import drop_copies, group_copies
from helpers import documents, tuples
from pyspark.sql import functions as F

ROWS = [(i, "hot") for i in range(40)] + [(100, None), (101, ""), (102, " "), (103, "x" * 200_000), (104, "x" * 200_000 + "y"),
        (105, "x" * 200_000), (7, "hot"), (200, "solo"), (200, "solo"), (None, "solo"), (None, "only null"), (300, "x" * 33 + "a"),
        (301, "x" * 33 + "b"), (302, "é"), (303, "é")]


def brute(rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = keep(known) if known else None
        done = False
        for i in ids:
            first = i == best and not done
            done |= first
            out.append((i, best, len(ids), first, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("hot", [3, 256])
def test_groups(spark, keep, hot):
    got = group_copies(documents(spark, ROWS), keep=keep, hot_rows=hot)
    assert tuples(got, "id", "keep_id", "group_size", "kept", "text_sha256") == brute(ROWS, min if keep == "min" else max)


def test_drop_keeps_all_columns_whatever_their_names(spark):
    df = documents(spark, ROWS).withColumns({c: F.lit(c) for c in ("row", "id", "body", "head", "digest", "salt", "place")})
    out = drop_copies(df, hot_rows=3)
    assert out.columns == df.columns
    want = [x[0] for x in brute(ROWS, min) if x[3]]
    assert sorted(map(repr, (r["doc_id"] for r in out.collect()))) == sorted(map(repr, want))
    assert {r["row"] for r in out.collect()} == {"row"}


def test_normalise_and_empty_table(spark):
    df = documents(spark, [(1, "A b"), (2, "a B"), (3, "c")])
    assert tuples(group_copies(df, normalise=F.lower), "id", "keep_id") == [(1, 1), (2, 1), (3, 3)]
    assert group_copies(df.limit(0)).count() == 0 and drop_copies(df.limit(0)).count() == 0
