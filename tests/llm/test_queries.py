"""Every query with SQL against DuckDB on the smallest tables; shapes of all."""

from __future__ import annotations

import duckdb
import pytest
from duelframe.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    with duckdb.connect() as db:
        for t in TABLES:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
        want = db.execute(ORACLES[name])
        columns = [c[0] for c in want.description]
        df = QUERIES[name](spark, SMALL)
        assert sorted(df.columns) == sorted(columns)
        got = [tuple(r) for r in df.select(*columns).collect()]
        assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr) and got


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == [*range(1, 14)]
