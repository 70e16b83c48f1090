"""The driver contract: flagship runs on the smallest tables; every query has a callable."""

from __future__ import annotations

import __spark_entry__ as E
from duelframe.plans.features import BASE_NUMERIC_COLS, ID_COLS, ODDS_COLS


def test_entry_flagship(spark):
    df = E.entry(spark)
    assert df.columns == ID_COLS + BASE_NUMERIC_COLS + ODDS_COLS
    assert df.count() > 0


def test_contract_shapes():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 48
    assert all(isinstance(s, str) and s.strip() for s in o.values())
