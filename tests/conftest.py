from __future__ import annotations

import os
import sys
from datetime import datetime

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from duelframe.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", shuffle_partitions=4, app_name="duelframe-tests")
    yield s
    s.stop()


CONTEST_SCHEMA = ("match_id long, ts timestamp_ntz, season string, pool string, home string, "
                  "away string, hg int, ag int, ftr string, hs int, as_ int, hst int, ast_ int, "
                  "xg_h double, xg_a double")


def make_contests(spark, rows):
    """rows: dicts with at least ts/home/away/hg/ag/ftr; ids follow list order."""
    out = []
    for i, r in enumerate(rows):
        ts = r["ts"] if isinstance(r["ts"], datetime) else datetime.fromisoformat(r["ts"])
        out.append((r.get("match_id", i + 1), ts, r.get("season", "s1"), r.get("pool", "p"),
                    r["home"], r["away"], r.get("hg"), r.get("ag"), r["ftr"], r.get("hs"),
                    r.get("as_"), r.get("hst"), r.get("ast_"), r.get("xg_h"), r.get("xg_a")))
    return spark.createDataFrame(out, CONTEST_SCHEMA)
