"""Every query with SQL against that SQL, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from chartwork.plans.queries import ORACLES, QUERIES, flagship

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6g}"
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    want = con.sql(ORACLES[name])
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(want.columns)
    rows = sorted(str([plain(r[c]) for c in want.columns]) for r in df.collect())
    assert rows == sorted(str([plain(v) for v in r]) for r in want.fetchall())


def test_flagship(spark):
    rows = flagship(spark, SF).collect()
    assert sum(r["count"] for r in rows) == 500 * 499 // 2
