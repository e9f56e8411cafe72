"""Registered queries against their SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TICK_QUERIES = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        path = f"{SF}/{name}/*.parquet" if os.path.isdir(f"{SF}/{name}") else f"{SF}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)]
    def one(v):
        if pd.isna(v):
            return ""
        if hasattr(v, "isoformat"):
            return v.isoformat()
        return repr(round(float(v), 6)) if isinstance(v, (int, float)) or hasattr(v, "dtype") and not isinstance(v, str) else str(v)
    return sorted("|".join(one(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", TICK_QUERIES)
def test_equals_sql(spark, db, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), db.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"bos_detected_15m", "market_bias_4h", "fvg_age_bars", "session"} <= set(df.columns)
