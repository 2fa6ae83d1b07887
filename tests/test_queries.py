"""Each registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
CORE = [n for n in entry.queries() if n in entry.oracle_sql() and not n.startswith("op")]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if hasattr(v, "item"):
        return plain(v.item())
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    return None if v is None or str(v) in ("NaT", "<NA>") else v if isinstance(v, bool) else str(v)


def rows(pdf):
    return sorted((tuple(plain(x) for x in r) for r in pdf[sorted(pdf.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", CORE)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    got, want = entry.queries()[name](spark, DATA).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
