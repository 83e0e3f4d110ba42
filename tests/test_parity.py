"""Every query with SQL, against DuckDB on the same files."""

import datetime
import math

import duckdb
import pytest

from plumbline.plans.oracles import ORACLES
from plumbline.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v) if isinstance(v, (datetime.datetime, datetime.date)) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    want = con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    a = sorted(tuple(norm(r[c]) for c in cols) for r in got.collect())
    ix = [want.columns.index(c) for c in cols]
    b = sorted(tuple(norm(r[i]) for i in ix) for r in want.fetchall())
    assert a == b and a, "rows on both sides"


def test_every_query_has_rows(spark, sf):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, sf).count() > 0, name
