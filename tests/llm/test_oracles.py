import duckdb
import pytest

from plumbline.llm.oracles import ORACLES
from plumbline.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got, want = QUERIES[name](spark, sf), con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
