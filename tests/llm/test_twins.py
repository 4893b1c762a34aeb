"""Operators with an SQL twin give DuckDB's rows."""

import duckdb
import pytest

from lodestone import llm

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_as_duckdb(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got = llm.queries()[name](spark, FOLDER).toPandas()
    want = con.execute(llm.oracle_sql()[name]).fetchdf()[list(got.columns)]
    plain = lambda frame: sorted(map(tuple, frame.astype(str).to_numpy().tolist()))
    assert plain(got) == plain(want)
