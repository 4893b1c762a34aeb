"""Every query with an SQL twin gives DuckDB's rows."""

import decimal
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from lodestone import registry
from lodestone.sources.readers import TABLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, (list, np.ndarray)):
        return str([plain(x) for x in value])
    if value is None or pd.isna(value):
        return "None"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (int, np.integer)):
        return str(int(value))
    if isinstance(value, (float, decimal.Decimal)):
        return repr(float(value))
    return str(value)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(map(plain, r)) for r in frame[names].itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_as_duckdb(spark, duck, name):
    got = rows(registry.QUERIES[name](spark, FOLDER).toPandas())
    assert got == rows(duck.execute(registry.SQL[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_has_rows(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).limit(1).count() == 1
