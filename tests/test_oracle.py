"""Each query with oracle SQL against DuckDB over the same tables, by rows as multisets and by column names."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def cell(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    return tuple(map(cell, x)) if isinstance(x, (list, tuple)) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(df.columns)
    rows = Counter(tuple(cell(r[c]) for c in cols) for r in df.collect())
    wanted = Counter(tuple(map(cell, r)) for r in want.fetchall())
    assert rows == wanted, (list((rows - wanted).items())[:3], list((wanted - rows).items())[:3])
