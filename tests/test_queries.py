"""Every query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from heddle.plans import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, str(DATA))
    rows = sorted(tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect())
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    want = sorted(tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in sorted(columns)) for r in found.fetchall())
    assert sorted(got.columns) == sorted(columns) and rows == want


def test_entry(spark):
    assert set(ORACLES) == set(QUERIES) and set(QUERIES) <= set(__spark_entry__.queries())
    if DATA.exists():
        assert __spark_entry__.entry(spark).count() > 0
