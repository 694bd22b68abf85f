"""Every registered query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import datetime
from pathlib import Path

import duckdb
import pytest

from panelforge import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def rows(cells):
    return sorted((tuple(x.isoformat() if isinstance(x, datetime.datetime) else x for x in r) for r in cells), key=repr)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = rows(tuple(r[c] for c in cols) for r in df.collect())
    if name not in plans.ORACLE:
        assert got
        return
    found = duck.execute(plans.ORACLE[name])
    at = [[x[0] for x in found.description].index(c) for c in cols]
    assert got == rows(tuple(r[i] for i in at) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["user_id", "slope", "area"]
    assert df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
