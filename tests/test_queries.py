"""Every query with an SQL twin gives the same rows in Spark and DuckDB."""

import datetime
from pathlib import Path

import duckdb
import pytest

from pactspark.queries import ORACLE, QUERIES

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(x):
    return round(float(x), 6) if isinstance(x, float) else x.isoformat() if isinstance(x, (datetime.date, datetime.datetime)) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(spark, duck, name):
    df = QUERIES[name](spark, str(SF))
    twin = duck.sql(ORACLE[name])
    names = [d[0] for d in twin.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    assert got == sorted(repr([plain(x) for x in r]) for r in twin.fetchall())
    assert got or name == "constraint_violations"
