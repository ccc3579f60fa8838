"""Every query with an SQL twin against DuckDB on the smallest tables; the others run and have rows or a schema."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from holdfold import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return (0, str(v))
    if hasattr(v, "year"):
        return (0, str(v)[:19])
    if isinstance(v, str):
        return (0, v)
    return (2, "nan") if math.isnan(float(v)) else (1, float(v))


def same(a, b):
    return a == b or (a[0] == b[0] == 1 and abs(a[1] - b[1]) <= 2e-4 * max(1.0, abs(a[1])))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cur = duck.execute(catalogue.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(c[0] for c in cur.description)
    place = [[c[0] for c in cur.description].index(c) for c in columns]
    ours = sorted([plain(r[c]) for c in columns] for r in df.collect())
    theirs = sorted([plain(r[k]) for k in place] for r in cur.fetchall())
    assert len(ours) == len(theirs)
    assert all(same(x, y) for a, b in zip(ours, theirs, strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    """Rows come out, and every number is one somewhere."""
    rows = catalogue.QUERIES[name](spark, SF).collect()
    assert rows
    for column in rows[0].asDict():
        values = [r[column] for r in rows if r[column] is not None]
        assert values, column
        assert not isinstance(values[0], float) or any(math.isfinite(v) for v in values), column


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
