"""Every query that has SQL gives what DuckDB gives, on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from marketloom.plans import capture_queries, match_queries, page_queries, research_queries, text_queries  # noqa: F401
from marketloom.plans.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def plain(x):
    if x is None or x != x:
        return None
    return repr(float(x)) if isinstance(x, (float, decimal.Decimal)) else str(x)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = duck.execute(ORACLE[name])
    names = [c[0] for c in found.description]
    assert columns == sorted(names)
    want = sorted(str([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert sorted(str([plain(r[c]) for c in columns]) for r in df.collect()) == want


def test_without_sql(spark):
    for name in set(QUERIES) - set(ORACLE):
        assert QUERIES[name](spark, FOLDER).columns


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
