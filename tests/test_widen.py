"""Both outcomes of a conditional union, on rows worked out by hand and on two scales."""

import duckdb

from marketloom.operators import rows as R
from marketloom.plans.queries import ORACLE, QUERIES

NAME = "conditional_union_anti_documents"


def test_widen(spark):
    some = spark.createDataFrame([(1, "a"), (2, "b")], "id long, digest string")
    more = spark.createDataFrame([(1, "a"), (3, "b"), (4, "c"), (5, "c"), (6, None)], "id long, digest string")
    assert sorted(r["id"] for r in R.widen(some, more, "digest", 3).collect()) == [1, 2, 4, 5, 6]
    assert sorted(r["id"] for r in R.widen(some, more, "digest", 2).collect()) == [1, 2]
    assert R.widen(some.limit(0), more, "digest", 1).count() == 5


def test_both_outcomes_match_sql(spark):
    widened = []
    for scale in ("sf0.001", "sf0.01"):
        folder = f"/root/testdata/{scale}"
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
        got = sorted(map(str, (tuple(r) for r in QUERIES[NAME](spark, folder).collect())))
        assert got == sorted(map(str, con.execute(ORACLE[NAME]).fetchall()))
        narrow = con.execute("SELECT count(*) FROM documents WHERE contains(lower(text), 'license')").fetchone()[0]
        widened.append(len(got) > narrow)
        print(scale, narrow, len(got))
    assert widened == [True, False]
