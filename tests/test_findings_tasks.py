"""Small cases of the third round's findings on the memory of a task: each failed before its change."""

from pyspark.sql import functions as F

from marketloom.plans import capture_queries, research_queries  # noqa: F401  (add their queries to the same tables)
from marketloom.plans.queries import QUERIES, evidence
from marketloom.sources import captures

FOLDER = "/root/testdata/sf0.001"


def tasks(df):
    return len({r[0] for r in df.select(F.spark_partition_id(), *df.columns).collect()})


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_searches_are_dealt_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr("marketloom.session.ROWS_A_TASK", 100, raising=False)
    assert tasks(QUERIES["paged_captures"](spark, FOLDER)) > 4


def test_pages_are_read_in_one_pass_with_the_fields_that_are_wanted(spark):
    rows = [("google", "us", 1, k, '{"organic":[{"title":"a","link":"https://n.example/1","snippet":"s"},{"title":"b"},{"title":"b"}]}') for k in (0, 1, 1)]
    df = spark.createDataFrame(rows, "source string, market string, query int, page int, payload string")
    found = captures.read_pages(df, ("snippet",))
    assert optimized(found).count("Union") == 0 and "brand" not in found.columns
    got = sorted((r["page"], r["pos"], r["title"], r["snippet"]) for r in found.collect())
    # of the url's rows one stays, of those without a url all, those of equal places too
    assert got == [(0, 0, "a", "s"), *((k, p, "b", None) for k, p in ((0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2)))]
    assert sorted(captures.read_pages(df).columns) == sorted(["source", "market", "query", "page", "pos", "kind", "id", *captures.FIELDS])


def test_offers_are_dealt_by_part_once(spark, monkeypatch):
    monkeypatch.setattr("marketloom.session.ROWS_A_TASK", 100, raising=False)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a large table
    try:
        found = evidence(spark, FOLDER)
        assert tasks(found) > 4 and optimized(found).count("Expand") == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_suggestions_are_dealt_by_their_queries(spark, monkeypatch):
    monkeypatch.setattr("marketloom.session.ROWS_A_TASK", 100, raising=False)
    assert tasks(QUERIES["suggestion_union"](spark, FOLDER)) > 4
