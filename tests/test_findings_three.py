"""Small cases of the third round's findings: each failed before its change."""

import time

import duckdb
from pyspark.sql import functions as F

from marketloom.operators import listings as LM
from marketloom.plans import page_queries, text_queries  # noqa: F401  (add their queries to the same tables)
from marketloom.plans.queries import ORACLE, QUERIES


def test_page_titles_keep_other_references(spark, tmp_path):
    titles = ["a &amp;&amp", "b &copy; &#39;c&#39;", "d &lt;e&gt; &quot;f&quot; &AMP;", "g &amp;lt; & h", "i j &ampk", "&", None]
    rows = [(i, "https://shop.example/", t and f"<html><body><h1>{t}</h1></body></html>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = dict(con.execute(ORACLE["page_titles"]).fetchall())
    assert {r["page_id"]: r["title"] for r in QUERIES["page_titles"](spark, str(tmp_path)).collect()} == want
    assert want[0] == "a &&amp"


def test_rows_of_equal_words_are_compared_once(spark):
    """30,000 products and as many listings of one name: pairs of rows would be 900 million."""
    n, nothing = 30_000, F.lit(None).cast("string")
    code = F.when(F.col("id") == n - 1, "4006381333931")
    title = F.lit("HiPP rice porridge 250 g")
    rows = spark.range(n)
    products = rows.select("id", title.alias("title"), F.lit("HiPP").alias("brand"), code.alias("gtin"))
    listings = rows.select(
        F.col("id").alias("listing"), title.alias("title"), F.lit("HiPP").alias("brand"), nothing.alias("seller"), F.lit("tiki").alias("source"), nothing.alias("domain"),
        code.alias("gtin"), F.col("id").alias("price_vnd"), F.col("id").alias("sold"), nothing.alias("importer"),
    )
    start = time.monotonic()
    for f in (LM.matches, LM.pool_matches):
        got = {r["id"]: r for r in f(products, listings).groupBy("id").agg(F.collect_set("listing").alias("l"), F.sum("price_vnd").alias("p"), F.max("rank").alias("r")).collect()}
        assert len(got) == n and set(got[5]["l"]) == set(range(12)) and got[5]["p"] == 66 and got[5]["r"] == 12
        # the code's listing has the greatest score too, but the greatest number
        assert set(got[n - 1]["l"]) == set(range(12)) and got[n - 1]["r"] == 12
    assert time.monotonic() - start < 240


def test_reach_makes_no_row_of_a_pair_and_a_value(spark):
    """120 alike sets that share 2,000 values: pairs times values would be 28.8 million rows; the plan joins pairs with no offer."""
    from marketloom.operators import matching as M

    items = spark.createDataFrame([(i, "b", ["x", "y", "z", f"w{i % 120}"]) for i in range(240)], "id long, brand string, tokens array<string>")
    offers = spark.range(240).select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1999).cast("long"))).alias("shop"))
    offers = offers.union(spark.createDataFrame([(7, 9_999_999_999), (3, -5), (4, -5)], "id long, shop long"))
    found = M.reached(items, offers, "tokens", 0.5, on=["brand"], counted=["shop"])
    got = {r["id"]: r["shop"] for r in found.collect()}
    # item 7 alone has one shop, items 3 and 4 share another
    assert got == {i: 2001 if i == 7 else 2002 for i in range(240)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroupsInArrow") > 0


def test_long_expressions_are_told_over_all_cores(spark):
    for name in ("title_fields", "item_build", "product_page_fields"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Repartition" in plan, name
