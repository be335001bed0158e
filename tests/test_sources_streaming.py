"""Connectors, pages, sinks, row operators, and the stream against the batch."""

import json

from pyspark.sql import functions as F

from marketloom.operators import history, rows
from marketloom.sources import captures, pages, sinks
from marketloom.streaming.admission import admitted_stream, drop_versions, keep_latest, latest


def test_connectors(spark):
    payloads = {
        "tiki": {"data": [{"name": "Milk", "url_key": "milk", "price": 120000, "sku": "12345678", "quantity_sold": {"value": 7}}, {"name": "B", "url_path": "b.html"}]},
        "woolworths": {"Products": [{"Products": [{"Name": "Oats", "Stockcode": 5, "Price": 3.5, "WasPrice": 4}]}, {"Products": [{"DisplayName": "Rice", "Stockcode": 6}]}]},
        "kurly": {"data": {"listSections": [{"data": {"items": [{"no": 9, "name": " Rice  snack ", "salesPrice": 2000, "discountedPrice": 1500}]}}, {"x": 1}]}},
        "brave": {"web": {"results": [{"title": "<strong>Puree</strong> €3.20", "url": "https://x.org"}]}},
        "off": {"hits": [{"code": "123", "product_name": "Jar"}, {"code": "5"}]},
        "google": {"nothing": []},
    }
    df = spark.createDataFrame([(s, "vn", json.dumps(p)) for s, p in payloads.items()], "source string, market string, payload string")
    got = {(r["source"], r["pos"]): r for r in captures.read_all(df).collect()}
    assert set(got) == {("tiki", 0), ("tiki", 1), ("woolworths", 0), ("woolworths", 1), ("kurly", 0), ("brave", 0), ("off", 0)}
    assert got["tiki", 0]["url"] == "https://tiki.vn/milk.html" and got["tiki", 0]["gtin"] == "12345678" and got["tiki", 0]["sold"] == 7
    assert got["woolworths", 0]["originalPrice"] == 4.0 and got["woolworths", 1]["title"] == "Rice"
    assert got["kurly", 0]["price"] == 1500.0 and got["kurly", 0]["originalPrice"] == 2000.0 and got["kurly", 0]["title"] == "Rice snack"
    assert got["brave", 0]["price_text"] == "€3.20" and len(got["off", 0]["id"]) == 16


def test_connectors_read_pages_of_a_search_once(spark):
    item = lambda i, title: {"title": title, "link": f"https://n/{i}" if i else None, "imageUrl": "x"}
    pages = [(1, 1, [item(2, "b, later"), item(0, "no link, later"), item(3, "c")]), (1, 0, [item(1, "a"), item(2, "b"), item(1, "a again"), item(0, "no link")]), (2, 0, [item(1, "other search")])]
    rows = [("google", "us", q, n, json.dumps({"organic": found})) for q, n, found in pages] + [("google", "us", 3, 0, None), ("unknown", "us", 1, 0, "{}"), ("tiki", "vn", 1, 0, "no json")]
    df = spark.createDataFrame(rows, "source string, market string, query int, page int, payload string")
    got = sorted((r["query"], r["page"], r["pos"], r["title"]) for r in captures.read_pages(df).collect())
    assert got == [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 0, 3, "no link"), (1, 1, 1, "no link, later"), (1, 1, 2, "c"), (2, 0, 0, "other search")]
    assert captures.read_pages(df.limit(0)).collect() == []


def test_all_sources_are_read_in_one_pass(spark, tmp_path):
    spark.createDataFrame([("google", "us", "{}")], "source string, market string, payload string").write.parquet(str(tmp_path / "c"))
    df = captures.read_all(spark.read.parquet(str(tmp_path / "c")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan and "In(source" in plan


def test_pages(spark):
    ld = {"@graph": [{"@type": "Product", "name": "Porridge", "url": "/p/1", "brand": {"name": "Holle"}, "offers": {"price": "4.99", "priceCurrency": "EUR"}, "gtin13": "4006381333931"}, {"@type": "Thing", "name": "no"}]}
    html = f'<html><script type="application/ld+json">{json.dumps(ld)}</script><script type="application/ld+json">not json</script></html>'
    df = spark.createDataFrame([(1, "https://x.org/a", html), (2, None, None), (3, "u", "<p>nothing")], "page_id long, url string, html string")
    got = pages.products(df).collect()
    assert [(r["page_id"], r["title"], r["url"], r["brand"], r["price"], r["currency"]) for r in got] == [(1, "Porridge", "https://x.org/p/1", "Holle", 4.99, "EUR")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', ["x", "y"]), (2, "t\tn", [])], "id int, s string, l array<string>")
    assert [r[0] for r in df.orderBy("id").select(sinks.csv_line([F.col("id"), F.col("s")])).collect()] == ['1,"a ""b"", c"', "2,t\tn"]
    assert [r[0] for r in df.orderBy("id").select(sinks.tsv_line([F.col("s")])).collect()] == ['a "b", c', "t n"]
    sinks.write_csv(df, str(tmp_path / "c"))
    back = spark.read.csv(str(tmp_path / "c"), header=True, quote='"', escape='"').orderBy("id").collect()
    assert back[0]["s"] == 'a "b", c' and back[0]["l"] == "x; y"
    sinks.write_ndjson(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_upsert(spark):
    old = spark.createDataFrame([("k", 1, "A", "s1")], "key string, t int, title string, seller string")
    new = spark.createDataFrame([("k", 2, "B", None), ("l", 2, "C", None)], "key string, t int, title string, seller string")
    got = {r["key"]: (r["t"], r["title"], r["seller"]) for r in sinks.upsert(old, new, "key", "t", newest=["title"]).collect()}
    assert got == {"k": (2, "B", "s1"), "l": (2, "C", None)}


def test_rows(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, None)], "k string, o int, v string")
    assert sorted(map(tuple, rows.first_wins(df, ["k"], ["o"]).collect())) == [("a", 1, "y"), ("b", 3, None)]
    assert sorted(map(tuple, rows.newest(df, ["k"], ["o"]).collect())) == [("a", 2, "x"), ("b", 3, None)]
    items = spark.createDataFrame(
        [(1, 0.9, ["gluten"], ["DHA"], "Rice Bánh"), (2, 0.2, [], [], "rice"), (3, None, None, ["DHA", "Bio"], "Gạo rice")],
        "ord int, relevance double, allergens array<string>, claims array<string>, title string",
    )
    pick = lambda **k: sorted(r["ord"] for r in rows.result_filter(items, **k).collect())
    assert pick(relevant=True) == [1, 3]
    assert pick(claims=["DHA"]) == [1, 3] and pick(claims=["DHA", "Bio"]) == [3]
    assert pick(without=["gluten"]) == [2, 3]
    assert pick(words="banh") == [1] and pick(words="RICE gao") == [3]
    assert pick() == [1, 2, 3]


def test_admission_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr(
        "user_id as key", "event_id", "unix_millis(cast(ts as timestamp)) as t", "cast(floor(value / 20) as bigint) as sold"
    )
    batch = history.admitted(events, "key", ["t", "event_id"], "t", ["sold"], history.SNAPSHOT_GAP_MS)
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    kept = admitted_stream(stream, "key", "t", ["sold"], history.SNAPSHOT_GAP_MS)
    q = kept.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["event_id"] for r in batch.collect()}


def test_keyed_table(spark, tmp_path):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("a", 0, "late"), ("c", 1, None), ("b", 3, "w"), ("d", 1, "v")]
    want = [("a", 2, "y"), ("b", 3, "w"), ("c", 1, None), ("d", 1, "v")]
    kind = "k string, t int, v string"
    table, source = str(tmp_path / "table"), tmp_path / "in"
    schema = spark.createDataFrame([], kind).schema
    read = lambda: sorted(map(tuple, latest(spark, table, schema, ["k"], ["t"]).collect()), key=str)
    assert read() == []

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        q = keep_latest(stream, table, ["k"], ["t"], str(tmp_path / "cp"), every=2)
        q.awaitTermination(120)
        assert q.exception() is None

    for i, row in enumerate(rows[:5]):
        spark.createDataFrame([row], kind).coalesce(1).write.mode("append").parquet(str(source))
    run()
    assert read() == [("a", 2, "y"), ("b", 1, "z"), ("c", 1, None)]
    assert drop_versions(spark, table) > 0 and drop_versions(spark, table) == 0
    for row in rows[5:]:
        spark.createDataFrame([row], kind).coalesce(1).write.mode("append").parquet(str(source))
    run()
    assert read() == want
    (tmp_path / "table/whole/v99").mkdir(parents=True)  # a compaction that broke off counts for nothing
    assert read() == want
