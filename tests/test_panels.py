"""Panels by hand: plans, engines, importers by fallback, histories, short lists; and the orders and filters of rows that no query uses."""

from pyspark.sql import functions as F

from marketloom.operators import history, panels, rows


def test_task_plan(spark):
    sources = spark.createDataFrame([("a", True, False, ["*"]), ("b", True, False, ["vn", "xx"]), ("c", False, False, ["*"]), ("g", True, True, ["*"])],
                                    "source string, enabled boolean, global boolean, markets array<string>")
    markets = spark.createDataFrame([("vn",), ("us",)], "market string")
    got = sorted(map(tuple, panels.task_plan(sources, markets).collect()))
    assert got == [("a", "us"), ("a", "vn"), ("b", "vn"), ("g", "world")]


def test_importers_by_fallback(spark):
    brands = spark.createDataFrame([("HiPP",), ("Holle",), ("Gerber",), ("None",), (None,)], "brand string")
    of_run = spark.createDataFrame([("hipp", "Run Co"), ("Holle", "")], "brand string, importer string")
    book = spark.createDataFrame([("HiPP", "Book Co", 9), ("Holle", "Few", 2), ("HOLLE", "Most", 5)], "brand string, importer string, seen int")
    shops = [("Gerber", i, s, imp) for i, (s, imp) in enumerate([("lazada", "L"), ("concung", None), ("kidsplaza", "K"), ("tiki", "T"), ("other", None), ("lazada", "L2")])]
    listings = spark.createDataFrame(shops, "brand string, listing int, source string, importer string")
    got = {r["brand"]: (r["importer"], r["known_by"]) for r in panels.importers_of(brands, of_run, book, listings).collect()}
    assert got == {"HiPP": ("Run Co", "run"), "Holle": ("Most", "directory"), "Gerber": ("K", "listing"), "None": (None, None), None: (None, None)}
    assert [r["listing"] for r in panels.importer_candidates(listings).orderBy("place").collect()] == [4, 1, 2, 3, 0]


def test_product_history(spark):
    day = history.DAY_MS
    df = spark.createDataFrame([("a", 0, 10), ("a", 7 * day, 17), ("b", 1, 5), ("b", 2, 6)], "key string, t long, sold long")
    r = panels.product_history(df).first()
    assert (r["sold_per_week"], r["first_seen"], r["snapshots"], [tuple(x) for x in r["days"]]) == (7.0, 0, 4, [(0, 16), (7, 17)])


def test_short_lists(spark):
    df = spark.createDataFrame([(i, f"b{i % 3}" if i % 4 else None, None if i == 9 else i * 2, i % 5, "nkcn" if i == 7 else "absent", i) for i in range(20)],
                               "id int, brand string, sold int, score int, cls string, reviews int")
    assert [r["id"] for r in panels.top_sold(df).collect()] == [19, 18, 17, 16, 15, 14, 13, 12, 11, 10]
    assert [r["id"] for r in panels.open_opportunities(df).collect()] == [19, 14, 9, 4, 18, 13]
    assert [r["id"] for r in panels.checking_order(df).limit(6).collect()] == [0, 4, 8, 12, 16, 3]
    stamped = df.withColumn("added_at", -F.col("id"))
    assert [r["id"] for r in panels.compared(stamped).collect()] == [19, 18, 17, 16, 15, 14]
    assert [r["id"] for r in panels.tracked_first(stamped).limit(2).collect()] == [0, 1]
    assert panels.of_class(df.withColumnRenamed("cls", "class"), "nkcn").count() == 1 and panels.of_class(df, None).count() == 20
    lists = spark.createDataFrame([(["a", "b"], None, ["b", "c"])], "x array<string>, y array<string>, z array<string>")
    assert lists.select(panels.union_of(F.col("x"), F.col("y"), F.col("z"))).first()[0] == ["a", "b", "c"]


def test_orders_of_the_result_list(spark):
    df = spark.createDataFrame(
        [(0, 0.5, 100, None, 3, "i", "shop", 0, 10, 5), (1, 0.5, None, 9, None, None, "web", 0, None, None), (2, 0.9, 50, 7, 8, "i", "shop", 20, 30, 5), (3, None, 70, 8, 8, None, "shop", 1, 20, 9)],
        "ord int, relevance double, priceVND int, pricePer100VND int, sold int, image string, kind string, pos int, discount int, rating int",
    ).withColumn("sections", F.create_map().cast("map<string,string>")).withColumn("reviews", F.lit(1))
    order = lambda name: [r["ord"] for r in rows.ordered(df, name).collect()]
    assert order("relevance") == [2, 0, 1, 3] and order("price-asc") == [2, 3, 0, 1] and order("price-desc") == [0, 3, 2, 1]
    assert order("p100-asc") == [2, 3, 1, 0] and order("sold-desc") == [2, 3, 0, 1] and order("discount-desc") == [2, 3, 0, 1] and order("rating-desc") == [3, 0, 2, 1]
