"""Items, details, brands, countries and the listing match on rows derived by hand."""

from pyspark.sql import functions as F

from marketloom.functions import brands as B
from marketloom.functions import phrases
from marketloom.operators import items as Items
from marketloom.operators import listings as LM


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    return [r[0] for r in df.select(column(F.col("s"))).collect()]


def test_brands(spark):
    assert one(spark, B.guess_brand, "Bột HIPP organic", "bledina pouch", "nanotech", "Ella's Kitchen puree", None, "") == [
        "HiPP", "Blédina", None, "Ella's Kitchen", None, None,
    ]
    assert one(spark, B.normalize_brand, " ACME  FOODS ", "acme", "McVities", "No Brand", "n/a", "nestle", "", None) == [
        "Acme Foods", "Acme", "McVities", None, None, "Nestlé", None, None,
    ]


def test_countries(spark):
    assert one(spark, B.country_from_url, "https://www.amazon.com/x", "http://a.b.co.uk/", "https://shop.de", "https://x.info", "nothing", None) == [
        "us", "gb", "de", None, None, None,
    ]
    assert one(spark, B.country_from_text, "Made in Japan", "Xuất xứ: Đức", "Austria", None) == ["jp", "de", "at", None]
    assert one(spark, B.country_from_currency, "JPY", "EUR", None) == ["jp", None, None]


RAW = "source string, title string, url string, brand string, seller string, price string, currency string, original_price string, sold string, origin string, sections map<string,string>, rating double, note string"


def test_make_items(spark):
    rows = [
        ("shop", " Heinz  Puffs 6x10g từ 8 tháng ", "https://www.shop.vn/p?x=1", "Shop!", "SHOP", "45.000 ₫", None, "60.000đ", "1.2k", None,
         {"ingredients": "milk, wheat", "age": ""}, 4.66, "kept"),
        ("shop", "Spoon set", None, None, None, "99000000", "VND", None, None, None, None, 0.0, None),
        (None, None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    got = {r["title"]: r for r in Items.make_items(spark.createDataFrame(rows, RAW)).collect()}
    a = got["Heinz Puffs 6x10g từ 8 tháng"]
    assert (a["price"], a["currency"], a["price_vnd"], a["original_price_vnd"], a["discount"]) == (45000.0, "VND", 45000, 60000, 25)
    assert (a["qty"]["total"], a["price_per_100_vnd"], a["age_months"], a["sold"], a["rating"]) == (60, 75000, 8, 1200, 4.7)
    assert (a["brand"], a["seller"], a["domain"], a["country"], a["type"], a["non_food"]) == ("Heinz", "SHOP", "shop.vn", "vn", "Bánh / snack", False)
    assert a["allergens"] == ["Sữa", "Gluten/lúa mì"] and a["note"] == "kept" and len(a["id"]) == 16
    b = got["Spoon set"]  # an absurd price is dropped; a spoon is no food
    assert (b["price"], b["price_vnd"], b["non_food"], b["rating"], b["country"]) == (None, None, True, None, "vn")
    assert got[""]["price_vnd"] is None and got[""]["claims"] == []
    assert Items.make_items(spark.createDataFrame([], RAW)).count() == 0


def test_merge_details(spark):
    rows = [("shop", "Puffs 40g", "https://www.shop.de/p", None, None, None, None, None, None, None, {"age": "from 6 months"}, None, None)] * 1
    items = Items.make_items(spark.createDataFrame(rows, RAW), "de")
    details = items.select(
        "id", F.lit(2.0).alias("price"), F.lit("EUR").alias("currency"), F.lit("HOLLE").alias("brand"), F.lit(4.44).alias("rating"),
        F.create_map(F.lit("age"), F.lit("from 9 months"), F.lit("origin"), F.lit("Germany")).alias("sections"),
    )
    r = Items.merge_details(items, details).first()
    assert (r["price"], r["currency"], r["price_vnd"], r["brand"], r["rating"]) == (2.0, "EUR", 61000, "Holle", 4.4)
    assert r["sections"] == {"age": "from 6 months", "origin": "Germany"} and r["age_months"] == 6 and r["origin_country"] == "de"
    assert Items.merge_details(items, details.limit(0)).first()["price"] is None


def test_final_relevance(spark):
    rows = [(0.5, False, 0.3, False, None, False), (0.2, False, 0.3, True, "match", True), (0.9, False, 0.0, True, "other", True),
            (0.9, False, 0.3, True, None, False), (0.5, True, 0.3, False, None, False), (1.3, False, 0.3, True, "match", True)]
    df = spark.createDataFrame(rows, "r double, split boolean, bonus double, forms boolean, form string, names boolean")
    got = df.select(Items.final_relevance(*(F.col(c) for c in df.columns))).collect()
    assert [g[0] for g in got] == [0.8, 0.2, 0.15, 0.44, 0.5, 1.4]


def test_concepts(spark):
    assert one(spark, phrases.concepts, "Organic Rice Cereal", "Bột gạo hữu cơ", "Bánh vị dâu táo", "dầu ăn", None) == [
        ["cereal", "rice"], ["cereal", "rice"], ["apple", "strawberry"], [], [],
    ]


def test_listing_match(spark):
    products = spark.createDataFrame(
        [(1, "Holle Organic Rice Cereal 250g", None, None), (2, "Zed bar", "Zed", "4006381333931"), (3, "Nobody knows this", "Qqq", None)],
        "id long, title string, brand string, gtin string",
    )
    rows = [
        (10, "Bột gạo hữu cơ Holle 250g xách tay", None, "Con Cưng", "concung", None, None, 100, 5, "Imp A"),
        (11, "Holle rice cereal 250 g", "HOLLE", "Kids Plaza official", "x", "kidsplaza.vn", None, 90, None, None),
        (12, "Holle apple puree", "Holle", None, "tiki", None, None, 0, 2, None),
        (13, "Something else", None, None, "tiki", None, "4006381333931", 70, 1, None),
        (14, None, None, None, None, None, None, None, None, None),
    ]
    listings = spark.createDataFrame(
        rows, "listing long, title string, brand string, seller string, source string, domain string, gtin string, price_vnd long, sold long, importer string"
    )
    matched = LM.matches(products, listings)
    got = {(r["id"], r["listing"]): round(r["score"], 3) for r in matched.collect()}
    assert got == {(1, 10): 1.0, (1, 11): 1.0, (2, 13): 1.0}
    out = {r["id"]: r for r in LM.evidence(products, matched, LM.brand_listings(products, listings)).collect()}
    assert (out[1]["class"], out[1]["chains"], out[1]["importers"], out[1]["hand_carried"], out[1]["min_price_vnd"]) == ("nkcn", ["Con Cưng", "Kids Plaza"], ["Imp A"], 1, 90)
    assert (out[2]["class"], out[3]["class"], out[3]["reasons"]) == ("partial", "absent", ["not found"])
    assert LM.matches(products, listings.limit(0)).count() == 0
