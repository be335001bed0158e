"""Candidates, lookups, watch lists and exports against hand-derived values."""

import json

from pyspark.sql import functions as F

from marketloom.functions import price, text, urls
from marketloom.operators import candidates, exports, tracking
from marketloom.sources import captures, details, lookups


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).collect()[0][0]


def test_lead_brand(spark):
    for title, want in {
        "【和光堂】 お粥": "和光堂", "Ella's Kitchen Pouch": "Ella's Kitchen", "Plasmon omogeneizzato": "Plasmon", "6 jars": None, "x y": None,
        "Happy baby": "Happy", "": None, "– Holle: Brei": "Holle",
    }.items():
        assert one(spark, candidates.lead_brand(F.col("t")), t=title) == want, title


def test_best_sellers(spark):
    rows = [("Aptamil Folgemilch 2", None), ("Baby Water 1l", None), ("HiPP Brei", "HiPP"), ("Töpfer Reis", "Nan")]
    df = spark.createDataFrame(rows, "title string, brand string")
    assert sorted(r["brand"] for r in candidates.best_sellers(df).collect()) == ["HiPP", "Töpfer"]
    assert candidates.best_sellers(df, formula=True).count() == 3


def test_similar_query(spark):
    q = candidates.similar_query(F.col("b"), F.col("t"))
    assert one(spark, q, b="HiPP", t="hipp [Bio] Reis (neu) mit Apfel, 200g") == "HiPP Reis mit Apfel"
    assert one(spark, q, b="", t="a b c d e f g h i j") == "a b c d e f g h"


def test_detail_rules(spark):
    ok = candidates.fetchable(F.col("s"), F.col("u"), F.col("d"), F.lit(False))
    assert one(spark, ok, s="web", u="https://x.org/a", d="x.org")
    assert not one(spark, ok, s="web", u="https://x.org/a.PDF?x", d="x.org")
    assert not one(spark, ok, s="web", u="https://m.facebook.com/a", d="m.facebook.com")
    assert not one(spark, ok, s="gshop", u="https://x.org/a", d="x.org")
    assert not one(spark, ok, s="web", u=None, d=None)
    code = candidates.enrichable(F.col("s"), F.col("u"), F.col("d"), F.lit(False), F.col("g"))
    assert one(spark, code, s="gshop", u="", d="", g="4006381333931")


def test_interest_and_directory(spark):
    rows = [("Gerber", 0, "gerber puffs"), ("Gerber", 1, "Gerber Puffs"), ("Gerber", 2, "gerber accumark"), ("Gerber", 3, "bánh Gerber"), ("Holle", 0, None)]
    got = candidates.brand_interest(spark.createDataFrame(rows, "brand string, pos int, text string")).collect()
    assert [(r["brand"], r["suggestions"], r["sample"]) for r in got] == [("Gerber", 2, ["gerber puffs", "bánh Gerber"])]
    book = spark.createDataFrame([("HiPP", "Công ty A", 3), ("Holle", "An Bình", 9), ("HiPP", "B", 5)], "brand string, importer string, seen int")
    assert [r["importer"] for r in candidates.importer_search(book, "hipp").collect()] == ["B", "Công ty A"]
    assert [r["brand"] for r in candidates.importer_search(book, "an-binh").collect()] == ["Holle"]


def test_food_facts(spark):
    payload = json.dumps({"product": {"product_name": "Jar", "ingredients_text_en": "rice", "ingredients_text_de": "Reis, Wasser", "conservation_conditions": "keep dry"}})
    facts = lookups.food_facts(spark.createDataFrame([("4006381333931", payload), ("123", payload)], "gtin string, payload string"))
    items = spark.createDataFrame(
        [(1, "4006381333931", {"storage": "own"}), (2, "x", None), (3, None, {})], "id int, gtin string, sections map<string,string>"
    )
    got = {r["id"]: (r["sections"], r["section_notes"]) for r in lookups.with_food_facts(items, facts).collect()}
    assert got[1] == ({"storage": "own", "ingredients": "Reis, Wasser"}, {"ingredients": "food database"})
    assert got[2] == ({}, {}) and got[3] == ({}, {})


def test_rates_fall_back(spark):
    empty = spark.createDataFrame([], "t int, payload string")
    got = {r["currency"]: (r["rate"], r["live"]) for r in lookups.rates(empty, {"EUR": 3.0}).collect()}
    assert got == {"EUR": (3.0, False)}


def test_stored_and_cached(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "x", "n": 1},\n {"id": "y"}]')
    assert {(r["id"], r["n"]) for r in lookups.stored(spark, str(tmp_path), "id string, n int").collect()} == {("x", 1), ("y", None)}
    cache = spark.createDataFrame([("a", 5, "old"), ("a", 9, "new"), ("b", 2, "gone")], "key string, exp long, value string")
    assert [tuple(r) for r in lookups.alive(cache, F.lit(3)).collect()] == [("a", "new", 9)]
    words = spark.createDataFrame([("cháo", "de", "Brei"), ("cháo", "fr", "bouillie")], "text string, lang string, translation string")
    got = lookups.translated(spark.createDataFrame([("cháo",), ("mì",)], "query string"), words, "de").collect()
    assert {tuple(r) for r in got} == {("cháo", "Brei"), ("mì", "mì")}


def test_watch(spark):
    watch = spark.createDataFrame([("a", 1.0)], "id string, price double")
    new = spark.createDataFrame([("a", 2.0), ("b", 3.0)], "id string, price double")
    assert {tuple(r) for r in tracking.watched(watch, new).collect()} == {("a", 1.0), ("b", 3.0)}
    figures = spark.createDataFrame([(110.0, 100.0, 200.0, 150.0), (None, None, None, 0.0)], "price double, first_price double, target_price double, cost double")
    got = [tuple(r)[4:] for r in tracking.watch_figures(figures).collect()]
    assert [round(x, 6) for x in got[0]] == [10.0, 25.0, 81.818182] and got[1] == (0.0, None, None)
    checked = spark.createDataFrame([("absent",), ("brand",), ("absent",)], "class string")
    assert tuple(tracking.class_counts(checked, ["absent", "brand", "nkcn"]).collect()[0]) == (3, 2, 1, 0)
    done = spark.createDataFrame([(None,), ("x",)], "error string")
    assert tuple(tracking.refresh_counts(done).collect()[0]) == (1, 2)
    assert {tuple(r) for r in tracking.table_counts({"w": watch, "n": new}).collect()} == {("w", 1), ("n", 2)}


def test_opportunity_export(spark):
    row = {
        "score": 7, "demand": 9, "parts": [("reviews", 5), ("rank", 4)], "product": {"id": "p", "title": "T", "brand": "B", "country": "de", "price_vnd": 3, "reviews": 4, "url": "u"},
        "class": "absent", "uncertain": True, "reasons": ["a", "b"], "listings": 0, "chains": ["c"], "importers": [], "brand_importer": None, "sold": 0,
        "hand_carried": 0, "min_price_vnd": None, "match_urls": list("123456"),
    }
    schema = (
        "score int, demand int, parts array<struct<label:string,points:int>>, product struct<id:string,title:string,brand:string,country:string,price_vnd:long,reviews:long,url:string>, "
        "class string, uncertain boolean, reasons array<string>, listings int, chains array<string>, importers array<string>, brand_importer string, sold int, hand_carried int, "
        "min_price_vnd long, match_urls array<string>"
    )
    got = exports.opportunity_rows(spark.createDataFrame([row], schema), countries={"de": "Germany"}, classes={"absent": "new"})
    r = got.collect()[0]
    assert len(got.columns) == 20 and r["parts"] == "reviews +5; rank +4" and r["match_urls"] == "1 2 3 4 5"
    assert (r["country"], r["class"], r["uncertain"], r["reasons"]) == ("Germany", "new", "yes", "a | b")
    assert json.loads(exports.json_lines(got.select("title", "brand_importer")).collect()[0][0]) == {"title": "T", "brand_importer": None}


def test_more_connectors(spark):
    next_data = {"props": {"pageProps": {"viewDefinitionResults": {"viewDefinition": {"layout": {"sections": {"mainContentCollection": {"components": [
        {"data": {"productTiles": [{"productId": 1, "title": "A", "link": "/a?x=1", "pricing": {"price": "3.5"}}, {"productId": 2, "title": "S", "link": "/s", "isSponsored": True}]}},
        {"data": {"productTiles": [{"productId": 1, "title": "again", "link": "/b"}]}}, {"x": 1},
    ]}}}}}}}}
    payloads = {
        "11st": json.dumps({"data": [{"items": [{"id": 1, "title": "K", "finalPrc": "900", "selPrc": 1000}, {"id": 3, "title": "ad", "finalPrc": 1, "adProduct": True}]},
                                     {"items": [{"id": 1, "title": "again", "finalPrc": 1}]}]}),
        "asda": json.dumps({"hits": [{"NAME": "Oat Jar", "CIN": 7, "BRAND": "Asda", "PRICES": '{"EN": {"PRICE": 1.25, "PRICEPERUOMFORMATTED": "1p/g"}}',
                                      "PRIMARY_TAXONOMY": '{"AISLE_NAME": "Baby Food"}', "PACK_SIZE": "100G", "AVG_RATING": 4.26, "RATING_COUNT": 3}, {"NAME": "off", "CIN": 8, "DISPLAY_ONLINE": "false"}]}),
        "sainsburys": json.dumps({"products": [{"name": "P", "full_url": "http://s.co.uk/p", "retail_price": {"price": 2}, "eans": ["123"], "promotions": [{"original_price": 3}]}]}),
        "shoppers": f'<script id="__NEXT_DATA__" type="x">{json.dumps(next_data)}</script>',
        "lotteon": '"brazeData": {"spdNm":"N","spdNo":"L1","price":"20","discountPrice":"15"} .. "brazeData":{"spdNm":"N2","spdNo":"L1"} "brazeData":{broken}',
    }
    df = spark.createDataFrame([(s, "xx", p) for s, p in payloads.items()], "source string, market string, payload string")
    got = {s: captures.read(df, s).collect() for s in payloads}
    assert {s: len(r) for s, r in got.items()} == dict.fromkeys(payloads, 1)
    first = {s: r[0] for s, r in got.items()}
    assert (first["11st"]["price"], first["11st"]["originalPrice"], first["11st"]["url"]) == (900.0, 1000.0, "https://www.11st.co.kr/products/1")
    assert first["asda"]["title"] == "Asda Oat Jar" and first["asda"]["price"] == 1.25 and first["asda"]["snippet"] == "100G · 1p/g"
    assert first["asda"]["url"] == "https://www.asda.com/groceries/product/baby-food/asda-oat-jar/7" and first["asda"]["rating"] == 4.3
    assert (first["sainsburys"]["url"], first["sainsburys"]["originalPrice"], first["sainsburys"]["gtin"]) == ("https://s.co.uk/p", 3.0, "123")
    assert (first["shoppers"]["url"], first["shoppers"]["price"]) == ("https://shop.shoppersdrugmart.ca/a", 3.5)
    assert (first["lotteon"]["price"], first["lotteon"]["originalPrice"]) == (15.0, 20.0)


def test_small_functions(spark):
    x = F.col("x")
    for want, got in (
        (4.99, price.euro_price(F.lit("4,99 €"))), (None, price.euro_price(F.lit("4,99 €/kg"))), (None, price.euro_price(F.lit("5 €"))),
        (3.5, price.plain_price(F.lit(" 3,5 "))), (None, price.plain_price(F.lit("3.555"))), ("2 tuổi+", price.age_label(F.lit(24))),
        ("6 tháng+", price.age_label(F.lit(6))), ("", price.age_label(F.lit(None))), ("Gạo", text.cut_tail(F.lit("Gạo  Xem thêm nữa"))),
        ("baby food jar pomme", text.english_food_words(F.lit("petits pots pomme"))), ("x.org", urls.shop_name(F.lit("shop.x.org"))),
    ):
        assert one(spark, got, x="") == want
    assert one(spark, x, x="") == ""


def test_details(spark):
    payloads = {
        "tiki": {"price": 5, "specifications": [{"attributes": [{"code": "volume", "value": "0,5"}, {"code": "origin", "value": "<b>Nhật</b>"}, {"code": "warning", "value": "Đang cập nhật"}]}, {}]},
        "target": {"data": {"product": {"item": {"primary_barcode": "1", "product_description": {"bullet_descriptions": ["<B>Age Level:</B> 6 Months", "x"]}, "enrichment": {"nutrition_facts": {"ingredients": "Oats"}}}}}},
        "woolworths": {"AdditionalAttributes": {"allergystatement": "Milk", "allergenmaybepresent": "Soy"}, "CountryOfOriginLabel": "Made in Australia"},
        "dm": {"descriptionGroups": [{"header": "Zutaten", "contentBlock": [{"texts": ["Reis", "Salz"]}]}, {"header": "Zutaten", "contentBlock": [{"texts": ["no"]}]}, {"header": "Produktbeschreibung", "contentBlock": ["Gut"]}, {"header": "x", "contentBlock": ["y"]}]},
        "off": {"items": [{"price": 1, "currency": "EUR", "date": "2024-01-01"}, {"price": 2, "currency": "USD", "date": "2024-03-01"}]},
    }
    rows = [(s, s, json.dumps(p)) for s, p in payloads.items()] + [("bad", "off", "no json"), ("none", "dm", None)]
    got = {r["id"]: r for r in details.read_all(spark.createDataFrame(rows, "id string, source string, payload string")).collect()}
    assert got["tiki"]["sections"] == {"weight": "500g", "origin": "Nhật"} and got["tiki"]["price"] == 5.0
    assert got["target"]["sections"] == {"ingredients": "Oats", "age": "6 Months"} and got["target"]["gtin"] == "1"
    assert got["woolworths"]["sections"] == {"warnings": "Milk. May contain: Soy", "origin": "Made in Australia"}
    assert got["dm"]["sections"] == {"ingredients": "Reis Salz"} and got["dm"]["description"] == "Gut"
    assert (got["off"]["price"], got["off"]["currency"]) == (2.0, "USD") and got["bad"]["price"] is None and len(got) == 7
