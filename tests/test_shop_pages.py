"""Result pages of two shops, product pages of two, and searches restricted to sites, against hand-derived rows."""

import json

from pyspark.sql import functions as F

from marketloom.sources import cards, shop_details
from marketloom.sources.site_search import site_rows

REWE = """<div class="a-pt__product-tile_x"><a href="/shop/p/brei/1"><img src="r.jpg"></a><h4> Bio  Brei </h4><span class="grammage">250g (1 kg = 8,00 €)</span>
<div class="base-price">1 kg = 8,00 €</div><div class="priceBox">1,99 €</div><div class="product-tile__more"><a href="/shop/p/brei/1">x</a><h4>Again</h4></div></div>
<div class="product-tile"><h4>No link</h4></div><div class="product-tile"><a href="/shop/p/reis/2">y</a><p class="product-title">Reis</p></div>"""
BING = """<div class="offer"><a class="br-titlelink" href="/ck/1"><div><div class="br-title"><span title="Oat  jar">Oat…</span></div></div></a><div class="br-pdMainImg"><img data-src="o.jpg"></div>
<div class="pd-price">$4.50</div><del>$5.00</del><span class="br-sellerName">Walmart + 3 more</span><i aria-label="4,5 star rating"></i><b>Sponsored</b></div>
<div class="offer"><a href="https://x.org/p"><span class="br-title"><span title="Oat jar">again</span></span><img src="p.jpg"></a></div>
<div class="offer"><a href="https://x.org/q"><span class="br-title"><span title="Rice jar">Rice</span></span><img src="q.jpg"><b class="br-price">$2</b></a></div>"""


def test_result_pages(spark):
    rows = [("rewe", "de", REWE), ("bingshop", "us", BING), ("rewe", "de", None), ("bingshop", "us", "<p>")]
    found = cards.read(spark.createDataFrame(rows, "source string, market string, payload string")).collect()
    got = {(r["source"], r["pos"]): r for r in found}
    assert len(found) == len(got) == 4
    tell = lambda s, p, *names: tuple(got[s, p][n] for n in names)
    assert tell("rewe", 0, "title", "url", "price_text", "image", "currency", "seller") == (
        "Bio Brei 250g (1 kg = 8,00 €)", "https://shop.rewe.de/shop/p/brei/1", "1.99 €", "r.jpg", "EUR", "REWE")
    assert tell("rewe", 1, "title", "price_text") == ("Reis", None)
    assert tell("bingshop", 0, "title", "url", "price_text", "originalPrice", "seller", "rating", "image", "sponsored") == (
        "Oat jar", "https://www.bing.com/ck/1", "$4.50", 5.0, "Walmart", 4.5, "o.jpg", True)
    assert tell("bingshop", 1, "title", "url", "price_text", "sponsored", "seller") == ("Rice jar", "https://x.org/q", "$2", False, None)


def test_product_pages(spark):
    told = '<p>Sweet "jar"</p><p>Ingredients: rice flour, milk powder, salt</p><p>Importer: Good Food Trading Co; x</p>'
    lazada = f'<script>var d = {{"highlights":"<li>Storage: keep in a cool and dry place</li>","desc":{json.dumps(told)},"desc2":1}}</script>'
    linked = '<script type="application/ld+json">{"@type":"Product","offers":[{"price":"see"},{"lowPrice":3.5}]}</script>'
    rows = [("l", "lazada", lazada), ("l0", "lazada", "<p>captcha"), ("ln", "lazada", None), ("a", "auchan", '<meta itemprop="price" content="2,49">' + linked),
            ("b", "auchan", linked), ("c", "auchan", '<b itemprop="price" content="from 3">'), ("t", "other", "x")]
    got = {r["id"]: r for r in shop_details.read(spark.createDataFrame(rows, "id string, source string, payload string")).collect()}
    assert set(got) == {"l", "l0", "ln", "a", "b", "c"}
    assert got["l"]["description"].startswith('Sweet "jar"') and got["l"]["importer"] == "Good Food Trading Co"
    assert got["l"]["sections"]["ingredients"].startswith("rice flour") and got["l"]["sections"]["storage"].startswith("keep in a cool")
    assert [got[k]["description"] for k in ("l0", "ln")] == [None, None] and got["l0"]["sections"] is None
    assert [(got[k]["price"], got[k]["currency"]) for k in "abc"] == [(2.49, "EUR"), (3.5, "EUR"), (None, None)]


def test_site_search(spark):
    answers = spark.createDataFrame(
        [("us", q, p, n, k) for q, p, n, k in [(1, "s", 0, True), (1, "d", 1, False), (2, "x", 0, False), (2, "d", 1, False), (3, "d", 1, False), (4, "x", 0, False)]],
        "market string, query int, provider string, priority int, keyed boolean",
    )
    rows = spark.createDataFrame(
        [("us", 1, "d", "https://www.store.com/a", "A", 0, None), ("us", 2, "x", "https://notstore.com/a", "B", 0, None), ("us", 2, "d", "https://groceries.store.com/b", "C €3", 1, ""),
         ("us", 2, "d", "https://groceries.store.com/b", "later", 2, "$9"), ("us", 3, "d", "https://store.com/c", None, 0, "$1"), ("us", 3, "d", None, "no url", 1, "$1"), ("de", 4, "x", "https://store.com/c", "other market", 0, None)],
        "market string, query int, provider string, url string, title string, pos int, price_text string",
    ).withColumn("snippet", F.lit(None).cast("string"))
    sites = spark.createDataFrame([("us", "store.com"), ("us", "store.com")], "market string, site string")
    got = sorted((r["query"], r["url"], r["seller"], r["price_text"]) for r in site_rows(answers, rows, sites).collect())
    assert got == [(2, "https://groceries.store.com/b", "store.com", "€3"), (3, "https://store.com/c", "store.com", "$1")]
    assert site_rows(answers.limit(0), rows.limit(0), sites).collect() == []
