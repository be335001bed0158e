"""Result cards of shops and search engines with a form of their own, and shops whose pages carry state."""

import base64
import json

from marketloom.sources import captures, cards

AMAZON = """<div data-component-type="s-search-result" data-asin="B01"><img class="s-image" src="/i.jpg"><h2 aria-label="Sponsored Ad - HiPP Porridge 500 g"><span>x</span></h2>
<span>Sponsored</span><span class="a-price"><span class="a-offscreen">€4,99</span></span><span class="a-price a-text-price"><span class="a-offscreen">€6,49</span></span>
<i><span class="a-icon-alt">4,6 von 5 Sternen</span></i><a aria-label="1.234 ratings" href="#c">1.234</a><span>2K+ gekauft</span></div>
<div data-component-type="s-search-result"><h2><span>no code</span></h2></div><div data-component-type="s-search-result" data-asin="B02"><h2><span>Holle</span></h2></div>"""
ALDI = """<div class="product-tile" title="Alt name"><a href="/product/1"><img src="u.jpg"></a><p class="product-tile__brandname">Mamia</p><div class="product-tile__name">Oat Bars</div>
<span class="product-tile__unit-of-measurement">5 x 20g</span><span class="base-price__regular">£1.29</span><span class="base-price__was-price">£1.59</span><i class="product-tile__comparison-price">£12.90/KG</i></div>"""
KROGER = """<div class="AutoGrid-cell"><div class="ProductCard" aria-label="Gerber Puffs"><a href="/p/gerber/0001500004732?x=1">g</a><img src="k.png"><data data-testid="product-item-unit-price"> now $2.79 was $3</data>
<span data-testid="product-item-sizing">1.48 oz</span><div class="ProductCard-tags">Sponsored</div></div></div>"""
RAKUTEN = """<div class="x searchresultitem" data-card-type="item" data-track-price="1280"><a href="https://item.rakuten.co.jp/s/1/?l=2"><img alt="和光堂 ビスケット" src="r.jpg"></a>
<div class="review--1">4.52 (1,023件)</div><div class="merchant--x"><a>ベビー店</a></div></div><div class="searchresultitem" data-card-type="ad"></div>"""
SHOPEE = """<a href="/Banh-an-dam-i.12.345?sp=1"><img alt="Bánh ăn dặm Gerber 42g" src="https://cf.shopee.vn/a"><div><span>₫</span><span>55.000</span></div><div>4.9</div><div>Đã bán 1,2k</div></a>
<a href="/again-i.12.345">₫ 1.000</a><a href="/none-i.1.2"><b>No price</b></a>"""


def test_cards(spark):
    rows = [("amazon", "de", AMAZON), ("aldiuk", "gb", ALDI), ("kroger", "us", KROGER), ("rakuten", "jp", RAKUTEN), ("shopee", "vn", SHOPEE), ("unknown", "us", KROGER), ("kroger", "us", None)]
    got = {(r["source"], r["pos"]): r for r in cards.read(spark.createDataFrame(rows, "source string, market string, payload string")).collect()}
    assert set(got) == {("amazon", 0), ("amazon", 1), ("aldiuk", 0), ("kroger", 0), ("rakuten", 0), ("shopee", 0)}
    tell = lambda s, *names: tuple(got[s, 0][n] for n in names)
    assert tell("amazon", "title", "url", "price_text", "originalPrice", "currency", "rating", "reviews", "sold", "sponsored", "seller") == (
        "HiPP Porridge 500 g", "https://www.amazon.de/dp/B01", "€4,99", 6.49, "EUR", 4.6, 1234, 2000, True, "Amazon")
    assert got["amazon", 1]["title"] == "Holle" and got["amazon", 1]["price_text"] is None and not got["amazon", 1]["sponsored"]
    assert tell("aldiuk", "title", "brand", "url", "price_text", "originalPrice", "snippet") == ("Mamia Oat Bars 5 x 20g", "Mamia", "https://www.aldi.co.uk/product/1", "£1.29", 1.59, "£12.90/KG")
    assert tell("kroger", "title", "url", "price_text", "gtin", "snippet", "sponsored") == ("Gerber Puffs", "https://www.kroger.com/p/gerber/0001500004732", "$2.79", "0001500004732", "1.48 oz", True)
    assert tell("rakuten", "title", "url", "price_text", "rating", "reviews", "seller") == ("和光堂 ビスケット", "https://item.rakuten.co.jp/s/1/", "1280", 4.52, 1023, "Rakuten · ベビー店")
    assert tell("shopee", "title", "url", "price_text", "rating", "sold", "image") == ("Bánh ăn dặm Gerber 42g", "https://shopee.vn/Banh-an-dam-i.12.345", "55.000₫", 4.9, 1200, "https://cf.shopee.vn/a")
    assert got["shopee", 0]["currency"] == "VND" and len(got["shopee", 0]["id"]) == 16


AUCHAN = """<article itemtype="http://schema.org/Product"><a class="productThumbnailLink" href="/bledina/pr-C1"><picture><source alt="Blédina Petits pots"></picture></a><meta itemprop="image" content="a.jpg">
<meta itemprop="ratingValue" content="4.5"><meta itemprop="reviewCount" content="31"><div class="see-prices price">1,00 €</div><div class="price">2,50 €/kg</div><div class="product-price">3,29 €</div></article>"""
CHRONO = """<article class="product-card" aria-label="Compote pomme"><a class="card-content-link" href="/p/1">x</a><div class="media"><img src="m.jpg"></div><span class="product-actions-value">1,99 €</span></article>"""
LECLERC = """<article data-product-card data-ean="3041091234567"><a href="/fp/petit-pot-3041" title="Petit pot carotte">x</a><span class="p-small">Blédina</span><img src="l.jpg">
<div currency="EUR">15 € , 99 soit 7,99 € / kg</div></article>"""
BEST = """<div id="gridItemRoot"><span class="zg-bdg-text">#3</span><div data-asin="B07"><img alt="Plasmon Omogeneizzato Pollo" src="b.jpg"></div><span class="_x_p13n-sc-price_y">VND 285,321</span>
<div class="a-icon-row"><span class="a-icon-alt">4,7 su 5</span><span class="a-size-small">1.025</span></div></div>"""
TARGET = base64.urlsafe_b64encode(b"https://shop.example/p?x=1").decode().rstrip("=")
BING = f"""<ol><li class="b_algo"><h2><a href="https://www.bing.com/ck/a?u=a1{TARGET}&n=1">HiPP <b>porridge</b></a></h2><img src="https://t/1.jpg" width="32"><img src="https://t/2.jpg" width="60">
<div class="b_caption"><p>12 thg 3, 2024 · Only 45.000₫ today</p></div></li><li class="b_algo"><h2>none</h2></li></ol>"""
DDG = """<table><tr><td><a class="result-link" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fx.org%2Fa&rut=1">First</a></td></tr><tr><td class="result-snippet">Told here</td></tr>
<tr><td><a class="result-link" href="https://duckduckgo.com/y.js?ad=1">Advert</a></td></tr></table>"""
TESCO = "<script type=\"application/json\">" + json.dumps({"pad": "x" * 200, "l": [{"title": "Ella Kitchen pouch", "id": 77, "defaultImageUrl": "https://t/i.jpg", "price": {"actual": 1.5}, "href": "/x/y"}]}) + "</script>"
ROUTE = [{"data": 1}, [2], {"type": 3, "attributes": 4, "links": 5}, "product", {"title": 6, "brand": 7, "offers": 8, "ean": 12, "images": 13}, {"self": 9}, "Petit pot", "Blédina", {"k": 10},
         "/p/petit-pot-1", {"m": 11}, {"attributes": 15}, "3041090000000", {"paths": 14}, [16], {"price": 17}, "https://c/FORMAT.jpg", {"price": 18, "perUnitLabel": 19}, 2.35, "11,75 € / KG"]
CARREFOUR = f"<script>window.__INITIAL_STATE__={json.dumps({'vuex': {'routeData': json.dumps(ROUTE)}})};</script>"


def test_more_cards(spark):
    rows = [("auchan", "fr", AUCHAN), ("chronodrive", "fr", CHRONO), ("leclerc", "fr", LECLERC), ("bestsellers", "it", BEST), ("bing", "vn", BING), ("ddg", "us", DDG), ("tesco", "gb", TESCO), ("carrefour", "fr", CARREFOUR)]
    found = cards.read(spark.createDataFrame(rows, "source string, market string, payload string")).collect()
    got = {r["source"]: r for r in found}
    assert len(found) == len(got) == 8
    tell = lambda s, *names: tuple(got[s][n] for n in names)
    assert tell("auchan", "title", "url", "price_text", "rating", "reviews", "image") == ("Blédina Petits pots", "https://www.auchan.fr/bledina/pr-C1", "3,29 €", 4.5, 31, "a.jpg")
    assert tell("chronodrive", "title", "price_text", "image", "currency") == ("Compote pomme", "1,99 €", "m.jpg", "EUR")
    assert tell("leclerc", "title", "price_text", "gtin", "brand", "snippet") == ("Petit pot carotte", "15.99 €", "3041091234567", "Blédina", "7,99 € / kg")
    assert tell("bestsellers", "title", "rank", "url", "currency", "rating", "reviews") == ("Plasmon Omogeneizzato Pollo", 3, "https://www.amazon.it/dp/B07", "VND", 4.7, 1025)
    assert tell("bing", "kind", "title", "url", "snippet", "image", "price_text") == ("web", "HiPP porridge", "https://shop.example/p?x=1", "Only 45.000₫ today", "https://t/2.jpg", "45.000₫")
    assert tell("ddg", "kind", "title", "url", "snippet") == ("web", "First", "https://x.org/a", "Told here")
    assert tell("tesco", "title", "url", "image", "price_text", "currency") == ("Ella Kitchen pouch", "https://www.tesco.com/groceries/en-GB/products/77", "https://t/i.jpg", "1.5", "GBP")
    assert tell("carrefour", "title", "url", "brand", "price_text", "gtin", "image", "snippet") == (
        "Petit pot", "https://www.carrefour.fr/p/petit-pot-1", "Blédina", "2.35", "3041090000000", "https://c/540x540.jpg", "11,75 € / KG")


def test_lazada(spark):
    item = {"name": "Bột ăn dặm", "itemUrl": "//www.lazada.vn/products/i1.html?x=1", "price": "55000.00", "originalPrice": "60000", "itemSoldCntShow": "1.2K sold", "ratingScore": "4.9", "adFlag": 1}
    df = spark.createDataFrame([("lazada", "vn", json.dumps({"mods": {"listItems": [item]}}))], "source string, market string, payload string")
    r = captures.read(df, "lazada").first()
    assert (r["title"], r["url"], r["price"], r["originalPrice"], r["currency"], r["sold"], r["sponsored"]) == ("Bột ăn dặm", "https://www.lazada.vn/products/i1.html", 55000.0, 60000.0, "VND", 1200, True)
