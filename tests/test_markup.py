"""Listing and product pages by hand: cards of four layouts, state objects, JSON-LD, sections and their precedence."""

import json
import random

import pytest

from marketloom.sources import markup, pages, product_pages, sections, state, storefronts

BASE = "https://shop.example/search?q=x"


def grid(n):
    return "".join(
        f'<div class="tile"><a href="/p/{i}"><img data-src="//cdn.example/{i}.jpg" alt="Oat porridge {i}"></a><h3>Oat porridge {i}</h3>'
        f'<span class="old">$ {i + 9}.50</span><span>$ {i + 1}.25</span><a href="/p/{i}">more</a></div>'
        for i in range(n)
    )


def bullets(n):
    return "<ul>" + "".join(
        f'<li><a href="/b/{i}" title="Rice cakes organic {i}"><img srcset="/i/{i}.webp 1x, /i/{i}b.webp 2x"></a><p>{i + 2},99 €'
        for i in range(n)
    ) + "</ul>"


def rows_of_table(n):
    return "<table>" + "".join(
        f'<tr><td><img src="/t/{i}.png" alt=""><td><a href="/t/{i}">Apple puree pouch {i}</a><td><b>{i + 3}0.000₫</b>' for i in range(n)
    ) + "</table>"


def nested(n):
    return "".join(
        f'<section><div><div class="pic"><img src="{i}.jpg"></div></div><div><div><a href="https://shop.example/n/{i}#top"><span class="prod-name">'
        f"Milk snack {i}</span></a></div><div><div><em>£{i}.10</em></div></div></div></section>"
        for i in range(n)
    )


@pytest.mark.parametrize("layout, first", [
    (grid, ("Oat porridge 0", "https://shop.example/p/0", "https://cdn.example/0.jpg", ["$ 9.50", "$ 1.25"])),
    (bullets, ("Rice cakes organic 0", "https://shop.example/b/0", "https://shop.example/i/0.webp", ["2,99 €"])),
    (rows_of_table, ("Apple puree pouch 0", "https://shop.example/t/0", "https://shop.example/t/0.png", ["30.000₫"])),
    (nested, ("Milk snack 0", "https://shop.example/n/0#top", "https://shop.example/0.jpg", ["£0.10"])),
])
def test_cards_of_four_layouts(layout, first):
    page = markup.Page(f"<html><body><nav><a href='/'>Home</a> $1 off</nav>{layout(5)}<p>$ 5</p></body></html>")
    found = markup.cards(page, BASE)
    assert len(found) == 5 and tuple(found[0].values()) == first
    assert [c["title"][-1] for c in found] == list("01234")


def test_no_cards():
    for html in (None, "", "<p>$ 5", "<div><a href='/x'>A long title here</a><b>$5</b></div>", "<div><img src=a><b>$5</b></div>",
                 "<div><img src=a><a href='#'>Not a link at all</a><b>$5</b></div>", "<body><img src=a>" + "<a href='/1'>t</a><a href=/2>u</a><a href=/3>u</a><a href=/4>u</a><b>$5</b>"):
        assert markup.cards(markup.Page(html), BASE) == []


def test_page_lists():
    page = markup.Page("<ul><li>a<ul><li>b</ul><li>c</ul><p>d<div>e</div><br/>f</x><script>if (a<b) '</p>'</script>")
    tree = [(page.tag[i], page.text(i)) for i in page.under()]
    assert tree[:6] == [("ul", "abc"), ("li", "ab"), ("ul", "b"), ("li", "b"), ("li", "c"), ("p", "d")]
    assert ("div", "e") in tree and list(page.scripts()) == [("", "if (a<b) '</p>'")]
    for i in range(1, len(page.tag)):
        assert page.up[i] < i < page.end[i] <= page.end[page.up[i]]


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 4 else 4)
    if kind < 4:
        return [rng.randint(-5, 5), rng.choice(['a"b', "c\\", "{[", "]}'", "é\n"]), None, rng.random()][kind]
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(['k', '"', "}", "a'"]) + str(i): value(rng, depth + 1) for i in range(rng.randrange(4))}


def test_scanner_against_json():
    rng = random.Random(4)
    for _ in range(500):
        v = [value(rng)] if rng.random() < 0.5 else {"a": value(rng)}
        text = json.dumps(v, ensure_ascii=rng.random() < 0.5)
        stop = state.closing(text + rng.choice(["", ";x={}", "}]", " 'q'"]))
        assert text[:stop] == text
        assert state.closing(text[:-1]) == -1
        quoted = json.dumps(text)
        assert state.literal(quoted + " tail") == text
        assert state.literal("'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'") == text
    assert state.closing('{"a') == -1 and state.literal("'open") is None and state.literal(r"'\x41é\q'") == "Aéq"


def test_hydration_of_graphs():
    root = state.hydrated([{"data": 1, "self": 0, "n": -1}, [2, 2, 9], {"type": 3, "up": 1}, "product"])
    assert root["self"] is root and root["n"] == -1 and root["data"][0] is root["data"][1] and root["data"][2] is None
    assert root["data"][0]["type"] == "product" and root["data"][0]["up"] is root["data"]
    deep = state.hydrated([[i + 1] for i in range(50_000)] + ["end"])
    for _ in range(50_000):
        deep = deep[0]
    assert deep == "end" and state.hydrated([]) is None


def test_state_products():
    items = [{"name": f"Baby cereal {i}", "size": "200 g", "price": {"current": {"amount": i + 1.5, "currency": "usd"}, "was": 99}, "media": [{"url": f"/i/{i}.jpg"}],
              "links": {"canonical": f"/p/{i}"}, "brand": {"name": "HiPP"}} for i in range(3)]
    loop = {"props": {"items": [*items, items[0], {"name": "No price here", "url": "/p/9"}, {"name": "Was only", "wasPrice": 4, "url": "/p/8"}]}}
    text = json.dumps(loop)
    pad = "/*" + "x" * 200 + "*/"
    for script in (f'<script type="application/json">{text}</script>', f"<script>{pad}window.__STATE__ = {text}; var z='}}';</script>",
                   f"<script>{pad}window.pageData = JSON.parse({json.dumps(text)})</script>"):
        found = state.products(state.blobs(markup.Page(script)), BASE)
        assert sorted((p["title"], p["url"], p["image"], p["price"], p["currency"], p["brand"]) for p in found) == [
            (f"Baby cereal {i} 200 g", f"https://shop.example/p/{i}", f"https://shop.example/i/{i}.jpg", i + 1.5, "usd", "HiPP") for i in range(3)
        ]
    assert state.price_in({"price": "$4.20", "currency": "CAD"}) == ("$4.20", "CAD") and state.price_in({"value": 3}) is None
    assert state.price_in({"cost": {"value": 3}}) is None and state.price_in({"amount": {"value": 3}}) == (3.0, None)


def test_linked_data():
    ld = {"@type": ["Thing", "Product"], "name": " Jar  x ", "@id": "/p/1", "image": [{"contentUrl": "/a.jpg"}], "countryOfOrigin": {"name": "Germany"}, "sku": 7,
          "offers": {"offers": [{"priceCurrency": "x"}, {"lowPrice": "1,299.50", "priceCurrency": "eur", "availability": "https://schema.org/InStock"}]}}
    html = f'<script type="application/ld+json">{json.dumps(ld)[:-1]},}}</script>'
    p, = pages.ld_products(html, BASE)
    assert (p["title"], p["url"], p["image"], p["price"], p["currency"], p["availability"], p["origin"], p["sku"]) == (
        "Jar x", "https://shop.example/p/1", "https://shop.example/a.jpg", 1299.5, "EUR", "InStock", "Germany", "7")


def test_listing_precedence(spark):
    ld = [{"@type": "Product", "name": f"Linked {i}", "url": f"/l/{i}", "offers": {"price": i + 1}} for i in range(4)]
    linked = lambda n: f'<script type="application/ld+json">{json.dumps(ld[:n])}</script>'
    data = json.dumps({"list": [{"title": f"Stated {i}", "price": "$2.50", "url": f"/s/{i // 2}", "pad": "x" * 99} for i in (0, 0, 1, 2)]})
    stated = f'<script type="application/json">{data}</script>'
    rows = [(1, BASE, linked(4) + stated + grid(5)), (2, BASE, linked(2) + stated + grid(5)), (3, BASE, linked(2) + grid(5)), (4, BASE, linked(2) + grid(1)),
            (5, None, None), (6, BASE, ""), (7, BASE, grid(2))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = storefronts.listing(df).orderBy("page_id", "pos").collect()
    ways = {}
    for r in got:
        ways.setdefault(r["page_id"], []).append((r["way"], r["title"]))
    assert {k: (v[0][0], len(v)) for k, v in ways.items()} == {1: (0, 4), 2: (1, 3), 3: (2, 5), 4: (0, 2), 7: (2, 2)}
    card = next(r for r in got if r["page_id"] == 7)
    assert (card["price"], card["originalPrice"], card["currency"], card["pos"]) == (1.25, 9.5, "USD", 0)
    state_row = next(r for r in got if r["page_id"] == 2)
    assert (state_row["price"], state_row["currency"], state_row["originalPrice"]) == (2.5, "USD", None)
    caps = spark.createDataFrame([("walmart", "us", BASE, grid(3)), ("farmae", "it", BASE, linked(3)), ("other", "us", BASE, grid(3)), ("farmae", "it", BASE, linked(3))],
                                 "source string, market string, url string, payload string")
    got = sorted((r["source"], r["market"], r["title"], r["price"], r["currency"], r["seller"], r["kind"]) for r in storefronts.read(caps).collect())
    assert got[0] == ("farmae", "it", "Linked 0", 1.0, "EUR", "Farmaè", "shop") and len(got) == 9 and got[-1] == ("walmart", "us", "Oat porridge 2", 3.25, "USD", "Walmart", "shop")


def test_sections_by_label_and_heading():
    text = "Thành phần sản phẩm: gạo, sữa. Xem thêm tại đây\nHDSD\nBảo quản\nNơi khô ráo, thoáng mát và tránh ánh nắng trực tiếp của mặt trời\nMua ngay\nXuất xứ: Nước Đức"
    got = sections.sections_of(text)
    assert got == {"ingredients": "gạo, sữa.", "storage": "Nơi khô ráo, thoáng mát và tránh ánh nắng trực tiếp của mặt trời", "origin": "Nước Đức"}
    headed = "Các thành phần chính có trong bột\nBột gạo, đường, sữa bột\nvà dầu cọ\nHow to prepare the porridge\nStir 20 g into 100 ml of warm water."
    assert sections.sections_of(headed) == {"ingredients": "Bột gạo, đường, sữa bột và dầu cọ", "usage": "Stir 20 g into 100 ml of warm water."}
    assert sections.sections_of("Suitable for: everyone\n") == {} and sections.sections_of("Suitable for: from 6 months") == {"age": "from 6 months"}
    assert sections.sections_of(None) == {} and sections.sections_of("Zutaten: " + "Hafer, " * 200)["ingredients"].endswith("…")
    assert sections.sections_of("原材料名：米、砂糖、食塩\n保存方法：冷暗所で保存") == {"ingredients": "米、砂糖、食塩", "storage": "冷暗所で保存"}


def test_product_page_fields(spark):
    faq = {"@type": "FAQPage", "mainEntity": [{"@type": "Question", "name": "q", "acceptedAnswer": {"text": "Dạ chào mẹ, thành phần gồm: bột gạo lứt hữu cơ, sữa. Shop cảm ơn mẹ."}},
                                             {"@type": "Question", "acceptedAnswer": [{"text": "<p>Bảo quản nơi khô ráo nhé.</p>"}]}]}
    info = {"product": {"title": "storage", "content": {"x": "Keep cool after opening", "url": "/no"}}, "i18n": {"ingredients": "Label of ingredients"}, "pad": "y" * 200,
            "details": {"ingredients": ["Oats (60 %)", "milk"], "countryOfOrigin": "{country}", "ingredientsTitle": "Ingredients title"}}
    ld = {"@type": "Product", "name": "Porridge", "offers": {"price": 4.5, "priceCurrency": "eur"}, "countryOfOrigin": "Germany"}
    full = (f'<html><head><title>Page</title><meta property="og:title" content="Meta"><script type="application/ld+json">{json.dumps(ld)}</script>'
            f'<script type="application/ld+json">{json.dumps(faq)}</script><script type="application/json">{json.dumps(info)}</script></head>'
            "<body><header>Zutaten: none of these</header><main><h1>Head</h1><p>Ingredients: page text<p>Directions: stir well<br>Best before: see lid</main></body></html>")
    meta = ('<meta property="og:title" content=" Meta  title "><meta property="og:price:amount" content="12.50"><meta property="og:price:currency" content="usd">'
            '<meta name="description" content="About it"><meta property="og:image" content="/i.jpg"><h1>Head</h1>')
    marked = '<h1> Head <b>line</b></h1><div class="price old">$ 9</div><span itemprop="price" content="7,90 €">x</span><div class="price">$ 8</div>'
    classed = '<title>T</title><div class="price-was">$ 9</div><div class="Price now">only $ 8.10</div>'
    rows = [(1, BASE, full), (2, BASE, meta), (3, BASE, marked), (4, BASE, classed), (5, None, None)]
    got = {r["page_id"]: r for r in product_pages.details(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    r = got[1]
    assert (r["title"], r["price"], r["currency"], r["origin"]) == ("Porridge", 4.5, "EUR", "Germany")
    assert r["sections"] == {"ingredients": "Oats (60 %), milk", "storage": "Keep cool after opening", "usage": "stir well", "expiry": "see lid", "origin": "Germany"}
    r = got[2]
    assert (r["title"], r["price"], r["currency"], r["description"], r["image"]) == ("Meta title", 12.5, "USD", "About it", "https://shop.example/i.jpg")
    assert (got[3]["title"], got[3]["price"], got[3]["currency"]) == ("Head line", 7.9, "EUR")
    assert (got[4]["title"], got[4]["price"], got[4]["currency"]) == ("T", 8.1, "USD")
    assert (got[5]["title"], got[5]["price"], got[5]["sections"]) == (None, None, {})
    only_faq = product_pages.detail(f'<script type="application/ld+json">{json.dumps(faq)}</script>', None)["sections"]
    assert only_faq == {"ingredients": "bột gạo lứt hữu cơ, sữa.", "storage": "Bảo quản nơi khô ráo nhé."}
    assert product_pages.unglued("cho béHướng dẫn 5gBột") == "cho bé\nHướng dẫn 5g\nBột"
