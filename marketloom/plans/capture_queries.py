"""Registered queries of the JSON connectors: parts become the answers of every source, and the readers give the parts back."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import dealt, table
from ..sources import captures, cards
from ..sources.site_search import site_rows as site_search_rows
from .queries import query

PER_PAGE = 20


@dataclass(frozen=True)
class Answer:
    """One source's answer: what stands around its records, a record, and SQL of what a record's row is.

    In records $K is the key, $R the key plus one, $N the title, $B the brand, $P the price, $W the price before, $C that in
    cents, $G a barcode.  Fields that are not named are null.
    """

    source: str
    market: str
    start: str
    record: str
    end: str
    row: dict[str, str]
    #: State objects are found from the last one on.
    backwards: bool = False


_RATED = {"rating": "4.5", "reviews": "k + 1"}
_FULL = {"title": "n", "price": "p", "original_price": "w", "brand": "b", "gtin": "g", **_RATED}


def _shop(url: str, currency: str, seller: str, *without: str, **more: str) -> dict[str, str]:
    row = {**_FULL, "url": url, "currency": f"'{currency}'", "seller": seller, **more}
    return {name: value for name, value in row.items() if name not in without}


_DASHED_TITLE = "trim(regexp_replace(lower(b || ' ' || n), '[^a-z0-9]+', '-', 'g'), '-')"

ANSWERS = (
    Answer("tiki", "vn", '{"data":[', '{"name":"$N","url_key":"x$K","price":$P,"original_price":$W,"brand_name":"$B","seller_name":"s","rating_average":4.5,"review_count":$R,"quantity_sold":{"value":$R},"sku":"$G"}', "]}",
           _shop("'https://tiki.vn/x' || k || '.html'", "VND", "'s'", sold="k + 1")),
    Answer("naver", "kr", '{"items":[', '{"title":"<b>$N</b> &amp; co","link":"https://n.example/$K","lprice":"$P","maker":"$B","category1":"a","category3":"c"}', "]}",
           _shop("'https://n.example/' || k", "KRW", "'Naver Shopping'", "original_price", "gtin", "rating", "reviews", title="n || ' & co'", snippet="'a > c'")),
    Answer("gshop", "us", '{"shopping":[', '{"title":"$N","link":"https://g.example/$K","price":"$$P","source":"g","rating":4.5,"ratingCount":$R}', "]}",
           {"title": "n", "url": "'https://g.example/' || k", "price_text": "'$' || t", "seller": "'g'", **_RATED}),
    Answer("google", "us", '{"organic":[', '{"title":"$N","link":"https://g.example/$K","snippet":"$B","priceRange":"$$P"}', "]}",
           {"title": "n", "url": "'https://g.example/' || k", "snippet": "b", "price_text": "'$' || t"}),
    Answer("searxng", "us", '{"results":[', '{"title":"$N","url":"https://x.example/$K","content":"now €$P only"}', "]}",
           {"title": "n", "url": "'https://x.example/' || k", "snippet": "'now €' || t || ' only'", "price_text": "'€' || t"}),
    Answer("brave", "us", '{"web":{"results":[', '{"title":"<strong>$N</strong>","url":"https://x.example/$K","description":"$B","product":{"price":"$P"}}', "]}}",
           {"title": "n", "url": "'https://x.example/' || k", "snippet": "b", "price_text": "t"}),
    Answer("target", "us", '{"data":{"search":{"products":[', '{"item":{"product_description":{"title":"$N"},"enrichment":{"buy_url":"https://t.example/$K"},"primary_brand":{"name":"$B"},"primary_barcode":"$G"},"price":{"current_retail":$P,"reg_retail":$W},"ratings_and_reviews":{"statistics":{"rating":{"average":4.5,"count":$R}}}}', "]}}}",
           _shop("'https://t.example/' || k", "USD", "'Target'")),
    Answer("woolworths", "au", '{"Products":[{"Products":[', '{"DisplayName":"$N","Stockcode":$K,"UrlFriendlyName":"x","Brand":"$B","InstorePrice":$P,"Price":null,"WasPrice":$W,"Barcode":"$G"}', ']},{"Products":null},{}]}',
           _shop("'https://www.woolworths.com.au/shop/productdetails/' || k || '/x'", "AUD", "'Woolworths'", "rating", "reviews", "original_price")),
    Answer("dm", "de", '{"products":[', '{"title":"$N","brandName":"$B","gtin":$K,"tileData":{"self":"/p$K.html","price":{"price":{"current":{"value":$P}}},"title":{"subheadline":"$B"},"rating":{"ratingValue":4.5,"ratingCount":$R}}}', "]}",
           _shop("'https://www.dm.de/p' || k || '.html'", "EUR", "'dm'", "original_price", title="b || ' ' || n", gtin="CAST(k AS VARCHAR)", snippet="b")),
    Answer("fairprice", "sg", '{"data":{"product":[', '{"name":"$N","slug":"x-$K","brand":{"name":"$B"},"final_price":"$P","storeSpecificData":[{"mrp":"$W","discount":"5"}],"barcodes":["$G","1"]}', "]}}",
           _shop("'https://www.fairprice.com.sg/product/x-' || k", "SGD", "'FairPrice'", "rating", "reviews")),
    Answer("kurly", "kr", '{"data":{"listSections":[{"view":1},{"data":{"items":[', '{"no":$K,"name":" $N ","salesPrice":$W,"discountedPrice":$P,"reviewCount":"$R+"}', "]}}]}}",
           _shop("'https://www.kurly.com/goods/' || k", "KRW", "'Kurly'", "brand", "gtin", "rating")),
    Answer("prenatal", "it", '{"hits":[', '{"title":"$N","permalink":"https://p.example/$K","analytics_item":{"price":"$P"},"regular_price":{"min":$C},"form":{"ean":"$G","brand":{"name":"$B"}},"average_rating":4.5,"rating_count":$R,"total_sales":$R}', "]}",
           _shop("'https://p.example/' || k", "EUR", "'Prenatal'", sold="k + 1")),
    Answer("efarma", "it", '{"hits":[', '{"name":"$N","url":"https://e.example/$K","price":{"EUR":{"default":$P,"default_original":"$W"}},"manufacturer":"$B","ean":"$G","rating_summary":90,"rating_count":$R,"total_ordered":"$R.4"}', "]}",
           _shop("'https://e.example/' || k", "EUR", "'eFarma'", sold="k + 1")),
    Answer("boots", "gb", '{"hits":[', '{"offerName":"$N","actionURL":"/x-$K","currentPrice":$P,"regularPrice":$W,"brand":"$B","upc":"$G","numberOfReviews":$R,"averageReviewScore":4.51,"ppuVolume":"a","pricePerUnit":"b"}', "]}",
           _shop("'https://www.boots.com/x-' || k", "GBP", "'Boots'", snippet="'a · b'")),
    Answer("sainsburys", "gb", '{"products":[', '{"name":"$N","full_url":"http://s.example/$K","retail_price":{"price":$P},"promotions":[{"original_price":$W}],"eans":["$G"],"reviews":{"average_rating":4.5,"total":$R}}', "]}",
           _shop("'https://s.example/' || k", "GBP", "'Sainsbury''s'", "brand")),
    Answer("11st", "kr", '{"data":[{"items":[', '{"id":"$K","title":"$N","finalPrc":$P,"selPrc":$W,"brandEngNm":"$B","satisfactionScore":4.5,"reviewCountText":"($R)","saleCnt":$R,"sellerNickName":"m"},{"id":"$K","title":"again","finalPrc":1},{"id":"a$K","title":"$N","finalPrc":1,"adProduct":true}', "]}]}",
           _shop("'https://www.11st.co.kr/products/' || k", "KRW", "'11번가 · m'", "gtin", sold="k + 1")),
    Answer("asda", "gb", '{"hits":[', '{"NAME":"$N","CIN":"$K","BRAND":"$B","PRIMARY_TAXONOMY":{"AISLE_NAME":"Baby & Food"},"PRICES":{"EN":{"PRICE":$P}},"AVG_RATING":4.5,"RATING_COUNT":$R,"PACK_SIZE":"2x"}', "]}",
           _shop(f"'https://www.asda.com/groceries/product/baby-food/' || {_DASHED_TITLE} || '/' || k", "GBP", "'Asda'", "original_price", "gtin", title="b || ' ' || n", snippet="'2x'")),
    Answer("shoppers", "ca", '<html><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"viewDefinitionResults":{"viewDefinition":{"layout":{"sections":{"mainContentCollection":{"components":[{"data":{}},{"data":{"productTiles":[',
           '{"productId":"$K","title":"$N","link":"/p/$K?a=b","pricing":{"price":$P},"brand":"$B","ratings":{"average_rating":4.5,"review_count":$R},"pricingUnits":{"unit":"ea"}},{"productId":"$K","title":"again","link":"/q"}', "]}}]}}}}}}}}</script></html>",
           _shop("'https://shop.shoppersdrugmart.ca/p/' || k", "CAD", "'Shoppers Drug Mart'", "original_price", "gtin", snippet="'ea'")),
    Answer("lotteon", "kr", "<html><script>var x = [", '{"brazeData":{"spdNo":"$K","spdNm":"$N","price":$W,"discountPrice":$P,"brandName":"$B","reviewScore":4.5,"reviewCount":$R}},{"brazeData":{"spdNo":"$K","spdNm":"again"}}', "];</script>",
           _shop("'https://www.lotteon.com/p/product/' || k", "KRW", "'Lotte ON'", "gtin")),
    Answer("lazada", "sg", '{"mods":{"listItems":[', '{"name":"$N","itemUrl":"//www.lazada.sg/products/i$K.html?x=1","price":"$P","originalPrice":"$W","brandName":"$B","sellerName":"s","ratingScore":"4.5","review":"$R","itemSoldCntShow":"$R sold"}', "]}}",
           _shop("'https://www.lazada.sg/products/i' || k || '.html'", "SGD", "'s'", "gtin", sold="k + 1")),
    Answer("off", "de", '{"hits":[', '{"code":"$G","product_name":"$N","product_name_en":"other","brands":["$B, x"],"generic_name":"g"}', "]}",
           {"title": "n", "url": "'https://world.openfoodfacts.org/product/' || g", "brand": "b", "snippet": "'g'", "gtin": "g"}),
)

#: Columns of the query, by the reader's names.
SHOWN = {
    "title": "title", "url": "url", "price": "price", "price_text": "price_text", "currency": "currency", "original_price": "originalPrice",
    "brand": "brand", "seller": "seller", "rating": "rating", "reviews": "reviews", "sold": "sold", "gtin": "gtin", "snippet": "snippet",
}


def _filled(record: str) -> Column:
    """A record's text with a part's values in the places of its marks."""
    key, price = F.col("p_partkey"), F.round("p_retailprice", 2)
    values = {
        "$K": key.cast("string"), "$R": (key + 1).cast("string"), "$N": F.concat("p_name", F.lit(" "), key.cast("string")), "$B": F.col("p_brand"),
        "$P": F.format_string("%.2f", price), "$W": F.format_string("%.2f", price + 5), "$C": F.round((price + 5) * 100).cast("long").cast("string"),
        "$G": F.lpad((key + 1).cast("string"), 13, "0"),
    }
    return F.concat(*(values.get(piece, F.lit(piece)) for piece in re.split(r"(\$[KRNBPWCG])", record) if piece))


def answers(part: DataFrame, of: tuple[Answer, ...] = ANSWERS) -> DataFrame:
    """captures(page_id, source, market, payload): each page of parts as one source's answer, the sources in turn."""
    page = F.floor(F.col("p_partkey") / PER_PAGE)
    turn = page % len(of)

    def by_turn(values: list[Column]) -> Column:
        out = F.when(F.col("turn") == 0, values[0])
        for i, value in enumerate(values[1:], 1):
            out = out.when(F.col("turn") == i, value)
        return out

    rows = part.select("*", page.alias("page_id"), turn.alias("turn"))
    rows = rows.select("page_id", "turn", "p_partkey", by_turn([_filled(a.record) for a in of]).alias("record"))
    pages = rows.groupBy("page_id", "turn").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "record"))).alias("records"))
    payload = F.concat(by_turn([F.lit(a.start) for a in of]), F.array_join("records.record", ","), by_turn([F.lit(a.end) for a in of]))
    names = {name: by_turn([F.lit(getattr(a, name)) for a in of]).alias(name) for name in ("source", "market")}
    return pages.select("page_id", names["source"], names["market"], payload.alias("payload"))


_PARTS = f"""p AS (SELECT p_partkey AS k, p_partkey // {PER_PAGE} AS page_id, p_name || ' ' || p_partkey AS n, p_brand AS b, round(p_retailprice, 2) AS p,
round(round(p_retailprice, 2) + 5, 2) AS w, printf('%.2f', round(p_retailprice, 2)) AS t, lpad(CAST(p_partkey + 1 AS VARCHAR), 13, '0') AS g,
row_number() OVER (PARTITION BY p_partkey // {PER_PAGE} ORDER BY p_partkey) - 1 AS pos, count(*) OVER (PARTITION BY p_partkey // {PER_PAGE}) AS size FROM part)"""

_KINDS = {"price": "DOUBLE", "original_price": "DOUBLE", "rating": "DOUBLE", "reviews": "BIGINT", "sold": "BIGINT", "rank": "INT"}


def _rows_sql(of: tuple[Answer, ...] = ANSWERS, shown: dict[str, str] = SHOWN) -> str:
    """SQL of the rows of all sources: one CASE a column, by whose turn the page is."""

    def column(name: str) -> str:
        cases = " ".join(f"WHEN {i} THEN {a.row[name]}" for i, a in enumerate(of) if name in a.row)
        return f"CAST(CASE page_id % {len(of)} {cases} END AS {_KINDS.get(name, 'VARCHAR')}) AS {name}"

    names = " ".join(f"WHEN {i} THEN '{a.source}'" for i, a in enumerate(of))
    turned = ", ".join(["-1", *(str(i) for i, a in enumerate(of) if a.backwards)])
    place = f"CAST(CASE WHEN page_id % {len(of)} IN ({turned}) THEN size - 1 - pos ELSE pos END AS INT)"
    return f"SELECT page_id, CASE page_id % {len(of)} {names} END AS source, {place} AS pos, {', '.join(map(column, shown))} FROM p"


def _shown(shown: dict[str, str] = SHOWN) -> list[Column]:
    money = ("price", "originalPrice")
    return [(F.round(reader, 2) if reader in money else F.col(reader)).alias(name) for name, reader in shown.items()]


@query(f"WITH {_PARTS} {_rows_sql()}")
def captured_rows(spark, d):
    """The parts, read back from the JSON answers of twenty-one sources in one pass."""
    asked = answers(table(spark, d, "part")).select("source", "market", "payload", F.col("page_id").alias("query"), F.lit(0).alias("page"))
    rows = captures.read_pages(asked)
    return rows.select(F.col("query").alias("page_id"), "source", "pos", *_shown())


@query(f"""WITH q AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, o_orderkey % 3 AS u, o_totalprice FROM orders),
r AS (SELECT o_custkey AS query, i // 4 AS page, i % 4 AS pos, 'https://n.example/' || o_custkey || '/' || u AS url, o_totalprice AS price FROM q)
SELECT query, url, CAST(arg_min(page, [page, pos]) AS INT) AS page, CAST(arg_min(pos, [page, pos]) AS INT) AS pos, arg_min(price, [page, pos]) AS price FROM r GROUP BY query, url""")
def paged_captures(spark, d):
    """A search's rows over all its pages, one for each url, the first by page and position.

    A customer is a search, the customer's orders its rows, four a page.
    """
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    orders = dealt(orders, orders.count(), "o_custkey")
    link = F.concat(F.lit("https://n.example/"), F.col("o_custkey").cast("string"), F.lit("/"), (F.col("o_orderkey") % 3).cast("string"))
    record = F.struct(F.lit("x").alias("title"), link.alias("link"), F.col("o_totalprice").alias("lprice"))
    # records are made after the sort
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    found = orders.withColumn("i", place).select("o_custkey", "i", record.alias("record"))
    pages = found.groupBy("o_custkey", F.floor(F.col("i") / 4).cast("int").alias("page")).agg(F.array_sort(F.collect_list(F.struct("i", "record"))).alias("records"))
    payload = F.to_json(F.struct(F.col("records.record").alias("items")))
    asked = pages.select(F.lit("naver").alias("source"), F.lit("kr").alias("market"), F.col("o_custkey").alias("query"), "page", payload.alias("payload"))
    return captures.read_pages(asked, ("price",)).select("query", "url", "page", "pos", "price")


_HOST_OF = r"regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '')"


@query(rf"""WITH r AS (SELECT page_id, url, {_HOST_OF} AS host, CASE page_id % 2 WHEN 0 THEN 'us' ELSE 'de' END AS market, (page_id // 2) % 40 AS query,
  CASE (page_id // 80) % 3 WHEN 0 THEN 'serper' WHEN 1 THEN 'ddg' ELSE 'bing' END AS provider, (page_id // 80) % 3 AS priority FROM pages),
k AS (SELECT * FROM r WHERE CASE market WHEN 'us' THEN host = 'example.com' OR host LIKE '%.example.com' ELSE host = 'example.net' OR host LIKE '%.example.net' END),
a AS (SELECT DISTINCT market, query, provider, priority, priority = 0 AND query % 10 = 0 AS keyed FROM r),
c AS (SELECT market, query, min(priority) AS priority FROM a WHERE keyed OR EXISTS (SELECT 1 FROM k WHERE k.market = a.market AND k.query = a.query AND k.provider = a.provider) GROUP BY ALL)
SELECT market, query, url, min(page_id) AS page_id, any_value(regexp_replace(host, '^(www|shop|shopping|groceries|tienda|supermercado|courses)\.', '')) AS seller,
'$' || min(page_id) || '.50' AS price_text FROM k SEMI JOIN c USING (market, query, priority) GROUP BY market, query, url""")
def site_search(spark, d):
    """S43, J10, I6, O-U9: pages as the answers of three engines to forty searches in two markets, restricted to a site each."""
    page = F.col("page_id")
    turn = F.floor(page / 80) % 3
    rows = table(spark, d, "pages").select(
        F.when(page % 2 == 0, "us").otherwise("de").alias("market"), (F.floor(page / 2) % 40).alias("query"), turn.alias("priority"),
        F.when(turn == 0, "serper").when(turn == 1, "ddg").otherwise("bing").alias("provider"), "url", page.alias("pos"), "page_id",
        F.lit("Jar").alias("title"), F.concat(F.lit("for $"), page.cast("string"), F.lit(".50 each")).alias("snippet"), F.lit("").alias("price_text"),
    )
    answers = rows.select("market", "query", "provider", "priority", ((F.col("priority") == 0) & (F.col("query") % 10 == 0)).alias("keyed")).distinct()
    sites = spark.createDataFrame([("us", "example.com"), ("de", "example.net")], "market string, site string")
    return site_search_rows(answers, rows.drop("priority"), sites).select("market", "query", "url", "page_id", "seller", "price_text")


_DASHED_NAME = "trim(regexp_replace(lower(n), '[^a-z0-9]+', '-', 'g'), '-')"
_STATE = '<script type="application/json">{"pad":"' + "x" * 200 + '","l":['


def _page(source: str, market: str, record: str, *, start: str = "<html><body>", end: str = "</body></html>", **row: str) -> Answer:
    return Answer(source, market, start, record, end, {"title": "n", **row}, backwards=start == _STATE)


#: The same for result pages in markup and in state objects.
PAGES = (
    _page("amazon", "de", '<div data-component-type="s-search-result" data-asin="B$K"><h2 aria-label="Gesponserte Anzeige – $N"><span>x</span></h2><span class="a-price a-text-price"><span class="a-offscreen">€$W</span></span><span class="a-price"><span class="a-offscreen">€$P</span></span><span class="a-icon-alt">4,5 von 5 Sternen</span><a aria-label="all ratings">$R</a><span>2K+ gekauft</span></div>',
          url="'https://www.amazon.de/dp/B' || k", price_text="'€' || t", original_price="w", currency="'EUR'", seller="'Amazon'", sold="2000", **_RATED),
    _page("aldiuk", "gb", '<div class="product-tile" title="Alt"><a href="/product/$K"></a><p class="product-tile__brandname">$B</p><div class="product-tile__name">$N</div><b class="product-tile__unit-of-measurement">5 x 20g</b><i class="base-price__regular">£$P</i><i class="base-price__was-price">£$W</i><i class="product-tile__comparison-price">£1/KG</i></div>',
          title="b || ' ' || n || ' 5 x 20g'", brand="b", url="'https://www.aldi.co.uk/product/' || k", price_text="'£' || t", original_price="w", currency="'GBP'", seller="'Aldi UK'", snippet="'£1/KG'"),
    _page("kroger", "us", '<div class="ProductCard" aria-label="$N"><a href="/p/x/$G?y=1">g</a><data data-testid="product-item-unit-price">now $$P was $$W</data><i data-testid="product-item-sizing">1 oz</i></div>',
          url="'https://www.kroger.com/p/x/' || g", gtin="g", price_text="'$' || t", currency="'USD'", seller="'Kroger'", snippet="'1 oz'"),
    _page("rakuten", "jp", '<div class="x searchresultitem" data-card-type="item" data-track-price="$P"><a href="https://item.rakuten.co.jp/s/$K/?l=2"><img alt="$N" src="r.jpg"></a><div class="review-1">4.5 ($R件)</div><div class="merchant-x"><a>s</a></div></div>',
          url="'https://item.rakuten.co.jp/s/' || k || '/'", price_text="t", currency="'JPY'", seller="'Rakuten · s'", **_RATED),
    _page("shopee", "vn", '<a href="/x-i.1.$K?sp=1"><img alt="$N" src="https://cf.shopee.vn/a"><div><span>₫</span><span>$P</span></div><div>4.5</div><div>Đã bán $R</div></a><a href="/again-i.1.$K">₫ 1.000</a>',
          url="'https://shopee.vn/x-i.1.' || k", price_text="t || '₫'", currency="'VND'", seller="'Shopee'", rating="4.5", sold="k + 1"),
    _page("auchan", "fr", '<article itemtype="http://schema.org/Product"><a class="productThumbnailLink" href="/x/pr-$K"><picture><source alt="$N"></picture></a><meta itemprop="ratingValue" content="4.5"><meta itemprop="reviewCount" content="$R"><div class="price">2,50 €/kg</div><div class="product-price">$P €</div></article>',
          url="'https://www.auchan.fr/x/pr-' || k", price_text="t || ' €'", currency="'EUR'", seller="'Auchan'", **_RATED),
    _page("chronodrive", "fr", '<article class="product-card" aria-label="$N"><a class="card-content-link" href="/p/$K">x</a><span class="product-actions-value">$P €</span></article>',
          url="'https://www.chronodrive.com/p/' || k", price_text="t || ' €'", currency="'EUR'", seller="'Chronodrive'"),
    _page("leclerc", "fr", '<article data-product-card data-ean="$G"><a href="/fp/$K" title="$N">x</a><span class="p-small">$B</span><div currency="EUR">$P €</div></article>',
          url="'https://www.e.leclerc/fp/' || k", price_text="t || ' €'", currency="'EUR'", brand="b", gtin="g", seller="'E.Leclerc'"),
    _page("rewe", "de", '<div class="product-tile"><a href="/shop/p/$K">x</a><h4>$N</h4><b class="grammage">1 St.</b><div class="base-price">1 kg = 8,00 €</div><div class="priceBox">$P €</div><div class="product-tile__more"><a href="/shop/p/$K">x</a><h4>Again</h4></div></div>',
          title="n || ' 1 St.'", url="'https://shop.rewe.de/shop/p/' || k", price_text="t || ' €'", currency="'EUR'", seller="'REWE'"),
    _page("bingshop", "us", '<div class="offer"><a class="br-titlelink" href="/ck/$K"><div><div class="br-title"><span title="$N">x</span></div></div></a><img src="o.jpg"><div class="pd-price">$$P</div><del>$$W</del><span class="br-sellerName">s + 3 more</span><i aria-label="4,5 star rating"></i></div>',
          url="'https://www.bing.com/ck/' || k", price_text="'$' || t", original_price="w", currency="'USD'", seller="'s'", rating="4.5"),
    _page("bestsellers", "it", '<div id="gridItemRoot"><span class="zg-bdg-text">#$R</span><div data-asin="B$K"><img alt="$N" src="b.jpg"></div><span class="x_p13n-sc-price_y">€$P</span><div class="a-icon-row"><span class="a-icon-alt">4,5 su 5</span><span class="a-size-small">$R</span></div></div>',
          url="'https://www.amazon.it/dp/B' || k", price_text="'€' || t", currency="'EUR'", seller="'Amazon'", rank="k + 1", **_RATED),
    _page("bing", "vn", '<li class="b_algo"><h2><a href="https://x.example/$K">$N</a></h2><div class="b_caption"><p>12 thg 3, 2024 · now €$P only</p></div></li>',
          start="<ol>", end="</ol>", url="'https://x.example/' || k", snippet="'now €' || t || ' only'", price_text="'€' || t"),
    _page("ddg", "us", '<tr><td><a class="result-link" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fx.example%2F$K&rut=1">$N</a></td></tr><tr><td class="result-snippet">of $B</td></tr>',
          start="<table>", end="</table>", url="'https://x.example/' || k", snippet="'of ' || b"),
    _page("tesco", "gb", '{"title":"$N","id":$R,"defaultImageUrl":"https://t/i.jpg","price":{"actual":$P},"href":"/x/y$K"}', start=_STATE, end="]}</script>",
          url="'https://www.tesco.com/groceries/en-GB/products/' || (k + 1)", price_text="CAST(p AS VARCHAR)", currency="'GBP'", seller="'Tesco'"),
    _page("waitrose", "gb", '{"name":"$N","id":"$R-x","thumbnail":"https://t/i.jpg","price":{"actual":$P},"href":"/x/y$K"}', start=_STATE, end="]}</script>",
          url=f"'https://www.waitrose.com/ecom/products/' || {_DASHED_NAME} || '/' || (k + 1) || '-x'", price_text="CAST(p AS VARCHAR)", currency="'GBP'", seller="'Waitrose'"),
    _page("morrisons", "gb", '{"name":"$N","retailerProductId":"$R","image":{"src":"https://t/i.jpg"},"price":{"actual":$P},"href":"/x/y$K"}', start=_STATE, end="]}</script>",
          url=f"'https://groceries.morrisons.com/products/' || {_DASHED_NAME} || '/' || (k + 1)", price_text="CAST(p AS VARCHAR)", currency="'GBP'", seller="'Morrisons'"),
)
_PAGE_SHOWN = {name: reader for name, reader in SHOWN.items() if name != "price"} | {"rank": "rank"}


@query(f"WITH {_PARTS} SELECT * EXCLUDE (page_id) FROM ({_rows_sql(PAGES, _PAGE_SHOWN)})")
def result_page_rows(spark, d):
    """The parts, read back from the result pages of sixteen sources."""
    asked = answers(table(spark, d, "part"), PAGES)
    rows = cards.read(asked)
    return rows.select("source", "pos", *_shown(_PAGE_SHOWN))
