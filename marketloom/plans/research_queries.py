"""Registered queries of candidates, watch lists, lookups and exports, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .. import lexicon as L
from ..operators import candidates as C
from ..operators import exports as E
from ..operators import tracking as W
from ..session import dealt, table
from ..sources import lookups
from .queries import _OFFERS, _SNAP, offers, query, snapshots


@query("""SELECT l_returnflag AS task,
count(*) FILTER (WHERE l_tax < 0.07 AND NOT (l_linestatus = 'O' AND l_discount * 5 < 0.3)) AS n,
count(*) FILTER (WHERE l_tax < 0.07 AND l_linestatus = 'O' AND l_discount * 5 < 0.3) AS hidden, count(*) FILTER (WHERE l_tax >= 0.07) AS off_form
FROM lineitem GROUP BY l_returnflag""")
def admission_counts(spark, d):
    """What a search task keeps, hides, and drops for its product form."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("task"), (F.col("l_discount") * 5).alias("relevance"), (F.col("l_tax") >= 0.07).alias("off_form"), "l_linestatus"
    )
    return C.task_counts(C.admission(rows, F.col("l_linestatus") == "O"), ["task"])


_MARKET = "CASE p_size % 4 WHEN 0 THEN 'us' WHEN 1 THEN 'de' WHEN 2 THEN 'jp' ELSE 'vn' END"


@query(f"""WITH p AS (SELECT p_partkey AS part, p_brand AS brand, p_type, p_name || CASE WHEN p_size % 2 = 0 THEN ' baby' ELSE '' END AS title, {_MARKET} AS market FROM part),
best AS (SELECT *, 0 AS f FROM p WHERE p_type = 'PROMO' AND market IN ('us', 'de') QUALIFY row_number() OVER (PARTITION BY market ORDER BY part) <= 10),
both_ AS (SELECT part, brand, title, market, f, 'shop' AS kind FROM best UNION ALL
  SELECT part, brand, title, market, 1, CASE p_type WHEN 'LARGE' THEN 'web' ELSE 'shop' END FROM p),
k AS (SELECT *, trim(regexp_replace(lower(brand || ' ' || title), '[^a-z0-9]+', ' ', 'g')) AS key FROM both_ WHERE kind <> 'web' AND market <> 'vn' AND (f = 0 OR title LIKE '%baby%')),
o AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY f, part) = 1)
SELECT part, market, f = 0 AS bestseller FROM o ORDER BY f, part LIMIT 80""")
def import_candidates(spark, d):
    """Best sellers first, then found rows, one a product."""
    p = table(spark, d, "part").select(
        F.col("p_partkey").alias("ord"), F.col("p_brand").alias("brand"), "p_type", F.expr(_MARKET).alias("market"), F.lit("").alias("gtin"),
        F.concat("p_name", F.when(F.col("p_size") % 2 == 0, " baby").otherwise("")).alias("title"), F.lit(None).cast("int").alias("age_months"),
        F.when(F.col("p_type") == "LARGE", "web").otherwise("shop").alias("kind"), F.lit("shop").alias("source"), F.lit("").alias("country"),
        F.lit(False).alias("non_food"),
    )
    best = p.where("p_type = 'PROMO'")
    found = C.import_candidates(p, best, ["us", "de"])
    return found.select(F.col("ord").alias("part"), "market", F.coalesce("bestseller", F.lit(False)).alias("bestseller"))


@query("SELECT p_partkey AS part, p_brand || ' ' || p_name || ' 10g' AS search FROM part")
def similar_search(spark, d):
    """The query that looks for products like one."""
    title = F.concat(F.upper("p_brand"), F.lit(" "), "p_name", F.lit(" (new) 10g - [x] pack"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("part"), C.similar_query(F.col("p_brand"), title).alias("search"))


@query("""WITH b AS (SELECT p_partkey AS part, p_name, p_brand, p_size % 4 AS k FROM part)
SELECT part, CASE k WHEN 0 THEN p_brand WHEN 1 THEN 'Cold Farm' WHEN 2 THEN split_part(p_name, ' ', 1) END AS brand FROM b WHERE k <> 3""")
def best_seller_brands(spark, d):
    """F26, R10, O-T25: what is no food goes, and each title's leading words give its brand."""
    title = F.expr("CASE p_size % 4 WHEN 0 THEN concat('【', p_brand, '】 ', p_name) WHEN 1 THEN concat('Cold Farm ', p_name) WHEN 2 THEN p_name ELSE concat(p_name, ' baby formula') END")
    pages = table(spark, d, "part").select(F.col("p_partkey").alias("part"), title.alias("title"), F.lit("Other").alias("brand"))
    return C.best_sellers(pages).select("part", "brand")


_SOURCE = "CASE page_id % 3 WHEN 0 THEN 'lazada' WHEN 1 THEN 'web' ELSE 'bing' END"


@query(f"""SELECT page_id, ({_SOURCE} <> 'lazada' AND NOT regexp_matches(url, '(?i)\\.(pdf|docx?|xlsx?)($|\\?)')) OR page_id % 5 = 0 AS fetchable FROM pages""")
def detail_candidates(spark, d):
    """rows whose detail page can be read, by reader, source, file kind and host."""
    pages = table(spark, d, "pages").withColumn("source", F.expr(_SOURCE))
    ok = C.fetchable(F.col("source"), F.col("url"), F.regexp_extract("url", "//([^/?#]+)", 1), F.col("page_id") % 5 == 0)
    return pages.select("page_id", ok.alias("fetchable"))


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query(f"""WITH s AS (SELECT DISTINCT c_mktsegment AS query FROM customer), m AS (SELECT unnest({_list(L.MODIFIERS)}) AS m)
SELECT query, trim(query || m) AS seed FROM s, m""")
def keyword_seeds(spark, d):
    """Every keyword with every modifier of a fixed list."""
    return C.seeds(table(spark, d, "customer").select(F.col("c_mktsegment").alias("query")).distinct())


@query("""SELECT c_name AS query, unnest([c_mktsegment, c_mktsegment || ' x', 'bé ' || c_mktsegment]) AS suggestion, unnest([1, 2, 3]) AS place FROM customer""")
def suggestion_union(spark, d):
    """Captured answers of two services, one for each folded text, in order."""
    c = table(spark, d, "customer").select(F.col("c_name").alias("query"), F.col("c_mktsegment").alias("s"))
    c = dealt(c, 5 * c.count(), "query")  # a query has five texts
    s = F.col("s")
    first = F.concat(F.lit("["), F.to_json(F.array("query")), F.lit(","), F.to_json(F.array(s, F.lower(s), F.concat(s, F.lit(" x")))), F.lit("]"))
    first = F.replace(first, F.concat(F.lit("["), F.to_json(F.array("query"))), F.concat(F.lit('["'), F.col("query"), F.lit('"')))
    second = F.to_json(F.array(F.struct(F.concat(s, F.lit(" X ")).alias("phrase")), F.struct(F.concat(F.lit("bé "), s).alias("phrase"))))
    captures = c.select("query", F.explode(F.array(
        F.struct(F.lit("google").alias("provider"), first.alias("payload")), F.struct(F.lit("ddg").alias("provider"), second.alias("payload"))
    )).alias("c")).select("query", "c.*")
    return C.suggestions(lookups.suggestion_answers(captures)).select("query", "suggestion", F.col("place").cast("int").alias("place"))


_RATES = {"result": "success", "rates": {"USD": 1, "VND": 25000, "EUR": 0.5}}


@query("""SELECT p_partkey AS part, CAST(floor(p_retailprice * CASE p_size % 3 WHEN 0 THEN 25000.0 WHEN 1 THEN 50000.0 END + 0.5) AS BIGINT) AS price_vnd FROM part""")
def live_rates(spark, d):
    """The last successful answer of the rate service, joined by currency; unknown currencies have no price."""
    captures = spark.createDataFrame([(1, '{"result": "error"}'), (0, json.dumps(_RATES))], "t int, payload string")
    currency = F.expr("CASE p_size % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'none' END")
    items = table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_retailprice").alias("price"), currency.alias("currency"))
    return lookups.in_dong(items, lookups.rates(captures)).select("part", "price_vnd")


@query(f"WITH {_SNAP} SELECT key, min(t) AS first_seen, max(t) AS last_seen, CAST(floor((max(t) - min(t)) / 86400000.0 + 0.5) AS BIGINT) AS tracked_days FROM snap GROUP BY key")
def tracked_since(spark, d):
    """First and last point of each listing."""
    return W.tracking(snapshots(spark, d), "key", "t")


@query(f"WITH {_SNAP}, s AS (SELECT key, t, value, event_id FROM snap WHERE t >= 1705276800000), e AS (SELECT key, min(value) AS low, max(value) AS high FROM s GROUP BY key)"
       " SELECT event_id, key, round(coalesce((value - low) / nullif(high - low, 0), 0), 6) AS y FROM s JOIN e USING (key) WHERE value IS NOT NULL")
def sparkline_points(spark, d):
    """The last 90 days of each listing, scaled between its least and most."""
    late = W.recent(snapshots(spark, d).select("event_id", "key", "t", "value"), "t", F.lit(1713052800000))
    return W.scaled(late, "key", "value").where("y is not null").select("event_id", "key", F.round("y", 6).alias("y"))


@query("""SELECT o_orderkey AS id, round(coalesce((nullif(o_totalprice, 0) - 100000) / 100000 * 100, 0), 6) AS change_percent,
CASE WHEN o_orderstatus <> 'P' AND o_custkey <> 0 THEN round((200000.0 - o_custkey) / 200000 * 100, 6) END AS margin_percent,
CASE WHEN o_orderstatus <> 'P' THEN round((200000.0 - o_totalprice) / nullif(o_totalprice, 0) * 100, 6) END AS vs_market_percent FROM orders""")
def watch_figures(spark, d):
    """Change since the first price, margin, and the planned price against the market."""
    target = F.when(F.col("o_orderstatus") != "P", F.lit(200000.0))
    watch = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.lit(100000.0).alias("first_price"), target.alias("target_price"),
        F.col("o_custkey").cast("double").alias("cost"),
    )
    names = ("change_percent", "margin_percent", "vs_market_percent")
    return W.watch_figures(watch).select("id", *(F.round(n, 6).alias(n) for n in names))


@query(f"""WITH {_OFFERS}, c AS (SELECT country, brand, count(*) AS n FROM offers GROUP BY ALL)
SELECT country, brand, n, row_number() OVER (PARTITION BY country ORDER BY n DESC, brand) AS place FROM c QUALIFY place <= 2""")
def brand_leaders(spark, d):
    """The two brands with most offers in each country."""
    return W.leaders(offers(spark, d), "country", "brand")


_ITEMS_SQL = "WITH i AS (SELECT *, CASE WHEN p_size % 2 = 0 THEN p_type END AS own, p_size % 3 = 0 AS lent FROM part)"


def _export_items(spark, d):
    c = F.col
    none = F.lit(None).cast("string")
    return table(spark, d, "part").select(
        c("p_name").alias("title"), c("p_brand").alias("brand"), F.lit("s").alias("source"), none.alias("seller"), F.lit("de").alias("country"),
        F.when(c("p_size") % 5 == 0, F.array(F.lit("de"), F.lit("fr"))).alias("countries"), F.lit("de").alias("market"),
        c("p_retailprice").alias("price"), F.lit("EUR").alias("currency"), c("p_size").cast("long").alias("price_vnd"),
        F.lit(None).cast("long").alias("original_price_vnd"), F.lit(None).cast("long").alias("discount"),
        F.struct(F.concat(c("p_size").cast("string"), F.lit("g")).alias("label")).alias("qty"), F.lit(None).cast("long").alias("price_per_100_vnd"),
        F.lit(6).alias("age_months"), c("p_type").alias("type"), F.array(F.lit("a"), F.lit("b")).alias("claims"),
        F.array().cast("array<string>").alias("allergens"), F.lit(None).cast("double").alias("rating"), F.lit(None).cast("long").alias("reviews"),
        F.lit(None).cast("long").alias("sold"), F.create_map(F.lit("ingredients"), F.when(c("p_size") % 2 == 0, c("p_type")).otherwise("")).alias("sections"),
        F.when(c("p_size") % 3 == 0, F.create_map(F.lit("storage"), F.struct(
            F.lit("dry").alias("text"), c("p_partkey").cast("string").alias("donor"), F.lit(1.0).alias("score")
        ))).alias("borrowed"),
        F.lit("").alias("description"), c("p_name").alias("snippet"), F.concat(F.lit("https://s.de/"), c("p_partkey").cast("string")).alias("url"), none.alias("image"),
    )


@query(_ITEMS_SQL + """ SELECT p_name AS title, p_brand AS brand, 'Shop' AS source, NULL AS seller, CASE WHEN p_size % 5 = 0 THEN 'Germany; France' ELSE 'Germany' END AS country,
'DE' AS market, p_retailprice AS price, 'EUR' AS currency, CAST(p_size AS BIGINT) AS price_vnd, NULL AS original_price_vnd, NULL AS discount, p_size || 'g' AS pack,
NULL AS price_per_100_vnd, 6 AS age_months, p_type AS type, 'a; b' AS claims, '' AS allergens, NULL AS rating, NULL AS reviews, NULL AS sold, own AS ingredients,
NULL AS usage, CASE WHEN lent THEN 'dry' END AS storage, NULL AS origin, NULL AS expiry,
CASE WHEN own IS NULL AND NOT lent THEN NULL ELSE concat_ws('; ', CASE WHEN own IS NOT NULL THEN 'ingredients: product page' END, CASE WHEN lent THEN 'storage: item ' || p_partkey END) END AS section_source,
p_name AS description, 'https://s.de/' || p_partkey AS url, NULL AS image FROM i""")
def result_export(spark, d):
    """The 29 columns, with names looked up and borrowed sections shown with their donor."""
    return E.result_rows(_export_items(spark, d), sources={"s": "Shop"}, countries={"de": "Germany", "fr": "France"}, markets={"de": "DE"})


@query(_ITEMS_SQL + """, n AS (SELECT count(*) AS n, count(own) AS a, count(*) FILTER (WHERE lent) AS b FROM i)
SELECT 'ingredients' AS section, a AS items, CAST(floor(a / n * 100 + 0.5) AS BIGINT) AS percent FROM n UNION ALL SELECT 'storage', b, CAST(floor(b / n * 100 + 0.5) AS BIGINT) FROM n
UNION ALL SELECT 'usage', 0, 0""")
def section_coverage(spark, d):
    """How many items show a section, own or borrowed."""
    return W.section_coverage(_export_items(spark, d), ["ingredients", "storage", "usage"])


@query("""SELECT o_orderpriority AS title, NULL AS brand, 'Shop' AS source, 'de' AS country, CAST(floor(o_totalprice) AS BIGINT) AS price_vnd, o_totalprice AS price, 'EUR' AS currency,
CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS status, NULL AS supplier, CAST(o_custkey AS DOUBLE) AS cost, 500.0 AS target_price,
CASE WHEN o_custkey <> 0 THEN floor((500.0 - o_custkey) / 500 * 100 * 10 + 0.5) / 10 END AS margin_percent, '' AS note, 'u' || o_orderkey AS url, o_orderkey AS saved_at FROM orders""")
def watch_export(spark, d):
    """K7: the 15 columns of a watch list."""
    none = F.lit(None).cast("string")
    item = F.struct(
        F.col("o_orderpriority").alias("title"), none.alias("brand"), F.lit("s").alias("source"), F.lit("de").alias("country"),
        F.floor("o_totalprice").cast("long").alias("price_vnd"), F.col("o_totalprice").alias("price"), F.lit("EUR").alias("currency"),
        F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("url"),
    )
    watch = table(spark, d, "orders").select(
        item.alias("item"), F.col("o_orderstatus").alias("status"), none.alias("supplier"), F.col("o_custkey").cast("double").alias("cost"),
        F.lit(500.0).alias("target_price"), F.lit("").alias("note"), F.col("o_orderkey").alias("saved_at"),
    )
    return E.watch_rows(watch, sources={"s": "Shop"}, states={"F": "done", "O": "open"})
