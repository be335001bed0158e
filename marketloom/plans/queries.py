"""The registered queries of the engine's own operators, and the SQL that says the same.

The driver's tables stand in for captured listings: parts are products, line items their offers,
suppliers shops, nations countries, events snapshots of a listing (user_id) over time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import price as P
from ..functions import text as T
from ..functions import urls as U
from ..operators import history as H
from ..operators import insights as I
from ..operators import items as Items
from ..operators import listings as LM
from ..operators import matching as M
from ..operators import panels as Panels
from ..operators import rows as R
from ..session import dealt, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


HOME = "NATION_8"


def offers(spark: SparkSession, d: str) -> DataFrame:
    """One row per offer: product, brand, country and unit price."""
    line = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount")
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    supplier = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    return (
        line.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("p_partkey").alias("part"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
            F.col("p_type").alias("type"), F.col("n_name").alias("country"), F.col("s_name").alias("seller"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("quantity"),
            F.col("l_discount").alias("discount"),
        )
    )


_OFFERS = """offers AS (
  SELECT p_partkey AS part, p_name AS name, p_brand AS brand, p_type AS type, n_name AS country, s_name AS seller,
    l_extendedprice / l_quantity AS price, l_quantity AS quantity, l_discount AS discount
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey)"""


@query(f"""WITH {_OFFERS}, m AS (SELECT brand, country, median(price) AS m FROM offers GROUP BY ALL),
b AS (SELECT brand, max(m) FILTER (WHERE country = '{HOME}') AS home, arg_min(country, (m, country)) FILTER (WHERE country <> '{HOME}') AS c,
  min(m) FILTER (WHERE country <> '{HOME}') AS low FROM m GROUP BY brand)
SELECT brand, home AS home_median, c AS cheapest_country, low AS cheapest_median,
  (home - low) / low * 100 AS gap_percent FROM b WHERE home IS NOT NULL AND low IS NOT NULL""")
def brand_cheapest_abroad(spark, d):
    return I.cheapest_abroad(offers(spark, d), HOME)


@query("""SELECT p_brand, count(*) AS n, count(p_retailprice) AS n_priced, median(p_retailprice) AS median,
min(p_retailprice) AS low, max(p_retailprice) AS high FROM part WHERE p_brand IS NOT NULL AND p_brand <> '' GROUP BY p_brand""")
def group_stats_median(spark, d):
    return I.group_stats(table(spark, d, "part"), "p_brand", "p_retailprice")


@query("""SELECT count(o_totalprice) AS n, round(quantile_cont(o_totalprice, 0.25), 2) AS p25, round(quantile_cont(o_totalprice, 0.33), 2) AS p33,
round(quantile_cont(o_totalprice, 0.5), 2) AS p50, round(quantile_cont(o_totalprice, 0.67), 2) AS p67, round(quantile_cont(o_totalprice, 0.75), 2) AS p75 FROM orders""")
def price_quartiles_terciles(spark, d):
    return I.quantiles(table(spark, d, "orders"), "o_totalprice", (0.25, 0.33, 0.5, 0.67, 0.75))


@query("""WITH c AS (SELECT quantile_cont(o_totalprice, 0.95) AS p95, min(o_totalprice) AS low FROM orders),
r AS (SELECT *, greatest(1000.0, (p95 - low) / 10) AS raw FROM c),
p AS (SELECT *, pow(10.0, floor(log10(raw) + 1e-12)) AS power FROM r),
s AS (SELECT *, CASE WHEN raw / power <= 1 THEN 1.0 WHEN raw / power <= 2 THEN 2.0 WHEN raw / power <= 2.5 THEN 2.5
  WHEN raw / power <= 5 THEN 5.0 ELSE 10.0 END * power AS step FROM p),
f AS (SELECT CAST(step AS DOUBLE) AS step, CAST(floor(low / step) * step AS DOUBLE) AS start, p95 FROM s),
g AS (SELECT *, CAST(floor((p95 - start) / step) AS BIGINT) AS last FROM f),
b AS (SELECT least(CAST(floor((o_totalprice - start) / step) AS BIGINT), last + 1) AS bin, count(*) AS n FROM orders, g GROUP BY 1),
k AS (SELECT g.*, unnest(range(0, last + 2)) AS bin FROM g)
SELECT start + k.bin * step AS x0, CASE WHEN k.bin <= last THEN start + k.bin * step + step END AS x1, coalesce(n, 0) AS n
FROM k LEFT JOIN b ON k.bin = b.bin WHERE k.bin <= last OR n > 0""")
def price_histogram(spark, d):
    return I.histogram(table(spark, d, "orders").select("o_totalprice"), "o_totalprice")


@query(" UNION ALL ".join(f"SELECT '{c}' AS facet, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM part WHERE {c} IS NOT NULL GROUP BY {c}"
                          for c in ("p_brand", "p_type", "p_size")))
def facet_counts(spark, d):
    return I.facets(table(spark, d, "part"), ("p_brand", "p_type", "p_size"))


# Labels of notices in documents, in the place of claims on packs.
NOTICES = [("licence", "(?i)licen[cs]e"), ("rights", "(?i)all rights reserved"), ("address", "@"), ("number", "[0-9]{4}"), ("shout", "!!")]


@query(" UNION ALL ".join(f"SELECT '{n}' AS label, count(*) AS n FROM documents WHERE regexp_matches(text, '{p}') HAVING count(*) > 0" for n, p in NOTICES))
def claim_frequency(spark, d):
    return I.label_frequency(table(spark, d, "documents").select("text"), T.labels_of(F.col("text"), NOTICES))


@query("""SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size BETWEEN 6 AND 11 AND p_retailprice >= 905 AND p_retailprice <= 1050""")
def result_filter_bands(spark, d):
    items = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", F.col("p_size").alias("ageMonths"), F.col("p_retailprice").alias("priceVND"))
    return R.result_filter(items, age=(6, 11), least=905, most=1050).select("p_partkey", "p_size", "p_retailprice")


@query("""SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name || ' ' || p_brand), 'blue') AND contains(lower(p_name || ' ' || p_brand), 'brand#1')""")
def result_filter_text(spark, d):
    return R.result_filter(table(spark, d, "part"), words="Blue brand#1", text=("p_name", "p_brand")).select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 120")
def sort_price_desc(spark, d):
    items = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("priceVND"))
    return R.ordered(items, "price-desc", "o_orderkey").limit(120).select("o_orderkey", F.col("priceVND").alias("o_totalprice"))


@query("""SELECT l_partkey, rating, reviews FROM (SELECT l_partkey, round(avg(l_tax) * 50 + 1, 1) AS rating, count(*) AS reviews FROM lineitem GROUP BY l_partkey)
ORDER BY rating DESC NULLS LAST, reviews DESC NULLS LAST, l_partkey LIMIT 120""")
def sort_rating_then_reviews(spark, d):
    items = table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.round(F.avg("l_tax") * 50 + 1, 1).alias("rating"), F.count(F.lit(1)).alias("reviews")
    )
    return R.ordered(items, "rating-desc", "l_partkey").limit(120)


@query("""SELECT p_partkey, round(p_size / 50.0 + CASE WHEN p_retailprice >= 1000 THEN 0.12 ELSE 0 END + 0.06 + CASE WHEN p_type <> 'ECONOMY' THEN 0.05 ELSE 0 END
  - 0.003 * (p_partkey % 24), 6) AS score FROM part ORDER BY score DESC, p_partkey LIMIT 120""")
def relevance_composite_order(spark, d):
    items = table(spark, d, "part").select(
        "p_partkey", (F.col("p_size") / 50.0).alias("relevance"), F.when(F.col("p_retailprice") >= 1000, F.col("p_retailprice")).alias("priceVND"),
        F.lit("i").alias("image"), F.when(F.col("p_type") == "ECONOMY", "web").otherwise("shop").alias("kind"), (F.col("p_partkey") % 24).alias("pos"),
        F.create_map().cast("map<string,string>").alias("sections"),
    )
    return items.select("p_partkey", F.round(R.relevance_score(), 6).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(120)


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, place FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey
  ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS place FROM lineitem) WHERE place <= 1 + l_suppkey % 3""")
def topn_per_group_plan(spark, d):
    plan = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (1 + F.col("s_suppkey") % 3).alias("n"))
    ranked = R.top_per_group(
        table(spark, d, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 3, "place"
    )
    return ranked.join(plan, "l_suppkey").where("place <= n").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "place")


@query(f"""WITH {_OFFERS}, s AS (SELECT country, brand, sum(quantity) AS sold FROM offers GROUP BY ALL)
SELECT country, brand, sold, rank FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY sold DESC, brand) AS rank FROM s) WHERE rank <= 10""")
def topn_per_market(spark, d):
    sold = offers(spark, d).groupBy("country", "brand").agg(F.sum("quantity").alias("sold"))
    return R.top_per_group(sold, ["country"], [F.desc("sold"), F.col("brand")], 10)


@query("""SELECT md5(coalesce(text, '')) AS digest, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*) AS n FROM documents GROUP BY 1""")
def dedupe_first_wins(spark, d):
    docs = table(spark, d, "documents").select(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), "doc_id", "source")
    n = docs.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    return R.first_wins(docs, ["digest"], ["doc_id"]).join(n, "digest").select("digest", "doc_id", "source", "n")


_HOST = r"""regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '')"""
_NORM = rf"""lower({_HOST} || regexp_replace(regexp_extract(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?]*([^?]*)', 1), '/$', '')
  || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END)"""
_KEPT = r"""list_filter(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_|fbclid|gclid|srsltid|ref)'))"""


@query(f"""WITH u AS (SELECT page_id, url, {_KEPT} AS kept FROM pages)
SELECT {_NORM} AS norm_url, min(page_id) AS page_id, count(*) AS n, count(DISTINCT url) AS forms FROM u GROUP BY 1""")
def dedupe_norm_url(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", U.norm_url(F.col("url")).alias("norm_url"))
    return pages.groupBy("norm_url").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"), F.count_distinct("url").alias("forms"))


@query(f"SELECT page_id, {_HOST} AS host FROM pages")
def url_host(spark, d):
    return table(spark, d, "pages").select("page_id", U.host(F.col("url")).alias("host"))


@query("""SELECT page_id, CASE WHEN url <> '' THEN lower(regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/$', '')) ELSE lower('page:' || page_id) END AS key FROM pages""")
def listing_key(spark, d):
    return table(spark, d, "pages").select("page_id", U.listing_key(F.col("url"), F.lit("page"), F.col("page_id").cast("string")).alias("key"))


@query("""WITH many AS (SELECT doc_id AS id, md5(text) AS digest, contains(lower(text), 'license') AS narrow FROM documents), few AS (SELECT id, digest FROM many WHERE narrow)
SELECT * FROM few UNION ALL SELECT id, digest FROM many WHERE NOT EXISTS (SELECT 1 FROM few WHERE few.digest = many.digest) AND (SELECT count(*) FROM few) < 8""")
def conditional_union_anti_documents(spark, d):
    docs = table(spark, d, "documents")
    wide = docs.select(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("digest"), F.contains(F.lower("text"), F.lit("license")).alias("narrow"))
    return R.widen(wide.where("narrow").drop("narrow"), wide.drop("narrow"), "digest", 8)


@query(f"""SELECT page_id, {_HOST} AS host FROM pages WHERE {_HOST} IN ('example.net', 'example.org') OR {_HOST} LIKE '%.example.net' OR {_HOST} LIKE '%.example.org'""")
def domain_semi_join(spark, d):
    sites = spark.createDataFrame([("example.net",), ("example.org",)], "site string")
    hosts = table(spark, d, "pages").select("page_id", U.host(F.col("url")).alias("host"))
    distinct = hosts.select("host").distinct().select("host", F.explode(U.suffixes(F.col("host"))).alias("site"))
    return hosts.join(distinct.join(F.broadcast(sites), "site", "left_semi").select("host"), "host", "left_semi").select("page_id", "host")


@query("""WITH p AS (SELECT *, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS priority FROM events)
SELECT user_id, priority, count(*) AS n FROM p WHERE priority = (SELECT min(priority) FROM p q WHERE q.user_id = p.user_id) GROUP BY ALL""")
def provider_fallback_priority(spark, d):
    priority = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).otherwise(3)
    events = table(spark, d, "events").select("user_id", priority.alias("priority"))
    return R.first_provider(events, "user_id", "priority").groupBy("user_id", "priority").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT r_name AS source, n_name AS market FROM region, nation WHERE r_regionkey = 0 OR n_regionkey = r_regionkey
UNION ALL SELECT 'global' AS source, 'world' AS market""")
def task_cross_plan(spark, d):
    markets = table(spark, d, "nation").select("n_regionkey", F.col("n_name").alias("market"))
    own = markets.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list("market").alias("own"))
    everywhere = F.when(F.col("r_regionkey") == 0, F.array(F.lit("*"))).otherwise(F.coalesce("own", F.array().cast("array<string>")))
    sources = table(spark, d, "region").join(own, "r_regionkey", "left").select(
        F.col("r_name").alias("source"), F.lit(True).alias("enabled"), F.lit(False).alias("global"), everywhere.alias("markets")
    )
    world = spark.createDataFrame([("global", True, True, ["*"]), ("off", False, False, ["*"])], sources.schema)
    return Panels.task_plan(sources.union(world), markets)


@query("""SELECT o_orderkey, CASE WHEN rate > 0 THEN CAST(floor(o_totalprice * rate + 0.5) AS BIGINT) END AS vnd FROM (
SELECT o_orderkey, o_totalprice, CASE c_nationkey % 4 WHEN 0 THEN 25400.0 WHEN 1 THEN 27500.0 WHEN 2 THEN 0.0 END AS rate FROM orders JOIN customer ON o_custkey = c_custkey)""")
def fx_convert_round(spark, d):
    rates = spark.createDataFrame([(0, 25400.0), (1, 27500.0), (2, 0.0)], "currency int, rate double")
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") % 4).alias("currency"))
    priced = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(customers, "o_custkey")
    priced = priced.join(F.broadcast(rates), "currency", "left")
    return priced.select("o_orderkey", P.to_dong(F.col("o_totalprice"), F.col("rate")).alias("vnd"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_extendedprice <= 60000 THEN CAST(floor(l_extendedprice + 0.5) AS BIGINT) END AS price,
CASE WHEN l_extendedprice <= 60000 AND l_discount > 0 THEN CAST(floor(l_discount * 100 + 0.5) AS BIGINT) END AS discount FROM lineitem""")
def discount_and_guard(spark, d):
    fits = F.col("l_extendedprice") <= 60000
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(fits, P.half_up(F.col("l_extendedprice"))).alias("price"),
        F.when(fits & (F.col("l_discount") > 0), P.half_up(F.col("l_discount") * 100)).alias("discount"),
    )


@query("""SELECT p_partkey, CASE WHEN p_size >= 20 THEN CAST(floor(p_retailprice * 100 / p_size + 0.5) AS BIGINT) END AS per_100 FROM part""")
def price_per_100(spark, d):
    total = P.parse_quantity(F.concat(F.col("p_size").cast("string"), F.lit("g")))["total"]
    return table(spark, d, "part").select("p_partkey", F.when(total >= 20, P.half_up(F.col("p_retailprice") * 100 / total)).alias("per_100"))


def snapshots(spark, d):
    return table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("key"), F.unix_millis("ts").alias("t"), F.floor(F.col("value") / 20).cast("long").alias("sold"), "event_type", "value"
    )


_SNAP = "snap AS (SELECT event_id, user_id AS key, epoch_us(ts) // 1000 AS t, CAST(floor(value / 20) AS BIGINT) AS sold, event_type, value FROM events)"


@query(f"""WITH {_SNAP}, e AS (SELECT key, arg_min(value, t) AS a, arg_max(value, t) AS b, min(t) AS t0, max(t) AS t1, count(*) AS n FROM snap WHERE value IS NOT NULL GROUP BY key)
SELECT key, CASE WHEN n >= 2 AND (t1 - t0) / 86400000.0 >= 0.5 THEN round(greatest(0.0, (b - a) / ((t1 - t0) / 86400000.0) * 7), 6) END AS rate FROM e""")
def weekly_rate(spark, d):
    return H.weekly_rate(snapshots(spark, d), "key", "t", "value").withColumn("rate", F.round("rate", 6))


@query(f"""WITH {_SNAP}, l AS (SELECT key, CAST(floor(t / 86400000) AS BIGINT) AS day, arg_max(sold, t) AS v FROM snap GROUP BY ALL)
SELECT day, CAST(sum(v) AS BIGINT) AS total, count(*) AS n_keys FROM l GROUP BY day""")
def daily_last_sum(spark, d):
    return H.daily_last_sum(snapshots(spark, d), "key", "t", "sold")


@query(f"WITH {_SNAP} SELECT key, arg_max(event_id, (t, event_id)) AS event_id, max(t) AS t, arg_max(event_type, (t, event_id)) AS event_type FROM snap GROUP BY key")
def latest_per_key(spark, d):
    return R.newest(snapshots(spark, d).select("key", "event_id", "t", "event_type"), ["key"], ["t", "event_id"])


@query(f"""WITH {_SNAP}, c AS (SELECT *, lag(event_type) OVER (PARTITION BY key ORDER BY t, event_id) AS before FROM snap),
k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t DESC, event_id DESC) AS n FROM c WHERE before IS NULL OR before <> event_type)
SELECT key, event_id, event_type FROM k WHERE n <= 50""")
def class_change_log(spark, d):
    return H.change_log(snapshots(spark, d), "key", ["t", "event_id"], "event_type").select("key", "event_id", "event_type")


def _admission(value: str, gap: int) -> str:
    return f"""WITH RECURSIVE {_SNAP}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, event_id) AS n FROM snap),
w AS (SELECT key, n, event_id, t AS kt, {value} AS kv, true AS ok FROM o WHERE n = 1
 UNION ALL SELECT o.key, o.n, o.event_id, CASE WHEN o.t - w.kt >= {gap} OR o.{value} <> w.kv THEN o.t ELSE w.kt END,
  CASE WHEN o.t - w.kt >= {gap} OR o.{value} <> w.kv THEN o.{value} ELSE w.kv END, o.t - w.kt >= {gap} OR o.{value} <> w.kv
  FROM w JOIN o ON o.key = w.key AND o.n = w.n + 1)
SELECT key, event_id FROM w WHERE ok"""


@query(_admission("sold", H.SNAPSHOT_GAP_MS))
def snapshot_admission(spark, d):
    rows = snapshots(spark, d).select("key", "event_id", "t", "sold")
    return H.admitted(rows, "key", ["t", "event_id"], "t", ["sold"], H.SNAPSHOT_GAP_MS).select("key", "event_id")


@query(_admission("sold", H.PRICE_GAP_MS).replace("SELECT key, event_id FROM w WHERE ok",
       f"SELECT key, event_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC) AS back FROM w WHERE ok) WHERE back <= {H.PRICE_POINTS}"))
def price_point_admission(spark, d):
    rows = snapshots(spark, d).select("key", "event_id", "t", "sold")
    kept = H.admitted(rows, "key", ["t", "event_id"], "t", ["sold"], H.PRICE_GAP_MS)
    return R.top_per_group(kept, ["key"], [F.desc("t"), F.desc("event_id")], H.PRICE_POINTS).select("key", "event_id")


@query(f"WITH {_SNAP} SELECT key, max(t) AS last_check FROM snap GROUP BY key HAVING max(t) IS NULL OR 1706659200000 - max(t) > 86400000")
def tracked_due(spark, d):
    return H.due(snapshots(spark, d), "key", "t", 1706659200000, 86_400_000)


_STOPS = ", ".join(f"'{w}'" for w in L.STOP)


_SEED = ("that", "dans", "und")
_SEEDS = ", ".join(f"'{w}'" for w in _SEED)


@query(f"""WITH t AS (SELECT replace(regexp_replace(strip_accents(lower(text)), '[\u0300-\u036f]', '', 'g'), 'đ', 'd') AS folded FROM documents WHERE text IS NOT NULL),
w AS (SELECT unnest(list_distinct(list_filter(string_split(trim(regexp_replace(folded, '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: len(x) >= 2))) AS word FROM t)
SELECT word, count(*) AS n FROM w WHERE word NOT IN ({_STOPS}) AND word NOT IN ({_SEEDS}) GROUP BY word ORDER BY n DESC, word LIMIT 30""")
def keyword_cooccurrence(spark, d):
    """Words of whole documents, folded, without stop and seed words."""
    words = F.filter(F.split(T.fold(F.col("text")), "[^a-z0-9]+"), lambda w: F.length(w) >= 2)
    return I.co_occurrence(table(spark, d, "documents").where("text is not null"), words, L.STOP, _SEED)


_NAMES = "names AS (SELECT p_partkey AS id, p_brand, list_distinct(string_split(lower(p_name || ' ' || p_type || ' ' || CAST(p_size % 7 AS VARCHAR)), ' ')) AS tokens FROM part)"


def names(spark, d):
    text = F.lower(F.concat_ws(" ", "p_name", "p_type", (F.col("p_size") % 7).cast("string")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", F.array_distinct(F.split(text, " ")).alias("tokens"))


@query(f"""WITH {_NAMES}, p AS (SELECT a.id AS id, b.id AS donor, len(list_intersect(a.tokens, b.tokens)) AS i, len(a.tokens) + len(b.tokens) AS s
 FROM names a JOIN names b ON a.p_brand = b.p_brand AND a.id <> b.id)
SELECT id, donor, round(i / CAST(s - i AS DOUBLE), 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i / CAST(s - i AS DOUBLE) DESC, donor) AS n FROM p WHERE i / CAST(s - i AS DOUBLE) >= 0.6) WHERE n = 1""")
def jaccard_borrow(spark, d):
    best = M.nearest_by_tokens(names(spark, d), "tokens", 0.6, on=["p_brand"])
    return best.select("id", "donor", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {_NAMES}, p AS (SELECT a.id AS id, b.id AS other FROM names a JOIN names b ON a.p_brand = b.p_brand AND a.id <> b.id
 WHERE len(list_intersect(a.tokens, b.tokens)) / CAST(len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens, b.tokens)) AS DOUBLE) >= 0.5)
SELECT p.id AS id, count(DISTINCT s_nationkey) AS countries, count(DISTINCT s_suppkey) AS retailers FROM p JOIN lineitem ON l_partkey = other JOIN supplier ON l_suppkey = s_suppkey GROUP BY p.id""")
def breadth_self_join(spark, d):
    sold = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("retailers")).distinct()
    shops = table(spark, d, "supplier").select(F.col("s_suppkey").alias("retailers"), F.col("s_nationkey").alias("countries"))
    return M.reached(
        names(spark, d), sold.join(shops, "retailers"), "tokens", 0.5, on=["p_brand"], counted=["countries", "retailers"]
    )


_EVIDENCE = """ev AS (SELECT p_partkey AS part, count(l_orderkey) AS reviews, count(DISTINCT s_nationkey) AS markets, count(DISTINCT l_suppkey) AS retailers,
 coalesce(sum(l_quantity) FILTER (WHERE s_nationkey = 8), 0) AS sold, count(*) FILTER (WHERE s_nationkey = 8) AS listings,
 count(DISTINCT l_suppkey) FILTER (WHERE s_nationkey IN (8, 12)) AS chains, min(l_extendedprice / l_quantity) FILTER (WHERE s_nationkey = 8) AS home_low,
 min(l_extendedprice / l_quantity) FILTER (WHERE s_nationkey <> 8) AS price, any_value(p_size) AS size
 FROM part LEFT JOIN lineitem ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY p_partkey),
cl AS (SELECT *, CASE WHEN listings > 1 THEN CASE WHEN chains >= 2 AND size % 2 = 0 THEN 'nkcn' ELSE 'partial' END WHEN listings > 0 THEN 'partial'
 WHEN size % 5 > 0 THEN 'brand' ELSE 'absent' END AS cls FROM ev)"""


def evidence(spark, d):
    """What line items tell of each part; its rows are dealt by part once, and suppliers and markets are told apart as sets of a part's own."""
    line = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice")
    shops = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    home, unit = F.col("s_nationkey") == 8, F.col("l_extendedprice") / F.col("l_quantity")
    told = line.join(shops, "l_suppkey", "left").select(
        "p_partkey", "l_orderkey", "l_suppkey", "s_nationkey", F.when(home, F.col("l_quantity")).alias("sold"),
        F.when(home, unit).alias("home_low"), F.when(F.col("s_nationkey") != 8, unit).alias("price"),
    )
    rows = table(spark, d, "part").select("p_partkey", "p_size").join(dealt(told, line.count(), "p_partkey"), "p_partkey", "left")
    chain = F.when(F.col("s_nationkey").isin(8, 12), F.col("l_suppkey"))

    def distinct(value) -> Column:
        return F.size(F.collect_set(value)).cast("long")

    seen = rows.groupBy(F.col("p_partkey").alias("part")).agg(
        F.count("l_orderkey").alias("reviews"), distinct("s_nationkey").alias("markets"), distinct("l_suppkey").alias("retailers"),
        F.coalesce(F.sum("sold"), F.lit(0.0)).alias("sold"), F.count_if(home).alias("listings"), distinct(chain).alias("chains"),
        F.min("home_low").alias("home_low"), F.min("price").alias("price"), F.first("p_size").alias("size"),
    )
    strong = F.when(F.col("listings") > 1, F.col("listings")).otherwise(0)
    cls = M.import_class(strong, F.col("listings"), F.col("chains"), F.col("size") % 2 == 0, F.col("size") % 5)
    return seen.withColumn("cls", cls)


@query(f"WITH {_EVIDENCE} SELECT part, listings, chains, cls FROM cl")
def import_classification(spark, d):
    return evidence(spark, d).select("part", "listings", "chains", "cls")


_PARTS = (
    "least(30.0, 7.5 * log10(1 + reviews))", "greatest(0.0, least(15.0, 17.0 - size))", "CASE WHEN size / 10.0 >= 4.5 THEN 5.0 WHEN size / 10.0 >= 4 THEN 3.0 END",
    "least(15.0, 5.0 * (markets - 1) + 2.0 * (retailers - 1))", "CASE WHEN cls <> 'nkcn' THEN least(20.0, 5 * log10(1 + sold) + 2.0 * least(listings, 5)) END",
    "CASE WHEN cls <> 'nkcn' THEN least(10.0, sold / 10) END", "least(10.0, 2.0 * (size % 7))", "CASE WHEN price > 0 AND home_low > price THEN least(10.0, 20 * (home_low - price) / price) END",
)
_POINTS = " + ".join(f"CASE WHEN coalesce({p}, 0) > 0.4 THEN floor(coalesce({p}, 0) + 0.5) ELSE 0 END" for p in _PARTS)


@query(f"""WITH {_EVIDENCE}, s AS (SELECT part, cls, least(100, CAST({_POINTS} AS BIGINT)) AS demand,
 CASE cls WHEN 'absent' THEN 1.0 WHEN 'brand' THEN 0.9 WHEN 'partial' THEN 0.8 WHEN 'nkcn' THEN 0.2 ELSE 0.5 END AS weight FROM cl)
SELECT part, cls, demand, CAST(floor(demand * CAST(weight AS DOUBLE) + 0.5) AS BIGINT) AS score FROM s""")
def opportunity_score(spark, d):
    c = F.col
    o = M.opportunity(c("cls"), c("reviews"), c("size"), c("size") / 10.0, c("markets"), c("retailers"), c("sold"), c("listings"), c("sold"), c("size") % 7, c("home_low"), c("price"))
    return evidence(spark, d).select("part", "cls", o.alias("o")).select("part", "cls", "o.demand", "o.score")


@query(f"""WITH {_OFFERS} SELECT brand, regexp_replace(lower(seller), '[^a-z0-9]+', '', 'g') AS importer_key, min(seller) AS importer, count(*) AS seen FROM offers GROUP BY ALL""")
def importer_directory(spark, d):
    return Panels.importer_directory(offers(spark, d), "seller", P.company_key(F.col("seller")))


@query("""WITH c AS (SELECT p_partkey, lpad(CAST(p_partkey * 7919 + 100000 AS VARCHAR), CASE p_partkey % 4 WHEN 0 THEN 14 WHEN 1 THEN 13 WHEN 2 THEN 12 ELSE 11 END, '4') AS code FROM part),
s AS (SELECT *, len(code) AS n, list_sum(list_transform(range(1, len(code)), lambda i: CAST(code[len(code) - i] AS INTEGER) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)) AS total FROM c)
SELECT p_partkey, CASE WHEN n >= 12 AND (10 - total % 10) % 10 = CAST(code[n] AS INTEGER) THEN code END AS gtin FROM s""")
def gtin_checksum(spark, d):
    """O-P16: every part, with codes of 11 (no barcode) to 14 digits; a tenth of the others have a right check digit."""
    n = F.when(F.col("p_partkey") % 4 == 0, 14).when(F.col("p_partkey") % 4 == 1, 13).when(F.col("p_partkey") % 4 == 2, 12).otherwise(11)
    code = F.lpad((F.col("p_partkey") * 7919 + 100000).cast("string"), 14, "4")
    return table(spark, d, "part").select("p_partkey", P.gtin(F.substring(code, 15 - n, n)).alias("gtin"))


@query(r"""SELECT page_id, trim(regexp_replace(coalesce(nullif(trim(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)), ''), trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))), '\s+', ' ', 'g')) AS title FROM pages""")
def page_title_precedence(spark, d):
    h1 = F.trim(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    title = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return table(spark, d, "pages").select("page_id", F.trim(F.regexp_replace(F.coalesce(F.nullif(h1, F.lit("")), title), r"\s+", " ")).alias("title"))


@query()
def text_from_html(spark, d):
    return table(spark, d, "pages").select("page_id", T.text_from_html(F.col("html")).alias("text"))


@query("""SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY ALL""")
def json_props(spark, d):
    return table(spark, d, "events").select("event_type", (F.from_json("props", "k bigint")["k"] % 10).alias("k")).groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, len(c) AS n_clean, md5(lower(strip_accents(replace(c, 'ß', 'ß')))) AS folded FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS c FROM documents)""")
def clean_fold(spark, d):
    c = T.clean(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(c).alias("n_clean").cast("long"), F.md5(T.fold(c).cast("binary")).alias("folded"))


@query("""SELECT p_partkey AS id, p_name AS title, p_brand AS brand, p_type || '; ' || CAST(p_size AS VARCHAR) AS details, regexp_replace(p_name, '[\\t\\n\\r]+', ' ', 'g') AS tsv_title FROM part""")
def csv_export_projection(spark, d):
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"),
        F.array_join(F.array("p_type", F.col("p_size").cast("string")), "; ").alias("details"), F.regexp_replace("p_name", r"[\t\n\r]+", " ").alias("tsv_title"),
    )


@query("SELECT user_id, count(*) AS n_points, min(value) AS low, max(value) AS high FROM events GROUP BY user_id")
def sparkline_scale(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_points"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("""SELECT CAST(count(*) AS BIGINT) AS products, count(p_retailprice) AS priced, count(DISTINCT p_brand) AS brands, median(p_retailprice) AS median_price FROM part""")
def headline_stats(spark, d):
    return I.headline(table(spark, d, "part"), "p_retailprice", "p_brand")


@query(f"""WITH {_OFFERS}, m AS (SELECT type, part, min(price) AS price FROM offers GROUP BY ALL) SELECT type, part, price = min(price) OVER (PARTITION BY type) AS best FROM m""")
def compare_best_flag(spark, d):
    lowest = offers(spark, d).groupBy("type", "part").agg(F.min("price").alias("price"))
    return lowest.select("type", "part", Panels.cheapest(lowest, ["type"], "price").alias("best"))


@query(f"""WITH {_EVIDENCE}, s AS (SELECT part, cls, least(100, CAST({_POINTS} AS BIGINT)) AS demand, reviews,
 CASE cls WHEN 'absent' THEN 1.0 WHEN 'brand' THEN 0.9 WHEN 'partial' THEN 0.8 WHEN 'nkcn' THEN 0.2 ELSE 0.5 END AS weight FROM cl),
b AS (SELECT p_brand AS brand, max(CAST(floor(demand * CAST(weight AS DOUBLE) + 0.5) AS BIGINT)) AS score, CAST(sum(reviews) AS BIGINT) AS reviews, count(*) AS items,
 array_to_string(list_sort(list_distinct(list(cls))), ',') AS classes FROM s JOIN part ON part = p_partkey GROUP BY p_brand)
SELECT * FROM b WHERE classes <> 'nkcn' ORDER BY score DESC, reviews DESC, brand LIMIT 12""")
def brand_opportunities(spark, d):
    c = F.col
    o = M.opportunity(c("cls"), c("reviews"), c("size"), c("size") / 10.0, c("markets"), c("retailers"), c("sold"), c("listings"), c("sold"), c("size") % 7, c("home_low"), c("price"))
    scored = evidence(spark, d).select("part", "cls", "reviews", o["score"].alias("score"))
    brands = table(spark, d, "part").select(c("p_partkey").alias("part"), c("p_brand").alias("brand"))
    return Panels.brand_opportunities(scored.join(brands, "part"))


@query("""WITH p AS (SELECT p_partkey, ltrim(lpad(substr(p_brand, 7) || lpad(CAST(p_size AS VARCHAR), 2, '0'), 13, '0'), '0') AS code,
 p_type IN ('ECONOMY', 'PROMO', 'SMALL') AS ingredients, p_type IN ('PROMO', 'LARGE') AS storage FROM part),
d AS (SELECT code, max(p_partkey) AS donor, arg_max(ingredients, p_partkey) AS gives_ingredients, arg_max(storage, p_partkey) AS gives_storage FROM p WHERE ingredients OR storage GROUP BY code)
SELECT p_partkey, 'ingredients' AS section, donor, 2 AS score FROM p JOIN d USING (code) WHERE p_partkey <> donor AND NOT ingredients AND gives_ingredients
UNION ALL SELECT p_partkey, 'storage', donor, 2 FROM p JOIN d USING (code) WHERE p_partkey <> donor AND NOT storage AND gives_storage""")
def barcode_donor_sections(spark, d):
    code = F.lpad(F.concat(F.substring("p_brand", 7, 9), F.lpad(F.col("p_size").cast("string"), 2, "0")), 13, "0")
    parts = table(spark, d, "part").select(
        "p_partkey", code.alias("code"), F.col("p_type").isin("ECONOMY", "PROMO", "SMALL").alias("ingredients"),
        F.col("p_type").isin("PROMO", "LARGE").alias("storage"),
    )
    return M.code_donors(parts, "code", ["ingredients", "storage"], key="p_partkey")


@query(f"""WITH u AS (SELECT page_id, url, {_KEPT} AS kept, page_id % 3 AS engine FROM pages), n AS (SELECT page_id, engine, {_NORM} AS norm FROM u)
SELECT norm, min(page_id) AS first_page, array_to_string(list_sort(list_distinct(list(CAST(engine AS VARCHAR)))), ',') AS engines FROM n GROUP BY norm""")
def first_seen_engines(spark, d):
    rows = table(spark, d, "pages").select("page_id", U.norm_url(F.col("url")).alias("norm"), (F.col("page_id") % 3).cast("string").alias("engine"))
    found = Panels.first_seen(rows, "norm", "page_id", "engine")
    return found.select("norm", F.col("first").alias("first_page"), F.array_join("engines", ",").alias("engines"))


@query(f"""WITH {_SNAP}, h AS (SELECT key, event_id, t, row_number() OVER (PARTITION BY key, event_type ORDER BY t DESC, event_id DESC) AS again FROM snap)
SELECT key, event_id, place FROM (SELECT key, event_id, row_number() OVER (PARTITION BY key ORDER BY t DESC, event_id DESC) AS place FROM h WHERE again = 1) WHERE place <= 100""")
def search_history(spark, d):
    latest = R.newest(snapshots(spark, d).select("key", "event_type", "t", "event_id"), ["key", "event_type"], ["t", "event_id"])
    return R.top_per_group(latest, ["key"], [F.desc("t"), F.desc("event_id")], 100, "place").select("key", "event_id", "place")


@query("""SELECT o_orderpriority AS task, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS hidden, count(*) FILTER (WHERE o_totalprice < 50000) AS off_form,
round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'O') / count(*), 2) AS coverage FROM orders GROUP BY o_orderpriority""")
def task_counters(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("task")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("hidden"), F.count_if(F.col("o_totalprice") < 50000).alias("off_form"),
        F.round(100.0 * F.count_if(F.col("o_orderstatus") == "O") / F.count(F.lit(1)), 2).alias("coverage"),
    )


@query(f"""WITH {_SNAP} SELECT key, round(arg_max(value, (t, event_id)) / nullif(arg_min(value, (t, event_id)), 0) * 100 - 100, 4) AS change_percent,
round((max(value) - avg(value)) / nullif(max(value), 0) * 100, 1) AS margin_percent FROM snap GROUP BY key""")
def watch_metrics(spark, d):
    order = F.struct("t", "event_id")
    first, last = F.min_by("value", order), F.max_by("value", order)
    return snapshots(spark, d).groupBy("key").agg(
        F.round(last / F.nullif(first, F.lit(0.0)) * 100 - 100, 4).alias("change_percent"),
        F.round((F.max("value") - F.avg("value")) / F.nullif(F.max("value"), F.lit(0.0)) * 100, 1).alias("margin_percent"),
    )


@query(f"""WITH {_SNAP}, b AS (SELECT key, arg_max(event_type, (t, event_id)) FILTER (WHERE t < 1705276800000) AS before, arg_max(event_type, (t, event_id)) AS after FROM snap GROUP BY key)
SELECT key, before, after FROM b WHERE before IS NOT NULL AND before <> after""")
def recheck_changes(spark, d):
    return Panels.changed_since(snapshots(spark, d), "key", "event_type", ["t", "event_id"], "t", 1705276800000)


@query("""WITH n AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS pos FROM supplier)
SELECT s_nationkey, CAST(floor(pos / 4) AS BIGINT) AS part, string_agg(CAST(s_suppkey AS VARCHAR), ' OR ' ORDER BY s_suppkey) AS sites FROM n GROUP BY ALL""")
def site_chunks(spark, d):
    return Panels.site_groups(table(spark, d, "supplier"), "s_nationkey", "s_suppkey", 4)


@query("""SELECT s_suppkey, CASE WHEN s_nationkey % 5 = 0 THEN 'A' WHEN s_suppkey % 3 = 0 THEN 'B' END AS chain,
coalesce(CASE WHEN s_acctbal > 5000 THEN 'run' END, CASE WHEN s_acctbal > 0 THEN 'directory' END, 'listing') AS importer FROM supplier""")
def importer_lookup(spark, d):
    return table(spark, d, "supplier").select(
        "s_suppkey",
        F.when(F.col("s_nationkey") % 5 == 0, "A").when(F.col("s_suppkey") % 3 == 0, "B").alias("chain"),
        F.coalesce(F.when(F.col("s_acctbal") > 5000, "run"), F.when(F.col("s_acctbal") > 0, "directory"), F.lit("listing")).alias("importer"),
    )


# ---- items and listings


def _captured(spark: SparkSession, d: str) -> DataFrame:
    """Raw connector rows: every part as a shop's offer with its price as a text in euros and its pack in the title."""
    part = spread(table(spark, d, "part"))
    euros = F.floor("p_retailprice").cast("long")
    return part.select(
        F.col("p_partkey").alias("part"), F.lit("shop").alias("source"),
        F.concat(F.col("p_name"), F.lit(" 2x"), F.col("p_size").cast("string"), F.lit("g")).alias("title"),
        F.concat(F.lit("https://www.shop.de/p/"), F.col("p_partkey").cast("string")).alias("url"),
        F.upper("p_brand").alias("brand"), F.col("p_type").alias("seller"),
        F.concat(F.lit("€ "), euros.cast("string")).alias("price"),
        F.concat((euros + F.col("p_size")).cast("string"), F.lit(" EUR")).alias("original_price"),
        F.when(F.col("p_size") % 2 == 0, F.lit("Made in Japan")).alias("origin"),
        F.concat(F.col("p_size").cast("string"), F.lit("k+")).alias("sold"),
    )


@query("""
SELECT p_partkey AS part, 'Brand' || substr(p_brand, 6) AS brand, 'EUR' AS currency, CAST(floor(p_retailprice) AS DOUBLE) AS price,
  CASE WHEN floor(p_retailprice) * 30500 <= 30000000 THEN CAST(floor(p_retailprice) * 30500 AS BIGINT) END AS price_vnd,
  CASE WHEN floor(p_retailprice) * 30500 <= 30000000
    THEN CAST(floor((1 - floor(p_retailprice) / (floor(p_retailprice) + p_size)) * 100 + 0.5) AS BIGINT) END AS discount,
  CAST(2 * p_size AS BIGINT) AS size,
  CASE WHEN floor(p_retailprice) * 30500 <= 30000000 AND 2 * p_size >= 20
    THEN CAST(floor(floor(p_retailprice) * 30500 / (2 * p_size) * 100 + 0.5) AS BIGINT) END AS per_100,
  'de' AS country, CASE WHEN p_size % 2 = 0 THEN 'jp' END AS origin_country, CAST(p_size * 1000 AS BIGINT) AS sold, 'shop.de' AS domain
FROM part
""".replace("CAST(floor(p_retailprice) AS DOUBLE) AS price,", "CASE WHEN floor(p_retailprice) * 30500 <= 30000000 THEN CAST(floor(p_retailprice) AS DOUBLE) END AS price,"))
def item_build(spark, d):
    """Raw rows to items; the brand of capitals is put in title case, an absurd price is dropped."""
    items = Items.make_items(_captured(spark, d), "de")
    return items.select(
        "part", "brand", "currency", "price", "price_vnd", "discount", F.col("qty.total").alias("size"),
        F.col("price_per_100_vnd").alias("per_100"), "country", "origin_country", "sold", "domain",
    )


def _listed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, d, "part")
    abroad = part.where("p_size % 2 = 1").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.lit(None).cast("string").alias("gtin")
    )
    home = part.where("p_size % 2 = 0").select(
        F.col("p_partkey").alias("listing"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("seller"),
        F.when(F.col("p_size") % 3 == 0, "concung").when(F.col("p_size") % 3 == 1, "kidsplaza").otherwise("tiki").alias("source"),
        F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("gtin"),
        F.floor("p_retailprice").cast("long").alias("price_vnd"), F.col("p_size").cast("long").alias("sold"),
        F.when(F.col("p_size") % 10 == 0, F.concat(F.lit("Importer "), F.col("p_brand"))).alias("importer"),
    )
    return abroad, home


_WORDS_SQL = "list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: len(x) > 1 AND NOT regexp_full_match(x, '[0-9]+'))"
_LISTING_MATCH = f"""
WITH a AS (SELECT p_partkey AS id, p_brand AS brand, list_distinct({_WORDS_SQL}) AS need FROM part WHERE p_size % 2 = 1),
h AS (SELECT p_partkey AS listing, p_brand AS brand, {_WORDS_SQL} AS have, p_size,
  CASE p_size % 3 WHEN 0 THEN 'Con Cưng' WHEN 1 THEN 'Kids Plaza' END AS chain,
  CAST(floor(p_retailprice) AS BIGINT) AS price_vnd, CASE WHEN p_size % 10 = 0 THEN 'Importer ' || p_brand END AS importer
  FROM part WHERE p_size % 2 = 0),
s AS (SELECT id, listing, chain, price_vnd, importer, p_size AS sold, len(list_filter(need, lambda w: list_contains(have, w) OR
    (len(w) >= 4 AND len(list_filter(have, lambda x: len(x) >= 4 AND (starts_with(x, w) OR starts_with(w, x)))) > 0))) / len(need) AS score
  FROM a JOIN h USING (brand)),
m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, listing) AS rank FROM s WHERE score >= 0.5
  QUALIFY rank <= 12)
"""


@query(_LISTING_MATCH + "SELECT id, listing, round(score, 6) AS score, rank, chain FROM m")
def listing_match(spark, d):
    """Each product's twelve best listings at home, met by brand."""
    abroad, home = _listed(spark, d)
    return LM.matches(abroad, home).select("id", "listing", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "chain")


@query(_LISTING_MATCH + """,
e AS (SELECT id, count(*) AS listings, count(*) FILTER (score >= 0.65) AS strong, CAST(sum(sold) AS BIGINT) AS sold,
  min(price_vnd) AS min_price_vnd, max(price_vnd) AS max_price_vnd, count(DISTINCT chain) FILTER (score >= 0.65) AS chains,
  count(DISTINCT importer) AS importers FROM m GROUP BY id),
b AS (SELECT brand, count(*) AS n FROM h GROUP BY brand)
SELECT a.id, coalesce(e.listings, 0) AS listings, coalesce(e.strong, 0) AS strong, coalesce(e.sold, 0) AS sold, e.min_price_vnd, e.max_price_vnd,
  coalesce(e.chains, 0) AS chains, coalesce(e.importers, 0) AS importers, coalesce(b.n, 0) AS brand_listings,
  CASE WHEN e.strong > 0 THEN CASE WHEN e.chains >= 2 AND e.importers > 0 THEN 'nkcn' ELSE 'partial' END
    WHEN e.listings > 0 THEN 'partial' WHEN b.n > 0 THEN 'brand' ELSE 'absent' END AS class
FROM a LEFT JOIN e USING (id) LEFT JOIN b USING (brand)
""")
def import_check(spark, d):
    """A13, A14, O-P19: evidence of a product's listings at home, and its import class."""
    abroad, home = _listed(spark, d)
    found = LM.evidence(abroad, LM.matches(abroad, home), LM.brand_listings(abroad, home))
    return found.select(
        "id", "listings", "strong", "sold", "min_price_vnd", "max_price_vnd", F.size("chains").cast("long").alias("chains"),
        F.size("importers").cast("long").alias("importers"), "brand_listings", "class",
    )
