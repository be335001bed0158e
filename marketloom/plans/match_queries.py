"""Registered queries of the whole listing match: brands inside words, missing brands, barcodes, sizes and concepts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import listings as LM
from ..operators import matching as M
from ..operators import rewriting as RW
from ..session import table
from ..sources import lookups
from .queries import query

_CODE = "CASE WHEN p_partkey % 5 = 0 THEN '40' || lpad(CAST(p_partkey AS {s}), 10, '0') END"
_KIND = "CASE p_type WHEN 'PROMO' THEN ' porridge' WHEN 'ECONOMY' THEN ' biscuit' ELSE '' END"
#: A part as a product, and as a listing: its brand glued to its name, in a column, or behind the name.
_PRODUCT = "p_name || {kind} || ' ' || (p_size * 10) || ' g'"
_LISTING = "CASE p_partkey % 3 WHEN 0 THEN replace(p_brand, '#', '') || p_name WHEN 1 THEN p_name ELSE p_name || ' ' || p_brand END || {kind} || ' ' || ((p_size + p_partkey % 3) * 10) || ' g'"


def _coded(code):
    """A 12-digit code with its check digit."""
    digit = lambda i: F.substring(code, i, 1).cast("int")
    total = sum((digit(i) * (3 if i % 2 == 0 else 1) for i in range(1, 13)), F.lit(0))
    return F.concat(code, ((10 - total % 10) % 10).cast("string"))


def products_and_listings(spark, d):
    """Every part as a product (a seventh without a brand) and as a listing (a third with the brand in a column)."""
    part = table(spark, d, "part")
    code, kind = _coded(F.expr(_CODE.format(s="STRING"))), _KIND
    products = part.select(
        F.col("p_partkey").alias("id"), F.expr(_PRODUCT.format(kind=kind)).alias("title"),
        F.when(F.col("p_partkey") % 7 != 0, F.col("p_brand")).alias("brand"), code.alias("gtin"),
    )
    nothing = F.lit(None).cast("string")
    listings = part.select(
        F.col("p_partkey").alias("listing"), F.expr(_LISTING.format(kind=kind)).alias("title"), F.when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).alias("brand"),
        F.concat(F.lit("seller "), F.col("p_size").cast("string")).alias("seller"), F.lit("tiki").alias("source"), nothing.alias("domain"), code.alias("gtin"),
        F.round("p_retailprice").cast("long").alias("price_vnd"), F.col("p_size").cast("long").alias("sold"), nothing.alias("importer"),
    )
    return products, listings


_PAIRS = f"""p AS (SELECT p_partkey AS id, list_distinct(string_split(p_name || {_KIND}, ' ')) AS words, nullif(trim({_KIND}), '') AS c, p_size * 10 AS size,
  CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS brand, {_CODE.format(s='VARCHAR')} AS code FROM part),
l AS (SELECT p_partkey AS listing, string_split(lower(CASE p_partkey % 3 WHEN 0 THEN replace(p_brand, '#', '') || p_name ELSE p_name END || {_KIND}), ' ') AS have,
  nullif(trim({_KIND}), '') AS c, (p_size + p_partkey % 3) * 10 AS size, {_CODE.format(s='VARCHAR')} AS code,
  regexp_replace(lower(CASE p_partkey % 3 WHEN 0 THEN p_brand || p_name || {_KIND} WHEN 1 THEN p_brand || p_name || {_KIND} ELSE p_name || p_brand || {_KIND} END
    || ((p_size + p_partkey % 3) * 10) || ' g'), '[^a-z0-9]', '', 'g') AS hay FROM part),
s AS (SELECT id, listing, CASE WHEN p.code = l.code THEN 1.0 ELSE least(1.0, greatest(0.0,
    greatest(CASE WHEN p.c IS NULL THEN 0.0 WHEN p.c = l.c THEN 1.0 ELSE 0.0 END, len(list_intersect(words, have))::DOUBLE / len(words))
    + CASE WHEN abs(p.size - l.size) <= 0.1 * greatest(p.size, l.size) THEN 0.1 ELSE -0.1 END)) END AS score
  FROM p, l WHERE p.code = l.code OR brand IS NULL OR contains(hay, regexp_replace(lower(brand), '[^a-z0-9]', '', 'g'))),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, listing) AS rank FROM s WHERE round(score, 9) >= 0.5)"""


@query(f"WITH {_PAIRS} SELECT id, listing, round(score, 6) AS score, rank FROM r WHERE rank <= 12")
def pool_match(spark, d):
    """J6, J7, O-P21: every product's twelve best listings."""
    products, listings = products_and_listings(spark, d)
    return LM.pool_matches(products, listings).select("id", "listing", F.round("score", 6).alias("score"), "rank")


@query(r"""WITH b AS (SELECT DISTINCT p_brand AS brand, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS run FROM part WHERE p_partkey % 7 <> 0),
h AS (SELECT p_partkey AS listing, regexp_replace(lower(CASE p_partkey % 3 WHEN 2 THEN p_name || p_brand ELSE p_brand || p_name END
  || CASE p_type WHEN 'PROMO' THEN ' porridge' WHEN 'ECONOMY' THEN ' biscuit' ELSE '' END || ((p_size + p_partkey % 3) * 10) || 'g'), '[^a-z0-9]', '', 'g') AS hay FROM part),
n AS (SELECT brand, count(*) AS brand_listings FROM b, h WHERE contains(hay, run) GROUP BY brand)
SELECT p_partkey AS id, brand_listings FROM part JOIN n ON p_brand = n.brand WHERE p_partkey % 7 <> 0""")
def brand_in_listings(spark, d):
    """How many listings hold each product's brand, also inside a longer word."""
    products, listings = products_and_listings(spark, d)
    return LM.brand_hits(products, listings)


_VI = "CASE p_type WHEN 'PROMO' THEN 'bột ăn dặm' WHEN 'ECONOMY' THEN 'bánh gạo ăn dặm' WHEN 'SMALL' THEN 'sữa' ELSE 'rice' END"
_EN = "CASE p_type WHEN 'PROMO' THEN 'baby cereal' WHEN 'ECONOMY' THEN 'baby rice cakes' WHEN 'SMALL' THEN 'sữa' ELSE 'rice' END"
_QUERY = "CASE WHEN p_size % 3 = 0 THEN 'HiPP ' ELSE '' END || {vi} || ' ' || p_name || ' ' || p_size || CASE WHEN p_size % 5 = 0 THEN ' Holle' ELSE '' END"


@query(f"""WITH q AS (SELECT p_partkey AS id, trim(CASE WHEN p_size % 3 = 0 THEN 'HiPP' ELSE '' END || CASE WHEN p_size % 5 = 0 THEN ' Holle' ELSE '' END) AS brands,
{_EN} || ' ' || p_name || ' ' || p_size AS rest, p_type NOT IN ('PROMO', 'ECONOMY', 'SMALL') AS plain, p_size % 2 = 0 AS captured FROM part)
SELECT id, trim(brands || ' ' || CASE WHEN captured AND NOT plain THEN 'auf deutsch ' || upper(rest) WHEN captured THEN 'auf deutsch ' || rest
WHEN plain THEN rest ELSE upper(rest) END) AS text FROM q""")
def query_rewriting(spark, d):
    """O-T26, O-T27, O-T29: a query of each part for a German market, half of them with a captured translation into German."""
    part = table(spark, d, "part")
    queries = part.select(F.col("p_partkey").alias("id"), F.expr(_QUERY.format(vi=_VI)).alias("query"), F.lit("de").alias("lang"))
    plain = ~F.col("p_type").isin("PROMO", "ECONOMY", "SMALL")
    rest = F.expr(f"{_EN} || ' ' || p_name || ' ' || p_size")
    english = F.when(plain, rest).otherwise(F.upper(rest))
    into = part.select(rest.alias("text"), F.lit("en").alias("lang"), english.alias("translation"), F.when(plain, "en").otherwise("vi").alias("detected"))
    even = part.select(english.alias("text"), F.lit("de").alias("lang"), F.concat(F.lit("auf deutsch "), english).alias("translation"), F.lit("en").alias("detected"), "p_size")
    return RW.translated_queries(queries, into.unionByName(even.where("p_size % 2 = 0").drop("p_size"))).select("id", "text")


_SECTIONS = "p_type IN ('ECONOMY', 'PROMO', 'SMALL') AS ingredients, p_type IN ('PROMO', 'LARGE') AS storage"


@query(f"""WITH names AS (SELECT p_partkey AS id, p_brand, list_distinct(string_split(lower(p_name || ' ' || CAST(p_size % 11 AS VARCHAR)), ' ')) AS tokens, {_SECTIONS} FROM part),
p AS (SELECT a.id AS id, b.id AS donor, len(list_intersect(a.tokens, b.tokens)) AS i, len(a.tokens) + len(b.tokens) AS s, NOT a.ingredients AND b.ingredients AS ingredients, NOT a.storage AND b.storage AS storage
  FROM names a JOIN names b ON a.p_brand = b.p_brand AND a.id <> b.id),
q AS (SELECT id, donor, i / CAST(s - i AS DOUBLE) AS score, unnest(CASE WHEN ingredients AND storage THEN ['ingredients', 'storage'] WHEN ingredients THEN ['ingredients'] ELSE ['storage'] END) AS section
  FROM p WHERE (ingredients OR storage) AND i / CAST(s - i AS DOUBLE) >= 0.6)
SELECT id, section, donor, round(score, 6) AS score FROM q QUALIFY row_number() OVER (PARTITION BY id, section ORDER BY score DESC, donor) = 1""")
def section_donors(spark, d):
    """For each section that a part lacks, the most similar part of its brand that has it."""
    tokens = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", (F.col("p_size") % 11).cast("string"))), " "))
    ingredients, storage = F.col("p_type").isin("ECONOMY", "PROMO", "SMALL"), F.col("p_type").isin("PROMO", "LARGE")
    items = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), "p_brand", tokens.alias("tokens"), ingredients.alias("ingredients"), storage.alias("storage")
    )
    found = M.section_donors(items, "tokens", ["ingredients", "storage"], 0.6, on=["p_brand"])
    return found.select("id", "section", "donor", F.round("score", 6).alias("score"))


@query("""WITH v AS (SELECT n_nationkey % 3 AS k, n_nationkey * 20000000 + 1704067200000 AS t, 100.0 + n_nationkey AS rate FROM nation),
e AS (SELECT event_id, user_id % 4 AS k, epoch_ms(ts) AS t FROM events)
SELECT event_id, coalesce((SELECT arg_max(rate, v.t) FROM v WHERE v.k = e.k AND v.t <= e.t), CASE e.k WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 END) AS rate FROM e""")
def rates_of_events(spark, d):
    """Each event's rate as of its time, from versions that come one after the other; fixed rates before the first."""
    name = lambda c: F.concat(F.lit("C"), c.cast("string"))
    versions = table(spark, d, "nation").select(
        name(F.col("n_nationkey") % 3).alias("currency"), (F.col("n_nationkey").cast("long") * 20_000_000 + 1_704_067_200_000).alias("t"),
        (F.col("n_nationkey") + 100.0).alias("rate"),
    )
    rows = table(spark, d, "events").select("event_id", name(F.col("user_id") % 4).alias("currency"), F.unix_millis("ts").alias("t"))
    return lookups.rates_as_of(rows, versions, fallback={"C0": 1.0, "C1": 2.0}).select("event_id", "rate")
