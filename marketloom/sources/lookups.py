"""Captured answers of lookup services, stored documents, and cached rows, as tables.

A capture's payload is the JSON text that a service answered with.  All readers are projections inside the JVM.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import price as P

#: Order in which suggestion services are asked.
PROVIDERS = {"google": 0, "ddg": 1}


def suggestion_answers(captures: DataFrame) -> DataFrame:
    """(query, provider, pos, text) of captures(query, provider, payload): a pair [query, [texts]] of one service, a list
    of {phrase} of the other.  Payloads that are neither give no rows."""
    texts = F.when(
        F.col("provider") == "google", F.from_json(F.get_json_object("payload", "$[1]"), "array<string>")
    ).otherwise(F.transform(F.from_json("payload", "array<struct<phrase:string>>"), lambda p: p["phrase"]))
    rank = F.element_at(F.create_map(*(F.lit(x) for pair in PROVIDERS.items() for x in pair)), F.col("provider"))
    return captures.select("query", rank.alias("provider"), F.posexplode(texts).alias("pos", "text")).where("text is not null")


def rates(captures: DataFrame, fallback: Mapping[str, float] | None = None) -> DataFrame:
    """(currency, rate, live): đồng for one unit.

    captures(t, payload) of a service that gives units for one dollar; the last successful answer counts.  Without
    any, the fixed rates; they also stand for currencies only they have."""
    good = captures.where(F.get_json_object("payload", "$.result") == "success").select(
        "t", F.from_json(F.get_json_object("payload", "$.rates"), "map<string,double>").alias("rates")
    )
    last = good.agg(F.max_by("rates", "t").alias("rates"))
    live = last.select(F.explode("rates").alias("currency", "per_usd"), F.element_at("rates", "VND").alias("vnd")).where("per_usd <> 0")
    live = live.select("currency", (F.col("vnd") / F.col("per_usd")).alias("rate"), F.lit(True).alias("live"))
    fixed = captures.sparkSession.createDataFrame(list((fallback or L.FALLBACK_RATES).items()), "currency string, fixed double")
    # two tables of a currency a row
    return fixed.join(live, "currency", "full").select(
        "currency", F.coalesce("rate", "fixed").alias("rate"), F.coalesce("live", F.lit(False)).alias("live")
    )


def rates_as_of(rows: DataFrame, versions: DataFrame, t: str = "t", fallback: Mapping[str, float] | None = None, horizon: int | None = None) -> DataFrame:
    """rows with ``rate`` and ``rate_t`` of their currency as it stood at their time, else the fixed rate and null.

    versions(currency, t, rate) is a table that grows by refreshes; a version counts from its own time on, for at most
    ``horizon`` (of the same unit as t) if that is given.  A currency's versions are one sorted array of a small table, so
    rows are not shuffled and need no order.
    """
    known = versions.where("rate is not null and rate <> 0").groupBy("currency", "t").agg(F.max("rate").alias("rate"))
    arrays = known.groupBy("currency").agg(F.array_sort(F.collect_list(F.struct("t", "rate"))).alias("_versions"))
    fixed = rows.sparkSession.createDataFrame(list((fallback or L.FALLBACK_RATES).items()), "currency string, _fixed double")
    table = fixed.join(arrays, "currency", "full")
    joined = rows.join(F.broadcast(table), "currency", "left")
    at = F.col(t)

    def counts(v: Column) -> Column:
        return (v["t"] <= at) if horizon is None else (v["t"] <= at) & (at - v["t"] <= horizon)

    held = F.filter("_versions", counts)
    return joined.withColumn("_v", F.try_element_at(held, F.lit(-1))).withColumns(
        {"rate": F.coalesce("_v.rate", "_fixed"), "rate_t": F.col("_v.t")}
    ).drop("_v", "_versions", "_fixed")


def in_dong(items: DataFrame, rate: DataFrame, price: str = "price", out: str = "price_vnd") -> DataFrame:
    """items with a price in đồng by a table of rates, one row a currency; unknown currencies give null."""
    r = rate.select("currency", F.col("rate").alias("_rate"))
    return items.join(F.broadcast(r), "currency", "left").withColumn(out, P.to_dong(F.col(price), F.col("_rate"))).drop("_rate")


def food_facts(captures: DataFrame) -> DataFrame:
    """(gtin, title, brand, ingredients, storage, usage) of captured records of the food database, one a barcode.

    captures(gtin, payload[, t]); a text counts from six signs on, and its languages are tried in a fixed order.  Of several
    records of a barcode one counts whole: the last captured, without ``t`` the one that says most, then the greatest."""

    def first(*names: str) -> Column:
        each = (F.get_json_object("payload", f"$.product.{n}") for n in names)
        return F.coalesce(*(F.when(F.length(F.trim(c)) > 5, c) for c in each))

    order = F.col("t") if "t" in captures.columns else F.lit(0)
    rows = captures.select(
        order.alias("_t"), P.gtin(F.col("gtin")).alias("gtin"), F.get_json_object("payload", "$.product.product_name").alias("title"),
        F.get_json_object("payload", "$.product.brands").alias("brand"),
        first(*(f"ingredients_text{s}" for s in ("_vi", "_en", "", "_de", "_fr"))).alias("ingredients"),
        first("conservation_conditions_vi", "conservation_conditions_en", "conservation_conditions").alias("storage"),
        first("preparation_vi", "preparation_en", "preparation").alias("usage"),
    ).where("gtin is not null")
    names = rows.columns[2:]
    told = sum((F.col(c).isNotNull().cast("int") for c in names), F.lit(0))
    record = F.struct(*names)
    last = rows.groupBy("gtin").agg(F.max_by(record, F.struct("_t", told.alias("n"), *names)).alias("r"))
    return last.select("gtin", "r.*")


def with_food_facts(items: DataFrame, facts: DataFrame) -> DataFrame:
    """items whose missing sections are filled from the database by valid barcode; section_notes names the origin."""
    names = ("ingredients", "storage", "usage")
    code = P.gtin(F.col("gtin"))
    # the many items without a valid barcode get keys that differ and meet nothing, so they do not gather in one task
    key = F.coalesce(code, F.concat(F.lit("none:"), F.xxhash64("id").cast("string")))
    f = facts.select(F.col("gtin").alias("_code"), *(F.col(n).alias(f"_{n}") for n in names))
    none = F.create_map().cast("map<string,string>")
    joined = items.withColumn("_key", key).join(f, F.col("_key") == F.col("_code"), "left")
    own = F.map_filter(F.coalesce("sections", none), lambda _, v: v != "")
    extra = F.map_filter(
        F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(f"_{n}") for n in names))),
        lambda k, v: v.isNotNull() & ~F.map_contains_key(own, k),
    )
    given = F.map_from_entries(F.transform(F.map_keys("_extra"), lambda k: F.struct(k.alias("k"), F.lit("food database").alias("v"))))
    notes = F.coalesce("section_notes", none) if "section_notes" in items.columns else none
    merged = joined.withColumn("_extra", extra).withColumn("section_notes", F.map_concat(notes, given)).withColumn("sections", F.map_concat(own, "_extra"))
    return merged.drop("_key", "_code", "_extra", *(f"_{n}" for n in names))


def translated(queries: DataFrame, table: DataFrame, language: str) -> DataFrame:
    """queries(query) with ``text`` in a language by a captured table(text, lang, translation); untranslated ones stay as they are."""
    known = table.where(F.col("lang") == language).groupBy(F.col("text").alias("query")).agg(F.min("translation").alias("_t"))
    return queries.join(known, "query", "left").withColumn("text", F.coalesce(F.nullif("_t", F.lit("")), "query")).drop("_t")


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of whole-document JSON files (a list or one object a file)."""
    return spark.read.schema(schema).json(path, multiLine=True)


def alive(cached: DataFrame, now: Column | None = None) -> DataFrame:
    """cached(key, exp, value) rows that have not expired, the last written of a key; exp in milliseconds."""
    at = F.unix_millis(F.current_timestamp()) if now is None else now
    return cached.where(F.col("exp") > at).groupBy("key").agg(F.max_by("value", "exp").alias("value"), F.max("exp").alias("exp"))
