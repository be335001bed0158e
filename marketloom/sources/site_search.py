"""Searches of search engines that are restricted to the sites of shops: which engine's answer counts, and its rows as shop rows.

Sites are a table (market, site); a site stands for its host and all subdomains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators.rows import first_wins
from .captures import PRICE_IN_TEXT


def on_sites(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """Rows(market, url, ...) whose host is one of their market's sites; each distinct host is looked up once."""
    hosts = rows.select("market", U.host(F.col("url")).alias("__host")).where("__host <> ''").distinct()
    of = hosts.select("market", "__host", F.explode(U.suffixes(F.col("__host"))).alias("site"))
    known = of.join(sites.select("market", "site"), ["market", "site"], "left_semi").select("market", "__host").distinct()
    return rows.withColumn("__host", U.host(F.col("url"))).join(known, ["market", "__host"], "left_semi").drop("__host").select(*rows.columns)


def site_rows(answers: DataFrame, rows: DataFrame, sites: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """Shop rows of site searches.

    answers(market, query, provider, priority, keyed) are the providers that answered a search, an empty answer too;
    rows(market, query, provider, url, title, snippet, price_text, pos, ...) what they listed.  The first provider by priority with a row
    on the sites counts, and one with a key counts even without any: what comes after it only repeats that nothing is there.
    Its rows are one for each url, the first by position; the price stands in title and snippet where the engine tells none,
    and the seller is the host.
    """
    search = ["market", "query"]
    kept = on_sites(rows, sites)
    full = kept.select(*search, "provider").distinct().withColumn("__full", F.lit(True))
    counted = answers.join(full, [*search, "provider"], "left").where(F.col("keyed") | F.coalesce("__full", F.lit(False)))
    chosen = counted.groupBy(*search).agg(F.min_by("provider", F.struct("priority", "provider")).alias("provider"))
    found = kept.join(chosen, [*search, "provider"], "left_semi")
    once = first_wins(found, [*search, "url"], ["pos", *(tie or [])])
    text = F.regexp_extract(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))), PRICE_IN_TEXT, 0)
    return once.withColumns({
        "price_text": F.coalesce(F.nullif(F.col("price_text"), F.lit("")), F.nullif(text, F.lit(""))),
        "seller": U.shop_name(U.host(F.col("url"))), "source": F.lit("siteshop"), "kind": F.lit("shop"),
    })
