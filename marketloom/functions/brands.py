"""Brands and countries of listings, as Columns."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon as L
from .text import clean, first_label, fold
from .urls import host, suffixes


def _plain(s: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c)).replace("đ", "d")


def guess_brand(text: Column) -> Column:
    """The first brand of the list that stands in a text as words of its own; null if none does."""
    known = [{"name": L.BRAND_SPELLING.get(b, b), "plain": _plain(b)} for b in L.BRANDS]
    brands = F.from_json(F.lit(json.dumps(known)), "array<struct<name:string,plain:string>>")  # folded to one literal
    some = fold(text).rlike("(?<!\\p{L})(?:" + "|".join(re.escape(_plain(b)) for b in L.BRANDS) + ")(?!\\p{L})")

    def first(folded: Column) -> Column:
        def stands(brand: Column) -> Column:
            own = F.concat(F.lit(r"(?<!\p{L})\Q"), brand["plain"], F.lit(r"\E(?!\p{L})"))
            return folded.contains(brand["plain"]) & F.regexp_like(folded, own)

        return F.get(F.filter(brands, stands), F.lit(0))["name"]

    # most texts name no brand: one pattern for all of them comes first
    return F.when(some, F.get(F.transform(F.array(fold(text)), first), F.lit(0)))


def normalize_brand(brand: Column) -> Column:
    """A known brand's spelling; else the text, in title case where it is all capitals or all small; null for none."""
    b = clean(brand)
    shaped = F.array_join(
        F.transform(F.split(F.lower(b), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " "
    )
    one_case = (b == F.upper(b)) | (b == F.lower(b))
    return F.when((b != "") & ~b.rlike(L.NO_BRAND), F.coalesce(guess_brand(b), F.when(one_case, shaped).otherwise(b)))


def _map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def country_from_url(url: Column) -> Column:
    """Country of a known shop's domain, else of a two-letter top domain that is one."""
    h = host(url)
    known = F.filter(F.transform(suffixes(h), lambda s: F.element_at(_map(L.DOMAIN_COUNTRY), s)), lambda c: c.isNotNull())
    top = F.regexp_extract(h, r"\.([a-z]{2})$", 1)
    top = F.when(top == "uk", "gb").otherwise(top)
    return F.when(h != "", F.coalesce(F.get(known, F.lit(0)), F.when(top.isin(*L.COUNTRIES), top)))


def country_from_currency(currency: Column) -> Column:
    return F.element_at(_map(L.CURRENCY_COUNTRY), currency)


def country_from_text(text: Column) -> Column:
    """Country that a short text of origin names."""
    return first_label(text, [(c, rf"(?iu)(?<!\p{{L}})(?:{words})(?!\p{{L}})") for words, c in L.ORIGIN_WORDS])


def rate(currency: Column, rates: dict[str, float] | None = None) -> Column:
    """Đồng for one unit: given rates, else the fixed ones."""
    return F.element_at(_map(rates or L.FALLBACK_RATES), currency)
