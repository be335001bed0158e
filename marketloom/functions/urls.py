"""Addresses: hosts, canonical forms and keys, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean

# Query parameters that only track, by their prefix.
TRACKING = r"^(utm_|fbclid|gclid|srsltid|ref)"


def host(url: Column) -> Column:
    """Lower-case host without a leading www.; empty where there is none."""
    h = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(h, r"^www\.", "")


def norm_url(url: Column) -> Column:
    """Host, path and untracked query in lower case; no scheme, fragment, www. or closing slash."""
    plain = F.regexp_replace(url, "#.*$", "")
    path = F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?]*([^?]*)", 1)
    kept = F.filter(
        F.split(F.regexp_extract(plain, r"\?(.*)$", 1), "&"), lambda kv: (kv != "") & ~kv.rlike(TRACKING)
    )
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    full = F.lower(F.concat(host(url), F.regexp_replace(path, "/$", ""), query))
    return F.when(host(url) == "", url).otherwise(full)


def listing_key(url: Column, source: Column, title: Column) -> Column:
    """A listing across runs: its address without query and fragment, else its source and title."""
    address = F.lower(F.regexp_replace(F.regexp_extract(url, r"^([^?#]*)", 1), "/$", ""))
    return F.when(url != "", address).otherwise(F.lower(F.concat(source, F.lit(":"), title)))


def suffixes(h: Column) -> Column:
    """A host and all domains it belongs to: a.b.c, b.c, c."""
    labels = F.split(h, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )


def redirect_target(url: Column, parameter: str) -> Column:
    """The address in a search engine's redirect parameter, url-decoded, else the url itself."""
    got = F.regexp_extract(url, rf"[?&]{parameter}=([^&#]*)", 1)
    return F.when(got != "", F.url_decode(got)).otherwise(url)


def base64_target(url: Column, parameter: str = "u") -> Column:
    """The address in a redirect parameter that holds "a1" and base64 with - and _."""
    got = F.regexp_extract(url, rf"[?&]{parameter}=a1([A-Za-z0-9_\-]+)", 1)
    padded = F.rpad(F.translate(got, "-_", "+/"), F.ceil(F.length(got) / 4) * 4, F.lit("="))
    return F.when(got != "", F.unbase64(padded).cast("string")).otherwise(url)


def public_http(url: Column) -> Column:
    """Whether an address is http(s) and not of a local or private host."""
    h = host(url)
    private = r"^(localhost|.*\.local|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(1[6-9]|2[0-9]|3[01])\..*|0\..*|\[.*)$"
    return clean(url).rlike("(?i)^https?://") & (h != "") & ~h.rlike(private)


def shop_name(h: Column) -> Column:
    """A host without the label that only says that it is a shop."""
    return F.regexp_replace(h, r"^(www|shop|shopping|groceries|tienda|supermercado|courses)\.", "")
