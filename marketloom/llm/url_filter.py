"""Operator 7: url verdicts by rules, and by naive Bayes over segmented host words where no rule fits.

Host names glue words together.  A unigram model (words of page titles and of delimited url parts,
counted over all pages) splits every run of letters of a host into its most probable words by
Viterbi.  The words of host and path are the tokens of a multinomial naive Bayes model.  Its
training labels are weak: a url whose segmented host holds a word of the seed list counts as
blocked, others as allowed; the seed words themselves enter with a pseudo count.

All work is on distinct values: candidate substrings of distinct host runs meet the word counts in a
join, so the word list is never collected, and scores are made per distinct (host, path tokens).

A url that is null or has no ``://`` has empty host and path, meets no rule and is scored by the prior
alone (allow).  Rows that repeat a page_id, and null page_ids, are judged each.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

# Fixed values: (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
# Seed words of unwanted sites.
SEEDS = (
    "ads", "ad", "adult", "bet", "bets", "casino", "cheap", "click", "escort", "farm", "free", "gambling",
    "loan", "loans", "lottery", "malware", "phishing", "pills", "poker", "porn", "promo", "sex", "slots",
    "spam", "track", "tracker", "tracking", "viagra", "win", "winner", "xxx",
)
#: Seeds that ordinary names hold too; they add to a score but never make a weak label alone.
WEAK_SEEDS = ("ad", "cheap", "click", "farm", "free", "promo", "track", "win")
LONGEST_WORD = 20
SEED_COUNT = 50
#: Pseudo count of a seed word among blocked tokens, as a share of their total.
SEED_SHARE = 0.01


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(name)).otherwise(verdict)
    return rule, verdict


def viterbi(run: str, counts: dict[str, int], total: int) -> list[str]:
    """Most probable words; an unknown word of n letters has probability 10 / (total * 10^n)."""
    best, back = [0.0] + [-math.inf] * len(run), [0] * (len(run) + 1)
    for end in range(1, len(run) + 1):
        for start in range(max(0, end - LONGEST_WORD), end):
            word = run[start:end]
            n = counts.get(word)
            p = math.log(n / total) if n else math.log(10 / total) - len(word) * math.log(10)
            if best[start] + p > best[end]:
                best[end], back[end] = best[start] + p, start
    words, end = [], len(run)
    while end:
        words.append(run[back[end] : end])
        end = back[end]
    return words[::-1]


def _letters(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) > 0)


def word_counts(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(word, n): words of titles and of url parts, and the seeds; those no longer than LONGEST_WORD."""
    titles = pages.select(F.explode(_letters(F.regexp_extract("html", r"(?is)<title[^>]*>([^<]*)", 1))).alias("word"), F.lit(1).alias("n"))
    # the parts of a host are glued names as often as words: they count once for each distinct host
    parts_ = hosts.select(F.explode(F.array_distinct(_letters(F.col("host")))).alias("word"), F.lit(1).alias("n"))
    seeds = pages.sparkSession.createDataFrame([(w, SEED_COUNT) for w in SEEDS], "word string, n int")
    return (
        titles.union(parts_).union(seeds).where(F.length("word") <= LONGEST_WORD).groupBy("word").agg(F.sum("n").alias("n"))
    )


def segments(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, words) of distinct letter runs."""
    total = counts.agg(F.sum("n").alias("total"))
    reach = F.sequence(F.lit(1), F.least(F.length("run"), F.lit(LONGEST_WORD)))
    pieces = (
        runs.select("run", F.explode(reach).alias("size"))
        .select("run", "size", F.explode(F.sequence(F.lit(1), F.length("run") - F.col("size") + 1)).alias("at"))
        .select("run", F.expr("substring(run, at, size)").alias("word"))
        .distinct()
    )
    known = pieces.join(counts, "word").groupBy("run").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    both = runs.join(known, "run", "left").crossJoin(F.broadcast(total))  # one row

    @F.pandas_udf("array<string>")
    def split(run: pd.Series, known: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series(
            [
                viterbi(r, {x["word"]: x["n"] for x in (k if k is not None else [])}, int(t))
                for r, k, t in zip(run, known, total, strict=True)
            ]
        )

    return both.select("run", split("run", "known", F.coalesce("total", F.lit(1))).alias("words"))


def _path_tokens(path: Column) -> Column:
    """Letter runs of a path, digits as one sign."""
    return F.filter(
        F.transform(F.split(F.lower(path), r"[/._~=+\-]+"), lambda t: F.when(t.rlike(r"^[0-9]+$"), "<number>").otherwise(t)),
        lambda t: F.length(t) > 0,
    )


def judge(spark: SparkSession, pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Per row of pages(page_id, url, html): page_id, host, path, rule, verdict, p_block."""
    scratch = Scratch(spark, "urls")
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    host, path = parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("tail", _path_tokens(F.col("path")))
    bags = scratch.write("bags", urls.groupBy("host", "tail").agg(F.count(F.lit(1)).alias("pages")))
    hosts = bags.select("host").distinct()
    # the last label is the public suffix; it names no site
    name = F.regexp_replace("host", r"\.[^.]*$", "")
    host_runs = hosts.select("host", F.explode(F.array_distinct(_letters(name))).alias("run"))
    split = segments(host_runs.select("run").distinct(), word_counts(pages, hosts))
    named = host_runs.join(split, "run").groupBy("host").agg(F.flatten(F.collect_list("words")).alias("words"))
    bags = scratch.write(
        "tokens",
        bags.join(named, "host", "left").select(
            "host", "tail", "pages", F.concat(F.coalesce("words", F.array().cast("array<string>")), "tail").alias("tokens"),
            F.coalesce(F.arrays_overlap("words", F.array(*(F.lit(w) for w in SEEDS if w not in WEAK_SEEDS))), F.lit(False)).alias("bad"),
        ),
    )
    each = bags.select("host", "tail", "pages", "bad", F.explode("tokens").alias("token"))
    counts = each.groupBy("token").agg(
        F.sum(F.when(F.col("bad"), F.col("pages")).otherwise(0)).alias("block"),
        F.sum(F.when(F.col("bad"), 0).otherwise(F.col("pages"))).alias("allow"),
    )
    totals = counts.agg(
        F.coalesce(F.sum("block"), F.lit(0)).alias("all_block"), F.coalesce(F.sum("allow"), F.lit(0)).alias("all_allow"), F.count(F.lit(1)).alias("kinds")
    )
    seeded = F.when(F.col("token").isin(*SEEDS), F.greatest(F.col("all_block") * SEED_SHARE, F.lit(1.0))).otherwise(0.0)
    weights = counts.crossJoin(F.broadcast(totals)).select(  # one row
        "token",
        (
            F.log((F.col("block") + seeded + 1) / (F.col("all_block") * (1 + SEED_SHARE * len(SEEDS)) + F.col("kinds")))
            - F.log((F.col("allow") + 1) / (F.col("all_allow") + F.col("kinds")))
        ).alias("weight"),
    )
    scores = (
        each.join(weights, "token")
        .groupBy("host", "tail")
        .agg(F.sum("weight").alias("odds"))
    )
    # sums of doubles depend on their order in the last bits; verdicts do not hang on those
    scores = scores.select("host", "tail", F.round("odds", 9).alias("odds"))
    out = urls.join(scores, ["host", "tail"], "left")
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    odds = F.coalesce("odds", F.lit(-1.0))
    return out.select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(odds > 0, "block").otherwise("allow")).alias("verdict"),
        F.round(1 / (1 + F.exp(-odds)), 6).alias("p_block"),
    )
