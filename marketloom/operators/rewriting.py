"""Search queries for another market: brands cut out, baby-food phrases by a glossary, the rest by captured translations.

Translations are rows, so a whole table of queries is rewritten by three equi joins.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions.phrases import folded
from ..functions.text import SPACE, english_food_words, pattern

# Vietnamese phrases of baby food in English, the longer ones first.
GLOSSARY = (
    ("bánh gạo ăn dặm", "baby rice cakes"), ("bánh quy ăn dặm", "baby biscuits"), ("bánh ăn dặm", "baby snacks"),
    ("bột ăn dặm", "baby cereal"), ("bột dinh dưỡng", "baby cereal"), ("cháo ăn dặm", "baby porridge"),
    ("súp ăn dặm", "baby soup"), ("mì ăn dặm", "baby noodles"), ("mỳ ăn dặm", "baby noodles"), ("nui ăn dặm", "baby pasta"),
    ("dầu ăn dặm", "baby food oil"), ("hạt nêm ăn dặm", "baby seasoning"), ("gia vị ăn dặm", "baby seasoning"),
    ("ruốc ăn dặm", "baby meat floss"), ("sữa chua ăn dặm", "baby yogurt"), ("váng sữa", "baby fromage frais"),
    ("hoa quả nghiền", "baby fruit puree"), ("trái cây nghiền", "baby fruit puree"), ("rau củ nghiền", "baby vegetable puree"),
    ("đồ ăn dặm", "baby food"), ("thức ăn dặm", "baby food"), ("ăn dặm", "baby food"), ("sữa công thức", "infant formula"),
    ("sữa bột", "formula milk"), ("cho bé", "for baby"), ("cho trẻ", "for kids"), ("trẻ em", "kids"), ("trẻ sơ sinh", "infant"),
)
# Words that no market translates, words of children's food in two languages, letters that only Vietnamese has.
KEEP = ("puffs", "puff", "melts", "yogurt melts", "teethers", "squeeze", "bio")
CHILD_VI = pattern(r"ăn dặm|cho bé|em bé|trẻ em|trẻ sơ sinh|nhũ nhi|\bbé\b")
CHILD_EN = pattern("baby|babies|infant|toddler|kid|child|weaning")
VIETNAMESE = "(?iu)[ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]"


def _known_names(names: Sequence[str]) -> dict[tuple[str, ...], int]:
    """Folded words of each name, and its turn: names of more words first, else in their order."""
    words = []
    for name in dict.fromkeys(names):
        plain = tuple(w for w in ("".join(c for c in part if c.isascii() and c.isalnum()) for part in folded(name).split()) if w)
        if len("".join(plain)) >= 3:
            words.append(plain)
    ordered = sorted(words, key=len, reverse=True)
    return {w: i for i, w in reversed(list(enumerate(ordered)))}


def without_names(query: str, known: dict[tuple[str, ...], int]) -> tuple[list[str], str]:
    """Names in a query, as written, and its other words; words that then are neighbours are looked at again."""
    most = max(map(len, known), default=0)
    names: list[str] = []
    words = query.split()
    while True:
        plain = ["".join(c for c in folded(w) if c.isascii() and c.isalnum()) for w in words]
        hits = [
            (known[key], i, n) for n in range(1, most + 1) for i in range(len(words) - n + 1) if (key := tuple(plain[i : i + n])) in known
        ]
        used: set[int] = set()
        for _, i, n in sorted(hits):
            if used.isdisjoint(range(i, i + n)):
                used.update(range(i, i + n))
                names.append(" ".join(words[i : i + n]))
        if not used:
            return names, query if not names else " ".join(words)
        words = [w for i, w in enumerate(words) if i not in used]


def split_brands(query: Column, names: Sequence[str] = (*L.BRANDS, *KEEP)) -> Column:
    """struct(brands, rest): known names of a query in order of their length in words, and what else it says."""
    known = _known_names(names)

    @F.pandas_udf("brands array<string>, rest string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([without_names(q or "", known) for q in s], columns=["brands", "rest"])

    return run(query)


def glossary(text: Column, entries: Sequence[tuple[str, str]] = GLOSSARY) -> Column:
    """Small letters, with each phrase's English in its place; one entry after the other."""
    out = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    for phrase, english in entries:
        out = F.replace(out, F.lit(phrase), F.lit(english))
    return F.trim(out)


def first_translations(table: DataFrame) -> DataFrame:
    """One row of table(text, lang, translation, detected[, at]) by text and language: the first captured, of equals the smallest."""
    at = F.col("at") if "at" in table.columns else F.lit(0)
    row = F.struct(F.nullif("translation", F.lit("")).alias("translation"), F.lower("detected").alias("detected"))
    return table.groupBy("text", "lang").agg(F.min_by(row, F.struct(at, "translation", "detected")).alias("t")).select("text", "lang", "t.*")


def translated_queries(queries: DataFrame, table: DataFrame) -> DataFrame:
    """queries(query, lang) with ``text``, the query as the market of that language is searched.

    ``table`` has captured translations; ``detected`` is the language that the text was found to be in.  Vietnamese
    queries stay for Vietnamese markets, brands are never translated and come first.  A Vietnamese query goes through the
    glossary and English, and keeps its word for children; one in the market's own language stays; others go through
    English, food words of other languages first.  What no capture translates stays as it is.
    """
    known = first_translations(table)

    def looked_up(df: DataFrame, text: str, lang: Column, name: str) -> DataFrame:
        found = known.select(F.col("text").alias("__text"), F.col("lang").alias("__lang"), F.struct("translation", "detected").alias(name))
        return df.withColumn("__to", lang).join(found, (F.col(text) == F.col("__text")) & (F.col("__to") == F.col("__lang")), "left").drop("__text", "__lang", "__to")

    base = F.substring_index("lang", "-", 1)
    df = queries.withColumn("__split", split_brands(F.col("query"))).withColumns({"__base": base, "__rest": F.col("__split.rest")})
    vietnamese = F.col("__rest").rlike(VIETNAMESE)
    df = df.withColumns({"__vi": vietnamese, "__first": F.when(vietnamese, glossary(F.col("__rest"))).otherwise(F.trim("__rest"))})
    df = looked_up(df, "__first", F.lit("en"), "__en").withColumn("__fixed", english_food_words(F.col("__rest")))
    df = looked_up(df, "__fixed", F.lit("en"), "__again")
    child = F.col("__rest").rlike(CHILD_VI)
    vi = F.coalesce(F.col("__en.translation"), F.col("__rest"))
    vi = F.when(child & ~vi.rlike(CHILD_EN), F.concat(F.lit("baby "), vi)).otherwise(vi)
    text = F.coalesce(F.col("__en.translation"), F.col("__rest"))
    foreign = F.when(F.col("__fixed") != F.col("__rest"), F.coalesce(F.col("__again.translation"), text)).otherwise(text)
    detected = F.col("__en.detected")
    english = F.when(F.col("__vi"), vi).when(detected.isNotNull() & (detected != "en"), foreign).otherwise(F.col("__rest"))
    df = df.withColumn("__english", F.trim(F.regexp_replace(english, SPACE + "+", " ")))
    own = ~F.col("__vi") & detected.eqNullSafe(F.col("__base"))
    df = looked_up(df, "__english", F.col("lang"), "__out")
    out = F.when(own, F.col("__rest")).when(F.col("__base") == "en", F.col("__english")).otherwise(F.coalesce(F.col("__out.translation"), F.col("__english")))
    brands = F.array_join("__split.brands", " ")
    joined = F.when(F.size("__split.brands") == 0, out).when(F.trim("__rest") == "", brands).otherwise(
        F.trim(F.regexp_replace(F.concat_ws(" ", brands, out), SPACE + "+", " "))
    )
    done = df.withColumn("text", F.when(F.col("__base") == "vi", F.col("query")).otherwise(joined))
    return done.drop(*(c for c in done.columns if c.startswith("__")))
