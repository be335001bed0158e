"""Which rows go on: admission of search rows, import candidates, detail candidates, best sellers, suggestions.

Predicates are Columns; what has to choose a first row of a key is an aggregate over an explicit order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import price as P
from ..functions import text as T
from . import rows as R

#: Relevance under which a row of a web source, or of one that repeats others, is hidden.
WEB_LEAST = 0.3
#: Candidates of one import check, and best sellers of a market among them.
CANDIDATES, BEST_PER_MARKET = 80, 10


def shop_bonus(kind: Column, filters: Column, pos: Column) -> Column:
    """What a row gains for being found by a shop's own search: more for the first 24; nothing for web sources
    and for shops whose search returns unrelated goods."""
    return F.when((kind != "web") & ~F.coalesce(filters, F.lit(False)), F.when(pos < 24, 0.45).otherwise(0.2)).otherwise(0.0)


def admission(rows: DataFrame, loose: Column) -> DataFrame:
    """rows with ``fate``: off_form (another product form), hidden (loose source, relevance under WEB_LEAST) or kept.

    ``loose`` tells rows of web sources and of sources that repeat others.  A missing relevance is kept."""
    weak = loose & (F.col("relevance") < WEB_LEAST)
    return rows.withColumn(
        "fate", F.when(F.coalesce("off_form", F.lit(False)), "off_form").when(F.coalesce(weak, F.lit(False)), "hidden").otherwise("kept")
    )


def task_counts(judged: DataFrame, task: Sequence[str]) -> DataFrame:
    """Per task: rows kept, hidden and of another form."""
    fates = (("n", "kept"), ("hidden", "hidden"), ("off_form", "off_form"))
    return judged.groupBy(*task).agg(*(F.count_if(F.col("fate") == fate).alias(name) for name, fate in fates))


def snapshot_rows(items: DataFrame) -> DataFrame:
    """Listings of home shops that say how much they sold or how often they were reviewed."""
    return items.where((F.col("market") == "vn") & (F.col("kind") == "shop") & (F.col("sold").isNotNull() | F.col("reviews").isNotNull()))


def candidate_key(gtin: Column, brand: Column, title: Column) -> Column:
    """What makes two candidates the same product: the barcode, else the folded brand and title."""
    name = T.fold(F.concat_ws(" ", F.coalesce(brand, F.lit("")), title))
    return F.coalesce(F.nullif(gtin, F.lit("")), F.trim(F.regexp_replace(name, "[^a-z0-9]+", " ")))


def for_babies(item: Sequence[str] = ()) -> Column:
    """Best sellers, rows with an age, rows of the food database, and titles that name a baby."""
    return (
        F.coalesce("bestseller", F.lit(False)) | F.col("age_months").isNotNull() | (F.col("source") == "off")
        | F.col("title").rlike(L.FOR_BABIES)
    )


def import_candidates(found: DataFrame, best: DataFrame, markets: Sequence[str], limit: int = CANDIDATES) -> DataFrame:
    """Candidates of an import check: the first best sellers of each wanted market, then found rows; one a product.

    Both tables hold items with ``ord``, the order of arrival.  The limit is the check's own."""
    top = R.top_per_group(
        best.where(~F.coalesce("non_food", F.lit(False)) & F.col("market").isin(*markets)), ["market"], [F.col("ord")], BEST_PER_MARKET, "_place"
    ).drop("_place")
    both = top.withColumn("_from", F.lit(0)).withColumn("bestseller", F.lit(True)).unionByName(
        found.withColumn("_from", F.lit(1)), allowMissingColumns=True
    )
    abroad = (
        (F.col("kind") != "web") & ~F.coalesce("non_food", F.lit(False)) & (F.col("market") != "vn")
        & (F.coalesce("country", F.lit("")) != "vn") & for_babies()
    )
    keyed = both.where(abroad).withColumn("_key", candidate_key(F.col("gtin"), F.col("brand"), F.col("title")))
    first = R.first_wins(keyed, ["_key"], ["_from", "ord"])
    return first.orderBy("_from", "ord").limit(limit).drop("_key", "_from")


def fetchable(source: Column, url: Column, domain: Column, has_detail: Column) -> Column:
    """Whether a detail page can be read: its source has a reader, or its address is that of a plain page."""
    plain = (
        ~source.isin(*L.NO_PLAIN_PAGE) & (F.coalesce(url, F.lit("")) != "") & ~url.rlike(r"(?i)\.(pdf|docx?|xlsx?)($|\?)")
        & ~F.coalesce(domain, F.lit("")).rlike(L.NO_DETAIL_HOSTS)
    )
    return F.coalesce(has_detail, F.lit(False)) | F.coalesce(plain, F.lit(False))


def enrichable(source: Column, url: Column, domain: Column, has_detail: Column, gtin: Column) -> Column:
    """A page to read, or a valid barcode to look up."""
    return fetchable(source, url, domain, has_detail) | P.gtin(gtin).isNotNull()


def detail_pending() -> Column:
    """Shop rows with an address or barcode that nobody has tried to complete."""
    code, url = (F.coalesce(c, F.lit("")) != "" for c in ("gtin", "url"))
    possible = (F.col("kind") != "web") & (~F.col("source").isin(*L.NO_PLAIN_PAGE) | code) & (url | code)
    return possible & ~F.coalesce("enrich_tried", F.lit(False)) & ~F.coalesce("enriched", F.lit(False))


def lead_brand(title: Column) -> Column:
    """The brand that opens a title: what stands in leading brackets, else the first word, with the second where
    that is a usual tail of brand names and capitalised; null where the title opens with a digit or single sign."""
    bracket = F.trim(F.regexp_extract(title, r"^[【\[]([^】\]]{1,20})[】\]]", 1))
    words = F.filter(F.split(F.regexp_replace(title, r"^[^\p{L}\p{N}]+", ""), r"[\s,–—|:()]+"), lambda w: w != "")
    one, two = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    tail = two.rlike(L.BRAND_TAIL) & two.rlike(r"^\p{Lu}")
    spoken = F.when(F.coalesce(tail, F.lit(False)), F.concat_ws(" ", one, two)).otherwise(one)
    return F.when(bracket != "", bracket).when((F.length(one) >= 2) & ~one.rlike("^[0-9]"), spoken)


def best_sellers(pages: DataFrame, formula: bool = False) -> DataFrame:
    """Rows of ranked pages without what is no food (and, unless wanted, no formula), each with its brand.

    pages(title, brand, rank, ...); a guessed brand stays where the title opens with it."""
    title = F.col("title")
    keep = ~title.rlike(L.NOT_FOOD) & (F.lit(formula) | ~title.rlike(L.FORMULA))
    opens = F.startswith(T.squash(title), T.squash(F.col("brand")))
    return pages.where(keep).withColumns({
        "brand": F.when(F.coalesce(opens, F.lit(False)), F.col("brand")).otherwise(F.coalesce(lead_brand(title), "brand")),
        "bestseller": F.lit(True),
    })


def similar_query(brand: Column, title: Column, words: int = 8) -> Column:
    """A search for products like this one: brand, then the title without brackets, its leading brand, and all after
    the first comma, bar, dash or colon; at most eight words."""
    b = F.coalesce(brand, F.lit(""))
    plain = F.regexp_replace(title, r"\[[^\]]*\]|\([^)]*\)|【[^】]*】", " ")
    rest = F.when(
        F.startswith(F.lower(plain), F.lower(b)), F.regexp_replace(F.substr(plain, F.length(b) + 1), r"^\s+", "")
    ).otherwise(plain)
    text = T.clean(F.concat_ws(" ", F.nullif(b, F.lit("")), F.get(F.split(rest, r"[,|–\-:]"), F.lit(0))))
    return F.array_join(F.slice(F.split(text, " "), 1, words), " ")


def suggestions(answers: DataFrame, limit: int = 12) -> DataFrame:
    """(query, suggestion, place): the answers of all providers in order, one for each folded text, the first twelve.

    answers(query, provider, pos, text); provider is the order in which they are asked."""
    one = R.first_wins(
        answers.where(F.col("text").isNotNull()).withColumn("_folded", F.trim(T.fold(F.col("text")))), ["query", "_folded"], ["provider", "pos"]
    )
    top = R.top_per_group(one, ["query"], [F.col("provider"), F.col("pos")], limit, "place")
    return top.select("query", F.col("text").alias("suggestion"), "place")


def seeds(queries: DataFrame) -> DataFrame:
    """(query, seed): every query with every shopper's modifier."""
    each = F.explode(F.array(*map(F.lit, L.MODIFIERS)))
    return queries.select("query", each.alias("_m")).select("query", F.trim(F.concat("query", "_m")).alias("seed"))


def brand_interest(answers: DataFrame, sample: int = 5) -> DataFrame:
    """(brand, suggestions, sample): distinct suggestions that hold the brand in a baby's context.

    answers(brand, pos, text), the answers for the brand alone before those for the brand with the modifier."""
    folded = T.fold(F.col("text"))
    about = F.contains(T.squash(F.col("text")), T.squash(F.col("brand"))) & folded.rlike(L.BABY_CONTEXT)
    one = answers.where(about).groupBy("brand", folded.alias("_folded")).agg(
        F.min("pos").alias("_pos"), F.min_by("text", "pos").alias("text")
    )
    place = F.row_number().over(Window.partitionBy("brand").orderBy("_pos", "_folded"))
    few = one.withColumn("_place", place)
    return few.groupBy("brand").agg(
        F.count(F.lit(1)).alias("suggestions"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("_place") <= sample, F.struct("_place", "text")))), lambda s: s["text"]
        ).alias("sample"),
    )


def importer_search(directory: DataFrame, words: str) -> DataFrame:
    """Directory rows whose brand or importer holds the squashed words; by brand, most often seen first."""
    want = T.squash(F.lit(words))
    hit = F.contains(T.squash(F.col("brand")), want) | F.contains(T.squash(F.col("importer")), want)
    return directory.where(hit).orderBy(T.fold(F.col("brand")), F.desc("seen"), "importer")


def page(df: DataFrame, order: Sequence[Column], number: int = 0, size: int = 120) -> DataFrame:
    """The rows of one page of a totally ordered list; Spark keeps (number + 1) * size rows a task."""
    return df.orderBy(*order).offset(number * size).limit(size)
