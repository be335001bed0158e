"""The whole listing match against all pairs, names in texts against plain search, the pool of listings."""

import random

from pyspark.sql import functions as F

from marketloom.functions import phrases
from marketloom.functions import price as P
from marketloom.functions import text as T
from marketloom.operators import brand_search
from marketloom.operators import listings as LM
from marketloom.operators.matching import match_score

LISTING = "listing long, title string, brand string, seller string, source string, domain string, gtin string, price_vnd long, sold long, importer string"
CODE = "4006381333931"


def all_pairs(products, listings):
    """Every product with every listing, without keys."""
    home = F.col("title_home") if "title_home" in products.columns else F.lit(None).cast("string")
    p = LM.identities(products).join(products.select("id", home.alias("title_home")), "id")
    right = listings.select(
        "listing", P.gtin(F.col("gtin")).alias("l_code"), P.parse_quantity(F.col("title"))["total"].alias("l_size"), LM.name_words(F.col("title")).alias("l_words"),
        phrases.concepts(F.col("title")).alias("l_concepts"), T.squash(F.concat_ws(" ", "brand", "title")).alias("hay"),
    )
    run = T.squash(F.col("brand"))
    brand_in = F.coalesce(F.col("brand"), F.lit("")).isin("") | ((F.length(run) >= 3) & F.contains(F.col("hay"), run))
    concept = phrases.concept_score(F.col("concepts"), F.col("l_concepts"))
    bare = (F.size("words") == 0) & concept.isNull()
    home_words = LM.distinctive(F.coalesce("title_home", F.lit("")), F.col("brand"))
    score = match_score(
        F.coalesce(F.col("code") == F.col("l_code"), F.lit(False)), brand_in, concept, LM.containment(F.col("words"), F.col("l_words")),
        F.when(~bare, LM.containment(home_words, F.col("l_words"))), bare, F.col("size"), F.col("l_size"),
    )
    known = ~bare | (F.coalesce(F.col("brand"), F.lit("")) != "") | (F.col("code") == F.col("l_code"))
    rows = p.crossJoin(right).where(known).withColumn("score", score).where("score >= 0.5").select("id", "listing", "score").collect()
    best = {}
    for r in rows:
        best.setdefault(r["id"], []).append((-round(r["score"], 9), r["listing"]))
    return {(i, listing): -s for i, found in best.items() for s, listing in sorted(found)[:12]}


def test_pool_match_equals_all_pairs(spark):
    rng = random.Random(7)
    brands = ["HiPP", "Holle", "Brand#2", "Brand#21", "Ella's Kitchen", "ab", None, None]
    words = "rice apple banana porridge cereal puree organic cream carrot spinach combiotic combi good night biscuit snack strawberry".split()
    vi = "bột gạo táo chuối cháo cà rốt hữu cơ bánh ăn dặm".split()

    def name():
        return " ".join(rng.sample(words, rng.randint(0, 4))) + rng.choice(["", " 250 g", " 240g", " 4x100 g", " 1 kg"])

    products, listings = [], []
    for i in range(120):
        home = " ".join(rng.sample(vi, rng.randint(1, 4))) if rng.random() < 0.4 else None
        products.append((i, name(), rng.choice(brands), CODE if i % 40 == 0 else None, home))
    for i in range(160):
        b, n = rng.choice(brands) or "", name() + (" " + " ".join(rng.sample(vi, 2)) if rng.random() < 0.4 else "")
        title = rng.choice([b + n, n + " " + b, n])
        listings.append((i, title or None, b if title == n else None, rng.choice(["Con Cưng", None]), "tiki", None, CODE if i % 50 == 0 else None, 5, 1, None))
    p = spark.createDataFrame(products, "id long, title string, brand string, gtin string, title_home string")
    q = spark.createDataFrame(listings, LISTING)
    got = {(r["id"], r["listing"]): round(r["score"], 9) for r in LM.pool_matches(p, q).collect()}
    want = all_pairs(p, q)
    assert got == want and len(got) > 300
    assert LM.pool_matches(p.limit(0), q).collect() == [] and LM.pool_matches(p, q.limit(0)).collect() == []


def test_glued_and_missing_brands(spark):
    products = spark.createDataFrame([(1, "Combiotic rice porridge", "HiPP", None), (2, "rice porridge spinach", None, None), (3, "HiPP", "HiPP", None)],
                                     "id long, title string, brand string, gtin string")
    listings = spark.createDataFrame([(7, "HiPPcombiotic rice porridge", None, None, "x", None, None, 1, 1, None), (8, "Rice porridge spinach", None, None, "x", None, None, 1, 1, None)], LISTING)
    got = {(r["id"], r["listing"]) for r in LM.pool_matches(products, listings).collect()}
    assert got >= {(1, 7), (2, 8), (3, 7)} and (1, 8) not in got
    assert {(r["id"], r["brand_listings"]) for r in LM.brand_hits(products, listings).collect()} == {(1, 1), (3, 1)}


def test_names_in_texts(spark):
    rng = random.Random(3)
    names = {"".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(60)} | {"é", ""}
    texts = {i: rng.choice([None, "", "".join(rng.choices("abcé ", k=30))]) for i in range(200)}
    n = spark.createDataFrame([(x,) for x in [*names, *names, None]], "name string")
    t = spark.createDataFrame(list(texts.items()), "id long, text string")
    want = {(i, x) for i, s in texts.items() for x in names if x and s and x in s}
    for shard, block in ((10, 30), (50_000, 1 << 18)):
        got = [tuple(r) for r in brand_search.names_in_texts(n, t, shard, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_pool(spark):
    a = spark.createDataFrame([(1, "https://x.vn/p/1?ref=2", "one"), (2, None, "two")], "listing long, url string, title string")
    b = spark.createDataFrame([(3, "https://X.vn/p/1/", "late"), (2, "", "late"), (4, "https://x.vn/p/2#a", "four")], "listing long, url string, title string")
    assert {(r["listing"], r["title"]) for r in LM.pool(a, b).collect()} == {(1, "one"), (2, "two"), (4, "four")}
