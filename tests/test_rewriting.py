"""Queries rewritten for other markets, syllable pairs and the split flag, whole records, rates as of a time, by hand."""

import json

from pyspark.sql import functions as F

from marketloom.functions import phrases as PH
from marketloom.operators import matching
from marketloom.operators import rewriting as RW
from marketloom.sources import lookups
from marketloom.streaming.admission import with_fresh_rates


def test_brands_are_cut_out(spark):
    known = RW._known_names(["HiPP", "Ella's Kitchen", "Kitchen", "ab", "Plum", "HiPP Bio", "puff"])
    assert RW.without_names("ella's kitchen puff cho bé", known) == (["ella's kitchen", "puff"], "cho bé")
    assert RW.without_names("bánh Hipp bio kitchen", known) == (["Hipp bio", "kitchen"], "bánh")
    assert RW.without_names("hipp plum bio x", known) == (["hipp", "plum"], "bio x")
    assert RW.without_names("  two  words ", known) == ([], "  two  words ") and RW.without_names("", known) == ([], "")
    # what becomes neighbours is looked at again
    assert RW.without_names("ella's plum kitchen", RW._known_names(["Ella's Kitchen", "Plum"])) == (["plum", "ella's kitchen"], "")


def test_glossary(spark):
    df = spark.createDataFrame([("Bánh gạo ăn dặm vị táo",), ("cháo ăn dặm cho bé",), ("x",), (None,)], "q string")
    assert [r[0] for r in df.select(RW.glossary(F.col("q"))).collect()] == ["baby rice cakes vị táo", "baby porridge for baby", "x", None]


def test_translated_queries(spark):
    table = spark.createDataFrame(
        [("baby rice cakes vị táo", "en", "baby apple rice cakes", "vi", 2), ("baby rice cakes vị táo", "en", "later", "vi", 3), ("sữa", "en", "milk", "vi", 1),
         ("thịt em bé", "en", "meat", "vi", 1), ("petit pot bébé", "en", "potty", "fr", 1), ("baby food jar bébé", "en", "baby jar", "fr", 1), ("rice", "en", "rice", "en", 1),
         ("baby apple rice cakes", "de", "Apfelreiswaffeln", "en", 1), ("baby jar", "it", "vasetto", "en", 1), ("rice", "de", "Reis", "en", 1), ("milk", "en-GB", "no", "en", 1)],
        "text string, lang string, translation string, detected string, at int",
    )
    rows = [
        ("HiPP bánh gạo ăn dặm vị táo", "de", "HiPP Apfelreiswaffeln"), ("bánh gạo ăn dặm vị táo", "en-GB", "baby apple rice cakes"), ("sữa", "vi", "sữa"), ("hipp", "de", "hipp"),
        ("petit pot bébé", "fr-FR", "petit pot bébé"), ("petit pot bébé", "it", "vasetto"), ("petit pot bébé", "en", "baby jar"), ("rice", "de", "Reis"), ("unknown words", "de", "unknown words"),
        ("thịt em bé", "en", "baby meat"), ("Sữa lạ", "en", "Sữa lạ"), ("", "de", ""),
    ]
    df = spark.createDataFrame([(i, q, lang) for i, (q, lang, _) in enumerate(rows)], "i int, query string, lang string")
    got = RW.translated_queries(df, table).orderBy("i").collect()
    assert [r["text"] for r in got] == [want for _, _, want in rows]


def test_syllable_pairs():
    assert PH.without_forms("Thanh phô mai que cho bé").split() == ["|", "phô", "mai", "|", "cho", "bé"]
    assert PH.syllable_pairs(PH.without_forms("thanh phô mai tươi que")) == [("pho", "mai"), ("mai", "tuoi")]
    assert PH.syllable_pairs("sữa của mẹ | chuối チーズ táo") == []


def test_relevance_of_syllables(spark):
    rows = [("Phô mai que", None), ("Phomai tươi", None), ("Ô mai thanh mai", None), ("phô-mai", ""), ("Kẹo dừa", "có phô mai"), ("Bánh quy", None), (None, None), ("Bột gạo", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, x string")
    got = [tuple(r[0]) for r in df.orderBy("i").select(PH.relevance_detail(F.col("t"), F.col("x"), ["thanh phô mai"])).collect()]
    # whole pair; written as one word; apart: one of two syllables at 0.4; hyphen; pair in the text: 0.4 of the hits at 0.7
    assert got == [(1.0, False), (1.0, False), (0.2, True), (1.0, False), (0.28, False), (0.0, False), (0.0, False), (0.0, True)]
    only_form = df.where("i = 5").select(PH.relevance_detail(F.col("t"), F.col("x"), ["bánh quy", "zzz"])["score"]).first()[0]
    assert only_form == 1.25
    assert [r[0] for r in df.where("i = 0").select(PH.token_list(F.col("t"))).collect()] == [["pho", "mai", "que"]]


def test_forms_in_scripts_without_spaces(spark):
    df = spark.createDataFrame([("チーズスティック 10本",), ("아기쌀과자",), ("Kekse und Riegel",), ("nước sốt phô mai kem",)], "t string")
    assert [r[0] for r in df.select(PH.forms(F.col("t"))).collect()] == [["stick"], ["ricecake"], ["biscuit", "stick"], ["sauce", "spread"]]


def test_one_record_of_a_barcode(spark):
    apple = json.dumps({"product": {"product_name": "Apple", "brands": "B", "ingredients_text": "apples, water"}})
    pear = json.dumps({"product": {"product_name": "Pear", "conservation_conditions": "keep it cool"}})
    rows = [("4006381333931", apple, 1), ("4006381333931", pear, 2)]
    df = spark.createDataFrame(rows, "gtin string, payload string, t int")
    assert tuple(lookups.food_facts(df).first())[1:] == ("Pear", None, None, "keep it cool", None)
    assert tuple(lookups.food_facts(df.drop("t")).first())[1:] == ("Apple", "B", "apples, water", None, None)


def test_section_donors(spark):
    rows = [(1, "b", "oat milk jar".split(), False, False), (2, "b", "oat milk jar".split(), True, False), (3, "b", "oat milk".split(), True, True),
            (4, "b", "jar".split(), False, False), (5, "c", "oat milk jar".split(), False, True), (6, "b", "oat milk jar big".split(), False, True)]
    df = spark.createDataFrame(rows, "id int, brand string, tokens array<string>, ingredients boolean, storage boolean")
    got = {(r["id"], r["section"]): (r["donor"], round(r["score"], 3)) for r in matching.section_donors(df, "tokens", ["ingredients", "storage"], 0.6, on=["brand"]).collect()}
    assert got == {(1, "ingredients"): (2, 1.0), (1, "storage"): (6, 0.75), (2, "storage"): (6, 0.75), (6, "ingredients"): (2, 0.75)}


def test_rates_refresh_under_a_stream(spark, tmp_path):
    schema = "currency string, t long, rate double"
    versions, events, seen = str(tmp_path / "v"), tmp_path / "e", []
    spark.createDataFrame([("EUR", 100, 2.0)], schema).write.parquet(versions)
    events.mkdir()

    def run(name, rows):
        (events / name).write_text("\n".join(json.dumps(r) for r in rows))
        stream = spark.readStream.schema("id int, currency string, t long").json(str(events))
        with_fresh_rates(stream, versions, lambda df, _: seen.extend(df.collect()), str(tmp_path / "c"), horizon=1000).awaitTermination(120)

    run("1.json", [{"id": 1, "currency": "EUR", "t": 150}, {"id": 2, "currency": "EUR", "t": 50}, {"id": 3, "currency": "???", "t": 150}])
    spark.createDataFrame([("EUR", 200, 3.0), ("EUR", 5000, 9.0)], schema).write.mode("append").parquet(versions)
    run("2.json", [{"id": 4, "currency": "EUR", "t": 150}, {"id": 5, "currency": "EUR", "t": 250}, {"id": 6, "currency": "EUR", "t": 1300}])
    fixed = lookups.L.FALLBACK_RATES["EUR"]
    assert {r["id"]: (r["rate"], r["rate_t"]) for r in seen} == {1: (2.0, 100), 2: (fixed, None), 3: (None, None), 4: (2.0, 100), 5: (3.0, 200), 6: (fixed, None)}


def test_name_tokens(spark):
    df = spark.createDataFrame([("Bột ăn dặm HiPP Bio gạo sữa 250g x 4", "HiPP Bio"), ("Combo 2 hộp sữa chua 4x100g", None), (None, None)], "t string, b string")
    got = [r[0] for r in df.select(matching.name_tokens(F.col("t"), F.col("b"))).collect()]
    assert got == [["bot", "an", "dam", "gao", "sua"], ["sua", "chua", "4x"], []]
