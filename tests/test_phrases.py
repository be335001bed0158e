"""Consuming phrase matches, relevance and sections, against values derived by hand."""

from pyspark.sql import functions as F

from marketloom.functions import phrases as PH
from marketloom.sources import sections as S


def column(spark, f, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_forms(spark):
    got = column(spark, PH.forms, ["Thanh phô mai", "Bánh quy phô mai que", "Bánh xốp 20 thanh", "Bánh mì kẹp thịt", "Rice cakes and biscuits", None])
    assert got == [["stick"], ["biscuit", "stick"], ["wafer"], ["burger"], ["ricecake", "biscuit"], []]


def test_form_match(spark):
    df = spark.createDataFrame([("Thạch phô mai que",), ("cheese sticks and jelly",), ("cheese",)], "t string")
    got = df.select(PH.form_match(F.col("t"), PH.forms(F.col("t")), F.array(F.lit("stick")))).collect()
    assert [r[0] for r in got] == ["other", "match", None]


def test_concepts(spark):
    got = column(spark, PH.concepts, ["Organic Rice Cake with Apple", "Bột gạo vị táo", "Cá hồi", ""])
    assert got == [["apple", "ricecake"], ["apple", "cereal", "rice"], ["salmon"], []]
    df = spark.createDataFrame([(["apple", "cereal"], ["apple", "banana"]), ([], ["apple"]), (["rice"], ["rice"])], "a array<string>, b array<string>")
    got = [r[0] for r in df.select(PH.concept_score(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - (1 / 1.5 - 0.15)) < 1e-9 and got[1] is None and got[2] == 1


def test_relevance(spark):
    df = spark.createDataFrame([("Cheese snack for baby", ""), ("Vegan bar", "cheese inside"), ("nothing", None), ("離乳食 チーズ", None)], "t string, x string")
    got = [r[0] for r in df.select(PH.relevance(F.col("t"), F.col("x"), ["cheese snacks"])).collect()]
    assert got == [1.15, 0.2, 0.0, 0.15]
    assert PH.tokens("Phô mai cho bé チーズ味") == ["pho", "mai", "チー", "ーズ", "ズ味"]


def test_sections(spark):
    text = "Intro\nIngredients: oats, milk.\nStorage: keep cool\nSuitable for: everyone\nIngredients: other"
    got = column(spark, S.sections, [text, None])
    assert got == [{"ingredients": "oats, milk.", "storage": "keep cool"}, {}]
    assert column(spark, S.importer, ["Nhà nhập khẩu: Công ty ABC, địa chỉ Hà Nội", "none"]) == ["Công ty ABC", None]
