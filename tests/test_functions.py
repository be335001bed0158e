"""Column functions against values derived by hand from the rules."""

import pytest
from pyspark.sql import functions as F

from marketloom import lexicon as L
from marketloom.functions import price as P
from marketloom.functions import text as T
from marketloom.functions import urls as U


def column(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_clean_fold_squash_truncate(spark):
    assert column(spark, T.clean, ["  a   b\n\tc ", None, ""]) == ["a b c", "", ""]
    assert column(spark, T.fold, ["Sữa ĐẬU Nành", "Blédina", "ﾃ", "Ñandú çé ïö"]) == ["sua dau nanh", "bledina", "ﾃ", "nandu ce io"]
    assert column(spark, T.squash, ["Kids-Plaza!"]) == ["kidsplaza"]
    assert column(spark, lambda c: T.truncate(c, 10), ["one two three four", "short"]) == ["one two…", "short"]


def test_border_is_ascii(spark):
    assert column(spark, lambda c: c.rlike(L.ALLERGENS[5][1]), ["cá hồi", "salmon", "cat"]) == [False, True, False]


def test_labels(spark):
    got = column(spark, lambda c: T.labels_of(c, L.CLAIMS), ["Organic oats, no added sugar, vegan", "iron", "plain"])
    assert got == [["Hữu cơ", "Không đường", "Thuần chay"], ["Bổ sung sắt"], []]
    assert column(spark, lambda c: T.first_label(c, L.TYPES), ["Baby rice porridge soup", "bánh quy", "x"]) == ["Bột ăn dặm", "Bánh / snack", None]


@pytest.mark.parametrize(
    "text,market,value,currency",
    [
        ("1.234.000 ₫", "vn", 1234000.0, "VND"), ("$4.32", "au", 4.32, "AUD"), ("4,32 €", "de", 4.32, "EUR"), ("US$1,234.50", "us", 1234.5, "USD"),
        ("12,900원", "kr", 12900.0, "KRW"), ("¥1,280", "jp", 1280.0, "JPY"), ("¥12.8", "cn", 12.8, "CNY"), ("25.77", "us", 25.77, None), ("1.234", "us", 1234.0, None),
    ],
)
def test_parse_price(spark, text, market, value, currency):
    got = column(spark, lambda c: P.parse_price(c, market), [text])[0]
    assert (got["value"], got["currency"]) == (value, currency)


def test_parse_price_without_number(spark):
    assert column(spark, P.parse_price, ["free", "", None, "0 ₫"]) == [None] * 4


def test_parse_quantity(spark):
    got = column(spark, P.parse_quantity, ["Puree 6x110g", "4 x 90 g", "110g x 6", "Milk 1,5 l", "80g pack of 3", "none", "99999g"])
    assert [(q["total"], q["unit"], q["label"]) if q else None for q in got] == [
        (660, "g", "6×110g"), (360, "g", "4×90g"), (660, "g", "6×110g"), (1500, "ml", "1,5l"), (240, "g", "3×80g"), None, None,
    ]


def test_parse_age(spark):
    assert column(spark, P.parse_age_months, ["1-3 years", "ab 6 monat", "8 tháng", "2 tuổi", "stage 3", "99 months", "x"]) == [12, 6, 8, 24, 9, None, None]


def test_parse_sold(spark):
    assert column(spark, P.parse_sold, ["1.2k", "3tr sold", "1.234", "250", "no"]) == [1200, 3000000, 1, 250, None]


def test_gtin(spark):
    assert column(spark, P.gtin, ["4006381333931", "400638133393 1", "4006381333930", "96385074", "123", None]) == [
        "4006381333931", "4006381333931", None, "96385074", None, None,
    ]


def test_numbers(spark):
    assert column(spark, P.half_up, [-2.5, 2.5, 2.4], "double") == [-2, 3, 2]
    assert column(spark, P.nice_step, [1000.0, 1300.0, 2400.0, 4000.0, 7000.0], "double") == [1000.0, 2000.0, 2500.0, 5000.0, 10000.0]
    assert column(spark, P.company_key, ["Công ty TNHH Thương Mại ABC Việt Nam"]) == ["abc"]


def test_urls(spark):
    urls = ["https://www.Shop.example.com/A/b/?utm_source=x&id=3#top", "http://shop.example.com/a/b?id=3", "no address", None]
    assert column(spark, U.norm_url, urls) == ["shop.example.com/a/b?id=3", "shop.example.com/a/b?id=3", "no address", None]
    assert column(spark, U.host, urls) == ["shop.example.com", "shop.example.com", "", ""]
    assert column(spark, U.suffixes, ["a.b.c"]) == [["a.b.c", "b.c", "c"]]
    assert column(spark, lambda c: U.redirect_target(c, "uddg"), ["https://d/l/?uddg=https%3A%2F%2Fx.org%2F&y=1"]) == ["https://x.org/"]
    assert column(spark, U.base64_target, ["https://b/ck?u=a1aHR0cHM6Ly94Lm9yZy8&n=1"]) == ["https://x.org/"]
    assert column(spark, U.public_http, ["https://x.org/", "http://localhost/", "ftp://x.org/", "http://10.0.0.1/"]) == [True, False, False, False]


def test_html(spark):
    html = "<style>x{}</style><p>A &amp; B</p><script>var a='<p>';</script><div>C<br>D</div><!-- no -->"
    assert column(spark, T.text_from_html, [html]) == ["A & B\nC\nD"]
    assert column(spark, T.unglue, ["milkSugar 5%Salt"]) == ["milk\nSugar 5%\nSalt"]
