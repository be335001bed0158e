"""Registered queries of the text parsers: each part gets a title put together from pieces, and SQL says what each piece tells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import brands, phrases
from ..functions import price as P
from ..functions import text as T
from ..session import spread, table
from .queries import query

#: A title's first piece, and the brand that it names; p_brand is no known one.
LEADS = (("HiPP", "HiPP"), ("nestle", "Nestlé"), ("ELLA'S KITCHEN", "Ella's Kitchen"), ("", None), ("Holle-ish", "Holle"), ("Hippo", None))
#: The second: text, type, concepts, claims, allergens, product form.
GOODS = (
    ("organic rice cereal", "Bột ăn dặm", "cereal|rice", ["Hữu cơ"], [], None),
    ("banana puree pouch", "Trái cây / rau nghiền", "banana|puree", [], [], "puree"),
    ("chicken noodles", "Mì / nui", "chicken|pasta", [], [], "noodles"),
    ("salmon risotto", "Cháo / súp", "salmon", [], ["Cá/hải sản"], None),
    ("egg biscuit with soy", "Bánh / snack", "biscuit|egg", [], ["Trứng", "Đậu nành"], "biscuit"),
    ("wooden ring", None, "", [], [], None),
    ("bánh gạo vị dâu táo", "Bánh / snack", "apple|ricecake|strawberry", [], [], "ricecake"),
    ("sữa chua vừng đen", "Sữa chua / váng sữa", "yogurt", [], ["Sữa", "Mè"], "yogurt"),
)
#: The third: text, claims, allergens, SQL of the months of age, whether it names small children.  $S is p_size, $A one to five.
TAILS = (
    ("gluten-free from $S months", ["Không gluten"], ["Gluten/lúa mì"], "p_size", True),
    ("no added sugar, stage 2", ["Không đường"], [], "6", True),
    ("with DHA and iron $S tháng", ["Bổ sung DHA", "Bổ sung sắt"], [], "CASE WHEN p_size BETWEEN 3 AND 36 THEN p_size END", True),
    ("vegan $A-9 years", ["Thuần chay"], [], "a * 12", False),
    ("non-GMO $A tuổi", ["Non-GMO"], [], "a * 12", False),
    ("plain", [], [], "NULL", False),
    ("probiotic ab $S Monat", ["Probiotic"], [], "p_size", False),
)
QUERIES = ("organic rice cereal", "salmon risotto")


def _choice(turn: Column, values: list[Column]) -> Column:
    out = F.when(turn == 0, values[0])
    for i, value in enumerate(values[1:], 1):
        out = out.when(turn == i, value)
    return out


def _filled(text: str) -> Column:
    size, few = F.col("p_size").cast("string"), (F.col("p_size") % 5 + 1).cast("string")
    return F.replace(F.replace(F.lit(text), F.lit("$S"), size), F.lit("$A"), few)


def _turns() -> tuple[Column, Column, Column]:
    key = F.col("p_partkey")
    return key % len(LEADS), F.floor(key / len(LEADS)) % len(GOODS), F.floor(key / (len(LEADS) * len(GOODS))) % len(TAILS)


def titled(part):
    """part with a title of three pieces and a description."""
    lead, good, tail = _turns()
    pieces = (
        _choice(lead, [F.lit(text) for text, _ in LEADS]), F.col("p_brand"), _choice(good, [F.lit(g[0]) for g in GOODS]), _choice(tail, [_filled(t[0]) for t in TAILS]),
    )
    told = F.when(F.col("p_size") % 2 == 0, "organic goods").otherwise("")
    return part.select("p_partkey", "p_size", F.concat_ws(" ", *pieces).alias("title"), told.alias("description"))


def _quoted(value) -> str:
    if isinstance(value, list):
        return "[" + ", ".join(map(_quoted, value)) + "]::VARCHAR[]"
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _case(turn: str, values) -> str:
    return f"CASE {turn} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_TITLED = f"""p AS (SELECT *, p_size % 5 + 1 AS a, p_partkey % {len(LEADS)} AS lead, p_partkey // {len(LEADS)} % {len(GOODS)} AS good,
p_partkey // {len(LEADS) * len(GOODS)} % {len(TAILS)} AS tail FROM part)"""


def _in_order(names: list[str], goods: int, tails: int) -> str:
    found = f"list_concat({_case('good', [_quoted(g[goods]) for g in GOODS])}, {_case('tail', [_quoted(t[tails]) for t in TAILS])})"
    return f"array_to_string(list_filter({_quoted(names)}, lambda x: list_contains({found}, x)), '|')"


@query(f"""WITH {_TITLED} SELECT p_partkey AS part, {_case('lead', [_quoted(b) for _, b in LEADS])} AS brand, {_case('good', [_quoted(g[1]) for g in GOODS])} AS type,
{_case('good', [_quoted(g[2]) for g in GOODS])} AS concepts, {_in_order([n for n, _ in L.CLAIMS], 3, 1)} AS claims, {_in_order([n for n, _ in L.ALLERGENS], 4, 2)} AS allergens,
{_case('good', [_quoted(g[5]) for g in GOODS])} AS form, CAST({_case('tail', [t[3] for t in TAILS])} AS INT) AS age_months FROM p""")
def title_fields(spark, d):
    """O-P8 to O-P12, O-T4: age, type, claims, allergens, concepts, product form and known brand of each title."""
    t = F.col("title")
    rows = titled(table(spark, d, "part")).select(F.col("p_partkey").alias("part"), "title")
    # a title is read once, however many parts have it
    told = spread(rows.select("title").distinct()).select(
        "title", brands.guess_brand(t).alias("brand"), T.first_label(t, L.TYPES).alias("type"),
        F.array_join(phrases.concepts(t), "|").alias("concepts"), F.array_join(T.labels_of(t, L.CLAIMS), "|").alias("claims"),
        F.array_join(T.labels_of(t, L.ALLERGENS), "|").alias("allergens"), F.get(phrases.forms(t), F.lit(0)).alias("form"),
        P.parse_age_months(t).cast("int").alias("age_months"),
    )
    return rows.join(told, "title").drop("title")


@query(f"""WITH {_TITLED} SELECT p_partkey AS part, floor(least(CASE WHEN good IN (0, 3) THEN 1.0::DOUBLE + 0.25 WHEN p_size % 2 = 0 THEN 0.4::DOUBLE / 3 ELSE 0 END
+ CASE WHEN tail IN (0, 1, 2) THEN 0.15 ELSE 0 END::DOUBLE, 1.4) * 100 + 0.5) / 100 AS relevance FROM p""")
def title_relevance(spark, d):
    """O-T8, O-T9: the relevance of each title and description to two searches."""
    rows = titled(table(spark, d, "part"))
    return rows.select(F.col("p_partkey").alias("part"), phrases.relevance(F.col("title"), F.col("description"), QUERIES).alias("relevance"))


#: Price texts: market, SQL of the text, SQL of the value, currency.
PRICES = (
    ("us", "'now only $' || en", "price", "USD"),
    ("de", "translate(en, ',.', '.,') || ' € inkl. MwSt.'", "price", "EUR"),
    ("vn", "'Giá ' || replace(big, ',', '.') || '₫'", "key1 * 1000", "VND"),
    ("jp", "'¥' || big", "key1 * 1000", "JPY"),
    ("gb", "'£' || key1 || ' each'", "key1", "GBP"),
    ("fr", "en_plain || ' EUR'", "price", "EUR"),
    ("au", "'$' || en_plain", "price", "AUD"),
    ("us", "'sold out'", "NULL", None),
)


@query(f"""WITH p AS (SELECT p_partkey, p_partkey % {len(PRICES)} AS turn, round(p_retailprice, 2)::DOUBLE AS price, (p_partkey + 1)::DOUBLE AS key1 FROM part)
SELECT p_partkey AS part, round({_case('turn', [f'({v})::DOUBLE' for _, _, v, _ in PRICES])}, 2) AS value, {_case('turn', [_quoted(c) for *_, c in PRICES])} AS currency FROM p""")
def price_texts(spark, d):
    """O-P1, O-P2: value and currency of prices as eight markets write them."""
    key1 = F.col("p_partkey") + 1
    rows = table(spark, d, "part").select(
        "p_partkey", (F.col("p_partkey") % len(PRICES)).alias("turn"), key1.cast("string").alias("key1"), F.format_number("p_retailprice", 2).alias("en"),
        F.format_string("%.2f", "p_retailprice").alias("en_plain"), F.format_number(key1 * 1000, 0).alias("big"),
    )
    rows = rows.select("p_partkey", _choice(F.col("turn"), [F.expr(t) for _, t, _, _ in PRICES]).alias("text"), _choice(F.col("turn"), [F.lit(m) for m, *_ in PRICES]).alias("market"))
    got = rows.select("p_partkey", P.parse_price(F.col("text"), F.col("market")).alias("p"))
    return got.select(F.col("p_partkey").alias("part"), F.round("p.value", 2).alias("value"), F.col("p.currency").alias("currency"))


#: Pack texts: text, SQL of the total, unit and label, SQL of the units sold that the same text's second half tells.
PACKS = (
    ("jar $S g | Đã bán $S", "p_size", "g", "p_size || 'g'", "p_size"),
    ("$A x $S ml | $S,5k sold", "a * p_size", "ml", "a || '×' || p_size || 'ml'", "p_size * 1000 + 500"),
    ("$Sg x $A | $S tr", "a * p_size", "g", "a || '×' || p_size || 'g'", "p_size * 1000000"),
    ("$S,5 kg | $S.5 nghìn", "CASE WHEN p_size < 20 THEN p_size * 1000 + 500 END", "g", "p_size || ',5kg'", "p_size * 1000 + 500"),
    ("pack of 4, $Sg | 0", "4 * p_size", "g", "'4×' || p_size || 'g'", "0"),
    ("lốc 6 $S lít | $Sm", "CASE WHEN p_size <= 20 THEN 6000 * p_size END", "ml", "'6×' || p_size || 'lít'", "p_size * 1000000"),
    ("no pack | none", "NULL", None, "NULL", "NULL"),
)


@query(f"""WITH p AS (SELECT *, p_size % 5 + 1 AS a, p_partkey % {len(PACKS)} AS turn FROM part), q AS (SELECT *, {_case('turn', [t for _, t, *_ in PACKS])} AS total FROM p)
SELECT p_partkey AS part, CAST(total AS BIGINT) AS total, CASE WHEN total IS NOT NULL THEN {_case('turn', [_quoted(u) for _, _, u, *_ in PACKS])} END AS unit,
CASE WHEN total IS NOT NULL THEN {_case('turn', [label for *_, label, _ in PACKS])} END AS label, CAST({_case('turn', [s for *_, s in PACKS])} AS BIGINT) AS sold FROM q""")
def pack_texts(spark, d):
    """O-P7, O-P14: pack sizes and units sold, as shops write them."""
    turn = F.col("p_partkey") % len(PACKS)
    half = lambda i: _choice(turn, [_filled(text.split(" | ")[i]) for text, *_ in PACKS])
    got = table(spark, d, "part").select("p_partkey", P.parse_quantity(half(0)).alias("q"), P.parse_sold(half(1)).alias("sold"))
    return got.select(F.col("p_partkey").alias("part"), F.col("q.total").cast("long").alias("total"), "q.unit", "q.label", F.col("sold").cast("long").alias("sold"))
