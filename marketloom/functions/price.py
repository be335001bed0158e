"""Prices, packs, ages, sales counts and barcodes out of text, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon as L
from .text import bound, clean, first_label, fold


def half_up(x: Column) -> Column:
    """Nearest whole number, halves towards plus infinity."""
    return F.floor(x + 0.5).cast("long")


def parse_number(token: Column, currency: Column) -> Column:
    """A number with dots and commas; the last of both, or a lone one not before three digits, is decimal."""
    t = F.regexp_replace(token, r"[\s ']", "")
    dot, comma = F.instr(t, ".") > 0, F.instr(t, ",") > 0
    dots_last = F.length(t) - F.instr(F.reverse(t), ".") > F.length(t) - F.instr(F.reverse(t), ",")
    both = F.when(dots_last, F.replace(t, F.lit(","), F.lit(""))).otherwise(
        F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    )
    groups = F.split(t, "[.,]")
    tail, n = F.element_at(groups, -1), F.size(groups)
    joined = F.array_join(groups, "")
    thousands = (F.length(tail) == 3) & ((n > 2) | (F.length(F.element_at(groups, 1)) <= 3))
    single = F.when(thousands, joined).otherwise(
        F.concat(F.array_join(F.slice(groups, F.lit(1), F.greatest(n - 1, F.lit(0))), ""), F.lit("."), tail)
    )
    whole = F.coalesce(currency.isin(*L.WHOLE), F.lit(False))
    text = F.when(whole, F.regexp_replace(t, "[.,]", "")).when(dot & comma, both).when(dot | comma, single).otherwise(t)
    return text.try_cast("double")


def parse_price(text: Column, market: Column | str = "vn", hint: Column | None = None) -> Column:
    """struct(value, currency) of a price text; null without a positive number."""
    market = F.lit(market) if isinstance(market, str) else market
    dollar = F.lit("USD")
    for code, name in L.DOLLARS.items():
        dollar = F.when(market == code, name).otherwise(dollar)

    def currency(sign: Column) -> Column:
        return (
            F.when(sign == "YEN", F.when(market == "cn", "CNY").otherwise("JPY")).when(sign == "DOLLAR", dollar).otherwise(sign)
        )

    def price(s: Column) -> Column:
        sign = first_label(s, L.CURRENCIES)
        token = F.regexp_replace(F.regexp_extract(s, r"[0-9][0-9\s., ']*", 0), r"[.,\s]+$", "")
        signed = F.coalesce(F.upper(hint), sign) if hint is not None else sign
        return bound(F.struct(token.alias("token"), bound(signed, currency).alias("currency")), valued)

    def valued(v: Column) -> Column:
        number = F.when(v["token"] != "", parse_number(v["token"], v["currency"]))
        return bound(number, lambda n: F.when(n > 0, F.struct(n.alias("value"), v["currency"].alias("currency"))))

    return bound(clean(text), price)


_NUM, _UNIT = r"([0-9]+(?:[.,][0-9]+)?)", r"(kg|grams?|gam|gr|g|ml|lít|lit|l|oz|lb)"


def parse_quantity(text: Column) -> Column:
    """struct(total, unit, label) of a pack text: n x size, size x n, or size with a pack count."""
    return bound(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), _quantity)


def _quantity(s: Column) -> Column:
    units = F.create_map(*(F.lit(x) for pair in L.UNITS.items() for x in pair))

    def number(x: Column) -> Column:
        return F.replace(x, F.lit(","), F.lit(".")).try_cast("double")

    def result(total: Column, unit: Column, label: Column) -> Column:
        kind = F.when(unit.rlike("ml|l|lít|lit"), "ml").otherwise("g")
        return F.struct(half_up(total).alias("total"), kind.alias("unit"), label.alias("label"))

    def group(pattern: str, i: int) -> Column:
        return F.regexp_extract(s, pattern, i)

    first = rf"([0-9]{{1,3}})\s*[x×]\s*{_NUM}\s*{_UNIT}(?![a-z])"
    second = rf"{_NUM}\s*{_UNIT}\s*[x×]\s*([0-9]{{1,3}})(?![0-9])"
    third = rf"(?<![0-9.,]){_NUM}\s*{_UNIT}(?![a-z])"
    pack = r"pack of ([0-9]{1,2})|([0-9]{1,2})[- ]?(?:pack|pk)(?![A-Za-z0-9_])|(?:combo|lốc|set|bộ|thùng)\s*([0-9]{1,2})(?!\s*(?:tháng|m(?![A-Za-z0-9_])|tuổi))"
    times = F.coalesce(*(F.nullif(group(pack, i), F.lit("")) for i in (1, 2, 3))).try_cast("int")
    packs = F.coalesce((times > 1) & (times <= 48), F.lit(False))
    size = number(group(third, 1)) * units[group(third, 2)]
    label = F.concat(group(third, 1), group(third, 2))
    single = F.when(
        (size > 0) & (size <= 20000),
        result(
            size * F.when(packs, times).otherwise(1),
            group(third, 2),
            F.when(packs, F.concat(times.cast("string"), F.lit("×"), label)).otherwise(label),
        ),
    )
    return (
        F.when(
            s.rlike(first),
            result(number(group(first, 1)) * (number(group(first, 2)) * units[group(first, 3)]), group(first, 3),
                   F.concat(group(first, 1), F.lit("×"), group(first, 2), group(first, 3))),
        )
        .when(
            s.rlike(second),
            result(number(group(second, 3)) * (number(group(second, 1)) * units[group(second, 2)]), group(second, 2),
                   F.concat(group(second, 3), F.lit("×"), group(second, 1), group(second, 2))),
        )
        .when(s.rlike(third), single)
    )


def parse_age_months(text: Column) -> Column:
    """Months of age a text names: a range of years, "from n", months 3 to 36, years 1 to 5, a stage."""
    return bound(F.lower(text), _age_months)


def _age_months(s: Column) -> Column:
    def number(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(s, pattern, 1), F.lit("")).try_cast("int")

    b = r"(?![A-Za-z0-9_])"
    years = number(r"([0-9]{1,2})\s*[-–~]\s*[0-9]{1,2}\s*(?:tuổi|years?|yrs?|ans|jahre)") * 12
    since = number(rf"(?:từ|trên|from|ab|dès|des|after)\s*([0-9]{{1,2}})\s*(?:\+\s*)?(?:tháng|months?|monat|mois|m{b})")
    months = number(rf"([0-9]{{1,2}})\s*\+?\s*(?:tháng tuổi|tháng|months?\+?|mths?|monate?n?|mois|m\+|m{b}|ヶ月|か月|カ月|개월)")
    old = number(r"([0-9])\s*\+?\s*(?:tuổi|years?|yrs?|歳|살)")
    stage = F.regexp_extract(s, r"(?:stage|giai đoạn|bước)\s*([0-9])", 1)
    stages = F.create_map(*(F.lit(x) for pair in L.STAGES.items() for x in pair))
    return F.coalesce(
        years, since, F.when(months.between(3, 36), months), F.when(old.between(1, 5), old * 12), F.element_at(stages, stage)
    )


def parse_sold(text: Column) -> Column:
    """Units sold from texts like "1.2k" or "3tr"; the separator is a decimal sign."""
    s = F.regexp_replace(F.lower(text), r"\s", "")
    pattern = r"([0-9]+(?:[.,][0-9]+)?)(k|m|nghìn|tr)?"
    n = F.replace(F.regexp_extract(s, pattern, 1), F.lit(","), F.lit(".")).try_cast("double")
    unit = F.regexp_extract(s, pattern, 2)
    return half_up(n * F.when(unit.isin("k", "nghìn"), 1000.0).when(unit.isin("m", "tr"), 1e6).otherwise(1.0))


def gtin(code: Column) -> Column:
    """Digits of a valid 8, 12, 13 or 14-digit barcode, else null."""
    c = F.regexp_replace(code.cast("string"), "[^0-9]", "")
    digits = F.transform(F.regexp_extract_all(c, F.lit("[0-9]"), F.lit(0)), lambda d: d.cast("int"))
    front = F.reverse(F.slice(digits, F.lit(1), F.greatest(F.size(digits) - 1, F.lit(0))))
    total = F.aggregate(
        F.transform(front, lambda d, i: d * F.when(i % 2 == 0, 3).otherwise(1)), F.lit(0), lambda a, x: a + x
    )
    valid = c.rlike("^(?:[0-9]{8}|[0-9]{12,14})$") & (((10 - total % 10) % 10) == F.try_element_at(digits, F.lit(-1)))
    return F.when(valid, c)


def to_dong(value: Column, rate: Column) -> Column:
    """Whole đồng; null without a value or a positive rate."""
    return F.when(rate > 0, half_up(value * rate))


def nice_step(raw: Column) -> Column:
    """The next of 1, 2, 2.5, 5, 10 times a power of ten."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw) + 1e-12))
    n = raw / power
    return F.when(n <= 1, 1.0).when(n <= 2, 2.0).when(n <= 2.5, 2.5).when(n <= 5, 5.0).otherwise(10.0) * power


def company_key(name: Column) -> Column:
    """Folded company name without legal forms, letters and digits only."""
    words = "|".join(L.LEGAL)
    return F.regexp_replace(F.regexp_replace(fold(name), rf"(?<![a-z0-9_])(?:{words})(?![a-z0-9_])", " "), "[^a-z0-9]+", "")


def euro_price(text: Column) -> Column:
    """A price with two decimals before a euro sign; null for others and for prices of a unit."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    found = F.concat_ws(".", *(F.nullif(F.regexp_extract(t, r"([0-9]+)[,.]([0-9]{2})\s*€", i), F.lit("")) for i in (1, 2)))
    return F.when(~t.rlike(r"(?i)/\s*(?:kg|l)\b|/\s*100|le kg|le litre"), F.nullif(found, F.lit("")).try_cast("double"))


def plain_price(text: Column) -> Column:
    """A text that is a number with at most two decimals and nothing else."""
    t = F.trim(text.cast("string"))
    return F.when(t.rlike(r"^[0-9]+(?:[.,][0-9]{1,2})?$"), F.replace(t, F.lit(","), F.lit(".")).cast("double"))


def age_label(months: Column) -> Column:
    """Months as "n tháng+", whole years as "n tuổi+"; empty for none."""
    years = F.concat((months / 12).cast("int").cast("string"), F.lit(" tuổi+"))
    return F.when(months.isNull(), "").when((months >= 12) & (months % 12 == 0), years).otherwise(F.concat(months.cast("int").cast("string"), F.lit(" tháng+")))
