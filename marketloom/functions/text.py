"""Text functions as Columns; JavaScript's notion of white space and word borders is spelled out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the source data's tools call white space.
SPACE = r"[\t\n\x0B\f\r    -     　﻿]"
#: A border between ASCII word and other characters (Java's \b would count accented letters as word).
BORDER = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
# Latin letters and what they fold to.
ACCENTED = "àáâãäåāăąảạằắẳẵặầấẩẫậçćčďđèéêëēĕėęěẻẽẹềếểễệìíîïĩīĭįỉịñńňòóôõöōŏőơỏọồốổỗộờớởỡợřšśţťùúûüũūŭůűųưủụừứửữựýÿỳỷỹỵžźż"
PLAIN = "aaaaaaaaaaaaaaaaaaaaacccddeeeeeeeeeeeeeeeeeiiiiiiiiiinnnooooooooooooooooooooorssttuuuuuuuuuuuuuuuuuuyyyyyyzzz"
assert len(ACCENTED) == len(PLAIN)


def pattern(p: str) -> str:
    """A case-insensitive pattern with ASCII word borders."""
    return "(?iu)(?:" + p.replace(r"\b", BORDER) + ")"


def bound(value: Column, body) -> Column:
    """``body(value)`` with value written and computed once, however often body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean(s: Column) -> Column:
    """White space collapsed to single spaces and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), SPACE + "+", " "))


def fold(s: Column) -> Column:
    """Lower case without Latin accents; composed and decomposed accents alike."""
    low = F.translate(F.lower(F.coalesce(s, F.lit(""))), ACCENTED, PLAIN)
    return F.regexp_replace(low, r"[̀-ͯ]", "")


def squash(s: Column) -> Column:
    """Folded letters and digits only."""
    return F.regexp_replace(fold(s), "[^a-z0-9]", "")


def truncate(s: Column, n: int) -> Column:
    """Cleaned text of at most n characters, cut at a word, with an ellipsis."""
    text = clean(s)
    cut = F.regexp_replace(F.substring(text, 1, n - 1), SPACE + r"+\S*$", "")
    return F.when(F.length(text) > n, F.concat(cut, F.lit("…"))).otherwise(text)


def slug(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(s), "[^a-z0-9]+", "-"), "^-|-$", "")


def item_id(source: Column, address: Column) -> Column:
    """First 16 hexadecimal digits of a row's SHA-1."""
    return F.substring(F.sha1(F.concat_ws("|", source, address).cast("binary")), 1, 16)


def word_list(s: Column, least: int = 2) -> Column:
    """Distinct folded words in order of appearance."""
    words = F.split(fold(s), r"[^\p{L}\p{N}\p{M}]+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= least))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) > 0, both / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both))


def text_from_html(html: Column) -> Column:
    """Visible text: scripts dropped, block tags as line feeds, other tags as spaces, common entities."""
    t = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|nav|header|footer)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    t = F.regexp_replace(t, r"[ \t\r\f]+", " ")
    return F.regexp_replace(F.regexp_replace(t, r" ?\n[ \n]*", "\n"), r"\A\s+|\s+\z", "")


def unglue(s: Column) -> Column:
    """A line feed where a lower-case letter, digit or closing sign meets a capitalised word."""
    return F.regexp_replace(s, r"(\p{Ll}|[0-9%)])(\p{Lu}\p{Ll})", "$1\n$2")


def labels_of(text: Column, lexicon: list[tuple[str, str]]) -> Column:
    """Names of all entries whose pattern occurs, in the lexicon's order."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(name)) for name, p in lexicon)))


def first_label(text: Column, lexicon: list[tuple[str, str]]) -> Column:
    """Name of the first entry whose pattern occurs."""
    out = F.lit(None).cast("string")
    for name, p in reversed(lexicon):
        out = F.when(text.rlike(p), F.lit(name)).otherwise(out)
    return out


# Words with which a shop's own text begins to follow a product's.
TAIL = (
    "Xem thêm|Xem chi tiết|Xem tất cả|Đọc thêm|Read more|Mua ngay|Giá sản phẩm trên Tiki|Giá sản phẩm đã bao gồm|"
    "Bên cạnh đó, tuỳ vào loại sản phẩm|Sản phẩm được phân phối bởi"
)
# European words for baby food, in English.
FOOD_WORDS = [
    (pattern(r"\bpetits? pots?\b"), "baby food jar"), (pattern(r"\bpotitos?\b|\btarritos?\b"), "baby food jar"),
    (pattern(r"\bomogeneizzat[oi]\b"), "baby puree"), (pattern(r"\bpappin[ae]\b|\bpappa\b"), "baby food"), (pattern(r"\bbrei\b"), "baby porridge"),
    (pattern(r"\bquetschies?\b"), "fruit pouch"), (pattern(r"\bgourdes?\b"), "fruit pouch"),
]


def cut_tail(s: Column) -> Column:
    """A text up to where the shop's own phrases follow."""
    return F.regexp_replace(s, rf"(?siu){SPACE}*(?:>>>|>>|{TAIL}){BORDER}.*$", "")


def english_food_words(s: Column) -> Column:
    """European words for baby food replaced by English ones, before a text is translated."""
    for words, english in FOOD_WORDS:
        s = F.regexp_replace(s, words, english)
    return s
