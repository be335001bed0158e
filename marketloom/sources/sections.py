"""Labelled sections of product texts: ingredients, storage, usage and their like, as a map.

A label opens a section up to the next label; headings that hold a section's words open what no label has given.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import TAIL
from .markup import tidy

# Label patterns by kind, the longest text kept of each, words of headings, texts that say nothing.
LABELS: Mapping[str, Sequence[str]] = {
    "ingredients": ("thành phần(?: dinh dưỡng| chính| nguyên liệu| sản phẩm)?", "nguyên liệu", "ingredients?", "zutaten", "ingrédients", "原材料名?", "원재료명?", "composition"),
    "usage": (
        "hướng dẫn sử dụng", "cách sử dụng", "cách dùng", "hướng dẫn pha(?: chế)?", "cách pha", "directions(?: for use)?", "how to (?:use|prepare|serve)",
        "preparation(?: instructions)?", "feeding guide", "zubereitung", "mode d'emploi", "préparation", "使用方法", "召し上がり方", "조리방법",
    ),
    "storage": (
        "hướng dẫn bảo quản", "cách bảo quản", "bảo quản", "storage(?: instructions| advice)?", "store (?:in|at)", "keep (?:in|refrigerated)", "once opened",
        "aufbewahrung", "conservation", "保存方法", "보관방법",
    ),
    "age": ("độ tuổi(?: sử dụng| phù hợp)?", "đối tượng(?: sử dụng)?", "dành cho (?:bé|trẻ)", "suitable (?:for|from)", "recommended age", "phù hợp với"),
    "origin": ("xuất xứ(?: thương hiệu)?", "nơi sản xuất", "sản xuất tại", "made in", "country of origin", "herkunftsland", "原産国", "원산지"),
    "expiry": ("hạn sử dụng", "hsd", "shelf life", "best before", "mindestens haltbar", "賞味期限", "유통기한"),
    "weight": (
        "khối lượng(?: tịnh)?", "trọng lượng(?: tịnh)?", "quy cách(?: đóng gói)?", "dung tích", "net (?:weight|wt\\.?)", "nettogewicht", "poids net", "内容量", "중량",
    ),
    "nutrition": ("giá trị dinh dưỡng", "thông tin dinh dưỡng", "bảng dinh dưỡng", "nutrition(?:al)? (?:information|facts|values)", "nährwerte", "栄養成分"),
    "warnings": ("lưu ý", "chú ý", "cảnh báo", "warnings?", "allergy (?:advice|information)", "thông tin dị ứng", "allergens?"),
}
LONGEST = {"ingredients": 500, "usage": 400, "storage": 260, "age": 120, "origin": 80, "expiry": 100, "weight": 80, "nutrition": 400, "warnings": 300}
HEADINGS = {
    "ingredients": "thành phần|nguyên liệu|ingredients|zutaten|ingrédients|原材料|원재료",
    "age": "độ tuổi|dành cho (?:bé|trẻ)|phù hợp (?:cho|với) (?:bé|trẻ)|suitable (?:for|from)|recommended age",
    "usage": (
        "hướng dẫn (?:sử dụng|pha|chế biến|cho bé ăn)|cách (?:pha|dùng|sử dụng|chế biến)|how to (?:use|prepare|serve)|directions|preparation|zubereitung"
    ),
    "storage": "bảo quản|storage|aufbewahrung|conservation|保存",
    "origin": "xuất xứ|sản xuất tại|made in|country of origin",
    "nutrition": "giá trị dinh dưỡng|thông tin dinh dưỡng|nutrition(?:al)? (?:information|facts)|nährwerte",
}
_EMPTY = re.compile("^(?:xem thêm|chi tiết|đang cập nhật|tham khảo mô tả|xem trên|updating)", re.I)
_AGE = re.compile(r"tháng|tuổi|month|year|mois|monat|jahr|ヶ月|か月|歳|개월|살|[0-9]\s*m\b|\+", re.I | re.A)
_NEWBORN = re.compile("sơ sinh|newborn|infant", re.I)
_TAIL = re.compile(rf"\s*(?:>>>|>>|{TAIL})\b.*", re.I | re.S | re.A)
_HEADINGS = {kind: re.compile(words, re.I) for kind, words in HEADINGS.items()}


def states_age(text: str) -> bool:
    """An age in digits with its unit, or a word for a child that has none yet."""
    if not re.search("[0-9]", text) and not _NEWBORN.search(text):
        return False
    return bool(_AGE.search(text))


def without_tail(text: str) -> str:
    """A text up to where the shop's own phrases follow."""
    return _TAIL.sub("", text, count=1)


def shortened(text: str, most: int) -> str:
    """At most so many signs, cut at a word, with an ellipsis."""
    return text if len(text) <= most else re.sub(r"\s+\S*$", "", text[: most - 1]) + "…"


def _matcher(labels: Mapping[str, Sequence[str]]):
    kinds = list(labels)
    # one named group for each kind: the label's kind is the group that matched
    each = "|".join(f"(?P<k{i}>{'|'.join(labels[k])})" for i, k in enumerate(kinds))
    return kinds, re.compile(rf"(?:^|\n|[.!;•▪●·-]\s*)(?:{each})(?:\s*(?:sản phẩm|của sản phẩm))?\s*(?:[:：]|\n)", re.I)


_KINDS, _PATTERN = _matcher(LABELS)


def _opening(lines: list[str]) -> str:
    """Lines joined up to a short one, like a heading, behind a first block that no comma leaves open."""
    body = ""
    for k, line in enumerate(lines):
        if k and len(body) > 40 and len(line) < 30 and not body.endswith((",", ";")):
            break
        body += (" " if body else "") + line
    return body


def labelled(text: str | None, kinds: Sequence[str] = tuple(_KINDS), pattern: re.Pattern = _PATTERN) -> dict[str, str]:
    """Sections that labels open; the first of a kind stays."""
    text = text or ""
    out: dict[str, str] = {}
    marks = [(kinds[int(m.lastgroup[1:])], m.end(), m.start(m.lastgroup)) for m in pattern.finditer(text)]
    for i, (kind, start, _) in enumerate(marks):
        if kind in out:
            continue
        stop = marks[i + 1][2] if i + 1 < len(marks) else len(text)
        most = LONGEST.get(kind, 400)
        body = _opening(text[start : min(stop, start + 2 * most)].split("\n"))
        body = re.sub(r"^[:：\-–\s]+", "", tidy(without_tail(body)))
        if len(body) >= 4 and not _EMPTY.match(body):
            out[kind] = shortened(body, most)
    return out


def headed(text: str | None) -> dict[str, str]:
    """Sections under lines that read like headings: 6 to 100 signs, no full stop at the end, with a section's words."""
    lines = [(line, next((k for k, p in _HEADINGS.items() if p.search(line)), None) if _like_heading(line) else None) for line in (text or "").split("\n")]
    out: dict[str, str] = {}
    for i, (_, kind) in enumerate(lines[:-1]):
        if not kind or kind in out:
            continue
        body = ""
        for line, other in lines[i + 1 :]:
            if len(body) >= 1.5 * LONGEST[kind] or other and len(body) > 20:
                break
            body += (" " if body else "") + line
        body = tidy(without_tail(body))
        if len(body) >= 15:
            out[kind] = shortened(body, LONGEST[kind])
    return out


def _like_heading(line: str) -> bool:
    return 6 <= len(line) <= 100 and not line.endswith((".", ";"))


def sections_of(text: str | None) -> dict[str, str]:
    """Sections by label, then by heading; an age that states none is dropped."""
    found = labelled(text)
    found = headed(text) | found
    if "age" in found and not states_age(found["age"]):
        del found["age"]
    return found


def sections(text: Column, labels: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Map from kind to text of ``sections_of``; with own labels, of those labels alone."""
    own = _matcher(labels) if labels else None

    def one(t: str | None) -> dict[str, str]:
        return labelled(t, *own) if own else sections_of(t)

    @F.pandas_udf("map<string,string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run(text)


_IMPORTER = (
    r"(?iu)(?:nhập khẩu(?: và phân phối)?(?: bởi)?|nhà nhập khẩu|importer|imported by|distributor|distributed by)\s*[:：]?\s*"
    r"([^\n.;|]{4,120})"
)


def importer(text: Column) -> Column:
    """The company a text names as importer or distributor."""
    return F.nullif(F.trim(F.split(F.regexp_extract(text, _IMPORTER, 1), r"(?iu),\s*(?:địa chỉ|address)|\s{2,}")[0]), F.lit(""))
