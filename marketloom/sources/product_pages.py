"""Product pages in markup as detail rows: JSON-LD, meta properties, marked prices, and sections by several ways.

Sections come from state objects, from labels and headings in the visible text, and from answered questions; where
several ways give one, that order decides.  A page is read once, in Arrow batches; price texts are parsed in the JVM.
"""

from __future__ import annotations

import re

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.phrases import folded
from ..functions.price import parse_price
from .batches import flat_rows
from .markup import HAS_CURRENCY, HIDDEN, Page, absolute, tidy
from .pages import is_kind, ld_product, ld_values
from .sections import LONGEST, importer, sections_of, shortened, without_tail
from .state import MOST_DEPTH, blobs

# Elements that stand on lines of their own; marks of prices that are not today's; greatest lengths.
BLOCKS = frozenset("p div li tr h1 h2 h3 h4 h5 h6 section article dd dt table ul ol td th strong b".split())
OLD_PRICE = re.compile("old|original|regular|compare|was|before|line-through|del|strike|list")
LONGEST_PRICE, LONGEST_DESCRIPTION, SAMPLE = 40, 600, 1500
# State keys and titles by section, keys whose text is no product's, paths of interface texts.
STATE_LABELS = {
    "ingredients": r"ingredients.*|ingredient|ingredienttext|ingredientstatement|ingredientlist|zutaten|zutatenliste|thanhphan|thanhphanchinh|原材料名?",
    "storage": r"storage.*|aufbewahrung|aufbewahrungshinweise|conservation|conservationconditions|baoquan|huongdanbaoquan|保存方法",
    "usage": (
        r"preparation|preparationinstructions?|preparationandusage|directions?|directionsforuse|usage|usageinstructions?|howtouse|instructionsforuse"
        r"|cookingguidelines|cookinginstructions|zubereitung|verwendungshinweise|huongdansudung|cachdung|cachsudung"
    ),
    "warnings": r"allerg(?:y|en|ens)(?:advice|statement|information|info)?|allergene|allergenmaybepresent|allergystatement",
    "origin": r"countryoforigin|herkunftsland|xuatxu",
}
NO_LABEL = re.compile(r"(?:note|notes|title|label|header|heading|link|url|icon|count|flag|bold|id|type|placeholder|button)$")
NO_TEXT_KEYS = frozenset("type id url href link icon class classname style image src alt key code".split())
INTERFACE = re.compile(r"(?:^|\.)(?:locale|strings|i18n|translations?|messages|dictionary|labels|copy|seo|navigation|menu|footer)(?:\.|$)", re.I)
NO_VALUE = re.compile("^(?:true|false|null|n/a|none|tham khảo mô tả)$", re.I)
TITLES, BODIES = ("title", "name", "label", "header", "heading", "key"), ("content", "value", "text", "body", "contentBlock", "description")
MOST_STATE_OBJECTS = 300_000
# How a shop's answers open and close, and what in them tells ingredients or storage.
GREETING = re.compile(r"^(?:dạ[,\s]*)?(?:chào\s+(?:ba mẹ|bố mẹ|ba|bố|mẹ|anh chị|anh|chị|bạn)(?:\s+(?:ơi|ạ))?[,.!\s]*)?(?:dạ[,\s]*)?", re.I)
THANKS = re.compile(r"\s*(?:con cưng|shop|kids ?plaza)?\s*(?:xin\s+)?(?:cảm|cám) ơn[^.]*\.?\s*$", re.I)
TOLD_INGREDIENTS = re.compile(r"thành phần(?:\s+(?:gồm|từ|chính|bao gồm|như sau|có))*\s*(?:là|:)?\s*(.{15,})", re.I | re.S)
TOLD_STORAGE = re.compile(r"((?:bảo quản|đậy kín|sau khi (?:mở|pha)).{10,})", re.I | re.S)
NO_PRESERVATIVE = re.compile(r"không (?:chứa |có )?(?:chất )?bảo quản", re.I)

_STATE_LABELS = {kind: re.compile(p) for kind, p in STATE_LABELS.items()}
_BREAKS = re.compile(r"<br\s*/?>|</(?:p|div|li|h[0-9]|tr|ul|ol|table)>", re.I)
_GLUED = regex.compile(r"(\p{Ll}|[0-9%)])(?=\p{Lu}\p{Ll})")


def fragment_text(markup: str | None) -> str:
    """Visible text of a piece of markup; blocks end lines, list members begin with a dot."""
    text = re.sub("<li[^>]*>", "\n• ", _BREAKS.sub("\n", markup or ""), flags=re.I)
    text = re.sub(r"[ \t\xa0]+", " ", Page(re.sub("<[^>]+>", " ", text)).text(0))
    return re.sub(r" *\n[ \n]*", "\n", text).strip()


def unglued(text: str) -> str:
    """A line break where a small letter runs into a capitalised word."""
    return _GLUED.sub(r"\1\n", text)


def page_text(page: Page) -> str:
    """Visible text with a line for each block; of the main part where there is one with text."""
    def collect(i: int) -> str:
        out = []
        closing: list[tuple[int, str]] = []
        j = i + 1
        while j < page.end[i]:
            while closing and closing[-1][0] <= j:
                out.append(closing.pop()[1])
            tag = page.tag[j]
            if tag in HIDDEN:
                j = page.end[j]
                continue
            if tag == "br":
                out.append("\n")
            elif not tag:
                out.append(page.data[j])
            elif tag in BLOCKS or tag == "span" and page.has_class(j, "title"):
                out.append("\n")
                closing.append((page.end[j], "\n"))
            j += 1
        out += [c for _, c in reversed(closing)]
        text = re.sub(r"[ \t\xa0​]+", " ", "".join(out))
        return re.sub(r"\n{2,}", "\n", re.sub(r" *\n *", "\n", text)).strip()

    main = page.first(0, lambda i: page.tag[i] == "main")
    body = page.first(0, lambda i: page.tag[i] == "body")
    return (collect(main) if main is not None else "") or collect(body if body is not None else 0)


def state_label(label: str) -> str | None:
    """The section that a state key or title names."""
    key = re.sub("[^a-z0-9぀-ヿ一-鿿]", "", folded(label))
    if not key or len(key) > 40 or NO_LABEL.search(key):
        return None
    return next((kind for kind, p in _STATE_LABELS.items() if p.fullmatch(key)), None)


def strings(value) -> list[str]:
    """All texts inside a value, without those of keys that carry no text."""
    out, waiting = [], [value]
    while waiting:
        v = waiting.pop()
        if isinstance(v, str):
            out.append(v)
        elif isinstance(v, list):
            waiting.extend(reversed(v))
        elif isinstance(v, dict):
            waiting.extend(x for k, x in reversed(v.items()) if k.lower() not in NO_TEXT_KEYS)
    return out


def state_sections(values) -> dict[str, str]:
    """Sections that state objects hold under a telling key, or as a pair of title and text; interface texts are no product's."""
    out: dict[str, str] = {}

    def put(kind: str | None, text: str) -> None:
        if kind and kind not in out:
            text = tidy(without_tail(fragment_text(text)))
            if len(text) >= 8 and not re.search(r"\{\w+\}", text) and not NO_VALUE.match(text):
                out[kind] = shortened(text, LONGEST[kind])

    stack = [(v, "", 0) for v in values]
    visited = 0
    while stack and visited < MOST_STATE_OBJECTS:
        visited += 1
        o, path, depth = stack.pop()
        if depth > MOST_DEPTH or INTERFACE.search(path):
            continue
        if isinstance(o, list):
            stack.extend((v, path, depth + 1) for v in o if isinstance(v, (dict, list)))
        elif isinstance(o, dict):
            title = next((o[k] for k in TITLES if isinstance(o.get(k), str)), None)
            body = next((o[k] for k in BODIES if o.get(k) is not None), None)
            if title and body is not None:
                put(state_label(title), " ".join(strings(body)) if isinstance(body, (dict, list)) else str(body))
            for k, v in o.items():
                if isinstance(v, str):
                    put(state_label(k), v)
                elif isinstance(v, list) and v and all(isinstance(x, str) for x in v):
                    put(state_label(k), ", ".join(v))
                elif isinstance(v, (dict, list)):
                    stack.append((v, f"{path}.{k}", depth + 1))
    return out


def answer_sections(objects: list[dict]) -> dict[str, str]:
    """Sections told in answers to visitors' questions; no warnings, which answers only mention."""
    out: dict[str, str] = {}
    for o in objects:
        given = o.get("acceptedAnswer")
        if not is_kind(o, "question") or not given:
            continue
        texts = [str(a.get("text") or "") for a in (given if isinstance(given, list) else [given]) if isinstance(a, dict)]
        answer = THANKS.sub("", GREETING.sub("", fragment_text("\n".join(texts)), count=1), count=1)
        told = TOLD_INGREDIENTS.search(answer)
        if told:
            out.setdefault("ingredients", shortened(tidy(told[1]), LONGEST["ingredients"]))
        told = TOLD_STORAGE.search(answer)
        if told and not NO_PRESERVATIVE.search(told[1][:30]):
            out.setdefault("storage", shortened(tidy(told[1]), LONGEST["storage"]))
        for kind, text in sections_of(unglued(answer)).items():
            if kind != "warnings":
                out.setdefault(kind, text)
    return out


def _price_texts(page: Page) -> list[str]:
    """What may tell a price: the first marked as such, then short texts of parts named for prices that are today's."""
    out = []
    marked = page.first(0, lambda i: page.attrs[i].get("itemprop") == "price")
    if marked is not None:
        out.append(page.attrs[marked].get("content") or page.text(marked))
    for i in page.under():
        named = page.attrs[i].get("class", "").lower()
        if "price" in named and not OLD_PRICE.search(named):
            text = tidy(page.text(i))
            if len(text) <= LONGEST_PRICE and HAS_CURRENCY.search(text):
                out.append(text)
    return out


def detail(html: str | None, base: str | None) -> dict:
    """Fields of one product page; prices that still are text stand in ``price_texts``, the first that can be read counts."""
    page = Page(html)
    objects = list(ld_values(text for kind, text in page.scripts() if kind == "application/ld+json"))
    product = next((o for o in objects if is_kind(o, "product") and o.get("name")), None)
    ld = ld_product(product, base) if product else {}
    price, currency = ld.get("price"), ld.get("currency")
    told = page.meta("product:price:amount") or page.meta("og:price:amount") or page.meta("price")
    if price is None and told:
        digits = re.sub("[^0-9.]", "", told)
        price = float(digits) or None if re.fullmatch(r"[0-9]*\.?[0-9]+\.?", digits) else None
        currency = page.meta("product:price:currency") or page.meta("og:price:currency") or page.meta("priceCurrency") or currency
    text = page_text(page)
    sections = answer_sections(objects) | sections_of(text) | state_sections(blobs(page))
    if ld.get("origin"):
        sections.setdefault("origin", ld["origin"])
    heading, title = (page.first(0, lambda i, tag=tag: page.tag[i] == tag) for tag in ("h1", "title"))
    description = ld.get("description") or page.meta("og:description") or page.meta("description")
    return {
        "title": ld.get("title") or page.meta("og:title") or tidy(page.text(heading)) or tidy(page.text(title)) or None,
        "image": ld.get("image") or absolute(page.meta("og:image") or page.meta("twitter:image"), base),
        "brand": ld.get("brand") or page.meta("product:brand"), "description": shortened(tidy(description), LONGEST_DESCRIPTION) or None,
        "price": price, "price_texts": [] if price is not None else _price_texts(page), "currency": str(currency).upper() if currency else None,
        "availability": ld.get("availability"), "rating": ld.get("rating"), "reviews": ld.get("reviews"), "gtin": ld.get("gtin"),
        "origin": ld.get("origin"), "sections": sections, "text": text, "text_sample": shortened(tidy(text), SAMPLE),
    }


_DETAIL = (
    "page_id long, title string, image string, brand string, description string, price double, price_texts array<string>, currency string, "
    "availability string, rating double, reviews long, gtin string, origin string, sections map<string,string>, text string, text_sample string"
)


def details(captured: DataFrame) -> DataFrame:
    """A detail row of each of captured(page_id, url, html), without a shuffle."""
    read = flat_rows(
        captured.select("page_id", "url", "html"), lambda p: [{"page_id": p["page_id"], **detail(p["html"], p["url"])}], _DETAIL
    )
    parsed = F.get(F.filter(F.transform("price_texts", lambda t: parse_price(t)), lambda p: p.isNotNull()), F.lit(0))
    return read.withColumn("parsed", parsed).withColumns({
        "price": F.coalesce("price", F.col("parsed.value")),
        "currency": F.coalesce(F.when(F.col("price").isNull(), F.col("parsed.currency")), F.col("currency")),
        "importer": importer(F.col("text")),
    }).drop("parsed", "price_texts", "text")
