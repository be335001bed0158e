"""A page's markup as flat lists in document order, so that what lies under a node is a run of nodes.

Only what the readers beside this module ask of markup is here: subtree texts, first matches and counts by bisection.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

# Elements without an end tag, elements that a start tag closes, elements whose text no visitor sees.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    **dict.fromkeys("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), {"p"}),
}
#: An element in which an earlier sibling's end tag is not looked for.
WALLS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
HIDDEN = frozenset("script style noscript svg iframe template link meta".split())
_SPACE = re.compile(r"\s+")


def tidy(text: str | None) -> str:
    """White space collapsed and trimmed."""
    return _SPACE.sub(" ", text or "").strip()


def absolute(address: str | None, base: str | None) -> str | None:
    """An address as seen from a page; null where it is none."""
    address = (address or "").strip()
    if not address or address.startswith("data:"):
        return None
    try:
        full = urljoin(base or "", "https:" + address if address.startswith("//") else address)
    except ValueError:
        return None
    return full if re.match(r"[a-z][a-z0-9+.-]*:", full, re.I) else None


class Page(HTMLParser):
    """``tag`` (empty for text), ``data``, ``attrs``, ``up`` (parent) and ``end`` (first node past the subtree) of each node."""

    def __init__(self, html: str | None):
        super().__init__(convert_charrefs=True)
        self.tag: list[str] = ["#"]
        self.data: list[str] = [""]
        self.attrs: list[dict[str, str]] = [{}]
        self.up: list[int] = [-1]
        self.end: list[int] = [0]
        self._stack = [0]
        self.feed(html or "")
        self.close()
        while self._stack:
            self.end[self._stack.pop()] = len(self.tag)
        self._where: dict[str, list[int]] = {}
        for i, t in enumerate(self.tag):
            self._where.setdefault(t, []).append(i)

    def _add(self, tag: str, data: str, attrs: dict[str, str]) -> int:
        i = len(self.tag)
        self.tag.append(tag)
        self.data.append(data)
        self.attrs.append(attrs)
        self.up.append(self._stack[-1])
        self.end.append(i + 1)
        return i

    def handle_starttag(self, tag, attrs):
        closes, walls = CLOSES.get(tag, ()), WALLS.get(tag, {"#"})
        for k in range(len(self._stack) - 1, 0, -1):
            held = self.tag[self._stack[k]]
            if held in closes:
                self._close(k)
            elif held in walls or "p" in closes:  # a paragraph ends only where it is the innermost element
                break
        i = self._add(tag, "", {k: v or "" for k, v in attrs})
        if tag not in VOID:
            self._stack.append(i)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash closes void elements alone, as browsers have it

    def _close(self, k: int) -> None:
        while len(self._stack) > k:
            self.end[self._stack.pop()] = len(self.tag)

    def handle_endtag(self, tag):
        for k in range(len(self._stack) - 1, 0, -1):
            if self.tag[self._stack[k]] == tag:
                self._close(k)
                break

    def handle_data(self, data):
        self._add("", data, {})

    def within(self, i: int, tag: str) -> list[int]:
        """Nodes of one tag under a node, in document order."""
        at = self._where.get(tag, [])
        return at[bisect_left(at, i + 1) : bisect_left(at, self.end[i])]

    def count(self, i: int, tag: str) -> int:
        at = self._where.get(tag, [])
        return bisect_left(at, self.end[i]) - bisect_left(at, i + 1)

    def under(self, i: int = 0) -> Iterator[int]:
        """Elements under a node, in document order."""
        return (j for j in range(i + 1, self.end[i]) if self.tag[j])

    def first(self, i: int, test: Callable[[int], bool]) -> int | None:
        return next((j for j in self.under(i) if test(j)), None)

    def text(self, i: int | None) -> str:
        """All text under a node."""
        return "" if i is None else "".join(self.data[j] for j in self.within(i, ""))

    def leaf(self, i: int) -> bool:
        """Whether no element lies under an element."""
        return not any(self.tag[j] for j in range(i + 1, self.end[i]))

    def has_class(self, i: int, *parts: str) -> bool:
        held = self.attrs[i].get("class", "")
        return any(p in held for p in parts)

    def meta(self, *names: str) -> str | None:
        """Content of the first of the named meta elements that has any."""
        for name in names:
            for i in self._where.get("meta", []):
                a = self.attrs[i]
                if name in (a.get("property"), a.get("name"), a.get("itemprop")) and tidy(a.get("content")):
                    return tidy(a["content"])
        return None

    def scripts(self) -> Iterator[tuple[str, str]]:
        """Type and text of each script."""
        for i in self._where.get("script", []):
            yield self.attrs[i].get("type", "").lower(), self.text(i).strip()


# A price as a card's whole text, and what makes a text a price.
PRICE_TEXT = re.compile(
    r"^\s*(?:(?:từ|from|giá)\s*:?\s*)?(?:[₫$£€¥￥₩฿₱]|US\$|S\$|A\$|RM|Rp)?\s*[0-9]{1,3}(?:[.,\s][0-9]{3})*(?:[.,][0-9]{1,2})?"
    r"\s*(?:₫|đ|VNĐ|VND|円|원|บาท|€)?\s*$", re.I,
)
HAS_CURRENCY = re.compile(r"[₫$£€¥￥₩฿₱]|đ|VNĐ|VND|円|원|บาท|RM|Rp", re.I)
# How far above a price its card may lie, and what a card may hold.
CLIMB, MOST_LINKS, MOST_IMAGES, LEAST_TITLE = 8, 3, 4, 6
_IMAGE_FIELDS = ("data-src", "data-original", "data-lazy-src", "data-srcset", "src", "srcset")


def image_of(page: Page, i: int, base: str | None) -> str | None:
    """An image's address; the ones that a script would load later come first."""
    for name in _IMAGE_FIELDS:
        value = page.attrs[i].get(name, "").strip()
        if value:
            return absolute(re.split("[ ,]", value)[0] if name.endswith("srcset") else value, base)
    return None


def is_price(text: str) -> bool:
    return bool(PRICE_TEXT.match(text) and HAS_CURRENCY.search(text))


def card_title(page: Page, i: int) -> str:
    """A title attribute of more than 8 characters, a heading or named part, the image's text, or the longest link's."""
    for j in page.under(i):
        if len(tidy(page.attrs[j].get("title"))) > 8:
            return tidy(page.attrs[j]["title"])
    named = tidy(page.text(page.first(i, lambda j: page.tag[j] in ("h2", "h3", "h4") or page.has_class(j, "name", "title"))))
    if named:
        return named
    image = next(iter(page.within(i, "img")), None)
    if image is not None and tidy(page.attrs[image].get("alt")):
        return tidy(page.attrs[image]["alt"])
    return max((tidy(page.text(a)) for a in page.within(i, "a")), key=len, default="")


def cards(page: Page, base: str | None) -> list[dict]:
    """Product cards of a listing: for each price the smallest part around it that holds an image, a link and a title.

    A part with more links or images than one product has ends the climb.  Of cards with one address the first stays.
    """
    # texts of elements that hold nothing but text, which can be prices
    priced = [i for i in page.under() if page.up[i] > 0 and page.leaf(i)]
    priced = [i for i in priced if len(page.text(i)) <= 40 and is_price(page.text(i))]
    out: dict[str, dict] = {}
    failed: set[int] = set()
    for leaf in priced:
        i = page.up[leaf]
        for _ in range(CLIMB):
            if i <= 0 or page.tag[i] in ("body", "html"):
                break
            images = page.count(i, "img")
            if images:
                links = [page.attrs[a].get("href", "") for a in page.within(i, "a") if "href" in page.attrs[a]]
                distinct = dict.fromkeys(u for u in (absolute(h, base) for h in links) if u)
                if len(distinct) > MOST_LINKS or images > MOST_IMAGES:
                    break
                usable = dict.fromkeys(u for u in (absolute(h, base) for h in links if h and h != "#" and not h.startswith("javascript")) if u)
                title = card_title(page, i) if usable and i not in failed else ""
                if len(title) >= LEAST_TITLE:
                    at = bisect_left(priced, i)
                    prices = [tidy(page.text(p)) for p in priced[at : bisect_left(priced, page.end[i])]]
                    address = next(iter(usable))
                    image = image_of(page, page.within(i, "img")[0], base)
                    out.setdefault(address, {"title": title, "url": address, "image": image, "prices": prices})
                    break
                failed.add(i)
            i = page.up[i]
    return list(out.values())
