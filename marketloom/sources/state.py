"""Product objects inside the state that a page's scripts carry: found, decoded, searched.

Scripts are scanned in one pass each; an object ends at the bracket that closes it, brackets inside strings don't count.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator

from .markup import Page, absolute, tidy

# Names under which pages keep their state; keys of names; how prices, images and addresses are keyed.
STATE = re.compile(r"(?:window\.|self\.|\bvar\s+|\blet\s+|\bconst\s+)(?:__[A-Z0-9_]+__|[A-Za-z_$][\w$]*(?:State|STATE|Data|DATA))\s*=\s*", re.A)
NAMES = ("name", "title", "productName", "product_name", "displayName", "itemName", "productTitle")
NO_PRICE = re.compile(
    "unit|per|cup|qualifier|was|original|regular|^reg|list|before|old|strike|compare|min|max|deposit|tax|ship|deliver|threshold|count|quantity"
    "|percent|saving|discount|loyalty|points|id$", re.I,
)
PRICE = re.compile("price|retail|amount|value|current|actual|final|sale|offer|now", re.I)
PRICE_ITSELF = re.compile("price|retail|offer", re.I)
PRICE_PARENT = re.compile("price|retail|offer|cost|amount", re.I)
MONEY = re.compile(r"[₫$£€¥￥₩฿₱]|\b(?:USD|GBP|EUR|JPY|AUD|SGD|VND|THB|MYR|KRW)\b")
PLAIN = re.compile(r"^[0-9]+(?:[.,][0-9]+)?$")
IMAGE_KEY = re.compile("image|thumb|img|media|picture|photo", re.I)
IMAGE = re.compile(r"^(https?:)?//|\.(jpe?g|png|webp)", re.I)
ADDRESS_KEY = re.compile("url|href|link|path|self|canonical", re.I)
NO_ADDRESS_KEY = re.compile("image|media|thumb|img|picture|photo|asset", re.I)
ADDRESS = re.compile(r"^(https?://|/)(?![^?#]*\.(?:jpe?g|png|webp|gif|svg|avif)(?:[?#]|$))\S{3,}$", re.I)
# Objects visited at most, depth at most, of a search for prices and strings as well.
MOST_VISITED, MOST_DEPTH, NEAR = 200_000, 40, 3

_PARTS = re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|[{}\[\]"\']', re.S)
_LITERAL = re.compile(r'"((?:[^"\\]|\\.)*)"|\'((?:[^\'\\]|\\.)*)\'', re.S)
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(.))", re.S)
_SHORT = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}


def closing(text: str, start: int = 0) -> int:
    """Position past the bracket that closes the one at start; -1 where none does."""
    depth = 0
    for m in _PARTS.finditer(text, start):
        part = m[0]
        if part in "{[":
            depth += 1
        elif part in "}]":
            depth -= 1
            if not depth:
                return m.end()
        elif len(part) == 1:  # a quote that nothing closes
            return -1
    return -1


def literal(text: str, start: int = 0) -> str | None:
    """The value of a script's string literal."""
    m = _LITERAL.match(text, start)
    if not m:
        return None
    body = m[1] if m[1] is not None else m[2]
    value = _ESCAPE.sub(lambda e: chr(int(e[1] or e[2], 16)) if e[1] or e[2] else _SHORT.get(e[3], e[3]), body)
    return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def parsed(text: str):
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def blobs(page: Page) -> Iterator:
    """JSON values in a page's scripts: whole scripts of a data type, state variables of the others."""
    for kind, text in page.scripts():
        if len(text) < 200 or "ld+json" in kind:
            continue
        if kind and not re.search("javascript|module", kind):
            yield parsed(text)
            continue
        at = 0
        while m := STATE.search(text, at):
            at = m.end()
            value = text[at : at + 11]
            if value.startswith("JSON.parse("):
                yield parsed(literal(text, at + 11) or "")
            elif value[:1] in ("{", "["):
                stop = closing(text, at)
                if stop > 0:
                    yield parsed(text[at:stop])


def hydrated(values: list):
    """The object graph that a list encodes in which members are indexes into the list; the first value is the root.

    Each entry becomes one object however often it is named, so a graph with cycles ends; negative and non-integer
    members stand for themselves.  Without recursion, so depth is bounded by memory alone.
    """
    made: dict[int, object] = {}
    waiting: deque[int] = deque()

    def at(n):
        if isinstance(n, bool) or not isinstance(n, int) or n < 0:
            return n
        if n not in made:
            value = values[n] if n < len(values) else None
            made[n] = type(value)() if isinstance(value, (list, dict)) else value
            if isinstance(value, (list, dict)):
                waiting.append(n)
        return made[n]

    root = at(0)
    while waiting:
        n = waiting.popleft()
        value, out = values[n], made[n]
        if isinstance(value, list):
            out.extend(map(at, value))
        else:
            out.update((k, at(v)) for k, v in value.items())
    return root


def _number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def price_in(o, depth: int = 0, priced: bool = False) -> tuple[float | str, str | None] | None:
    """(number or price text, currency) of the first key that names what a product costs now."""
    if not isinstance(o, dict) or depth > NEAR:
        return None
    currency = o.get("currency") or o.get("currencyCode")
    for k, v in o.items():
        if NO_PRICE.search(k) or not PRICE.search(k):
            continue
        itself = priced or bool(PRICE_ITSELF.search(k))
        if _number(v) and v > 0 and itself:
            return float(v), currency
        if isinstance(v, str) and len(v) < 30 and re.search("[1-9]", v) and (MONEY.search(v) or itself and PLAIN.match(v)):
            return v, currency
        if isinstance(v, dict):
            found = price_in(v, depth + 1, priced or bool(PRICE_PARENT.search(k)))
            if found:
                return found[0], found[1] or v.get("currencyCode") or v.get("currency")
    return None


def string_in(o, key: re.Pattern, value: re.Pattern, depth: int = 0, no_key: re.Pattern | None = None) -> str | None:
    """The first string under a fitting key, or under anything inside a fitting key."""
    if depth > NEAR:
        return None
    pairs = list(o.items()) if isinstance(o, dict) else list(enumerate(o)) if isinstance(o, list) else []
    for k, v in pairs:
        if isinstance(v, str) and (depth or key.search(str(k))) and value.search(v):
            return v
    for k, v in pairs:
        if isinstance(v, (dict, list)) and v and (depth or key.search(str(k))) and not (no_key and no_key.search(str(k))):
            found = string_in(v[0] if isinstance(v, list) else v, key, value, depth + 1)
            if found:
                return found
    return None


def products(values, base: str | None, raw: bool = False) -> list[dict]:
    """Objects with a name, a price and an address or image, as title, url, image, brand, price or price text, currency; ``raw`` adds the object.

    The search goes depth first from the last value on and ends after ``MOST_VISITED`` objects.
    """
    stack = [(v, 0) for v in values]
    out: dict[tuple, dict] = {}
    visited = 0
    while stack and visited < MOST_VISITED:
        visited += 1
        o, depth = stack.pop()
        if depth > MOST_DEPTH:
            continue
        if isinstance(o, list):
            stack.extend((v, depth + 1) for v in o if isinstance(v, (dict, list)))
            continue
        if not isinstance(o, dict):
            continue
        name = next((o[k] for k in NAMES if isinstance(o.get(k), str) and 5 <= len(o[k]) <= 300 and not re.match("https?:|/", o[k])), None)
        price = price_in(o) if name else None
        if price:
            image, address = string_in(o, IMAGE_KEY, IMAGE), string_in(o, ADDRESS_KEY, ADDRESS, no_key=NO_ADDRESS_KEY)
            title = tidy(name)
            if image or address:
                brand = o.get("brand")
                brand = brand if isinstance(brand, str) else (brand.get("name") if isinstance(brand, dict) else None) or o.get("brandName")
                size = o.get("size") if isinstance(o.get("size"), str) and o["size"] not in title else ""
                out.setdefault((title, price[0]), {
                    "title": " ".join(filter(None, (title, size))), "url": absolute(address, base), "image": absolute(image, base),
                    "brand": tidy(brand) or None if isinstance(brand, str) else None,
                    "price": price[0] if _number(price[0]) else None, "prices": [price[0]] if isinstance(price[0], str) else [],
                    "currency": price[1] if isinstance(price[1], str) else None, **({"raw": o} if raw else {}),
                })
        stack.extend((v, depth + 1) for v in o.values() if isinstance(v, (dict, list)))
    return list(out.values())
