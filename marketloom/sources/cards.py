"""Shops and search engines whose result pages have a form of their own: which elements are cards, and where in a card each field stands.

A source says that in a few readers over ``markup.Page``, or over the state objects of a page; texts leave as they stand, and
prices, ratings, counts and wrapped addresses are parsed in the JVM.  Rows have the connectors' columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.phrases import folded
from ..functions.price import parse_price, parse_sold
from ..functions.text import item_id
from . import state
from .batches import flat_rows
from .captures import FIELDS, PRICE_IN_TEXT
from .markup import Page, absolute, tidy

_RAW = (
    "source string, market string, pos int, title string, url string, image string, price_text string, original_text string, currency string, "
    "brand string, seller string, rating_text string, reviews_text string, sold_text string, gtin string, snippet string, sponsored boolean, "
    "rank_text string, text string"
)


class Card:
    """One card of a page, asked by class, tag and attribute."""

    def __init__(self, page: Page, node: int):
        self.page, self.node = page, node

    def nodes(self, tag: str | None = None, cls: str | None = None, without: str | None = None, **attrs: str) -> Iterator[int]:
        """Elements under the card: of a tag, with a whole class, without one, with attributes that hold a text."""
        for i in self.page.under(self.node):
            held = self.page.attrs[i]
            classes = held.get("class", "").split()
            if (tag is None or self.page.tag[i] == tag) and (cls is None or cls in classes) and (without is None or without not in classes):
                if all(part in held.get(name.replace("_", "-"), "") for name, part in attrs.items()):
                    yield i

    def text(self, *args, **kwargs) -> str:
        """Text of the first such element."""
        return tidy(self.page.text(next(self.nodes(*args, **kwargs), None)))

    def attr(self, name: str, *args, **kwargs) -> str:
        """An attribute of the first such element, or of the card itself where no element is asked for."""
        node = next(self.nodes(*args, **kwargs), None) if args or kwargs else self.node
        return tidy(self.page.attrs[node].get(name)) if node is not None else ""

    def inside(self, outer: Iterator[int]) -> Card | None:
        node = next(outer, None)
        return None if node is None else Card(self.page, node)

    def all_text(self) -> str:
        return tidy(self.page.text(self.node))


def found(pattern: str, text: str, group: int = 1) -> str | None:
    m = re.search(pattern, text, re.I)
    return m[group] if m else None


@dataclass(frozen=True)
class Shop:
    """``cards`` tells a card's element by tag, attributes; ``read`` its fields; rows without title or url are dropped."""

    id: str
    #: Base address, currency by market.
    markets: dict[str, tuple[str, str]]
    cards: Callable[[str, dict[str, str]], bool]
    read: Callable[[Card, str], dict | None]
    #: Of rows with equal values of this field the first stays.
    unique: str | None = None
    seller: str = field(default="")
    kind: str = "shop"


@dataclass(frozen=True)
class State:
    """A shop whose page carries its results as state: ``rows`` of a page, its text and base address."""

    id: str
    markets: dict[str, tuple[str, str]]
    rows: Callable[[Page, str, str], Iterator[dict]]
    seller: str = ""
    kind: str = "shop"


# A big shop's addresses and currencies, and what stands before the titles of its advertisements.
AMAZON = {
    "us": ("https://www.amazon.com", "USD"), "gb": ("https://www.amazon.co.uk", "GBP"), "de": ("https://www.amazon.de", "EUR"), "fr": ("https://www.amazon.fr", "EUR"),
    "jp": ("https://www.amazon.co.jp", "JPY"), "au": ("https://www.amazon.com.au", "AUD"), "sg": ("https://www.amazon.sg", "SGD"), "ca": ("https://www.amazon.ca", "CAD"),
    "it": ("https://www.amazon.it", "EUR"), "es": ("https://www.amazon.es", "EUR"), "nl": ("https://www.amazon.nl", "EUR"),
}
BING_SHOP = {"us": "USD", "gb": "GBP", "au": "AUD", "de": "EUR", "fr": "EUR", "ca": "CAD"}
ADVERTISED = re.compile(r"^(?:Sponsored Ad|Gesponserte Anzeige|Annonce sponsorisée|スポンサー広告)\s*[-–]\s*", re.I)
SPONSORED = re.compile("Sponsored|Gesponsert|スポンサー|Sponsorisé")
CURRENCY_IN_PRICE = r"\bVND\b|₫|\bUSD\b|US\$|\bGBP\b|£|\bEUR\b|€|\bCAD\b|CA\$|\bAUD\b|A\$|\bJPY\b|￥|¥"
BOUGHT = ("bought", "gekauft", "購入")


def _amazon(card: Card, base: str) -> dict | None:
    code, heading = card.attr("data-asin"), card.inside(card.nodes("h2"))
    title = ADVERTISED.sub("", (heading.attr("aria-label") or heading.text("span")) if heading else "")
    if not code:
        return None
    prices = [Card(card.page, i) for i in card.nodes(cls="a-price")]
    now = next((p.text(cls="a-offscreen") for p in prices if "a-text-price" not in p.attr("class").split()), "")
    old = next((p.text(cls="a-offscreen") for p in prices if "a-text-price" in p.attr("class").split()), "")
    rated = [x.replace(",", ".") for x in re.findall(r"[0-9]+[.,][0-9]", card.text(cls="a-icon-alt"))]
    bought = next((t for i in card.nodes("span") if any(b in (t := tidy(card.page.text(i))) for b in BOUGHT)), "")
    link = card.inside(card.nodes("a", href="customerReviews"))
    return {
        "title": title, "url": f"{base}/dp/{code}", "image": card.attr("src", "img", cls="s-image"), "price_text": now, "original_text": old,
        "rating_text": next((x for x in rated if float(x) <= 5), None), "reviews_text": card.text(aria_label="rating") or (link.text("span") if link else ""),
        "sold_text": found(r"([0-9]+(?:[.,][0-9]+)?\s?[KkMm]?)\+", bought), "sponsored": bool(SPONSORED.search(card.all_text())),
    }


def _aldi(card: Card, base: str) -> dict:
    brand, name = card.text(cls="product-tile__brandname"), card.text(cls="product-tile__name") or card.attr("title")
    size = card.text(cls="product-tile__unit-of-measurement")
    front = [] if not brand or name.lower().startswith(brand.lower()) else [brand]
    priced = next((i for i in card.nodes() if {"base-price__discounted", "base-price__regular"} & set(card.page.attrs[i].get("class", "").split())), None)
    return {
        "title": " ".join(filter(None, [*front, name, size])), "brand": brand, "url": absolute(card.attr("href", "a") or base, base), "image": card.attr("src", "img"),
        "price_text": tidy(card.page.text(priced)), "original_text": card.text(cls="base-price__was-price"), "snippet": card.text(cls="product-tile__comparison-price"),
    }


def _kroger(card: Card, base: str) -> dict:
    link = card.attr("href", "a", href="/p/")
    return {
        "title": card.attr("aria-label"), "url": absolute(link.split("?")[0], base) if link else None, "image": card.attr("src", "img"),
        "price_text": found(r"\$\s?[0-9]+(?:\.[0-9]{2})?", card.text(data_testid="product-item-unit-price"), 0), "gtin": found(r"/([0-9]{8,14})(?:\?|$)", link),
        "snippet": card.text(data_testid="product-item-sizing"), "sponsored": "Sponsored" in card.text(cls="ProductCard-tags"),
    }


def _rakuten(card: Card, base: str) -> dict:
    review = next((t for i in card.nodes() if "review" in card.page.attrs[i].get("class", "") for t in [tidy(card.page.text(i))]), "")
    shop = next((Card(card.page, i).text("a") for i in card.nodes() if "merchant" in card.page.attrs[i].get("class", "")), "")
    rated = re.search(r"([0-9](?:\.[0-9]+)?)\s*\(([0-9,]+)件\)", review)
    return {
        "title": card.attr("alt", "img"), "url": card.attr("href", "a", href="item.rakuten.co.jp").split("?")[0], "image": card.attr("src", "img"),
        "price_text": card.attr("data-track-price"), "rating_text": rated and rated[1], "reviews_text": rated and rated[2],
        "seller": f"Rakuten · {shop}" if shop else "Rakuten",
    }


def _shopee(card: Card, base: str) -> dict | None:
    href = card.attr("href")
    lines = [t for i in card.page.under(card.node) if card.page.leaf(i) and (t := tidy(card.page.text(i)))]
    text = " ".join(lines)
    price = found(r"₫\s?([0-9.]+)", text) or found(r"([0-9.]+)\s?₫", text)
    named = next((a for i in card.nodes("img") if len(a := tidy(card.page.attrs[i].get("alt"))) > 8), "")
    title = named or max((x for x in lines if not re.search(r"₫|đã bán|^[0-9]", x, re.I)), key=len, default="")
    sold = found(r"đã bán\s*([0-9.,]+\s*k?)", text)
    if not price:
        return None
    return {
        "title": title, "url": absolute(href.split("?")[0], base), "price_text": f"{price}₫", "sold_text": sold and sold.replace(",", "."),
        "image": next((s for i in card.nodes("img") if re.search(r"susercontent|cf\.shopee", s := card.page.attrs[i].get("src", ""))), None),
        "rating_text": found(r"(?:^|\s)([1-5][.,][0-9])(?:\s|$)", text), "sponsored": bool(re.search(r"\bAd\b|Tài trợ", text)),
        "key": found(r"-i\.[0-9]+\.([0-9]+)", href),
    }


# What a text says where its price is for a unit, and dates before a result's text.
PER_UNIT = re.compile(r"/\s*(?:kg|l)\b|/\s*100|le kg|le litre", re.I)
DATED = re.compile(r"^[0-9]{1,2} thg [0-9]{1,2}, [0-9]{4}\s*·\s*")
CAPTIONS = ("p_lineclamp2", "b_lineclamp2", "b_lineclamp3", "b_lineclamp4")


def _auchan(card: Card, base: str) -> dict | None:
    href = next((h for i in card.nodes("a") if "productThumbnailLink" in card.page.attrs[i].get("class", "").split() or "/pr-" in card.page.attrs[i].get("href", "") for h in [card.page.attrs[i].get("href")]), None)
    picture = card.inside(card.nodes("picture"))
    pictured = next((a for i in picture.nodes() if picture.page.tag[i] in ("source", "img") and (a := tidy(picture.page.attrs[i].get("alt")))), "") if picture else ""
    if not href:
        return None
    told = found(r"^([0-9]+(?:[.,][0-9]{1,2})?)$", card.attr("content", itemprop="price"))
    for i in card.nodes() if told is None else ():
        classes = card.page.attrs[i].get("class", "")
        text = tidy(card.page.text(i))
        if "price" in classes and "see-prices" not in classes and not PER_UNIT.search(text):
            told = found(r"([0-9]+[,.][0-9]{2})\s*€", text)
            if told:
                break
    return {
        "title": pictured or card.attr("content", itemprop="name"), "url": absolute(href, base), "image": card.attr("content", "meta", itemprop="image"),
        "price_text": told and f"{told} €", "rating_text": card.attr("content", itemprop="ratingValue"),
        "reviews_text": card.attr("content", itemprop="reviewCount") or card.attr("content", itemprop="ratingCount"),
    }


def _chronodrive(card: Card, base: str) -> dict | None:
    href, media = card.attr("href", "a", cls="card-content-link"), card.inside(card.nodes(cls="media"))
    if not href:
        return None
    return {
        "title": card.attr("aria-label") or card.text(cls="card-label"), "url": absolute(href, base), "price_text": card.text(cls="product-actions-value"),
        "image": (media.attr("src", "img") if media else "") or card.attr("src", "img"),
    }


def _best_seller(card: Card, base: str) -> dict | None:
    code, lines = card.attr("data-asin", data_asin=""), next((tidy(card.page.text(i)) for i in card.nodes() if card.page.has_class(i, "line-clamp")), "")
    code = next((c for i in card.nodes() if (c := card.page.attrs[i].get("data-asin"))), code)
    row = card.inside(card.nodes(cls="a-icon-row"))
    if not code:
        return None
    return {
        "title": card.attr("alt", "img") or lines, "url": f"{base}/dp/{code}", "image": card.attr("src", "img"), "rank_text": card.text(cls="zg-bdg-text"),
        "price_text": next((tidy(card.page.text(i)) for i in card.nodes() if card.page.has_class(i, "p13n-sc-price")), None),
        "rating_text": (found(r"([0-9]+[.,][0-9])", card.text(cls="a-icon-alt")) or "").replace(",", "."), "reviews_text": row.text(cls="a-size-small") if row else None,
    }


def _bing(card: Card, base: str) -> dict | None:
    heading = card.inside(card.nodes("h2"))
    link = heading.inside(heading.nodes("a")) if heading else None
    if not link:
        return None
    caption = card.inside(card.nodes(cls="b_caption"))
    told = (caption.text("p") if caption else "") or next((t for c in (*CAPTIONS, "b_algoSlug") if (t := card.text(cls=c))), "") or card.text("p")
    images = (card.page.attrs[i] for i in card.nodes("img"))
    image = next((a.get("src") or a.get("data-src") for a in images if _worth_showing(a)), None)
    return {"title": link.all_text(), "url": link.attr("href"), "snippet": DATED.sub("", told), "image": image, "text": card.all_text()}


def _worth_showing(image: dict[str, str]) -> bool:
    source, width = image.get("src") or image.get("data-src") or "", image.get("width") or "0"
    small = width.isdigit() and 0 < int(width) < 50
    return bool(re.match("https?:", source)) and not small and not re.search(r"favicon|/th\?id=ODF|/rp/", source)


def _ddg(card: Card, base: str) -> dict:
    page, row = card.page, card.node
    while row > 0 and page.tag[row] != "tr":
        row = page.up[row]
    # what is told about a link stands in the table's next row
    following = page.end[row]
    after = Card(page, following) if row > 0 and following < len(page.tag) and page.tag[following] == "tr" else None
    return {"title": card.all_text(), "url": card.attr("href"), "snippet": after.text("td", cls="result-snippet") if after else None}


def _listed(link: Callable[[dict, str], str | None], image: Callable[[dict], object]):
    def rows(page: Page, text: str, base: str) -> Iterator[dict]:
        for p in state.products(state.blobs(page), base, raw=True):
            o, pictured = p["raw"], image(p["raw"])
            price = str(p["price"]) if p["price"] is not None else p["prices"][0]
            yield {
                "title": p["title"], "url": link(o, base) or p["url"], "image": pictured if isinstance(pictured, str) and pictured else p["image"],
                "brand": p["brand"], "price_text": price, "currency": (p["currency"] or "").upper() or None,
            }

    return rows


def _dashed(text: object) -> str:
    return re.sub("^-|-$", "", re.sub("[^a-z0-9]+", "-", folded(str(text or ""))))


def _carrefour(page: Page, text: str, base: str) -> Iterator[dict]:
    """Products of the state's index-coded route data."""
    mark = "window.__INITIAL_STATE__="
    start = text.find(mark)
    stop = state.closing(text, start + len(mark)) if start >= 0 else -1
    whole = state.parsed(text[start + len(mark) : stop]) if stop > 0 else None
    whole = whole if isinstance(whole, dict) else {}
    coded = (whole.get("vuex") or {}).get("routeData") or whole.get("routeData")
    coded = state.parsed(coded) if isinstance(coded, str) else coded
    root = state.hydrated(coded) if isinstance(coded, list) else None
    for o in root.get("data") or [] if isinstance(root, dict) else []:
        if isinstance(o, dict) and o.get("type") == "product":
            yield _carrefour_row(_object(o.get("attributes")), _object(o.get("links")), base)


def _object(value) -> dict:
    return value if isinstance(value, dict) else {}


def _first_value(value) -> dict:
    return _object(next(iter(_object(value).values()), None))


def _carrefour_row(o: dict, links: dict, base: str) -> dict:
    offer = _object(_first_value(_first_value(o.get("offers"))).get("attributes"))
    price, reviews, paths = _object(offer.get("price")), _object(o.get("customerReviews")), _object(o.get("images")).get("paths") or [""]
    kinds = [c.get("label") for c in (o.get("categories") or [])[-1:] if isinstance(c, dict)]
    told = lambda v: None if v is None else str(v)
    return {
        "title": tidy(str(o.get("title") or "")), "url": base + links["self"] if links.get("self") else None, "image": str(paths[0]).replace("FORMAT", "540x540"),
        "price_text": told(price.get("price")), "brand": tidy(str(o.get("brand") or "")), "gtin": told(o.get("ean")), "rating_text": told(reviews.get("average")),
        "reviews_text": told(reviews.get("count")), "snippet": " · ".join(str(x) for x in (o.get("packaging"), price.get("perUnitLabel"), *kinds) if x),
    }


def _leclerc(card: Card, base: str) -> dict:
    link = next((i for i in card.nodes("a") if "data-product-card-title" in card.page.attrs[i] or card.page.attrs[i].get("href", "").startswith("/fp/")), None)
    held = card.page.attrs[link] if link is not None else {}
    told = next((tidy(card.page.text(i)) for i in card.nodes() if "currency" in card.page.attrs[i]), "")
    price = re.search(r"([0-9]+)\s*€\s*,\s*([0-9]{2})", told) or re.search(r"([0-9]+)[,.]([0-9]{2})\s*€", told)
    return {
        "title": tidy(held.get("title")) or tidy(card.page.text(link)), "url": base + held["href"] if held.get("href") else None, "image": card.attr("src", "img"),
        "price_text": price and f"{price[1]}.{price[2]} €", "brand": card.text(cls="p-small"), "gtin": card.attr("data-ean"), "snippet": found(r"[0-9,.]+\s*€\s*/\s*\w+", told, 0),
    }


# What says that a price is one for a unit, what says that an offer is an advertisement, and words of ratings.
BASE_PRICE = re.compile(r"kg|l =|grundpreis|/100|1 kg|1 l", re.I)
PROMOTED = re.compile("promoted|Được tài trợ|Sponsored|Gesponsert", re.I)
RATED = ("sao", "star", "Stern")


def _rewe(card: Card, base: str) -> dict | None:
    classed = lambda *parts: (i for i in card.nodes() if any(p in card.page.attrs[i].get("class", "") for p in parts))
    link = next((h for i in card.nodes("a") if (h := card.page.attrs[i].get("href", "")).startswith("/shop/p/")), None)
    named = next((i for i in card.nodes() if card.page.tag[i] == "h4" or "product-title" in card.page.attrs[i].get("class", "")), None)
    title, size = tidy(card.page.text(named)), tidy(card.page.text(next(classed("grammage"), None)))
    if not link:
        return None
    price = None
    for i in card.nodes():
        held = card.page.attrs[i]
        if "price" in held.get("class", "") or "Price" in held.get("class", "") or "price" in held.get("data-testid", ""):
            told = tidy(card.page.text(i))
            price = None if BASE_PRICE.search(told) else re.search(r"([0-9]+)[,.]([0-9]{2})\s*€", told) or re.search(r"€\s*([0-9]+)[,.]([0-9]{2})", told)
            if price:
                break
    return {
        "title": f"{title} {size}" if title and size and size not in title else title, "url": absolute(link, base), "image": card.attr("src", "img"),
        "price_text": price and f"{price[1]}.{price[2]} €", "key": link,
    }


def _bing_offer(card: Card, base: str) -> dict | None:
    page = card.page
    named = next((i for i in card.nodes("span") if "title" in page.attrs[i]), None)
    if named is None:
        return None
    # the card is the nearest element around the title that has a picture, not more than eight steps up
    around = page.up[named]
    for _ in range(8):
        if around <= 0 or page.count(around, "img"):
            break
        around = page.up[around]
    whole, above = Card(page, max(around, 0)), named
    while above > 0 and page.tag[above] != "a":
        above = page.up[above]
    href = whole.attr("href", "a", cls="br-titlelink") or page.attrs[above].get("href")
    first = lambda *classes: next((t for c in classes if (t := whole.text(cls=c))), "")
    image = whole.inside(i for i in whole.nodes() if page.tag[i] == "img")
    strike = next((i for i in whole.nodes() if page.tag[i] == "del" or {"br-strkPrice", "pd-strk"} & set(page.attrs[i].get("class", "").split())), None)
    seller = next((i for i in whole.nodes() if {"br-sellerName", "br-sellerNameWithTb", "br-seller"} & set(page.attrs[i].get("class", "").split())), None)
    rating = next((a for i in whole.nodes() if any(w in (a := page.attrs[i].get("aria-label", "")) for w in RATED)), "")
    return {
        "title": (title := tidy(page.attrs[named]["title"])), "key": title, "url": absolute(href, base) if href else None,
        "image": image and (image.attr("src") or image.attr("data-src")), "price_text": first("pd-price", "br-price"), "original_text": tidy(page.text(strike)),
        "seller": re.sub(r"\s*\+\s*[0-9]+.*$", "", tidy(page.text(seller))), "rating_text": found(r"([0-9]+(?:[.,][0-9])?)", rating),
        "sponsored": bool(PROMOTED.search(whole.all_text())),
    }


def _has_class(name: str) -> Callable[[str, dict[str, str]], bool]:
    return lambda tag, attrs: name in attrs.get("class", "").split()


SHOPS = {
    s.id: s
    for s in (
        Shop("amazon", AMAZON, lambda tag, a: a.get("data-component-type") == "s-search-result", _amazon, seller="Amazon"),
        Shop("aldiuk", {"gb": ("https://www.aldi.co.uk", "GBP")}, _has_class("product-tile"), _aldi, seller="Aldi UK"),
        Shop("kroger", {"us": ("https://www.kroger.com", "USD")}, _has_class("ProductCard"), _kroger, seller="Kroger"),
        Shop("rakuten", {"jp": ("https://search.rakuten.co.jp", "JPY")}, lambda tag, a: "searchresultitem" in a.get("class", "").split() and a.get("data-card-type") == "item", _rakuten),
        Shop("shopee", {"vn": ("https://shopee.vn", "VND")}, lambda tag, a: tag == "a" and re.search(r"-i\.[0-9]+\.[0-9]+", a.get("href", "")) is not None, _shopee, "key", "Shopee"),
        Shop("auchan", {"fr": ("https://www.auchan.fr", "EUR")}, lambda tag, a: tag == "article" and "schema.org/Product" in a.get("itemtype", ""), _auchan, seller="Auchan"),
        Shop("chronodrive", {"fr": ("https://www.chronodrive.com", "EUR")}, lambda tag, a: tag == "article" and "product-card" in a.get("class", "").split(), _chronodrive, seller="Chronodrive"),
        Shop("leclerc", {"fr": ("https://www.e.leclerc", "EUR")}, lambda tag, a: tag == "article" and "data-product-card" in a, _leclerc, seller="E.Leclerc"),
        Shop("bestsellers", {m: v for m, v in AMAZON.items() if m != "sg"}, lambda tag, a: a.get("id") == "gridItemRoot", _best_seller, seller="Amazon"),
        Shop("rewe", {"de": ("https://shop.rewe.de", "EUR")}, lambda tag, a: "product-tile" in a.get("class", ""), _rewe, "key", "REWE"),
        Shop("bingshop", {m: ("https://www.bing.com", c) for m, c in BING_SHOP.items()}, _has_class("br-title"), _bing_offer, "key"),
        Shop("bing", {}, lambda tag, a: tag == "li" and "b_algo" in a.get("class", "").split(), _bing, kind="web"),
        Shop("ddg", {}, lambda tag, a: tag == "a" and "result-link" in a.get("class", "").split(), _ddg, kind="web"),
        State("tesco", {"gb": ("https://www.tesco.com", "GBP")}, _listed(
            lambda o, base: f"{base}/groceries/en-GB/products/{o.get('id') or o['tpnc']}" if o.get("id") or o.get("tpnc") else None, lambda o: o.get("defaultImageUrl")), "Tesco"),
        State("waitrose", {"gb": ("https://www.waitrose.com", "GBP")}, _listed(
            lambda o, base: f"{base}/ecom/products/{_dashed(o.get('name'))}/{o['id']}" if o.get("id") else None, lambda o: o.get("thumbnail")), "Waitrose"),
        State("morrisons", {"gb": ("https://groceries.morrisons.com", "GBP")}, _listed(
            lambda o, base: f"{base}/products/{_dashed(o.get('name'))}/{o['retailerProductId']}" if o.get("retailerProductId") else None,
            lambda o: o["image"].get("src") if isinstance(o.get("image"), dict) else None), "Morrisons"),
        State("carrefour", {"fr": ("https://www.carrefour.fr", "EUR")}, _carrefour, "Carrefour"),
    )
}


def card_rows(source: str, market: str | None, html: str | None) -> Iterator[dict]:
    """Rows of one result page, in order of its cards."""
    shop = SHOPS[source]
    base, currency = shop.markets.get(market or "", next(iter(shop.markets.values()), ("", None)))
    page = Page(html)
    cards = shop.rows(page, html or "", base) if isinstance(shop, State) else (
        shop.read(Card(page, node), base) for node in page.under() if shop.cards(page.tag[node], page.attrs[node])
    )
    seen: set = set()
    pos = 0
    for row in cards:
        if not row or not row["title"] or not row["url"]:
            continue
        if isinstance(shop, Shop) and shop.unique:
            key = row.pop(shop.unique)
            if key in seen:
                continue
            seen.add(key)
        yield {"source": source, "market": market, "pos": pos, "currency": currency, "seller": shop.seller or None, **{k: v for k, v in row.items() if v}}
        pos += 1


def read(captures: DataFrame) -> DataFrame:
    """Listing rows of captures(source, market, payload) of the sources known here, without a shuffle; ``rank`` of best sellers.

    A search engine's wrapped addresses are unwrapped, results without one and advertisements are dropped.
    """
    known = captures.where(F.col("source").isin(*SHOPS)).select("source", "market", "payload")
    rows = flat_rows(known, lambda c: card_rows(c["source"], c["market"], c["payload"]), _RAW)
    number = lambda c: F.replace(F.col(c), F.lit(","), F.lit(".")).try_cast("double")
    url = F.when(F.col("source") == "bing", U.base64_target(F.col("url"))).when(F.col("source") == "ddg", U.redirect_target(F.col("url"), "uddg")).otherwise(F.col("url"))
    in_price = F.nullif(F.regexp_extract("price_text", CURRENCY_IN_PRICE, 0), F.lit(""))
    rows = rows.withColumns({
        "url": url, "originalPrice": parse_price(F.col("original_text"), F.col("market"), F.col("currency"))["value"], "rating": number("rating_text"),
        "reviews": F.nullif(F.regexp_replace("reviews_text", "[^0-9]", "").try_cast("long"), F.lit(0)), "sold": parse_sold(F.col("sold_text")),
        "sponsored": F.coalesce("sponsored", F.lit(False)), "price_text": F.coalesce("price_text", F.nullif(F.regexp_extract("text", PRICE_IN_TEXT, 0), F.lit(""))),
        # a price may be told in the visitor's currency
        "currency": F.when((F.col("source") == "bestsellers") & in_price.isNotNull(), parse_price(F.col("price_text"), F.col("market"))["currency"]).otherwise(F.col("currency")),
        "rank": F.nullif(F.regexp_replace("rank_text", "[^0-9]", "").try_cast("int"), F.lit(0)),
    }).where(F.col("url").rlike("^https?:") & ~((F.col("source") == "ddg") & U.host(F.col("url")).rlike(r"(^|\.)duckduckgo\.com$")))
    fields = [(F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name) for name, kind in FIELDS.items()]
    web = F.col("source").isin(*(s.id for s in SHOPS.values() if s.kind == "web"))
    out = rows.select("source", F.when(web, "web").otherwise("shop").alias("kind"), "market", "pos", "rank", *fields)
    return out.withColumn("id", item_id(F.col("source"), F.coalesce("url", "title")))
