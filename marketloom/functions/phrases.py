"""Phrase matching that consumes text, and relevance of a title to queries, as Arrow UDFs.

Independent patterns would be wrong here: a longer phrase takes its text away from shorter ones ("rice
cake" leaves no "rice").  A lexicon is a list of (label, phrase); it is a parameter, compiled once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words a query may lose.
STOP = frozenset(
    ["cho", "be", "va", "cua", "the", "a", "an", "of", "for", "and", "with", "loai", "nao", "tot", "gia", "re", "mua", "o", "dau"]
)
# Words that mark a product as one for small children, folded.
BABY = re.compile(
    "an dam|tre em|cho be|em be|so sinh|nhu nhi|baby|infant|toddler|kids?|months?|thang|weaning|stage|bebe|kinder|enfant|bayi"
)
# The same in scripts that folding would take apart; tested on the text as it is.
BABY_UNSPACED = re.compile("離乳食|ベビー|赤ちゃん|이유식|아기|婴儿|宝宝|辅食|เด็ก|ทารก")
# Words of product forms in several languages.
FORM_WORDS = {
    "stick": ["thanh", "que", "stick", "string", "string cheese", "cheestrings", "bar", "riegel", "barre", "barrita", "barretta", "barrette", "bâtonnet", "batonnet", "palito", "スティック", "バー", "스틱", "棒", "แท่ง"],
    "biscuit": ["bánh quy", "biscuit", "biscotti", "biscotto", "cookie", "cookies", "cracker", "keks", "kekse", "galleta", "sablé", "ビスケット", "クッキー", "クラッカー", "쿠키", "비스킷", "크래커", "饼干", "บิสกิต", "คุกกี้"],
    "wafer": ["bánh xốp", "bánh quế", "wafer", "waffel", "gaufrette", "ウエハース", "웨이퍼"],
    "burger": ["burger", "hamburger", "cheeseburger", "bánh mì kẹp", "バーガー", "버거"],
    "pizza": ["pizza", "ピザ", "피자"],
    "bread": ["bánh mì", "bread", "brot", "brötchen", "toast", "sandwich", "パン", "빵", "面包"],
    "cake": ["bánh bông lan", "bánh kem", "cake", "cupcake", "muffin", "kuchen", "gâteau", "gateau", "ケーキ", "케이크", "蛋糕"],
    "candy": ["kẹo", "candy", "candies", "gummy", "gummies", "bonbon", "lollipop", "グミ", "キャンディ", "사탕", "糖果"],
    "jelly": ["thạch", "jelly", "gelee", "gelée", "ゼリー", "젤리", "果冻"],
    "ricecake": ["bánh gạo", "rice cake", "rice cracker", "rice biscuit", "rice rusk", "せんべい", "쌀과자", "米饼"],
    "puffs": ["bỏng", "puff", "puffs", "melts", "ボーロ"],
    "chips": ["bim bim", "snack khoai", "chips", "crisps", "ポテトチップス", "칩"],
    "yogurt": ["sữa chua", "yogurt", "yoghurt", "joghurt", "yaourt", "ヨーグルト", "요거트", "요구르트", "酸奶"],
    "icecream": ["kem", "ice cream", "gelato", "アイス", "아이스크림", "冰淇淋"],
    "sauce": ["sốt", "xốt", "nước sốt", "nước xốt", "sauce", "soße", "dip", "ソース", "소스"],
    "powder": ["bột", "powder", "pulver", "poudre", "パウダー", "분말", "粉"],
    "spread": ["spread", "aufstrich", "à tartiner", "cream cheese", "phô mai kem", "クリームチーズ"],
    "slice": ["lát", "slice", "scheiben", "tranche", "スライス", "슬라이스"],
    "cube": ["viên", "cube", "würfel", "キューブ", "큐브"],
    "porridge": ["cháo", "porridge", "congee", "おかゆ", "粥", "죽"],
    "soup": ["súp", "soup", "suppe", "soupe", "スープ", "수프"],
    "noodles": ["mì", "mỳ", "nui", "pasta", "noodle", "nudeln", "pâtes", "macaroni", "うどん", "そうめん", "국수", "面条"],
    "puree": ["nghiền", "puree", "purée", "pouch", "quetschie", "compote", "ピューレ", "퓨레"],
    "juice": ["nước ép", "juice", "saft", "jus", "ジュース", "주스", "果汁"],
}
FORMS = tuple((form, phrase) for form, phrases in FORM_WORDS.items() for phrase in phrases)
# Concepts by folded words in several languages.
CONCEPT_WORDS = {
    "rice": ["rice", "gao", "reis", "riz", "arroz", "riso"],
    "oat": ["oat", "oats", "oatmeal", "yen mach", "hafer", "avoine", "avena"],
    "wheat": ["wheat", "lua mi", "weizen", "ble"],
    "corn": ["corn", "maize", "bap", "ngo", "mais"],
    "quinoa": ["quinoa", "diem mach"],
    "multigrain": ["multigrain", "mixed grain", "ngu coc tong hop", "mehrkorn", "multicereales"],
    "cereal": ["cereal", "cereals", "bot", "ngu coc", "brei", "cereales", "bouillie"],
    "porridge": ["porridge", "congee", "chao"],
    "puree": ["puree", "pouch", "nghien", "xay nhuyen", "mus", "compote"],
    "puffs": ["puffs", "puff", "banh phong", "banh xop", "melts"],
    "biscuit": ["biscuit", "biscuits", "cookie", "cookies", "banh quy", "keks", "galletas"],
    "rusk": ["rusk", "rusks", "teether", "teething", "banh gam", "zwieback"],
    "ricecake": ["rice cake", "rice cakes", "banh gao", "rice rusks"],
    "pasta": ["pasta", "noodle", "noodles", "nui", "mi", "nudeln"],
    "yogurt": ["yogurt", "yoghurt", "sua chua", "joghurt", "yaourt"],
    "apple": ["apple", "apples", "tao", "apfel", "pomme", "manzana", "mela"],
    "banana": ["banana", "bananas", "chuoi", "banane", "platano"],
    "pear": ["pear", "pears", "le", "birne", "poire", "pera"],
    "mango": ["mango", "mangoes", "xoai", "mangue"],
    "strawberry": ["strawberry", "strawberries", "dau tay", "erdbeere", "fraise", "fresa"],
    "blueberry": ["blueberry", "blueberries", "viet quat", "heidelbeere", "myrtille"],
    "raspberry": ["raspberry", "raspberries", "mam xoi", "himbeere", "framboise"],
    "peach": ["peach", "peaches", "dao", "pfirsich", "peche"],
    "apricot": ["apricot", "mo tay", "aprikose", "abricot"],
    "prune": ["prune", "plum", "man tay", "pflaume", "pruneau"],
    "orange": ["orange", "cam"],
    "pineapple": ["pineapple", "thom", "dua thom", "ananas"],
    "coconut": ["coconut", "nuoc dua", "cot dua"],
    "grape": ["grape", "traube"],
    "berry": ["berry", "berries", "qua mong"],
    "carrot": ["carrot", "carrots", "ca rot", "karotte", "carotte", "zanahoria"],
    "pumpkin": ["pumpkin", "squash", "butternut", "bi do", "kurbis", "potiron", "calabaza"],
    "sweetpotato": ["sweet potato", "sweet potatoes", "khoai lang", "susskartoffel", "patate douce"],
    "potato": ["potato", "potatoes", "khoai tay", "kartoffel"],
    "spinach": ["spinach", "rau bina", "cai bo xoi", "spinat", "epinard"],
    "broccoli": ["broccoli", "bong cai xanh", "sup lo xanh", "brokkoli", "brocoli"],
    "pea": ["pea", "peas", "dau ha lan", "erbse"],
    "beetroot": ["beetroot", "beet", "cu den", "rote bete"],
    "kale": ["kale", "cai xoan"],
    "tomato": ["tomato", "tomatoes", "ca chua", "tomate"],
    "vegetable": ["vegetable", "vegetables", "veggie", "veggies", "rau cu", "rau", "gemuse", "legumes", "verduras"],
    "fruit": ["fruit", "fruits", "trai cay", "hoa qua", "obst", "frucht"],
    "chicken": ["chicken", "ga", "huhn", "poulet", "pollo"],
    "beef": ["beef", "bo", "rind", "boeuf", "ternera"],
    "pork": ["pork", "heo", "lon", "schwein"],
    "salmon": ["salmon", "ca hoi", "lachs", "saumon"],
    "fish": ["fish", "ca", "fisch", "poisson"],
    "milk": ["milk", "sua", "milch", "lait", "leche"],
    "cheese": ["cheese", "pho mai", "kase", "fromage"],
    "vanilla": ["vanilla", "vani", "vanille"],
    "cocoa": ["cocoa", "chocolate", "socola", "ca cao", "kakao"],
    "cinnamon": ["cinnamon", "zimt", "cannelle"],
    "seaweed": ["seaweed", "rong bien"],
    "egg": ["egg", "trung ga", "oeuf"],
}
CONCEPTS = tuple((concept, phrase) for concept, phrases in CONCEPT_WORDS.items() for phrase in phrases)
# Fixed values: "dau" alone may be an oil or a bean; beside these words it is a strawberry.
STRAWBERRY = re.compile(r" (?:vi|huong) dau | dau (?:tao|chuoi|le|xoai|viet quat|cam) | (?:tao|chuoi|le|xoai|cam) dau ")
#: Concepts that name a format rather than a flavour; they weigh half.
FORMATS = frozenset(
    ["cereal", "porridge", "puree", "puffs", "biscuit", "rusk", "ricecake", "pasta", "yogurt", "fruit", "vegetable", "milk"]
)

_UNSPACED = re.compile(r"[฀-๿぀-ヿ㐀-䶿一-鿿]")
#: Scripts in which a form's word stands inside others.
_GLUED = re.compile(r"[฀-๿぀-ヿ㐀-䶿一-鿿가-힯]")
_MARKS = re.compile("[̀-ͯ]")
_WORDS = re.compile(r"[^\W_]+(?:[̀-ͯ]+[^\W_]*)*")


def folded(text: str | None) -> str:
    """Lower case without accents, for all scripts."""
    return _MARKS.sub("", unicodedata.normalize("NFD", (text or "").lower())).replace("đ", "d")


class Phrases:
    """Finds a lexicon's phrases, the longest first; text is found once."""

    def __init__(self, lexicon: Iterable[tuple[str, str]], plural: bool = False):
        ordered = sorted(lexicon, key=lambda e: -len(e[1]))
        self._patterns = []
        for label, phrase in ordered:
            body = re.escape(phrase).replace(r"\ ", r"\s+")
            spaced = not (_GLUED if plural else _UNSPACED).search(phrase)
            ending = "(?:e?s)?" if plural and spaced else ""
            self._patterns.append((label, re.compile(rf"(?<![^\W_]){body}{ending}(?![^\W_])" if spaced else body)))

    def find(self, text: str) -> list[tuple[int, str]]:
        """(position, label) of each label's earliest place, in order of position."""
        taken: list[tuple[int, int]] = []
        first: dict[str, int] = {}
        for label, pattern in self._patterns:
            for m in pattern.finditer(text):
                a, b = m.span()
                if all(b <= x or a >= y for x, y in taken):
                    taken.append((a, b))
                    first[label] = min(first.get(label, a), a)
        return sorted((at, label) for label, at in first.items())


    def cut(self, text: str, mark: str) -> str:
        """Text with a mark in the place of each phrase, the longest first."""
        for _, pattern in self._patterns:
            text = pattern.sub(mark, text)
        return text


_COUNTED = re.compile(r"[0-9]+\s*(?:x\s*)?(?:thanh|que|viên|lát|miếng)(?![^\W_])")


def forms(text: Column, lexicon: Sequence[tuple[str, str]] = FORMS) -> Column:
    """Product forms a title names, the earliest first; counted units are no forms."""
    matcher = Phrases(lexicon, plural=True)

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            low = unicodedata.normalize("NFC", t or "").lower()
            return [label for _, label in matcher.find(_COUNTED.sub(lambda m: " " * len(m[0]), low))]

        return s.map(one)

    return run(text)


def form_match(title: Column, title_forms: Column, wanted: Column) -> Column:
    """match, other or null: a Vietnamese title's first form decides, elsewhere any form does."""
    vietnamese = title.rlike("(?iu)[ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]")
    hit = F.when(vietnamese, F.array_contains(wanted, F.get(title_forms, F.lit(0)))).otherwise(F.arrays_overlap(title_forms, wanted))
    return F.when((F.size(wanted) > 0) & (F.size(title_forms) > 0), F.when(hit, "match").otherwise("other"))


def concepts(text: Column, lexicon: Sequence[tuple[str, str]] = CONCEPTS) -> Column:
    """Sorted concepts of a title, over folded words."""
    matcher = Phrases(lexicon)

    def one(t: str | None) -> list[str]:
        words = re.sub("[^a-z0-9]+", " ", folded(t))
        named = {"strawberry"} if STRAWBERRY.search(f" {words} ") else set()
        return sorted(named | {label for _, label in matcher.find(words)})

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run(text)


def concept_score(wanted: Column, found: Column) -> Column:
    """Weighted share of wanted concepts found, less 0.15 for each flavour too many; null if none is wanted."""

    def weight(c: Column) -> Column:
        return F.when(c.isin(*FORMATS), 0.5).otherwise(1.0)

    def total(a: Column) -> Column:
        return F.aggregate(F.transform(a, weight), F.lit(0.0), lambda x, y: x + y)

    extra = F.size(F.filter(F.array_except(found, wanted), lambda c: ~c.isin(*FORMATS)))
    score = total(F.array_intersect(wanted, found)) / total(wanted) - 0.15 * extra
    return F.when(F.size(wanted) > 0, F.greatest(F.lit(0.0), score))


def tokens(text: str | None) -> list[str]:
    """Folded words without stop words; character pairs in scripts without spaces."""
    out = []
    for w in _WORDS.findall((text or "").lower()):
        if _UNSPACED.search(w):
            out += [w] if len(w) < 3 else [w[i : i + 2] for i in range(len(w) - 1)]
        elif (f := folded(w)) not in STOP:
            out.append(f)
    return out


def _stands(token: str, hay: str, words: set[str]) -> bool:
    if _UNSPACED.search(token):
        return token in hay
    if token in words:
        return True
    return len(token) >= 4 and any(len(w) >= 4 and (w.startswith(token) or token.startswith(w)) for w in words)


VIETNAMESE = re.compile("[ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]", re.I)
_GAP = " | "


def token_list(text: Column) -> Column:
    """``tokens`` of each text."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(tokens)

    return run(text)


def without_forms(query: str | None, lexicon: Sequence[tuple[str, str]] = FORMS) -> str:
    """A query in small letters with a gap where it names a product form."""
    return _forms(tuple(lexicon)).cut(unicodedata.normalize("NFC", query or "").lower(), _GAP)


@lru_cache
def _forms(lexicon: tuple[tuple[str, str], ...]) -> Phrases:
    return Phrases(lexicon, plural=True)


def syllable_pairs(core: str) -> list[tuple[str, str]]:
    """Neighbouring folded syllables; no pair reaches over a gap, a stop word or a word of a script without spaces."""
    out = []
    for part in core.split("|"):
        before = None
        for word in _WORDS.findall(part):
            plain = folded(word)
            if plain in STOP or _UNSPACED.search(plain):
                before = None
                continue
            if before:
                out.append((before, plain))
            before = plain
    return out


class _Wanted:
    """One query, taken apart: its tokens without forms, its whole text, and a pattern for each pair of syllables."""

    def __init__(self, query: str, lexicon: Sequence[tuple[str, str]]):
        core = without_forms(query, lexicon)
        self.pairs = syllable_pairs(core) if VIETNAMESE.search(query or "") else []
        self.patterns = [re.compile(rf"(?<![^\W_]){re.escape(a)}[\s-]*{re.escape(b)}(?![^\W_])") for a, b in self.pairs]
        self.tokens = tokens(core.replace("|", " ")) or tokens(query)  # a query that only names a form keeps its words
        self.phrase = folded(query).strip()

    def score(self, ft: str, fx: str, wt: set[str], wx: set[str], vietnamese: bool) -> tuple[float, bool]:
        """The score, and whether the syllables stand in the texts apart from each other only."""
        for words in (wt, wx):  # two syllables written as one word count for both
            for a, b in self.pairs:
                if a + b in words:
                    words |= {a, b}
        in_title = sum(_stands(n, ft, wt) for n in self.tokens)
        in_text = sum(not _stands(n, ft, wt) and _stands(n, fx, wx) for n in self.tokens)
        together, apart = 1.0, False
        if self.pairs:
            met = sum(1.0 if p.search(ft) else 0.5 if p.search(fx) else 0.0 for p in self.patterns)
            together = 0.4 + 0.6 * met / len(self.pairs)
            apart = not met and (in_title > 0 or vietnamese)
        return (in_title + 0.4 * in_text) / len(self.tokens) * together + (0.25 if self.phrase in ft else 0.0), apart


def relevance_detail(title: Column, text: Column, queries: Sequence[str], lexicon: Sequence[tuple[str, str]] = FORMS) -> Column:
    """struct(score, split): the best over queries of token hits (those in the title whole, in the text 0.4) and a phrase bonus
    of 0.25, 0.15 more for child words, at most 1.4.

    Form words of a query count by ``form_match`` alone.  Neighbouring syllables of a Vietnamese query have to stand
    together: the share of pairs that do scales the hits from 0.4 to 1.  ``split`` tells that in the best query's case
    none does; of equal scores one that is not split speaks.
    """
    wanted = [w for w in (_Wanted(q, lexicon) for q in queries) if w.tokens]

    def one(t: str | None, x: str | None) -> tuple[float, bool]:
        ft, fx = folded(t) + "\n" + (t or "").lower(), folded(x) + "\n" + (x or "").lower()
        wt, wx = set(_WORDS.findall(ft)), set(_WORDS.findall(fx))
        vietnamese = bool(VIETNAMESE.search(t or ""))
        best, split = 0.0, False
        for w in wanted:
            score, apart = w.score(ft, fx, wt, wx, vietnamese)
            if score > best or score == best and not split:
                split = apart
            best = max(best, score)
        young = BABY.search(ft + " " + fx) or BABY_UNSPACED.search(f"{t or ''} {x or ''}")
        return float(int(min(best + (0.15 if young else 0.0), 1.4) * 100 + 0.5) / 100), split

    @F.pandas_udf("score double, split boolean")
    def run(t: pd.Series, x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(a, b) for a, b in zip(t, x, strict=True)], columns=["score", "split"])

    return run(title, text)


def relevance(title: Column, text: Column, queries: Sequence[str]) -> Column:
    """The score of ``relevance_detail``."""
    return relevance_detail(title, text, queries)["score"]
