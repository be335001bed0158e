"""Operator 2: personal data by weak supervision over exact base patterns.

Base spans (email, ip, card, phone) come from fixed patterns and checks and are always kept.  Beyond
them, broader patterns propose candidates: spelled-out addresses, keys and tokens, password
assignments, numbers grouped like identity numbers or account codes.  Labelers vote on each:
strict forms, gazetteers of known prefixes and domains, words of the context before it.  The counts
of vote patterns over all documents (a small table, whatever the corpus size) feed an expectation-
maximisation of each labeler's reliability; its posteriors train a logistic span classifier over
the candidate's own features, again on grouped counts.  The classifier decides which candidates
become spans.

Spans are in code points, end exclusive.  Nulls: a null text is empty and has no span; a null doc_id
stays null; repeated rows are judged each on their own.  Long texts cost their length times the logarithm
of their spans.  Of candidates that overlap, the one of the earlier rule is taken.  An empty table gives no rows, and a corpus
without candidates leaves the classifier closed.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_arrow

# The kinds, in order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Candidate patterns beyond the base.
EXTRA = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)+")),
    ("secret", re.compile(r"\b(?:AKIA|ASIA|ghp_|sk-|xox[bp]-)[A-Za-z0-9_-]{12,}+")),
    # a quoted value ends at its quote, any other at white space or a quote
    # the keyword may end a longer name, as in access_token
    ("secret", re.compile(r"""(?<![A-Za-z])(?:password|passwd|secret|token|api_key)["']?\s*+[=:]\s*+(?:"[^"\r\n]{6,}+"|'[^'\r\n]{6,}+'|["']?[^\s"']{6,}+)""", re.I)),
    ("secret", re.compile(r"\bBearer\s++[A-Za-z0-9._~+/=-]{16,}+", re.I)),
    ("secret", re.compile(r"\b[0-9A-Fa-f]{32,}+\b")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    # 15 to 34 signs in groups of four, the last of one to four
    ("iban", re.compile(r"\b[A-Z]{2}[0-9]{2}(?:(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|(?: ?[A-Z0-9]{4}){2} ?[A-Z0-9]{3})\b")),
)
# Gazetteers.
PREFIXES = ("akia", "asia", "ghp_", "sk-", "xox", "password", "passwd", "secret", "token", "api_key", "bearer")
MAIL_WORDS = ("mail", "example", "inbox", "post", "com", "net", "org")
COUNTRIES = ("DE", "FR", "ES", "GB", "IT", "NL", "BE", "AT", "CH", "PL")
CONTEXT = (
    "key", "token", "secret", "password", "credential", "login", "email", "mail", "contact", "write",
    "ssn", "social", "iban", "account", "bank", "aws",
)
AGAINST = ("sha", "hash", "md5", "commit", "digest", "checksum", "isbn", "version")
#: Code points of context before a candidate.
WINDOW = 40
LABELERS = ("form", "gazetteer", "context")


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) in order of start, then kind."""
    spans = [(a, 0, b) for a, b in emails(text)]
    if not text.isascii() or any(map(text.__contains__, "0123456789")):
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    spans.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = _digits(m[0])
                if 12 <= len(d) <= 19 and luhn(d):
                    spans.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    spans.append((m.start(), 3, m.end()))
    spans.sort()
    return spans


def votes_and_features(text: str, kind: str, rule: int, start: int, end: int) -> tuple[tuple, tuple]:
    """Votes (1, -1 or 0 for none) of the labelers, and small discrete features of a candidate."""
    s = text[start:end]
    low = s.lower()
    before = text[max(0, start - WINDOW) : start].lower()
    digits, letters = sum(c.isdigit() for c in s), sum(c.isalpha() for c in s)
    distinct = len(set(low))
    if kind == "secret":
        form = 1 if digits >= 2 and letters >= 2 and distinct >= 8 else -1
    elif kind == "ssn":
        form = 1 if s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000" else -1
    elif kind == "iban":
        form = 1 if _iban(s) else -1
    else:
        form = 1 if "at" in low else 0
    if kind == "iban":
        gazetteer = 1 if s[:2] in COUNTRIES else -1
    elif kind == "email":
        gazetteer = 1 if any(w in low for w in MAIL_WORDS) else -1
    else:
        gazetteer = 1 if low.startswith(PREFIXES) else 0
    words = re.findall(r"[a-z_0-9]+", before)[-5:]
    near = any(w.startswith(CONTEXT) for w in words)
    against = any(w.startswith(AGAINST) for w in words)
    context = -1 if against else 1 if near else 0
    features = (rule, min(len(s) // 8, 7), min(4 * digits // max(len(s), 1), 3), min(distinct // 4, 5))
    return (form, gazetteer, context), features


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    turned = s[4:] + s[:4]
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _iban_end(s: str) -> int:
    """Length of the longest valid account code that ends before a space of s or with s; else all of s."""
    end = len(s)
    while end > 0:
        if _iban(s[:end]):
            return end
        end = s.rfind(" ", 0, end)
    return len(s)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, rule) of candidates that overlap neither a base span nor an earlier candidate."""
    low = text.lower()
    taken = _Taken((a, b) for a, _, b in base)
    out = []
    for rule, (_, pattern) in enumerate(EXTRA):
        if rule == 0 and "at]" not in low and "at)" not in low:
            continue
        if rule == 1 and not any(p in text for p in ("AKIA", "ASIA", "ghp_", "sk-", "xox")):
            continue
        if rule == 2 and "=" not in text and ":" not in text:
            continue
        if rule == 3 and "bearer" not in low:
            continue
        if rule > 3 and not any(map(text.__contains__, "0123456789")):
            continue
        fresh = []  # matches of one pattern do not overlap each other
        for m in pattern.finditer(text):
            a, b = m.span()
            if EXTRA[rule][0] == "iban":  # capital words may follow a code
                b = a + _iban_end(m[0])
            if taken.free(a, b):
                out.append((a, b, rule))
                fresh.append((a, b))
        taken.add(fresh)
    return sorted(out)


class _Taken:
    """Spans that are taken, as disjoint runs in order, so that a test is one bisection."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        self.add(spans)

    def add(self, spans) -> None:
        runs: list[list[int]] = []
        for a, b in sorted([*zip(self.starts, self.ends, strict=True), *spans]):
            if runs and a < runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        self.starts, self.ends = [a for a, _ in runs], [b for _, b in runs]

    def free(self, a: int, b: int) -> bool:
        at = bisect.bisect_left(self.starts, b)  # runs from here on start at b or later
        return at == 0 or self.ends[at - 1] <= a


class Model:
    """Reliabilities by labeler, and the span classifier's weight by (feature, value)."""

    def __init__(self, reliability: dict, weights: dict, bias: float):
        self.reliability, self.weights, self.bias = reliability, weights, bias

    def probability(self, features: tuple) -> float:
        z = self.bias + sum(self.weights.get((i, v), 0.0) for i, v in enumerate(features))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def expectation_maximisation(patterns: list[tuple], counts: np.ndarray, rounds: int = 100):
    """Posterior of each vote pattern under independent labelers with abstention (Dawid-Skene)."""
    votes = np.array(patterns)
    n, k = votes.shape
    right, prior = np.full(k, 0.8), 0.5
    posterior = np.full(n, 0.5)
    for _ in range(rounds):
        log = np.zeros((n, 2))
        for j in range(k):
            agree = np.log(right[j]) - np.log(1 - right[j])
            log[:, 1] += np.where(votes[:, j] == 1, agree, np.where(votes[:, j] == -1, -agree, 0.0))
        odds = log[:, 1] + np.log(prior / (1 - prior))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        for j in range(k):
            cast = votes[:, j] != 0
            weight = counts[cast]
            hit = np.where(votes[cast, j] == 1, new[cast], 1 - new[cast])
            right[j] = np.clip(((weight * hit).sum() + 8) / (weight.sum() + 10), 0.55, 0.99)
        prior = float(np.clip(((counts * new).sum() + 1) / (counts.sum() + 2), 0.05, 0.95))
        if np.abs(new - posterior).max() < 1e-9:
            break
        posterior = new
    return posterior, right


def fit(rows: list[tuple[tuple, tuple, int]]) -> Model:
    """From (votes, features, count) rows, one for each combination that occurs."""
    if not rows:
        return Model({}, {}, -30.0)
    patterns = sorted({v for v, _, _ in rows})
    at = {v: i for i, v in enumerate(patterns)}
    counts = np.zeros(len(patterns))
    for v, _, c in rows:
        counts[at[v]] += c
    posterior, right = expectation_maximisation(patterns, counts)
    names = sorted({(i, x) for _, f, _ in rows for i, x in enumerate(f)})
    column = {name: i for i, name in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for r, (_, f, _) in enumerate(rows):
        for pair in enumerate(f):
            x[r, column[pair]] = 1
    y = np.array([posterior[at[v]] for v, _, _ in rows])
    weight = np.array([float(c) for _, _, c in rows])
    weight *= len(rows) / weight.sum()
    x = np.hstack([x, np.ones((len(rows), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(60):  # Newton steps of ridge logistic regression on soft targets
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + 0.05 * w
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.05 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return Model(
        dict(zip(LABELERS, right.tolist(), strict=True)), {n: float(w[i]) for n, i in column.items()}, float(w[-1])
    )


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def _scan(columns: dict) -> dict:
    out = {k: [] for k in ("base", "found", "votes", "features")}
    for text in columns["text"].to_pylist():
        text = text or ""
        base = base_spans(text)
        found = candidates(text, base)
        judged = [votes_and_features(text, EXTRA[r][0], r, a, b) for a, b, r in found]
        out["base"].append([x for span in base for x in span])
        out["found"].append([x for span in found for x in span])
        out["votes"].append([list(v) for v, _ in judged])
        out["features"].append([list(f) for _, f in judged])
    return out | {"doc_id": columns["doc_id"]}


_SCANNED = (
    "doc_id long, base array<int>, found array<int>, votes array<array<int>>, features array<array<int>>"
)


def _train(scanned: DataFrame) -> Model:
    combos = (
        scanned.where(F.size("votes") > 0)
        .select(F.explode(F.arrays_zip("votes", "features")).alias("c"))
        .groupBy("c.votes", "c.features")
        .count()
    )
    # votes and features are small discrete values: the table's size does not follow the corpus
    return fit(sorted((tuple(r[0]), tuple(r[1]), r[2]) for r in combos.collect()))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _triples(flat) -> list[tuple]:
    return list(zip(flat[0::3], flat[1::3], flat[2::3], strict=True))


def find(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    scratch = Scratch(spark, "pii")
    scanned = scratch.write("scanned", map_arrow(_plain(docs), _scan, _SCANNED))
    model = spark.sparkContext.broadcast(_train(scanned))

    def rows(columns: dict) -> dict:
        names = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")
        out = {k: [] for k in names}
        for base, found, features in zip(
            *(columns[c].to_pylist() for c in ("base", "found", "features")), strict=True
        ):
            spans = [(a, KINDS[k], b) for a, k, b in _triples(base)]
            out["base_sha256"].append(hashlib.sha256(_joined(spans).encode()).hexdigest())
            for kind in KINDS:
                out[f"n_{kind}"].append(sum(k == kind for _, k, _ in spans))
            added = [
                (a, EXTRA[r][0], b)
                for (a, b, r), f in zip(_triples(found), features, strict=True)
                if model.value.probability(tuple(f)) >= 0.5
            ]
            rank = {k: i for i, k in enumerate(KINDS)}
            out["spans"].append(_joined(sorted(spans + added, key=lambda s: (s[0], rank.get(s[1], 9), s[1]))))
            out["n_added"].append(len(added))
        return out | {"doc_id": columns["doc_id"]}

    return map_arrow(
        scanned.select("doc_id", "base", "found", "features"),
        rows,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long",
    )


def masked(text: str, model: Model) -> str:
    base = base_spans(text)
    spans = [(a, b, KINDS[k]) for a, k, b in base]
    for a, b, r in candidates(text, base):
        kind = EXTRA[r][0]
        if model.probability(votes_and_features(text, kind, r, a, b)[1]) >= 0.5:
            spans.append((a, b, kind))
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join(out) + text[at:]


def mask(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind; n_chars, where it exists, follows the text."""
    scanned = map_arrow(_plain(docs), _scan, _SCANNED)
    model = spark.sparkContext.broadcast(_train(scanned))

    @F.pandas_udf("string")
    def hide(texts):
        return texts.map(lambda t: None if t is None else masked(t, model.value))

    names = docs.columns
    out = docs.withColumn("text", hide(F.col("text").cast("string")))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*names)
