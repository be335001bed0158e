"""Bin packing, periodic runs and target resampling against brute force, the library's tokenizer and DuckDB."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marketloom.llm import bin_packing, periodic_runs, queries, target_resampling

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, length string, runs string, uid string, feature string, block string"
LONG = " ".join(f"w{i % 7}" for i in range(9_000)) + " " + " ".join(f"x{i}" for i in range(9_000))
ROWS = [
    (0, "a a a a a a a b", "clash"), (1, "", "x"), (2, None, "x"), (3, LONG, "x"), (3, LONG, "y"), (None, "b c b c b c b c d", "x"),
    (5, "Uno uno UNO uno uno uno ÄÖ äö <|endoftext|>", "x"), (6, " \t\n", "x"), (7, "one word   　 two", "x"),
    (8, "same text " * 40, "x"), (9, "same text " * 40, "x"), (11, "tok " * 2047, "x"), (12, "tok " * 2048 + "end", "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, n, n, n, n, n) for i, t, n in ROWS], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def rewritten(doc_id, words):
    h, n = (zlib.crc32(str(doc_id).encode()), len(words)) if doc_id is not None else (1, len(words))
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def all_runs(x, limit=None):
    """Every period by itself: stretches of equal words q apart, less those with a smaller period."""
    out = []
    for q in range(1, min(len(x) // 4, limit or len(x)) + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(6, 4 * q) and not any(x[i + e : i + n] == x[i : i + n - e] for e in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out)


def digest(s):
    return hashlib.sha256(s.encode("utf-8")).hexdigest()


def told(doc_id, text):
    words = rewritten(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    numbers = {}
    x = [numbers.setdefault(w, len(numbers)) for w in words]
    runs = all_runs(x) if len(x) < 3000 else periodic_runs.runs_of(x)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if runs else None
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *best, milli, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(kept))


def test_runs_of_words_against_every_period():
    rng = random.Random(5)
    for _ in range(3000):
        k, x = rng.choice([1, 2, 3, 9]), []
        while len(x) < rng.randint(0, 70):
            x += [rng.randrange(k) for _ in range(rng.randint(1, 8))] * rng.choice([1, 1, 4, 7])
        want = all_runs(x)
        assert periodic_runs.runs_of(x) == want, x
        assert periodic_runs.word_runs([b"%d" % v for v in x]) == want, x


def test_runs_report(spark, docs):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for df in (docs, table):
        got = [tuple(r) for r in periodic_runs.report(spark, df).collect()]
        want = [told(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert periodic_runs.report(spark, empty(spark)).collect() == []


def test_collapsed_texts(spark, docs):
    got = {(r.doc_id, r.collapsed) for r in periodic_runs.find(spark, docs).collect()}
    assert {(0, "a b"), (1, ""), (2, ""), (None, "b c d"), (6, ""), (8, "same text")} <= got
    with pytest.raises(ValueError):
        periodic_runs.find(spark, docs, exponent=2)


def check_packing(rows, texts, tokenizer):
    """Every id once, cuts as told, sequences gapless; returns the number of sequences and of tokens."""
    encoded = collections.Counter()
    for doc_id, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            encoded[doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert encoded == collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins), sum(r.length for r in rows)


def test_packing_whole_tables(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for df in (docs, table):
        texts = [tuple(r) for r in df.select("doc_id", "text").collect()]
        counts = [check_packing(bin_packing.pack(spark, df, block=n).collect(), texts, tokenizer) for n in (bin_packing.BLOCK, 64)]
        lengths = [n % 2048 for n in (len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts) if n % 2048]
        full = sum((len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) // 2048 for _, t in texts)
        least = full + bin_packing.least_bins(np.array(lengths), 2048)
        # blocks of 64 pieces, over several rounds, may cost a sequence
        assert least <= counts[0][0] <= least + 1 and counts[1][0] <= least + 2
    assert bin_packing.pack(spark, empty(spark)).collect() == []


def test_exchanges_empty_bins():
    lengths = np.array([6, 5, 5, 4, 4, 4, 3, 3, 2]) * 100
    assert bin_packing.least_bins(lengths, 1200) == 3
    assert len(bin_packing.pack_block(lengths, 1200)) == 3
    rng = np.random.default_rng(2)
    better = 0
    for _ in range(60):
        lengths = rng.integers(300, 900, 120)
        first = bin_packing.best_fit_decreasing(lengths, 2048)
        bins = bin_packing.pack_block(lengths)
        assert sorted(i for b in bins for i in b) == list(range(120))
        assert all(lengths[b].sum() <= 2048 for b in bins)
        assert bin_packing.least_bins(lengths, 2048) <= len(bins) <= len(first)
        better += len(bins) < len(first)
    assert better >= 10


def test_least_bins_never_exceeds_the_best():
    rng = random.Random(1)

    def fewest(items, size):
        best = len(items)

        def place(k, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(items):
                best = len(bins)
                return
            for i in range(len(bins)):
                if bins[i] + items[k] <= size:
                    place(k + 1, bins[:i] + [bins[i] + items[k]] + bins[i + 1 :])
            place(k + 1, [*bins, items[k]])

        place(0, [])
        return best

    for _ in range(150):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        best = fewest(items, 20)
        assert bin_packing.least_bins(np.array(items), 20) <= best <= len(bin_packing.pack_block(np.array(items), 20))


def brute_draw(rows, target, most_words=1):
    def grams(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return w, [" ".join(w[i : i + n]) for n in range(1, most_words + 1) for i in range(len(w) - n + 1)]

    s, t = collections.Counter(), collections.Counter()
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    for text, c in [(x[1], s) for x in rows] + [(x, t) for x in target]:
        c.update(map(bucket, grams(text)[1]))
    every_s, every_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (every_s + 10_000) / ((s[b] + 1) * (every_t + 10_000)))) for b in s}
    out = []
    for doc_id, text in rows:
        w, f = grams(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"2024:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(f), weight, score, None, len(w) >= 20 and doc_id is not None])
    may = sorted((x for x in out if x[5]), key=lambda x: (-x[3], x[0], x[1]))
    for k, x in enumerate(may[: len(may) * 10 // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


def test_draw_against_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(target_resampling, "HEAD", 50)  # so that most strings meet the rest of the dictionary
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    table = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    df = docs.select("doc_id", "text").union(table)
    rows, target = [tuple(r) for r in df.collect()], [r.text for r in bench.collect()]
    for words in (1, 2):
        got = [tuple(r) for r in target_resampling.draw(spark, df, bench, most_words=words).collect()]
        assert sorted(got, key=str) == brute_draw(rows, target, words)
    got = [tuple(r) for r in target_resampling.draw(spark, docs, empty(spark)).collect()]
    assert sorted(got, key=str) == brute_draw([(r[0], r[1]) for r in ROWS], [])
    assert target_resampling.draw(spark, empty(spark), bench).collect() == []


def test_draw_equals_its_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    want = sorted(con.sql(queries.ORACLE["op13_target_resampling"]).fetchall(), key=str)
    assert want == sorted((tuple(r) for r in queries.op13_target_resampling(spark, FOLDER).collect()), key=str)
