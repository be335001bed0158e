"""Operator 12: periodic runs of words, found by a suffix automaton, and texts without their repetitions.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends; those of at
least ``max(least_length, exponent * q)`` words are told.  A document's words outside the first q of each run that
holds them are what ``collapsed`` leaves out.

Method.  The suffix automaton of a word sequence has one state for all substrings with the same end positions.
The end positions of a state are those of the states that link to it, so they are merged along the links from long
states to short ones, the smaller ordered set into the larger.  When a merge makes two end positions neighbours at
a distance d that does not exceed the state's length, the state's longest string occurs twice at that distance: a
square of period d, which is extended both ways to its run.  A run of exponent e gives such a pair at a state of
length (e - 1) q or more, so shorter states need no merging, and pairs too close to their state's length seed no run
that is asked for.

Before that, stretches that can hold no run are left out, exactly: in a run of length L each word from the
(q + 4)-th on ends a four-word sequence that occurred at most q words before.  Where such positions follow each
other m times, q is at most ``(m + 3) / (exponent - 1)``, so farther recurrences break a stretch, until
nothing changes.  Hash collisions may only add work: automata compare words.

Everything is a map over documents; no row meets another.  Memory is that of one document's automaton.

Nulls: a null text has no words and no runs, its collapsed text is empty; a null doc_id is kept as null.  Texts
without words likewise.  Repeated rows give repeated results.  Further columns, whatever their names, are not read
and not returned.  An empty table gives no rows.  Very long texts are taken whole.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow

EXPONENT = 4
LEAST_LENGTH = 6
#: Words of the sequences whose recurrence the exact filter looks for; no run of LEAST_LENGTH words is shorter.
GRAM = 4
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class Automaton:
    """Suffix automaton of a sequence of integers: length and link of each state, and the state of each prefix."""

    def __init__(self, sequence: list[int]):
        size, link, step = [0], [-1], [{}]
        self.prefix: list[int] = []
        last = 0
        for i, c in enumerate(sequence):
            new = len(size)
            size.append(i + 1)
            link.append(0)
            step.append({})
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if size[q] == size[p] + 1:
                    link[new] = q
                else:
                    twin = len(size)
                    size.append(size[p] + 1)
                    link.append(link[q])
                    step.append(step[q].copy())
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            self.prefix.append(new)
            last = new
        self.size, self.link = size, link


def seeds(sequence: list[int], exponent: int = EXPONENT, least_length: int = LEAST_LENGTH):
    """(end, distance) of repeated strings that may belong to a run of at least ``exponent`` periods.

    The string that ends at ``end`` occurs ``distance`` words before too, and is at least exponent - 1 distances long.
    """
    automaton = Automaton(sequence)
    size, link = automaton.size, automaton.link
    ends: list[list[int] | None] = [None] * len(size)
    for i, state in enumerate(automaton.prefix):
        ends[state] = [i]
    # the shortest string of a run that its next occurrence follows: a period of one, or exponent - 1 periods
    shortest = min(max((exponent - 1) * d, least_length - d) for d in range(1, least_length + 1))
    for state in sorted(range(1, len(size)), key=size.__getitem__, reverse=True):
        up = link[state]
        length = size[up]
        if length < shortest:
            ends[state] = None
            continue
        small, large = ends[state], ends[up]
        ends[state] = None
        if large is None:
            ends[up] = small
            continue
        if len(small) > len(large):
            small, large = large, small
        for e in small:
            k = bisect_left(large, e)
            if k:
                d = e - large[k - 1]
                if d <= length and length + d >= exponent * d and length + d >= least_length:
                    yield e, d
            if k < len(large):
                d = large[k] - e
                if d <= length and length + d >= exponent * d and length + d >= least_length:
                    yield large[k], d
            large.insert(k, e)
        ends[up] = large


def _primes(d: int):
    p = 2
    while p * p <= d:
        if d % p == 0:
            yield p
            while d % p == 0:
                d //= p
        p += 1
    if d > 1:
        yield d


def _primitive(sequence: list[int], start: int, d: int) -> bool:
    """Whether the run at start, of at least two periods d, has no smaller period (that would divide d)."""
    for p in _primes(d):
        e = d // p
        if sequence[start : start + d] == sequence[start + e : start + e + d]:
            return False
    return True


def runs_of(sequence: list[int], exponent: int = EXPONENT, least_length: int = LEAST_LENGTH) -> list[tuple[int, int, int]]:
    """Sorted (start, length, period) of the runs of a whole sequence."""
    found: dict[int, list[tuple[int, int]]] = {}
    out = []
    n = len(sequence)
    for end, d in seeds(sequence, exponent, least_length):
        known = found.setdefault(d, [])
        k = bisect_left(known, (end - d + 1,)) - 1
        if k >= 0 and known[k][1] > end:  # runs of one period share fewer than d words: the seed's last d + 1 are this one's
            continue
        start = end - d
        while start >= 0 and sequence[start] == sequence[start + d]:
            start -= 1
        start += 1
        stop = end + 1
        while stop < n and sequence[stop] == sequence[stop - d]:
            stop += 1
        known.insert(bisect_left(known, (start,)), (start, stop))
        if stop - start >= max(least_length, exponent * d) and _primitive(sequence, start, d):
            out.append((start, stop - start, d))
    return sorted(set(out))


def candidates(hashes: np.ndarray, exponent: int = EXPONENT) -> list[tuple[int, int]]:
    """Disjoint stretches [from, to) of a sequence, each with a margin, outside which no run lies."""
    n = len(hashes)
    size = n - GRAM + 1
    if size < 2:
        return []
    with np.errstate(over="ignore"):
        gram = sum(hashes[k : k + size] * _MIX[k] for k in range(GRAM))
    order = np.argsort(gram, kind="stable")
    ordered = gram[order]
    again = np.flatnonzero(ordered[1:] == ordered[:-1])
    if not len(again):
        return []
    far = np.full(size, n, np.int64)
    far[order[again + 1]] = order[again + 1] - order[again]
    alive = far < n
    while True:
        edge = np.diff(np.concatenate(([False], alive, [False])).astype(np.int8))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(first):
            return []
        most = (last - first + GRAM - 1) // (exponent - 1)
        bound = np.zeros(size, np.int64)
        for a, b, q in zip(first.tolist(), last.tolist(), most.tolist(), strict=True):
            if b - a > 1:  # a single position is no run's
                bound[a:b] = q
        kept = alive & (far <= bound)
        if kept.sum() == alive.sum():
            break
        alive = kept
    out: list[tuple[int, int]] = []
    for a, b, q in zip(first.tolist(), last.tolist(), most.tolist(), strict=True):
        start, stop = max(0, a - q - 1), min(n, b + GRAM)
        while out and start <= out[-1][1]:
            before = out.pop()
            start, stop = min(start, before[0]), max(stop, before[1])
        out.append((start, stop))
    return out


def word_runs(words: list[bytes], exponent: int = EXPONENT, least_length: int = LEAST_LENGTH) -> list[tuple[int, int, int]]:
    """Sorted (start, length, period) of the runs among words."""
    if len(words) < least_length:
        return []
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    out: list[tuple[int, int, int]] = []
    for start, stop in candidates(hashes, exponent):
        numbers: dict[bytes, int] = {}
        part = [numbers.setdefault(w, len(numbers)) for w in words[start:stop]]
        out += [(start + s, length, q) for s, length, q in runs_of(part, exponent, least_length)]
    return sorted(out)


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """Words that no run holds behind its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    kept = bytearray(b"\1") * len(words)
    for start, length, q in runs:
        kept[start + q : start + length] = bytes(length - q)
    return b" ".join([w for w, k in zip(words, kept, strict=True) if k])


def _finder(exponent: int, least_length: int):
    def rows(columns: dict) -> dict:
        import pyarrow as pa

        runs, texts = [], []
        for text in columns["text"].cast(pa.binary()).to_pylist():
            words = (text or b"").split()  # bytes split at \x20 and \x09-\x0D alone
            found = word_runs(words, exponent, least_length)
            runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
            texts.append(without_repeats(words, found).decode())
        return {"doc_id": columns["doc_id"], "runs": runs, "collapsed": texts}

    return rows


def find(spark: SparkSession, docs: DataFrame, exponent: int = EXPONENT, least_length: int = LEAST_LENGTH) -> DataFrame:
    """doc_id, runs (structs of start, length, period, sorted) and the collapsed text of each of docs(doc_id, text)."""
    if least_length < GRAM + 2 or exponent < 4:
        raise ValueError(f"only runs of at least {GRAM + 2} words and 4 periods are found")
    return map_arrow(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
        _finder(exponent, least_length),
        "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string",
    )


def repeating(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) in which a tenth of the ids have a text whose words repeat periodically from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    g = F.floor(h / 10)

    def periodic(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(
            F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " "
        )

    # the words are bound once: a lambda's argument is not written out again where it is used
    rewritten = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, periodic(w))), 0)
    text = F.when(h % 10 == 0, F.coalesce(rewritten, F.col("text"))).otherwise(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select(
        "doc_id", text.alias("text")
    )


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Counts, the longest run and digests of what ``find`` gives for ``repeating`` documents."""
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("back"), (-r.period).alias("short")))
    )
    line = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return find(spark, repeating(docs)).select("doc_id", "runs", "collapsed", longest.alias("m")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("m.back")).alias("start"),
        F.col("m.length").alias("length"),
        (-F.col("m.short")).alias("period"),
        F.floor(1000 * F.col("m.length") / -F.col("m.short")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
