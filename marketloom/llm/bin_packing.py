"""Operator 11: documents into as few fixed-length sequences as can be, by swap-based local search.

A document's token ids and one end id are a piece; a longer one than a sequence is cut into full pieces behind a
first one that holds the rest, so only whole pieces move.  A full piece is a sequence of its own.  The others are
packed in blocks of at most ``BLOCK`` pieces.

Within a block, best fit in decreasing order gives a first packing.  While it holds more sequences than a lower bound
for the block, local search works on the underfull ones: from the emptiest sequence that can still give, the best of
these exchanges with another underfull one is made: a piece moves, one piece goes against one, two against one, or
one against two.  Only exchanges that raise the sum of squared fills count, so free space gathers in few sequences
until they are empty, and the search ends.

Pieces are dealt to blocks in order of length, one after the other, so that every block holds the same mixture and
packs as well as the whole.  What a block can't fill is not lost on its border: its emptiest sequences, up to a
quarter of its pieces, are opened again and packed with those of other blocks in the next round, until one block
holds all that is open.

Only lengths and numbers of pieces are shuffled; ids are encoded once, where the text is read, and reduced to their
checksum.  Each round is a written table.  A task holds one block.

Nulls: a null text is empty, its document is the end id alone; a null doc_id is kept as null.  Repeated rows are
packed once each.  Ties between equal exchanges go to the first found.  Further columns, whatever their names, are
not read and not returned.  An empty table gives no pieces.  Very long texts are cut, never shortened.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, partitions
from .tokenizing import rank_vocabulary

SEQUENCE = 2048
END_ID = 0
#: Most pieces of a block, so of a task's group.
BLOCK = 16_384
#: Share of a block's pieces, in its emptiest sequences, that the next round may pack again.
OPEN_SHARE = 4
#: Underfull bins among which exchanges are sought, and sources tried for a block at most; wherever the search stops, each
#: piece is packed.
WIDTH = 256
MOST_TRIES = 4_000


def best_fit_decreasing(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of piece numbers: each piece, longest first, goes where it leaves the least space."""
    bins: list[list[int]] = []
    by_space: list[list[int]] = [[] for _ in range(size + 1)]
    spaces = 0  # bit s is set while some bin has s tokens of space
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = spaces >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                spaces ^= 1 << space
            bins[b].append(i)
        else:
            space, b = size, len(bins)
            bins.append([i])
        left = space - n
        if left:
            by_space[left].append(b)
            spaces |= 1 << left
    return bins


def least_bins(lengths: np.ndarray, size: int) -> int:
    """Bins that any packing needs (Martello and Toth 1990): long pieces can't share, middle ones fill what those leave."""
    ordered = np.sort(lengths)
    total = np.concatenate(([0], np.cumsum(ordered)))
    half = np.searchsorted(ordered, size // 2, "right")
    k = np.arange(size // 2 + 1)
    long = np.searchsorted(ordered, size - k, "right")  # from here on longer than size - k
    short = np.searchsorted(ordered, k, "left")  # from here on at least k
    middle = (long - half) * size - (total[long] - total[half])  # what pieces over half a bin leave to those
    need = -(-(total[half] - total[np.minimum(short, half)] - middle) // size)
    return int((len(ordered) - half + np.maximum(need, 0)).max())


class LocalSearch:
    """Exchanges among the emptiest bins of one block, at most ``WIDTH`` of them at a time."""

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, size: int):
        self.bins, self.lengths, self.size = bins, lengths.tolist(), size
        self.fill = [sum(self.lengths[i] for i in b) for b in bins]
        self.least = least_bins(lengths, size)
        self.count = len(bins)
        self.given: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, ...]]]] = {}

    def options(self, b: int):
        """What bin b can give, in arrays (bin, total length, pieces) and as piece numbers: nothing, one piece or two.

        Of equal totals one example, with fewest pieces, is enough.
        """
        held = self.bins[b]
        found: dict[int, tuple[int, ...]] = {}
        ones: dict[int, int] = {}
        for i in held:
            n = self.lengths[i]
            if n in ones:
                found.setdefault(2 * n, (ones[n], i))
            else:
                ones[n] = i
        known = list(ones.items())
        for k, (n, i) in enumerate(known):
            for m, j in known[k + 1 :]:
                found.setdefault(n + m, (i, j))
        found |= {n: (i,) for n, i in known}
        pieces = [(), *found.values()]
        totals = np.array([0, *found], np.int64)
        return np.full(len(totals), b), totals, np.fromiter(map(len, pieces), np.int64, len(pieces)), pieces

    def run(self, most: int = MOST_TRIES) -> None:
        if self.count == self.least:
            return
        waiting = sorted((b for b, f in enumerate(self.fill) if 0 < f < self.size), key=self.fill.__getitem__, reverse=True)
        stuck: set[int] = set()
        moved = False
        for _ in range(most):
            while waiting and len(self.given) < WIDTH:
                b = waiting.pop()
                self.given[b] = self.options(b)
            source = min((b for b in self.given if b not in stuck), key=self.fill.__getitem__, default=None)
            if self.count == self.least or source is None and not moved:
                return
            if source is None:  # all are tried again after exchanges among others
                stuck.clear()
                moved = False
                continue
            move = self.best(source)
            if move is None:
                stuck.add(source)
                continue
            target, out, back = move
            moved = True
            self.shift(source, target, out)
            self.shift(target, source, back)
            for b in (source, target):
                stuck.discard(b)
                if 0 < self.fill[b] < self.size:
                    self.given[b] = self.options(b)
                else:
                    del self.given[b]
            if not self.fill[source]:
                self.count -= 1

    def shift(self, source: int, target: int, pieces: tuple[int, ...]) -> None:
        for i in pieces:
            self.bins[source].remove(i)
            self.bins[target].append(i)
            self.fill[source] -= self.lengths[i]
            self.fill[target] += self.lengths[i]

    def best(self, source: int):
        """The exchange of the source with another bin that raises the squared fills most, or None."""
        own = self.given[source]
        others = [x for b, x in self.given.items() if b != source]
        if not others:
            return None
        owner, total, count = (np.concatenate([x[k] for x in others]) for k in range(3))
        fill = np.array([self.fill[x[0][0]] for x in others]).repeat([len(x[3]) for x in others])
        space = self.size - fill
        best, chosen = 0, None
        for amount, out in zip(own[1][1:].tolist(), own[3][1:], strict=True):
            change = amount - total
            # a move, or one against one, two against one, one against two
            fits = (change > 0) & (change <= space) & (count + len(out) <= 3)
            if len(out) == 2:
                fits &= count == 1
            gain = np.where(fits, change * (fill - self.fill[source] + change), 0)
            k = int(gain.argmax())
            if gain[k] > best:
                best, chosen = gain[k], (int(owner[k]), out, k)
        if chosen is None:
            return None
        target, out, k = chosen
        return target, out, self.given[target][3][k - int((owner == target).argmax())]


def pack_block(lengths: np.ndarray, size: int = SEQUENCE) -> list[list[int]]:
    """Bins of piece numbers of one block."""
    search = LocalSearch(best_fit_decreasing(lengths, size), lengths, size)
    search.run()
    return [b for b in search.bins if b]


def _cutter(vocabulary: tuple[str, str], size: int):
    def rows(columns: dict) -> dict:
        memo = rank_vocabulary(*vocabulary)
        names = ("doc_id", "piece", "start", "length", "ids_crc32")
        out = {k: [] for k in names}
        for doc_id, text in zip(columns["doc_id"].to_pylist(), columns["text"].to_pylist(), strict=True):
            ids = np.append(memo.ids(text or ""), END_ID).astype("<u4")
            cuts = [0, *range((len(ids) - 1) % size + 1, len(ids) + 1, size)]
            for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                for name, value in zip(names, (doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                    out[name].append(value)
        return out

    return rows


def _packer(size: int, last: bool):
    def pack(block: pa.Table) -> pa.Table:
        block = block.sort_by([("length", "ascending"), ("uid", "ascending")])
        uid, lengths = block.column("uid").to_numpy(), block.column("length").to_numpy()
        bins = pack_block(lengths, size)
        fills = [int(lengths[b].sum()) for b in bins]
        left = 0 if last else len(uid) // OPEN_SHARE
        sequence, offset, closed = np.empty(len(uid), np.int64), np.empty(len(uid), np.int64), np.ones(len(uid), bool)
        for k in sorted(range(len(bins)), key=fills.__getitem__):
            b = bins[k]
            left -= len(b)
            sequence[b] = uid[b[0]]
            offset[b] = np.cumsum(lengths[b]) - lengths[b]
            closed[b] = left < 0 or fills[k] == size
        return pa.table({"uid": uid, "length": lengths, "sequence_id": sequence, "offset": offset, "closed": closed})

    return pack


def pack(spark: SparkSession, docs: DataFrame, vocabulary: tuple[str, str] | None = None, block: int = BLOCK) -> DataFrame:
    """Pieces of docs(doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``vocabulary`` names the rank file and the tokenizer's JSON file, whose added tokens keep their own ids.
    """
    vocabulary = vocabulary or (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))
    scratch = Scratch(spark, "bin_packing")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = scratch.write(
        "pieces", map_arrow(docs, _cutter(vocabulary, SEQUENCE), schema).withColumn("uid", F.monotonically_increasing_id())
    )
    open_pieces, closed = pieces.where(F.col("length") < SEQUENCE).select("uid", "length"), []
    count, k = open_pieces.count(), 0
    while count:
        blocks = -(-count // block)
        # the number of a row in its sorted partition deals out pieces of like length evenly; partitions start at different blocks
        at = F.monotonically_increasing_id()
        dealt = (
            open_pieces.repartitionByRange(partitions(spark), "length", "uid")
            .sortWithinPartitions("length", "uid")
            .withColumn("block", F.pmod(at.bitwiseAND((1 << 33) - 1) + F.hash(F.spark_partition_id()), F.lit(blocks)))
        )
        packed = scratch.write(
            f"round-{k}",
            dealt.groupBy("block").applyInArrow(
                _packer(SEQUENCE, blocks == 1), "uid long, length long, sequence_id long, offset long, closed boolean"
            ),
        )
        closed.append(packed.where("closed").select("uid", "sequence_id", "offset"))
        open_pieces = packed.where("not closed").select("uid", "length")
        count, k = open_pieces.count(), k + 1
    columns = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    full = pieces.where(F.col("length") == SEQUENCE).select("*", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = full.select(*columns)
    if closed:
        places = closed[0]
        for more in closed[1:]:
            places = places.union(more)
        out = out.union(pieces.where(F.col("length") < SEQUENCE).join(places, "uid").select(*columns))
    return out
