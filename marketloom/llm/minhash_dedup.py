"""Operator 4: near-duplicate documents by b-bit MinHash.

Per document one pass over the text makes the five-word shingle set, 128 minima of it, the hashes of
32 bands of four minima and a signature that keeps only the low four bits of every minimum.  Bands
give candidate pairs; the packed signatures estimate their similarity by bit counts, corrected for
the chance ``2**-b`` that different minima share their low bits; what the estimate cannot rule out
is confirmed on full sets.  Two documents that link at 0.75 miss every band with probability 5e-6
at exactly that similarity, and fall under the estimate's floor with probability 1e-5.

No step emits all pairs of a group.  Documents with equal sets are one class from the start.  Within
a bucket only the edges of a maximum spanning forest over estimated similarity are confirmed first;
links found there merge classes into components.  In buckets that are not yet of one component, every
outsider is then tried against its best estimate.  What remains are pairs of different components in
buckets that are still mixed: their full sets meet inside one task, block by block, and only links
leave it.

Vertices of the links are distinct sets, each with a number of its own; their documents follow from
that.

Nulls, blanks: an empty set, linked with nothing (n_shingles 0).  Rows that repeat a doc_id count
as one document, also where their texts differ: it is linked with whatever one of its texts is linked with,
each row returns its own n_shingles and the component of the doc_id.  A null doc_id is no vertex; its row
returns component_id null and kept false.  Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, connected, map_arrow, slices, sorted_groups
from .shingles import overlap, shingle_set

BANDS = 32
ROWS = 4
PERMUTATIONS = BANDS * ROWS
BITS = 4
#: Links need 100 * intersection >= 75 * union.
THRESHOLD_PERCENT = 75
#: Standard deviations of the b-bit estimate allowed under the threshold before a pair is dropped.
SIGMAS = 4.3
#: Members of a bucket that are compared as one block; larger buckets become blocks by blocks.
BLOCK = 1000
#: Shingles whose minima are computed at once.
_CHUNK = 1 << 16

_rng = np.random.default_rng(20240607)
_A = _rng.integers(1, 2**32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """128 minima of each non-empty set, as uint32 [sets, permutations]."""
    out = np.empty((len(sets), PERMUTATIONS), np.uint32)
    at = 0
    while at < len(sets):
        end, total = at, 0
        while end < len(sets) and (end == at or total + len(sets[end]) <= _CHUNK):
            total += len(sets[end])
            end += 1
        part = sets[at:end]
        h = (np.concatenate(part) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0] + [len(x) for x in part[:-1]])
        for j in range(PERMUTATIONS):
            x = h * _A[j]
            x += _B[j]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            x ^= x >> np.uint32(12)
            out[at:end, j] = np.minimum.reduceat(x, starts)
        at = end
    return out


def pack(low: np.ndarray) -> np.ndarray:
    """Low BITS bits of the minima as BITS bit planes of uint64 words: [sets, BITS, words]."""
    planes = ((low[:, None, :] >> np.arange(BITS, dtype=np.uint32)[None, :, None]) & 1).astype(np.uint8)
    return np.packbits(planes, axis=2).view(np.uint64)


def similarity(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Collision-corrected estimates between one packed signature and many."""
    differ = one[None, 0] ^ many[:, 0]
    for k in range(1, BITS):
        differ = differ | (one[None, k] ^ many[:, k])
    same = PERMUTATIONS - np.bitwise_count(differ).sum(axis=1).astype(np.int64)
    chance = 2.0**-BITS
    return (same / PERMUTATIONS - chance) / (1 - chance)


def floor_estimate() -> float:
    j, chance = THRESHOLD_PERCENT / 100, 2.0**-BITS
    p = j + (1 - j) * chance
    return j - SIGMAS * float(np.sqrt(p * (1 - p) / PERMUTATIONS)) / (1 - chance)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _signatures(columns: dict) -> dict:
    out = {k: [] for k in ("id", "n", "fp", "sig", "bands")}
    sets = [shingle_set(t) for t in columns["text"].to_pylist()]
    full = [s for s in sets if len(s)]
    mins = minima(full) if full else np.empty((0, PERMUTATIONS), np.uint32)
    sigs = pack(mins)
    bands = np.ascontiguousarray(mins).view(np.uint32).reshape(len(full), BANDS, ROWS)
    k = 0
    for doc_id, s in zip(columns["doc_id"].to_pylist(), sets, strict=True):
        out["id"].append(doc_id)
        out["n"].append(len(s))
        if len(s):
            out["fp"].append(_digest(s))
            out["sig"].append(sigs[k].tobytes())
            out["bands"].append(
                [_signed(xxhash.xxh3_64_intdigest(bands[k, b].tobytes(), b)) for b in range(BANDS)]
            )
            k += 1
        else:
            out["fp"].append(None)
            out["sig"].append(None)
            out["bands"].append(None)
    return out


def _unpack(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    sig = np.frombuffer(b"".join(group["sig"]), np.uint64).reshape(len(group), BITS, -1)
    bands = np.stack(group["bands"].to_numpy())
    return sig, bands


def _forest(floor: float):
    """Edges of a maximum spanning forest per block, by estimate (Prim), above the floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, ["band", "key", "block"]):
            n = len(g)
            if n < 2:
                continue
            ids = g["rep"].to_numpy()
            sig = np.frombuffer(b"".join(g["sig"]), np.uint64).reshape(n, BITS, -1)
            best = similarity(sig[0], sig)
            link = np.zeros(n, np.int64)
            best[0] = -np.inf
            done = np.zeros(n, bool)
            done[0] = True
            us, vs = [], []
            for _ in range(n - 1):
                v = int(np.argmax(best))
                if best[v] >= floor:
                    us.append(ids[link[v]])
                    vs.append(ids[v])
                done[v] = True
                best[v] = -np.inf
                s = similarity(sig[v], sig)
                s[done] = -np.inf
                better = s > best
                best[better] = s[better]
                link[better] = v
            if us:
                u, v = np.array(us, np.int64), np.array(vs, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"]
                )

    return run


def _cells(batches: Iterator[pa.RecordBatch], floor: float):
    """Of each cell: targets, and per outsider its row and the targets that may link with it.

    May link: of another component, not met in an earlier band, with an estimate above the floor.
    """
    for g in sorted_groups(batches, ["band", "key", "ob", "tb"]):
        side = g["outsider"].to_numpy()
        o, t = g[side], g[~side]
        if not len(o) or not len(t):
            continue
        band = int(g["band"].iloc[0])
        osig, obands = _unpack(o)
        tsig, tbands = _unpack(t)
        ocomp, tcomp = o["comp"].to_numpy(), t["comp"].to_numpy()
        for i in range(len(o)):
            ok = tcomp != ocomp[i]
            if band:
                ok &= ~(tbands[:, :band] == obands[i, :band]).any(axis=1)
            at = np.flatnonzero(ok)
            if len(at):
                guess = similarity(osig[i], tsig[at])
                near = guess >= floor
                if near.any():
                    yield o, t, i, at[near], guess[near]


def _edges(us: list, vs: list) -> pa.RecordBatch:
    u, v = np.array(us, np.int64), np.array(vs, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])


def _best(floor: float):
    """The best estimated partner of every outsider in a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for o, t, i, at, guess in _cells(batches, floor):
            yield _edges([o["rep"].iloc[i]], [t["rep"].iloc[at[np.argmax(guess)]]])

    return run


def _exact(floor: float):
    """Links between components, on full sets; one for each component that an outsider links with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for o, t, i, at, guess in _cells(batches, floor):
            one = np.frombuffer(o["items"].iloc[i], np.uint64)
            comp, items, rep = t["comp"].to_numpy(), t["items"].to_numpy(), t["rep"].to_numpy()
            met: set = set()
            us, vs = [], []
            for k in at[np.argsort(-guess, kind="stable")]:
                if comp[k] not in met and links(one, np.frombuffer(items[k], np.uint64)):
                    met.add(comp[k])
                    us.append(o["rep"].iloc[i])
                    vs.append(rep[k])
            if us:
                yield _edges(us, vs)

    return run


def links(x: np.ndarray, y: np.ndarray) -> bool:
    if 100 * min(len(x), len(y)) < THRESHOLD_PERCENT * max(len(x), len(y)):
        return False
    both = overlap(x, y)
    return 100 * both >= THRESHOLD_PERCENT * (len(x) + len(y) - both)


def _confirm(columns: dict) -> dict:
    out = {"u": [], "v": []}
    for u, v, a, b in zip(*(columns[c].to_pylist() for c in ("u", "v", "a", "b")), strict=True):
        if links(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)):
            out["u"].append(u)
            out["v"].append(v)
    return out


def _digest(items: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of the texts that stand for a class: rows(doc_id, text, fp, rep), sorted by doc_id, which may repeat.

    A doc_id's rows hold a class once for each repeat of its text; the first one is enough.
    """
    now, done = None, set()
    for batch in batches:
        for part in slices(batch):
            reps, items = [], []
            for doc_id, text, fp, rep in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "fp", "rep")), strict=True):
                if doc_id != now:
                    now, done = doc_id, set()
                if rep in done:
                    continue
                held = shingle_set(text)
                if _digest(held) == fp:
                    done.add(rep)
                    reps.append(rep)
                    items.append(held.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(items, pa.binary())], names=["rep", "items"])


def _confirmed(scratch: Scratch, sets: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """The pairs whose full sets link."""
    both = (
        pairs.join(sets.select(F.col("rep").alias("v"), F.col("items").alias("b")), "v")
        .join(sets.select(F.col("rep").alias("u"), F.col("items").alias("a")), "u")
        .select("u", "v", "a", "b")
    )
    return scratch.write(name, map_arrow(both, _confirm, "u long, v long"))


def _mixed(labelled: DataFrame) -> DataFrame:
    """Cells of the buckets that hold more than one component: outsiders by targets, in blocks.

    Outsiders are the members outside a bucket's largest component; targets are all its members.
    """
    sizes = labelled.groupBy("band", "key", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = (
        sizes.groupBy("band", "key")
        .agg(
            F.max_by("comp", F.struct("n", "comp")).alias("main"),
            F.count(F.lit(1)).alias("comps"),
            F.sum("n").alias("all"),
            F.max("n").alias("top"),
        )
        .where("comps > 1")
        .select(
            "band",
            "key",
            "main",
            F.ceil(F.col("all") / BLOCK).cast("int").alias("tbs"),
            F.ceil((F.col("all") - F.col("top")) / BLOCK).cast("int").alias("obs"),
        )
    )
    members = labelled.join(mixed, ["band", "key"])
    spot = F.xxhash64("rep")
    ob, tb = F.pmod(spot, F.col("obs").cast("long")).cast("int"), F.pmod(spot, F.col("tbs").cast("long")).cast("int")
    carried = ("band", "key", "rep", "comp")
    targets = members.select(
        *carried, F.lit(False).alias("outsider"), F.explode(F.sequence(F.lit(0), F.col("obs") - 1)).alias("ob"), tb.alias("tb")
    )
    outsiders = members.where(F.col("comp") != F.col("main")).select(
        *carried, F.lit(True).alias("outsider"), ob.alias("ob"), F.explode(F.sequence(F.lit(0), F.col("tbs") - 1)).alias("tb")
    )
    return targets.unionByName(outsiders)


def _dealt(cells: DataFrame) -> DataFrame:
    return cells.repartition("band", "key", "ob", "tb").sortWithinPartitions("band", "key", "ob", "tb")


def _labelled(entries: DataFrame, components: DataFrame) -> DataFrame:
    return entries.join(components.withColumnRenamed("node", "rep"), "rep", "left").select(
        "band", "key", "rep", F.coalesce("label", "rep").alias("comp")
    )


def _linked(scratch: Scratch, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows' digests signed(id, n, fp), classes(fp, rep, low) of equal sets, and the links(u, v) that join them."""
    signed = scratch.write(
        "signed",
        map_arrow(docs, _signatures, "id long, n long, fp binary, sig binary, bands array<long>"),
    )
    usable = signed.where("n > 0 and id is not null")
    classes = scratch.write(
        "classes",
        usable.groupBy("fp")
        .agg(F.min("id").alias("low"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
        .withColumn("rep", F.monotonically_increasing_id()),
    )
    entries = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    shared = entries.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    entries = scratch.write("entries", entries.join(shared, ["band", "key"]).select("band", "key", "size", "rep"))
    signatures = classes.select("rep", "sig", "bands")
    wanted = classes.join(entries.select("rep").distinct(), "rep", "left_semi").select(F.col("low").alias("doc_id"), "fp", "rep")
    # rows of a doc_id meet in one task, in order, whatever the sizes are
    chosen = docs.join(wanted.hint("merge"), "doc_id").select("doc_id", "text", "fp", "rep").sortWithinPartitions("doc_id")
    sets = scratch.write("sets", chosen.mapInArrow(_sets, "rep long, items binary"))
    floor = floor_estimate()
    block = F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / BLOCK).cast("long")).cast("int")
    forest = (
        entries.withColumn("block", block)
        .join(signatures.select("rep", "sig"), "rep")
        .repartition("band", "key", "block")
        .sortWithinPartitions("band", "key", "block")
        .mapInArrow(_forest(floor), "u long, v long")
        .distinct()
    )
    first = _confirmed(scratch, sets, scratch.write("forest", forest), "first")
    found = connected(scratch, first, "cc-first")

    cells = _mixed(scratch.write("labelled", _labelled(entries, found))).join(signatures, "rep")
    tried = _dealt(cells).mapInArrow(_best(floor), "u long, v long").distinct()
    second = _confirmed(scratch, sets, scratch.write("best", tried), "second")
    found = connected(scratch, first.union(second), "cc-second")

    cells = _mixed(scratch.write("relabelled", _labelled(entries, found))).join(signatures, "rep").join(sets, "rep")
    third = scratch.write("third", _dealt(cells).mapInArrow(_exact(floor), "u long, v long"))
    links = scratch.write("links", first.union(second).union(third))
    scratch.drop("entries", "sets", "forest", "best", "labelled", "relabelled", "first", "second", "third")
    return signed.select("id", "n", "fp"), classes.select("fp", "rep", "low"), links


def _several(signed: DataFrame) -> DataFrame:
    """doc_ids with more than one text, by digest; an empty one counts."""
    fp = F.coalesce("fp", F.lit(b""))
    return signed.where("id is not null").groupBy("id").agg(F.min(fp).alias("a"), F.max(fp).alias("b")).where("a <> b").select("id")


def _components(scratch: Scratch, classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes with ``label``, the number of their component."""
    final = scratch.write("components", connected(scratch, links, "cc-final"))
    return classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_shingles, component_id, kept."""
    scratch = Scratch(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed, classes, links = _linked(scratch, docs)
    # the texts of one doc_id are one document: each of their classes is linked with the first
    held = signed.where("n > 0").join(_several(signed), "id", "left_semi").distinct().join(classes, "fp").select("id", "rep")
    held = scratch.write("held", held)
    one = held.join(held.groupBy("id").agg(F.min("rep").alias("v")), "id").where("rep <> v").select(F.col("rep").alias("u"), "v")
    labelled = scratch.write("by-class", _components(scratch, classes, links.union(one)))
    lowest = labelled.groupBy("label").agg(F.min("low").alias("component"))
    by_class = labelled.join(lowest, "label").select("fp", "component")
    rows = signed.join(by_class, "fp", "left")
    # a doc_id's row without words takes the component of its rows with words
    bare = held.join(labelled.select("rep", "label"), "rep").join(lowest, "label").groupBy("id").agg(F.min("component").alias("of_id"))
    out = rows.join(bare, "id", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "of_id", "id"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"),
    )


def _text_digest():
    @F.pandas_udf("binary")
    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _digest(shingle_set(t)) or b"")

    return digest


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with one row of each near-duplicate component of texts; its columns stay as they are.

    Here texts are what is linked: a doc_id with several texts keeps each that no other kept text is near to.  Of a component
    the row of the smallest doc_id stays, one of those with equal words.  Of rows without words one a doc_id stays;
    rows without a doc_id all stay.
    """
    scratch = Scratch(spark, "minhash")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed, classes, links = _linked(scratch, plain)
    labelled = _components(scratch, classes, links)
    best = labelled.groupBy("label").agg(F.min(F.struct("low", "fp")).alias("k")).select(F.col("k.low").alias("__id"), F.col("k.fp").alias("__fp"))
    bare = signed.where("n = 0 and id is not null").select(F.col("id").alias("__id"), F.lit(b"").alias("__fp")).distinct()
    wanted = scratch.write("wanted", best.union(bare))
    several = scratch.write("several", _several(signed).withColumnRenamed("id", "__id"))
    same = docs["doc_id"].cast("long") == F.col("__id")
    # most doc_ids have one text, whose digest need not be told again
    single = docs.join(wanted.join(several, "__id", "left_anti").select("__id"), same, "left_semi").dropDuplicates(["doc_id"])
    mixed = docs.join(several, same, "left_semi").withColumn("__fp", _text_digest()(F.col("text").cast("string")))
    mixed = mixed.dropDuplicates(["doc_id", "__fp"])
    chosen = wanted.withColumnRenamed("__fp", "__kept")
    mixed = mixed.join(chosen, (mixed["doc_id"].cast("long") == F.col("__id")) & (F.col("__fp") == F.col("__kept")), "left_semi").drop("__fp")
    return single.unionByName(mixed).unionByName(docs.where(F.col("doc_id").isNull()))
