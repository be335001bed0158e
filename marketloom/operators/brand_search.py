"""Which of many names stand anywhere inside which texts, also glued into longer words.

Names are dealt into shards and texts into blocks, both of bounded size; each shard meets each block once, in a task that
builds an automaton of the shard's names and runs the block's texts through it.  No name meets a text one by one, and
neither side is collected.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of one automaton, and texts that run through it in one task.
SHARD, BLOCK = 50_000, 1 << 18


def _find(names: pa.Table, texts: pa.Table) -> pa.Table:
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for name in names.column("name").to_pylist():
        automaton.add_word(name, name)
    ids: list[int] = []
    found: list[str] = []
    if len(automaton):
        automaton.make_automaton()
        for i, text in zip(texts.column("id").to_pylist(), texts.column("text").to_pylist(), strict=True):
            hits = {name for _, name in automaton.iter(text)}
            ids += [i] * len(hits)
            found += hits
    return pa.table({"id": pa.array(ids, pa.int64()), "name": pa.array(found, pa.string())})


def names_in_texts(names: DataFrame, texts: DataFrame, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(id, name), once each, for every name of names(name) that texts(id, text) hold as a substring.

    Empty and missing names are in no text, missing texts hold none.
    """
    names = names.where("name <> ''").select("name").distinct()
    texts = texts.where("text is not null").select(F.col("id").cast("long").alias("id"), "text")
    shards, blocks = max(1, -(-names.count() // shard)), max(1, -(-texts.count() // block))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(column: str, n: int):
        return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")

    left = names.select("name", dealt("name", shards).alias("shard"), every(blocks).alias("block")).groupBy("shard", "block")
    right = texts.select("id", "text", dealt("id", blocks).alias("block"), every(shards).alias("shard")).groupBy("shard", "block")
    return left.cogroup(right).applyInArrow(_find, "id long, name string")
