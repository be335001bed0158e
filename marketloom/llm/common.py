"""Helpers shared by the corpus operators: shared-folder scratch tables, graph components, hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_machine(master: str) -> bool:
    """Whether driver and executor are one process, as in tests and on a notebook."""
    return re.fullmatch(r"local(\[.*\])?", master) is not None


@cache
def own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


class Scratch:
    """Parquet tables in the folder that ``spark.checkpoint.dir`` names (all executors share it).

    Writing an intermediate result there cuts its lineage: a lost executor costs only the tasks
    it ran, and later jobs reread files instead of recomputing.  Where the setting is missing, a local
    session, whose only machine is this one, gets a folder of its own; on a cluster there is no folder that
    all machines share, so it is an error.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and one_machine(spark.sparkContext.master):
            root = own_folder()
        if not root:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        self.root = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no returned DataFrame reads any more."""
        jvm = self.spark._jvm
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_arrow(df: DataFrame, rows, schema: str) -> DataFrame:
    """``mapInArrow`` with ``rows(dict of column -> list) -> dict of column -> list`` per batch."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    spark_schema = StructType.fromDDL(schema)
    names = spark_schema.names
    arrow_schema = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = rows({n: part.column(i) for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays(
                    [
                        c if isinstance(c, pa.Array) else pa.array(c, arrow_schema.field(n).type)
                        for n, c in ((n, out[n]) for n in names)
                    ],
                    schema=arrow_schema,
                )

    return df.mapInArrow(run, spark_schema)


#: Bytes of a batch that a Python function is given at once; longer batches are cut, so that a run
#: of very long texts does not multiply a worker's memory.  A single row is never cut.
BATCH_BYTES = 4 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    n = batch.num_rows
    if not n:
        return
    step = max(1, int(n * BATCH_BYTES / max(batch.nbytes, 1)))
    for at in range(0, n, step):
        yield batch.slice(at, min(step, n - at))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of rows that arrive sorted by keys; holds one group and one batch at a time."""
    rest = None
    for batch in batches:
        df = batch.to_pandas()
        if rest is not None:
            df = pd.concat([rest, df], ignore_index=True)
        if not len(df):
            continue
        new = np.zeros(len(df), bool)
        for k in keys:
            v = df[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        cuts = np.flatnonzero(new)
        start = 0
        for c in cuts:
            yield df.iloc[start:c]
            start = c
        rest = df.iloc[start:]
    if rest is not None and len(rest):
        yield rest


def group_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of whole groups of rows that arrive sorted by keys, with the row at which each group starts.

    A run ends with the batch it came in; only the last, open group is kept for the next one.
    """
    rest = None
    for batch in batches:
        run = pa.Table.from_batches([batch])
        run = run if rest is None else pa.concat_tables([rest, run]).combine_chunks()
        if not run.num_rows:
            continue
        new = np.zeros(run.num_rows, bool)
        new[0] = True
        for k in keys:
            v = run.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(new)
        if len(starts) > 1:
            yield run.slice(0, starts[-1]), starts[:-1]
        rest = run.slice(starts[-1])
    if rest is not None:
        yield rest.combine_chunks(), np.zeros(1, np.int64)


def connected(scratch: Scratch, edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """Component of every vertex of an undirected edge list, as ``(node, label)``.

    ``edges(u long, v long)``.  Alternating large-star and small-star rounds (Kiveris et al.,
    "Connected Components in MapReduce and Beyond"): every round is a minimum per vertex, which
    combines map-side, and an equi join of the edges with those minima, which AQE splits where a
    vertex is hot.  It ends when a round changes no edge; all edges then point at the smallest
    vertex of their component.  The number of rounds is logarithmic in practice.
    """
    scratch_name = f"{name}-0"
    current = scratch.write(
        scratch_name,
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
    )
    mark = _mark(current)
    for k in range(1, most_rounds + 1):
        if mark[0] == 0:
            break
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        nxt = scratch.write(f"{name}-{k}", small)
        after = _mark(nxt)
        scratch.drop(scratch_name)
        scratch_name, current = f"{name}-{k}", nxt
        if after == mark:
            break
        mark = after
    else:
        raise RuntimeError(f"{name}: components did not settle in {most_rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))
    ).first()
    return (row[0], row[1], row[2])
