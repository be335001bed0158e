"""Snapshots as a stream: admission by the last kept row, and a keyed table kept by micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegralType, LongType, StructField, StructType

from ..operators.history import admits
from ..operators.rows import newest
from ..sources.lookups import rates_as_of


def admitted_stream(df: DataFrame, key: str, t: str, values: list[str], gap: int) -> DataFrame:
    """The streaming form of ``history.admitted``: a key's state is its last kept time and values.

    Rows of a micro-batch are taken in order of time; across batches in order of arrival, as nothing is
    dropped for being late.  State is one row a key and grows with the keys only; it has the values' own types.  Rows whose
    values are all null are dropped.
    """
    names, kinds = df.columns, {f.name: f.dataType for f in df.schema.fields}
    whole = [isinstance(kinds[v], IntegralType) for v in values]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = None
        if state.exists:
            at, *kept = state.get
            last = (at, tuple(kept))
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(t, kind="stable")
        keep = []
        for at, *vs in zip(pdf[t], *(pdf[v] for v in values), strict=True):
            # pandas has no whole numbers beside nulls
            row = tuple(None if pd.isna(v) else int(v) if n else v for v, n in zip(vs, whole, strict=True))
            ok = any(v is not None for v in row) and admits(last, at, row, gap)
            if ok:
                last = (at, row)
            keep.append(ok)
        if last is not None:
            state.update((int(last[0]), *last[1]))
        yield pdf.loc[keep, names]

    schema = StructType([StructField("t", LongType()), *(StructField(f"v{i}", kinds[v]) for i, v in enumerate(values))])
    return df.groupBy(key).applyInPandasWithState(step, df.schema, schema, "append", GroupStateTimeout.NoTimeout)


#: Micro-batches between two compactions of a keyed table.
COMPACT_EVERY = 50


def _versions(spark: SparkSession, path: str) -> tuple[int | None, list[int]]:
    """The newest whole version of a keyed table and the changes after it, by their finished files."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def finished(kind: str) -> list[int]:
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, f"{kind}/v*/_SUCCESS")) or []
        return sorted(int(f.getPath().getParent().getName()[1:]) for f in found)

    whole = finished("whole")
    base = whole[-1] if whole else None
    return base, [v for v in finished("changes") if base is None or v > base]


def latest(spark: SparkSession, path: str, schema: StructType, keys: list[str], order: list[str], until: int | None = None) -> DataFrame:
    """A keyed table as it stands: the newest row of each key over its whole version and the changes since.

    A table that was never written is empty.  ``until`` leaves out later changes.
    """
    base, changes = _versions(spark, path)
    folders = [] if base is None else [f"{path}/whole/v{base}"]
    folders += [f"{path}/changes/v{v}" for v in changes if until is None or v <= until]
    if not folders:
        return spark.createDataFrame([], schema)
    return newest(spark.read.schema(schema).parquet(*folders), keys, order).select(*schema.names)


def keep_latest(stream: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str, every: int = COMPACT_EVERY):
    """A stream's rows upserted by key into a Parquet table, which ``latest`` reads.

    A micro-batch writes its own newest rows only, so its cost follows its size; every so many of them are
    merged with the whole version before them into the next one.  A batch that is run again writes its own
    changes again, so replays change nothing; a compaction reads changes up to its own batch, whatever came between.
    Versions that a newer whole one replaces stay, for readers that have opened them; ``drop_versions`` deletes them.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        schema = df.schema
        base, _ = _versions(df.sparkSession, path)
        if base is not None and epoch <= base:
            return  # merged already, before the stream could note that the batch was done
        newest(df, keys, order).select(*df.columns).write.mode("overwrite").parquet(f"{path}/changes/v{epoch}")
        if (epoch + 1) % every == 0:
            latest(df.sparkSession, path, schema, keys, order, until=epoch).write.mode("overwrite").parquet(f"{path}/whole/v{epoch}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drop_versions(spark: SparkSession, path: str) -> int:
    """Deletes what a keyed table's newest whole version replaces; the number of folders that went."""
    base, _ = _versions(spark, path)
    if base is None:
        return 0
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = 0
    for kind, last in (("whole", base - 1), ("changes", base)):
        for f in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, f"{kind}/v*")) or []:
            if int(f.getPath().getName()[1:]) <= last:
                gone += bool(fs.delete(f.getPath(), True))
    return gone


def with_fresh_rates(stream: DataFrame, versions_path: str, write, checkpoint: str, t: str = "t", horizon: int | None = None):
    """Runs a stream whose rows get their currency's rate as of their time, from a table of versions that others refresh.

    The table is listed anew by each micro-batch, so a refresh is seen without a restart; a batch that runs again gives
    earlier rows the same versions, for a version never counts before its own time.  ``write(df, epoch)`` takes the rows.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        versions = df.sparkSession.read.schema("currency string, t long, rate double").parquet(versions_path)
        write(rates_as_of(df, versions, t, horizon=horizon), epoch)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
