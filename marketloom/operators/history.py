"""Histories: rates, last values per day, change logs, and admission by the last kept row."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

DAY_MS = 86_400_000
#: Snapshots closer than this to the last kept one are dropped unless a number moved.
SNAPSHOT_GAP_MS = 12 * 3_600_000
PRICE_GAP_MS = 6 * 3_600_000
PRICE_POINTS = 60
#: Gaps that a segment of a key's rows is long, and segments that are told at a time.
SEGMENT_GAPS, TOLD_ROWS = 14, 1024


def weekly_rate(df: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """(key, rate): growth per week between first and last value, null under two points or half a day; of equal times the larger value."""
    seen = df.where(F.col(value).isNotNull())
    ends = seen.groupBy(key).agg(
        F.min_by(value, F.struct(F.col(t), -F.col(value))).alias("a"), F.max_by(value, F.struct(t, value)).alias("b"), F.min(t).alias("t0"), F.max(t).alias("t1"), F.count(F.lit(1)).alias("n")
    )
    days = (F.col("t1") - F.col("t0")) / DAY_MS
    rate = F.greatest(F.lit(0.0), (F.col("b") - F.col("a")) / days * 7)
    return ends.select(key, F.when((F.col("n") >= 2) & (days >= 0.5), rate).alias("rate"))


def daily_last_sum(df: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """(day, total): every key's last value of a UTC day, of equal times the larger one, summed over keys."""
    last = df.where(F.col(value).isNotNull()).groupBy(key, F.floor(F.col(t) / DAY_MS).cast("long").alias("day")).agg(
        F.max_by(value, F.struct(t, value)).alias("v")
    )
    return last.groupBy("day").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n_keys"))


def change_log(df: DataFrame, key: str, order: list[str], value: str, keep: int = 50) -> DataFrame:
    """Rows whose value differs from the one before, the last keep of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = df.withColumn("__before", F.lag(value).over(w)).where(
        F.col("__before").isNull() | (F.col("__before") != F.col(value))
    )
    back = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return changed.withColumn("__n", F.row_number().over(back)).where(F.col("__n") <= keep).drop("__n", "__before")


def admits(last: tuple | None, t: int, values: tuple, gap: int) -> bool:
    """Whether a row is kept after the last kept one."""
    return last is None or t - last[0] >= gap or values != last[1]


def told(values) -> tuple:
    """Values as a state: no number is null."""
    return tuple(None if v is None or v != v else v for v in values)


def walk(last: tuple | None, rows, gap: int):
    """(kept or not, state after it) of rows (t, values) in order, from the state of the last kept row on."""
    for t, values in rows:
        ok = admits(last, t, values, gap)
        if ok:
            last = (t, values)
        yield ok, last


class Segment:
    """What a stretch of a key's rows does to any state that comes in.

    As a kept row alone decides what follows it, a state is told by the first row that it keeps: a row of the first run
    of equal values, when the state has those values and the row is late enough, or else the row at which that run
    ends; a state of other values keeps the first row.  So the times of the first run, and the last row that each of them
    leads to, say all.
    """

    def __init__(self, rows: list[tuple[int, tuple]], gap: int):
        self.values = rows[0][1]
        run = next((i for i, r in enumerate(rows) if r[1] != self.values), len(rows))
        self.end: tuple | None = None
        if run < len(rows):
            for _, self.end in walk(None, rows[run:], gap):
                pass
        self.times = sorted({t for t, _ in rows[:run]})
        #: The time of the last kept row that starts at each of the times; null where it is ``end``.
        self.leads: list[int | None] = [None] * len(self.times)
        for i in range(len(self.times) - 1, -1, -1):
            k = bisect_left(self.times, self.times[i] + gap)
            self.leads[i] = self.leads[k] if k < len(self.times) else None if self.end else self.times[i]

    def after(self, state: tuple | None, gap: int) -> tuple | None:
        return passed(state, gap, self.values, self.times, self.leads, self.end)


def passed(state: tuple | None, gap: int, values: tuple, times: list[int], leads: list[int | None], end: tuple | None) -> tuple | None:
    """The state behind a segment that is told by its first values, times, leads and end."""
    k = 0 if state is None or state[1] != values else bisect_left(times, state[0] + gap)
    if k == len(times):
        return end or state
    return end if leads[k] is None else (leads[k], values)


def admitted(
    df: DataFrame, key: str, order: list[str], t: str, values: list[str], gap: int, needed: list[str] | None = None, width: int | None = None
) -> DataFrame:
    """Rows kept by their distance to, or difference from, the last kept row of their key.

    The rule recurs on kept rows, which no window frame can say.  A key's rows are cut into segments of ``width`` (else SEGMENT_GAPS
    gaps) in time, which are walked apart from each other, so a hot key is many tasks' work: a first pass tells what a segment
    does to any state that comes in, a second one takes each key's state through its segments, a third walks each segment
    from the state that it starts with.  ``order`` starts with ``t``, a whole number.  Rows whose ``needed`` columns (else
    ``values``) are all null are dropped, and so are rows without a time; a null key is a key.
    """
    if order[0] != t:
        raise ValueError("rows are ordered by time first")
    width = width or SEGMENT_GAPS * gap
    names, kinds = df.columns, {f.name: f.dataType for f in df.schema.fields}
    rows = df.where(F.coalesce(*(F.col(c).cast("string") for c in needed or values)).isNotNull() & F.col(t).isNotNull())
    rows = rows.withColumn("__seg", F.floor(F.col(t) / width))
    at = StructType([StructField("__key", kinds[key]), StructField("__at", LongType())])

    def fields(prefix: str) -> list[StructField]:
        return [StructField(f"{prefix}{i}", kinds[v]) for i, v in enumerate(values)]

    told_schema = StructType([
        *at, StructField("times", ArrayType(LongType())), StructField("leads", ArrayType(LongType())), *fields("first"), StructField("end_t", LongType()), *fields("end"),
    ])
    entry_schema = StructType([*at, StructField("__t", LongType()), *fields("__v")])
    arrow = {"told": to_arrow_schema(told_schema), "entry": to_arrow_schema(entry_schema)}
    n = range(len(values))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for (k, seg), held in groupby(_rows(batches, [key, "__seg", t, *values]), key=lambda r: (r[0], r[1])):
            s = Segment([(r[2], told(r[3:])) for r in held], gap)
            end_t, end = s.end or (None, [None] * len(values))
            row = {"__key": k, "__at": seg, "times": s.times, "leads": s.leads, "end_t": end_t}
            out.append(row | {f"first{i}": s.values[i] for i in n} | {f"end{i}": end[i] for i in n})
            if len(out) >= TOLD_ROWS:
                yield pa.RecordBatch.from_pylist(out, schema=arrow["told"])
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow["told"])

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, started = None, None, False
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if not started or r["__key"] != now:
                    now, state, started = r["__key"], None, True
                t0, vs = state or (None, [None] * len(values))
                out.append({"__key": now, "__at": r["__at"], "__t": t0} | {f"__v{i}": vs[i] for i in n})
                end = None if r["end_t"] is None else (r["end_t"], told(r[f"end{i}"] for i in n))
                state = passed(state, gap, told(r[f"first{i}"] for i in n), r["times"], r["leads"], end)
            yield pa.RecordBatch.from_pylist(out, schema=arrow["entry"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = (), None
        for batch in batches:
            kept = []
            columns = [key, "__seg", "__t", t, *(f"__v{i}" for i in n), *values]
            for k, seg, entry_t, at_t, *vs in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if now != (k, seg):
                    now, state = (k, seg), None if entry_t is None else (entry_t, told(vs[: len(values)]))
                (ok, state), = walk(state, [(at_t, told(vs[len(values) :]))], gap)
                kept.append(ok)
            yield batch.filter(pa.array(kept, pa.bool_())).select(names)

    dealt = rows.repartition(key, "__seg")
    segments = dealt.sortWithinPartitions(key, "__seg", *order).mapInArrow(tell, told_schema)
    entries = segments.repartition("__key").sortWithinPartitions("__key", "__at").mapInArrow(compose, entry_schema)
    entered = dealt.join(entries, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__seg") == F.col("__at")), "left")
    return entered.repartition(key, "__seg").sortWithinPartitions(key, "__seg", *order).mapInArrow(keep, df.schema)


def _rows(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def due(df: DataFrame, key: str, t: str, now: int, age: int) -> DataFrame:
    """Keys never checked, or last checked more than age before now."""
    last = df.groupBy(key).agg(F.max(t).alias("last_check"))
    return last.where(F.col("last_check").isNull() | (F.lit(now) - F.col("last_check") > age))
