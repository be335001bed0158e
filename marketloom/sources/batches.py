"""Rows that Python makes of rows, in Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Input bytes read, and rows given out, at a time; a single row is never cut.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4096


def flat_rows(df: DataFrame, rows: Callable[[dict], Iterable[dict]], schema: str) -> DataFrame:
    """``rows(row)`` of each row of df, one after the other; what a result lacks is null."""
    made = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for batch in batches:
            step = max(1, int(batch.num_rows * BATCH_BYTES / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                for row in batch.slice(at, step).to_pylist():
                    for made_row in rows(row):
                        out.append(made_row)
                        if len(out) >= BATCH_ROWS:
                            yield pa.RecordBatch.from_pylist(out, schema=made)
                            out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=made)
                out = []

    return df.mapInArrow(run, schema)
