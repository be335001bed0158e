"""Exports and table writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _flat(df: DataFrame, separator: str = "; ") -> list[Column]:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() == "array":
            c = F.array_join(c.cast("array<string>"), separator)
        elif f.dataType.typeName() in ("struct", "map"):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with RFC 4180 quoting and CRLF; each part file starts with its header."""
    df.select(*_flat(df)).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', lineSep="\r\n", emptyValue="")


def csv_line(columns: Sequence[Column]) -> Column:
    """One CSV line: fields with comma, quote or line end are quoted."""
    text = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    quoted = [
        F.when(t.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t) for t in text
    ]
    return F.concat_ws(",", *quoted)


def tsv_line(columns: Sequence[Column]) -> Column:
    """One TSV line: tabs and line ends inside fields become one space."""
    return F.concat_ws("\t", *(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\t\n\r]+", " ") for c in columns))


def write_ndjson(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def upsert(table: DataFrame, new: DataFrame, key: str, order: str, first: Sequence[str] = (), newest: Sequence[str] = ()) -> DataFrame:
    """One row a key: ``first`` columns keep their earliest value, ``newest`` always take the latest, others
    take the latest that is not null."""
    rows = table.unionByName(new, allowMissingColumns=True)
    out = []
    for c in rows.columns:
        if c == key:
            continue
        if c in first:
            out.append(F.min_by(c, order).alias(c))
        elif c in newest or c == order:
            out.append(F.max_by(c, order).alias(c))
        else:
            out.append(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c))
    return rows.groupBy(key).agg(*out)


def without(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """table without the given keys."""
    return table.join(keys.select(key), key, "left_anti")
