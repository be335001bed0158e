"""Session settings that the engine's semantics need, and nothing about a machine's size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",  # day buckets are UTC
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",  # a later section replaces an earlier one
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName("marketloom").config(map=SETTINGS | more)
    return (builder.master(master) if master else builder).getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table; NTZ timestamps become timestamps of the UTC session."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    ntz = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: df[c].cast("timestamp") for c in ntz}) if ntz else df


#: Tasks a core to which rows are dealt before long expressions.
TASKS_A_CORE = 4


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores: small files of many rows are few splits, and what is told of a row may cost far more than its bytes."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism * TASKS_A_CORE)


#: Rows that a task sorts or groups, where the session's shuffle partitions would give it more.
ROWS_A_TASK = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The same rows, those of equal keys together, in as many tasks as so many rows ask for; few rows stay as they are.

    A fixed number of partitions, or those that Spark merges down to the number of cores, would give each task a share that
    grows with the input, and its sorts as much memory.  Not fewer than the session's, so that a join keeps them.
    """
    spark = df.sparkSession
    tasks, most = -(-rows // ROWS_A_TASK), int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(tasks, most), *keys) if tasks > min(most, spark.sparkContext.defaultParallelism) else df
