"""Admission by segments equals the walk of each key's rows, whatever the segments are."""

import random

from pyspark.sql import functions as F

from marketloom.operators import history


def walked(rows, gap):
    """ids kept, by one walk for each key."""
    last, kept = {}, set()
    for k, t, i, *vs in sorted(rows, key=lambda r: (str(r[0]), r[1] if r[1] is not None else 0, r[2])):
        if t is None or all(v is None for v in vs):
            continue
        if k not in last or t - last[k][0] >= gap or tuple(vs) != last[k][1]:
            last[k] = (t, tuple(vs))
            kept.add(i)
    return kept


def test_segment_functions():
    rng = random.Random(6)
    for _ in range(4000):
        gap = rng.randint(1, 12)
        rows = sorted(((rng.randint(0, 40), (rng.choice([1, 1, 1, 2, None]),)) for _ in range(rng.randint(1, 25))), key=lambda r: r[0])
        cut = rng.randint(1, len(rows))
        state = None
        for part in (rows[:cut], rows[cut:]):
            if part:
                state = history.Segment(part, gap).after(state, gap)
        *_, (_, want) = history.walk(None, rows, gap)
        assert state == want, (gap, rows, cut)


def test_admitted_equals_walk(spark):
    rng = random.Random(9)
    for hot in (False, True):
        rows = []
        for i in range(3000):
            k = "hot" if hot else rng.choice([None, "a", "b", *map(str, range(30))])
            t = None if rng.random() < 0.02 else rng.randint(-2000, 20_000) // rng.choice([1, 50])
            rows.append((k, t, i, rng.choice([None, 1, 1, 1, 2]), rng.choice([None, 0.5, 0.5, 0.7])))
        df = spark.createDataFrame(rows, "k string, t long, i int, a int, b double")
        for gap, width in ((100, None), (100, 7), (1000, 100_000), (1, None)):
            got = [r["i"] for r in history.admitted(df, "k", ["t", "i"], "t", ["a", "b"], gap, width=width).collect()]
            assert len(got) == len(set(got)) and set(got) == walked(rows, gap), (hot, gap, width)
    assert history.admitted(df.limit(0), "k", ["t"], "t", ["a"], 5).collect() == []


def test_hot_key_is_many_tasks(spark):
    df = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("t"), (F.col("id") % 3).alias("v"))
    kept = history.admitted(df, "k", ["t"], "t", ["v"], 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows would share a task
    try:
        tasks = kept.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in tasks) == 4000 and len(tasks) > 1


def test_ties_in_time(spark):
    df = spark.createDataFrame([("k", 0, 5.0), ("k", 0, 3.0), ("k", 7 * history.DAY_MS, 9.0), ("k", 7 * history.DAY_MS, 8.0)], "k string, t long, v double")
    assert history.weekly_rate(df, "k", "t", "v").first()["rate"] == 4.0
    assert {r["total"] for r in history.daily_last_sum(df, "k", "t", "v").collect()} == {5.0, 9.0}
