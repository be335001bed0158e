"""Exact order statistics without a buffer per group, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import insights


def quantiles_of(rows, at):
    by = {}
    for k, v in rows:
        if v is not None:
            by.setdefault(k, []).append(v)
    return {k: (len(v), *(float(np.quantile(v, p)) for p in at)) for k, v in by.items()}


@pytest.mark.parametrize("kind", ["one group", "many", "ties", "signs"])
def test_against_numpy(spark, kind):
    rng = np.random.default_rng(2)
    n, at = 4000, (0.0, 0.1, 0.25, 0.33, 0.5, 0.95, 1.0)
    keys = ["all"] * n if kind == "one group" else [None if k == 0 else f"k{k}" for k in rng.integers(0, 40, n)]
    values = {"ties": rng.integers(0, 5, n) * 1.5, "signs": rng.normal(size=n) * 10.0 ** rng.integers(-300, 300, n)}.get(kind, rng.lognormal(3, 2, n))
    rows = [(k, None if i % 17 == 0 else float(v)) for i, (k, v) in enumerate(zip(keys, values))]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: tuple(r)[1:] for r in insights.order_statistics(df, ["k"], "v", at).collect()}
    want = quantiles_of(rows, at)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == want[k][0] and np.allclose(got[k][1:], want[k][1:], rtol=1e-12)
    whole, = insights.order_statistics(df, [], "v", at).collect()
    assert np.allclose(tuple(whole), quantiles_of([(0, v) for _, v in rows], at)[0], rtol=1e-12)


def test_few_values(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", None), ("b", None), ("", 3.0), (None, 4.0)], "k string, v double")
    assert [tuple(r) for r in insights.group_stats(df, "k", "v").orderBy("k").collect()] == [("a", 2, 1, 2.0, 2.0, 2.0), ("b", 1, 0, None, None, None)]
    assert tuple(insights.quantiles(df, "v", (0.5,)).first()) == (3, 3.0)
    assert tuple(insights.quantiles(df.limit(2), "v", (0.5,)).first()) == (1, None)
    assert tuple(insights.headline(df, "v", "k").first()) == (5, 3, 3, 3.0)
    nothing = df.where(F.lit(False))
    assert tuple(insights.headline(nothing, "v", "k").first()) == (0, 0, 0, None) and insights.histogram(nothing, "v").collect() == []
    assert tuple(insights.quantiles(nothing, "v", (0.5,)).first()) == (0, None)


def test_plan_has_no_collecting_aggregate(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    plan = insights.order_statistics(df, ["k"], "v", (0.5,))._jdf.queryExecution().executedPlan().toString().lower()
    assert not any(w in plan for w in ("percentile", "median", "collect_list", "cartesian"))
