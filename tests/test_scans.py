"""Running sums, carried values and percentiles over ranges against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import analytics, metrics, scans
from corpusloom.sources import tables


def test_sums_and_last_values(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["hot", "hot", "hot", "a", None]), rng.randrange(50), rng.choice([None, rng.random()])) for k in range(2000)]
    df = spark.createDataFrame(rows, "id long, g string, at int, v double").repartition(5)
    sums = {r.id: r.s for r in scans.with_sums_before(df, [F.col("at"), F.col("id")], {"s": F.col("id")}, "t").collect()}
    total = 0
    for i, _, _, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        assert sums[i] == total
        total += i
    last, found = {}, {r.id: r.p for r in scans.with_last_before(df, ["g"], ["at", "id"], F.col("v"), "p").collect()}
    for i, g, _, v in sorted(rows, key=lambda r: (r[2], r[0])):
        assert found[i] == last.get(g)
        last[g] = last.get(g) if v is None else v
    assert len(found) == 2000 and scans.with_last_before(df.limit(0), ["g"], ["at", "id"], F.col("v"), "p").count() == 0


def test_no_task_holds_a_hot_group(spark):
    """The window of a carried value is over ranges of a group."""
    runs = spark.range(1000).select(F.col("id").alias("run_id"), F.lit("m").alias("mode"), F.col("id").alias("started_at"), F.lit("done").alias("status"), F.lit(1.0).alias("recall"))
    plan = metrics.previous_run(runs, "recall")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [last(value_" in line]
    assert len(windows) == 1 and "[mode#" in windows[0] and ", deal#" in windows[0]


@pytest.mark.parametrize("small", [scans.SMALL, 5500])
@pytest.mark.parametrize("facts", [tables.FACTS, 1])
def test_percentiles(spark, monkeypatch, small, facts):
    monkeypatch.setattr(scans, "SMALL", small)
    monkeypatch.setattr(tables, "FACTS", facts)
    rng = np.random.default_rng(8)
    values = {"flat": rng.random(6000), "little": rng.random(900), "steps": rng.integers(0, 4, 9000).astype(float), "same": np.full(7000, 2.5), "one": np.array([7.0]), "two": np.array([1.0, 2.0]), "wide": rng.standard_cauchy(8000), None: rng.normal(size=30)}
    rows = [(g, float(x)) for g, v in values.items() for x in v] + [("flat", None), ("empty", None)]
    rng.shuffle(rows)
    shares = [0.0, 0.25, 0.5, 0.95, 0.9997, 1.0]
    got = {(r.g, r.share): r.percentile for r in scans.percentiles(spark.createDataFrame(rows, "g string, v double").repartition(4), "g", "v", shares).collect()}
    assert got == {(g, s): pytest.approx(float(np.quantile(v, s)), rel=1e-12, abs=1e-12) for g, v in values.items() for s in shares}


def test_counters_begin_again(spark):
    rows = [("a", t, t, v) for t, v in enumerate([5.0, 8.0, None, 9.0, 2.0, 2.0, 7.0])] + [("b", 0, 100, 50.0)]
    df = spark.createDataFrame(rows, "s string, t int, sample_id int, value double").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.sample_id: r.increase for r in analytics.increases(df, ["s"]).collect()}
    assert got == {0: 0.0, 1: 3.0, 2: 0.0, 3: 1.0, 4: 2.0, 5: 0.0, 6: 5.0, 100: 0.0}


def test_bucket_quantiles(spark):
    inf = float("inf")
    rows = [("a", 1.0, 2.0), ("a", 5.0, 8.0), ("a", inf, 10.0), ("none", 1.0, 0.0), ("none", inf, 0.0), ("low", 1.0, 4.0), ("low", inf, 4.0), ("beyond", 1.0, 0.0), ("beyond", inf, 3.0)]
    df = spark.createDataFrame(rows, "g string, le double, rate double")
    got = {r.g: r.quantile for r in analytics.bucket_quantile(df, ["g"], 0.5).collect()}
    assert got == {"a": pytest.approx(3.0), "none": None, "low": 0.5, "beyond": 1.0}
    assert {r.g: r.quantile for r in analytics.bucket_quantile(df, ["g"], 0.9).collect()}["a"] == 5.0
