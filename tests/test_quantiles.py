import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prepkit.operators import quantiles as q

WANTED = {"none": 0.0, "p01": 0.01, "q25": 0.25, "median": 0.5, "q75": 0.75, "p99": 0.99, "all": 1.0}


def expected(values):
    return {k: float(np.quantile(values, p)) for k, p in WANTED.items()}


def check(row, values):
    for name, value in expected(values).items():
        assert row[name] == pytest.approx(value, rel=1e-12, abs=1e-12), name


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101])
def test_small(numbers, n):
    random.seed(n)
    values = [random.gauss(0, 10) for _ in range(n)]
    check(q.exact_quantiles(numbers(values), ["x"], WANTED).first(), values)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(values=st.lists(st.one_of(st.integers(-3, 3).map(float), st.floats(-1e6, 1e6)), min_size=1, max_size=60))
def test_any_values(numbers, values):
    check(q.exact_quantiles(numbers(values), ["x"], WANTED).first(), values)


@pytest.mark.parametrize("shape", ["uniform", "ties", "heavy_tail"])
def test_more_rows_than_the_sketch_keeps(spark, shape):
    x = {
        "uniform": F.rand(7) * 1000,
        "ties": F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.floor(F.rand(7) * 10)),  # a third are equal
        "heavy_tail": F.exp(F.rand(7) * 30),
    }[shape].cast("double")
    df = spark.range(0, 150_000, 1, 6).select(x.alias("x"))
    values = [r[0] for r in df.collect()]
    check(q.exact_quantiles(df, ["x"], WANTED).first(), values)


def test_a_coarse_sketch_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(q, "ACCURACY", 50)
    monkeypatch.setattr(q, "COLUMN_ACCURACY", 50)
    monkeypatch.setattr(q, "CELLS", 7)
    df = spark.range(0, 20_000, 1, 5).select((F.rand(3) * F.rand(4) * 100).alias("x"))
    values = [r[0] for r in df.collect()]
    check(q.exact_quantiles(df, ["x"], WANTED).first(), values)


def test_groups_and_columns(spark):
    rows = [(i % 3, float(i * i % 101), i) for i in range(600)]
    df = spark.createDataFrame(rows, "g int, a double, b long")
    for r in q.exact_quantiles(df, ["a", "b"], WANTED, by=["g"]).collect():
        at = 1 if r["column_name"] == "a" else 2
        check(r, [float(row[at]) for row in rows if row[0] == r["g"]])


def test_missing_and_infinite(numbers):
    df = numbers([float("nan"), None, 1.0, 2.0, float("inf"), float("-inf")])
    row = q.exact_quantiles(df, ["x"], {"low": 0.0, "median": 0.5, "high": 1.0}).first()
    assert (row["low"], row["median"], row["high"]) == (-math.inf, 1.5, math.inf)


def test_no_values_no_row(numbers):
    assert q.exact_quantiles(numbers([None, float("nan")]), ["x"]).count() == 0


def test_approximate_is_near(spark):
    df = spark.range(100_000).select(F.col("id").cast("double").alias("x"))
    row = q.approx_quantiles(df, ["x"]).first()
    assert abs(row["median"] - 50_000) <= 100_000 / q.ACCURACY + 1


def test_no_task_merges_the_sketches_of_all_scan_tasks(spark):
    df = spark.range(0, 50_000, 1, 8).select(*[(F.col("id") * k % 1_009).cast("double").alias(f"x{k}") for k in range(1, 9)])
    sketches = q.column_sketches(df, df.columns)
    plan = sketches._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and plan.count("Exchange hashpartitioning") == 2 and plan.count("Range (") == 1
    assert sketches.count() == 8


def test_sketches_of_slices_add_up(spark):
    df = spark.range(60_000).select(F.col("id").cast("double").alias("x"))
    slices = [q.column_sketches(df.where(f"x >= {a} AND x < {b}"), ["x"]) for a, b in ((0, 100), (100, 50_000), (50_000, 60_000))]
    merged = q.merged_sketches(slices[0].unionByName(slices[1]).unionByName(slices[2]))
    n, median = merged.select(F.kll_sketch_get_n_double("sketch"), F.kll_sketch_get_quantile_double("sketch", F.lit(0.5))).first()
    assert n == 60_000 and abs(median - 30_000) <= 60_000 / q.COLUMN_ACCURACY
