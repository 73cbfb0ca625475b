import random

import pandas as pd
import pytest

from pyspark.sql import functions as F

from prepkit.operators.ordered import average_ranks, dense_codes, fill, with_bucket

BUCKETS = [1_000_000, 37, 5]


def table(spark, n=400):
    random.seed(5)
    rows = [(i, random.random() if random.random() < 0.2 else None,
             random.choice("abc") if random.random() < 0.1 else None) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k long, v double, s string").repartition(5)


@pytest.mark.parametrize("rows_per_bucket", BUCKETS)
@pytest.mark.parametrize("backward", [False, True])
def test_fill_is_that_of_pandas(spark, rows_per_bucket, backward):
    rows, df = table(spark)
    got = [tuple(r) for r in fill(df, ["v", "s"], ["k"], backward, rows_per_bucket).orderBy("k").collect()]
    pdf = pd.DataFrame(rows, columns=["k", "v", "s"])
    want = pdf.assign(**{c: pdf[c].bfill() if backward else pdf[c].ffill() for c in "vs"})
    assert got == [tuple(None if pd.isna(x) else x for x in r) for r in want.itertuples(index=False)]


def test_fill_edges(spark):
    df = spark.createDataFrame(list(enumerate([None, 1.0, None, 2.0, None])), "k long, v double")
    forward = [r["v"] for r in fill(df, ["v"], ["k"]).orderBy("k").collect()]
    back = [r["v"] for r in fill(df, ["v"], ["k"], backward=True).orderBy("k").collect()]
    assert forward == [None, 1.0, 1.0, 2.0, 2.0] and back == [1.0, 1.0, 2.0, 2.0, None]


@pytest.mark.parametrize("rows_per_bucket", BUCKETS)
def test_a_third_of_the_rows_share_one_key(spark, rows_per_bucket):
    rows = [(i, float(i) if i % 4 == 0 else None) for i in range(60)] + [(30, None)] * 30
    df = spark.createDataFrame(rows, "k long, v double")
    got = fill(df, ["v"], ["k"], rows_per_bucket=rows_per_bucket)
    assert got.count() == len(rows)
    assert {r["v"] for r in got.filter("k = 30").collect()} == {28.0}


def test_fill_by_two_keys_with_nulls(spark):
    rows = [(None, 1, None), ("a", None, 5.0), ("a", 1, None), ("b", 1, None), ("b", 2, 7.0), ("c", 0, None)]
    got = fill(spark.createDataFrame(rows, "g string, k int, v double"), ["v"], ["g", "k"], rows_per_bucket=2)
    found = {(r["g"], r["k"]): r["v"] for r in got.collect()}
    assert found == {(None, 1): None, ("a", None): 5.0, ("a", 1): 5.0, ("b", 1): 5.0, ("b", 2): 7.0, ("c", 0): 7.0}


def test_fill_needs_other_columns_as_order(spark):
    df = spark.createDataFrame([(1, 1.0)], "k long, v double")
    with pytest.raises(ValueError):
        fill(df, ["v"], ["v"])
    with pytest.raises(ValueError):
        fill(df, ["v"], ["nowhere"])


@pytest.mark.parametrize("rows_per_bucket", BUCKETS)
def test_codes_are_dense_and_sorted(spark, rows_per_bucket):
    values = [f"v{i:04d}" for i in range(200)]
    df = spark.createDataFrame([(v,) for v in random.sample(values, 200)], "value string")
    got = dense_codes(df, "value", rows_per_bucket).orderBy("value").collect()
    assert [(r["value"], r["code"]) for r in got] == [(v, i) for i, v in enumerate(values)]


@pytest.mark.parametrize("rows_per_bucket", BUCKETS)
def test_average_ranks(spark, rows_per_bucket):
    counts = [(float(i), i % 4 + 1) for i in range(80)]
    got = average_ranks(spark.createDataFrame(counts, "value double, n long"), rows_per_bucket)
    spread = pd.Series([v for v, n in counts for _ in range(n)])
    want = spread.rank().groupby(spread).first().tolist()
    assert [r["rank"] for r in got.orderBy("value").collect()] == want


def test_buckets_follow_the_order_and_are_even(spark):
    df = with_bucket(spark.range(0, 5000, 1, 7), ["id"], 100)
    spans = df.groupBy("__bucket").agg({"id": "min", "*": "count"}).orderBy("__bucket").collect()
    assert len(spans) > 20
    starts = [r["min(id)"] for r in spans]
    assert starts == sorted(starts) and max(r["count(1)"] for r in spans) < 500


@pytest.mark.parametrize("fine", [1_024, 4, 1])
@pytest.mark.parametrize("keys", ["numbers", "texts", "long texts"])
def test_buckets_follow_the_order_at_both_levels(spark, monkeypatch, fine, keys):
    from prepkit.operators import ordered
    monkeypatch.setattr(ordered, "FINE", fine)
    rng = random.Random(1)
    made = {"numbers": lambda: rng.random(), "texts": lambda: "".join(rng.choices("abcé", k=8)),
            "long texts": lambda: "".join(rng.choices("ab", k=6)) + "x" * 500 + rng.choice("ab")}[keys]
    rows = [(made(),) for _ in range(600)] + [(None,)] * 20
    rows += [rows[0]] * 200
    df = spark.createDataFrame(rows, "k double" if keys == "numbers" else "k string")
    got = with_bucket(df.repartition(4), ["k"], 20)
    again = with_bucket(df.repartition(7), ["k"], 20)
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))  # whatever the partitions
    ordered_rows = sorted(got.collect(), key=lambda r: (r["k"] is not None, r["k"] or (0 if keys == "numbers" else "")))
    found = [r[ordered.BUCKET] for r in ordered_rows]
    assert found == sorted(found) and len(rows) == len(found)
    held = pd.Series({k: b for k, b in zip([r["k"] for r in ordered_rows], found)}).value_counts()
    assert 10 < len(held) <= 60 and held.max() <= 80


def test_more_buckets_than_any_fixed_number(spark):
    df = spark.range(80_000).select((80_000 - F.col("id")).alias("k"))
    got = with_bucket(df, ["k"], 1)
    assert got.select("__bucket").distinct().count() > 40_000
