"""States of slices against the whole, and assessments against the operators they stand for."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from prepkit.operators import frequency, quality, recommend, state
from prepkit.operators.stats import column_stats
from prepkit.plans import results

@pytest.fixture(scope="module")
def df(spark):
    rows = spark.range(0, 600, 1, 5).selectExpr(
        "id AS whole", "IF(id % 7 = 0, NULL, POW(id % 50, 2) / 3) AS part", "IF(id % 11 = 0, DOUBLE('NaN'), DOUBLE(id % 4)) AS nan",
        "IF(id % 5 = 0, NULL, CONCAT('v', id % 9)) AS word", "STRING(id % 13) AS digits",
        "DATE_ADD(DATE '2024-01-01', INT(id % 40)) AS day", "'same' AS same", "id % 2 = 0 AS flag", "DOUBLE(NULL) AS void",
        "STRING(NULL) AS nothing", "9007199254740993 + id % 3 AS big")
    return rows.unionByName(rows.limit(60))


def as_rows(frame):
    return {r["column_name"]: r.asDict() for r in frame.collect()}


FIELDS = ("row_count", "non_null", "missing", "mean", "std", "min", "max", "skewness", "kurtosis", "zero_count", "negative_count",
          "positive_count", "infinite_count", "min_length", "max_length", "mean_length", "numeric_plain", "moment_like",
          "numeric_loose", "date_like", "numeric_comma", "min_moment", "max_moment", "bytes")


def near(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or a == pytest.approx(b, rel=1e-9, abs=1e-9)
    return a == b


def test_state_says_what_the_statistics_say(df):
    got = as_rows(state.finished(state.column_state(df)))
    want = as_rows(column_stats(df, ["moments", "shape", "signs", "length", "parse", "inconsistency", "comma_numeric", "moments_in_time", "bytes"]))
    assert set(got) == set(want) == set(df.columns)
    for name, row in want.items():
        for field in FIELDS if name != "big" else FIELDS[:3]:
            assert near(got[name][field], row[field]), (name, field, got[name][field], row[field])


def test_states_of_slices_add_up(df):
    slices = [state.column_state(df.where(c)) for c in ("whole < 10", "whole >= 10 AND whole < 400", "whole >= 400", "whole < 0")]
    merged = slices[0]
    for s in slices[1:]:
        merged = merged.unionByName(s)
    got, want = as_rows(state.finished(state.merged_states(merged))), as_rows(state.finished(state.column_state(df)))
    for name, row in want.items():
        for field in (*FIELDS, "distinct_count", "least_value"):
            if name == "big" and field in ("mean", "std", "skewness", "kurtosis"):
                continue  # its values differ by less than a double near them resolves
            assert near(got[name][field], row[field]), (name, field, got[name][field], row[field])


def test_distinct_sketch_is_near(spark):
    df = spark.range(0, 200_000, 1, 6).selectExpr("id", "id % 100 AS few", "STRING(id % 50000) AS t", "ARRAY(id % 10) AS a",
                                                  "IF(id % 3 = 0, NULL, id / 7) AS d", "DOUBLE(NULL) AS void")
    exact = {r[0]: r[1] for r in frequency.distinct_counts(df).collect()}
    about = {r[0]: r[1] for r in frequency.distinct_counts(df, approx=True).collect()}
    assert set(exact) == set(about) and "void" not in about
    for name, n in exact.items():
        assert abs(about[name] - n) <= 0.04 * n, name
    assert about["few"] == 100 and about["a"] == 10


@pytest.mark.parametrize("approx", [False, True])
def test_assessment_says_what_the_operators_say(df, approx):
    assessed = state.assess(df, approx)
    counts = frequency.row_counts(df).first()
    assert tuple(assessed.table.first())[:3] == tuple(counts)
    got = as_rows(assessed.columns)
    want = as_rows(quality.column_profile(df))
    for name, row in want.items():
        for field in ("row_count", "non_null", "missing", "least_value", "numeric_loose", "date_like", "mean", "std")[:6 if name == "big" else 8]:
            assert near(got[name][field], row[field]), (name, field)
        if not approx:
            assert got[name]["distinct_count"] == row["distinct_count"], name
            for field in ("q25", "q75"):
                assert near(got[name][field], row[field]), (name, field)
            assert (got[name]["z_outliers"], got[name]["iqr_outliers"]) == (row["z_outliers"] or 0, row["iqr_outliers"] or 0)
    if not approx:
        rows = lambda frame: sorted(map(str, frame.collect()))
        assert rows(quality.all_issues(df, assessed=assessed)) == rows(quality.all_issues(df))
        assert rows(quality.scores(df, assessed=assessed)) == rows(quality.scores(df))
        assert rows(recommend.all_recommendations(df, assessed=assessed)) == rows(recommend.all_recommendations(df))


def test_assessment_of_nothing(spark):
    empty = spark.createDataFrame([], "a double, b string")
    assessed = state.assess(empty)
    assert tuple(assessed.table.first()) == (0, 0, 0, 0)
    assert [(r["column_name"], r["row_count"], r["distinct_count"]) for r in assessed.columns.collect()] == [("a", 0, 0), ("b", 0, 0)]
    assert quality.all_issues(empty, assessed=assessed).count() == 0


def test_fingerprint_follows_the_data_alone(spark, df):
    one = results.fingerprint(df)
    assert one == results.fingerprint(df.repartition(7).orderBy(F.desc("digits")))
    assert one != results.fingerprint(df.withColumn("part", F.when(F.col("whole") == 3, 1.5).otherwise(F.col("part"))))
    assert one != results.fingerprint(df.unionByName(df.limit(1)))
    assert one != results.fingerprint(df.where("whole != 599"))
    assert one != results.fingerprint(df.withColumnRenamed("word", "words"))
    assert results.fingerprint(df.limit(0)) != results.fingerprint(df.limit(0).drop("day"))


def test_rows_of_one_language_are_moved_by_many_tasks(spark, monkeypatch):
    """The other order of the rows is not made by a column of few values."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "'en' AS lang")
    moved, count = [], results.fingerprints
    monkeypatch.setattr(results, "fingerprints", lambda d: moved.append(d) or count(d))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r["kind"]: r["equal"] for r in entry.same_fingerprints(docs).collect()}
        assert found == {"same": True, "repeated": False, "changed": False}
        held = [r["count"] for d in moved for r in d.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(moved) == 4 and sum(held) == 4 * 4000 + 1 and max(held) <= 2000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_slice_without_values_unites_with_others(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "i int, s string")
    slices = [state.column_state(df.where(c)) for c in ("i > 3", "i = 1", "i > 1")]
    for order in (slices, slices[::-1]):
        merged = order[0].unionByName(order[1]).unionByName(order[2])
        got = as_rows(state.finished(state.merged_states(merged)))
        assert (got["i"]["distinct_count"], got["s"]["distinct_count"], got["s"]["missing"]) == (3, 2, 1)
