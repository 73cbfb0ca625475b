import math

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from prepkit.functions import parsing
from prepkit.functions.columns import chunks, nan_to_null
from prepkit.operators import metadata, profile
from prepkit.operators.frequency import distinct_counts, row_counts
from prepkit.operators.stats import MEASURES, column_stats
from tests.conftest import by_column


def test_one_value(numbers):
    row = profile.numeric_profile(numbers([1.0])).first()
    assert (row["std"], row["skewness"], row["kurtosis"], row["median"]) == (0.0, 0.0, 0.0, 1.0)


def test_constant(numbers):
    row = profile.numeric_profile(numbers([1.0] * 4)).first()
    assert (row["std"], row["skewness"], row["kurtosis"]) == (0.0, 0.0, 0.0)


def test_nan_and_null_are_both_missing(numbers):
    row = profile.numeric_profile(numbers([float("nan"), 1.0, None])).first()
    assert (row["missing_count"], row["unique_count"], row["mean"]) == (2, 1, 1.0)


def test_infinities_are_counted(numbers):
    row = profile.numeric_insights(numbers([1.0, math.inf, -math.inf])).first()
    assert row["infinite_count"] == 2


def test_mode_tie_goes_to_the_smaller(texts):
    assert profile.string_profile(texts(["b", "a", "b", "a"])).first()["mode"] == "a"


@pytest.mark.parametrize("text,numeric", [
    ("1", True), ("1.5", True), (" 3 ", True), ("1e5", True), (".5", True), ("5.", True), ("+4", True),
    ("1d", False), ("nan", False), ("inf", False), ("1_000", False), ("-", False), ("abc", False), ("", False)])
def test_what_is_a_number(texts, text, numeric):
    df = texts([text])
    assert df.select(parsing.looks_numeric(df.k)).first()[0] is numeric
    assert (df.select(parsing.to_number(df.k)).first()[0] is not None) is numeric


def test_elapsed_days_are_whole(texts):
    row = metadata.datetime_stats(texts(["2024-01-01 23:00:00", "2024-01-03 01:00:00"])).first()
    assert row["range_days"] == 1


def test_semantic_types(spark):
    rows = [(i, i / 2, i % 2 == 0, f"{i}", f"2024-01-{i + 1:02d}", "ab"[i % 2], f"text {i}", None) for i in range(25)]
    df = spark.createDataFrame(rows, "i long, f double, b boolean, n string, d string, c string, t string, e string")
    found = {k: v["semantic_type"] for k, v in by_column(metadata.semantic_types(df)).items()}
    assert found == {"i": "integer", "f": "float", "b": "boolean", "n": "numeric_string", "d": "datetime_string",
                     "c": "categorical", "t": "text", "e": "empty"}


def test_simple_table(spark):
    df = spark.createDataFrame([("John", 25, None), ("Jane", None, "LA"), (None, 30, "Chicago")],
                               "name string, age int, city string")
    row = metadata.dataset_summary(df).first()
    assert (row["row_count"], row["column_count"], row["missing_cells"], row["duplicate_rows"]) == (3, 3, 3, 0)


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, b string")
    assert profile.quality_score(df.select("a")).first()["score"] == 100.0
    assert metadata.dataset_summary(df).first()["missing_percent"] == 0.0
    assert profile.numeric_profile(df).first()["mean"] is None


def test_rows_with_nested_and_odd_cells(spark):
    schema = "a array<int>, m map<string,int>, s struct<x:int>, b binary, d decimal(5,2)"
    import decimal
    row = ([1, None], {"k": 1, "j": 2}, (1,), bytearray(b"\xff"), decimal.Decimal("1.50"))
    other = ([1], {"k": 1}, (1,), None, None)
    counts = row_counts(spark.createDataFrame([row, row, other], schema)).first()
    assert (counts["row_count"], counts["distinct_rows"]) == (3, 2)
    measured = column_stats(spark.createDataFrame([row, other], schema), list(MEASURES))
    assert measured.count() == 5


def test_rows_that_only_look_alike_stay_apart(spark):
    rows = [("a", "b:"), ("a:", "b"), (None, "~"), ("~", None), ("", None), (None, ""), ("1:a", "")]
    assert row_counts(spark.createDataFrame(rows, "x string, y string")).first()["duplicate_rows"] == 0
    zeros = spark.createDataFrame([(0.0, "x"), (-0.0, "x"), (float("nan"), "x"), (None, "x")], "v double, t string")
    assert row_counts(zeros).first()["distinct_rows"] == 2


def test_long_texts_are_told_apart(texts):
    long = "x" * 5000
    assert distinct_counts(texts([long, long, long + "y", "x" * 48, "x" * 49])).first()["distinct_count"] == 4


def test_wide_table_is_split(spark):
    df = spark.createDataFrame([tuple(float(i * j) for j in range(120)) for i in range(5)],
                               T.StructType([T.StructField(f"c {i}.x`", T.DoubleType()) for i in range(120)]))
    found = by_column(column_stats(df, ["moments"]))
    assert len(found) == 120 and found["c 119.x`"]["max"] == 4.0 * 119
    assert [len(c) for c in chunks(list(range(5)), lambda _: 40)] == [2, 2, 1]


def test_footprint_adds_up(spark):
    df = spark.createDataFrame([("ab", 1), ("c", None)], "t string, n int")
    rows = profile.column_footprint(df).collect()
    assert sum(r["bytes"] for r in rows) == rows[0]["total_bytes"] == 3 + 8
    assert [r["column_name"] for r in rows if r["is_largest"]] == ["n"]


def test_unknown_column(numbers):
    with pytest.raises(ValueError):
        profile.column_lookup(numbers([1.0]), "nowhere")
    assert profile.column_lookup(numbers([1.0]), "x").count() == 1


def test_many_tables_with_one_that_cannot_be_profiled(numbers, texts):
    frame, report = profile.profile_tables({"good": numbers([1.0, 2.0]), "bad": texts(["a"])})
    assert frame.count() == 1 and report["success_rate"] == 50.0 and list(report["failed"]) == ["bad"]


CELL = st.one_of(st.none(), st.just(float("nan")), st.floats(-1000, 1000), st.integers(-5, 5).map(float))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(st.tuples(CELL, st.one_of(st.none(), st.text("ab1 ", max_size=4))), min_size=1, max_size=40))
def test_profile_properties(spark, rows):
    df = nan_to_null(spark.createDataFrame(rows, "n double, s string"))
    pdf = pd.DataFrame(rows, columns=["n", "s"])
    numeric, text = profile.numeric_profile(df).first(), profile.string_profile(df).first()
    assert numeric["count"] == text["count"] == len(rows)
    assert numeric["missing_count"] == pdf.n.isna().sum() and text["missing_count"] == pdf.s.isna().sum()
    assert numeric["unique_count"] == (pdf.n.dropna() + 0.0).nunique() and text["unique_count"] == pdf.s.nunique()
    if pdf.n.notna().any():
        assert numeric["min"] <= numeric["q25"] <= numeric["median"] <= numeric["q75"] <= numeric["max"]
    if pdf.s.notna().any():
        assert text["min_length"] <= text["max_length"]
        assert text["mode"] == pdf.s.mode()[0]
    assert 0 <= profile.quality_score(df).first()["score"] <= 100
    assert all(0 <= r["uniqueness_ratio"] <= 1 for r in profile.uniqueness(df).collect())
    assert row_counts(df).first()["duplicate_rows"] == pdf.duplicated().sum()


@pytest.mark.parametrize("most", [10_000, 0])
def test_top_texts_with_equal_heads(texts, monkeypatch, most):
    from prepkit.operators import frequency
    monkeypatch.setattr(frequency, "MOST_CANDIDATES", most)
    head = "h" * 60
    values = [head + c for c in "dcba"] * 2 + ["z"] * 3 + [head + "e"]
    rows = frequency.top_values(texts(values), k=3).orderBy("rank").collect()
    assert [(r["value"], r["n"]) for r in rows] == [("z", 3), (head + "a", 2), (head + "b", 2)]


def test_top_texts_are_those_of_pandas(texts):
    import random
    random.seed(2)
    values = [random.choice("xyz") * random.choice([1, 47, 48, 49, 200]) for _ in range(300)]
    counts = pd.Series(values).value_counts()
    want = sorted(((-n, v) for v, n in counts.items()))[:5]
    rows = profile.top_text_values(texts(values)).orderBy("rank").collect()
    assert [(-r["n"], r["value"]) for r in rows] == want
