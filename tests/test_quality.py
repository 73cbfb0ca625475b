import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from prepkit.operators import charts, frequency, quality, recommend
from tests.conftest import by_column


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, b string")
    row = quality.scores(df).first()
    assert (row["completeness"], row["uniqueness"]) == (100.0, 100.0)
    assert quality.all_issues(df).count() == 0
    assert recommend.all_recommendations(df).count() == 1  # a text column can be encoded


def test_negative_mean_is_not_low_variance(numbers):
    df = numbers([-1.0, -100.0, -50.0])
    assert quality.issues_of(df, "low_variance").count() == 0


def test_constant_has_no_outliers(numbers):
    found = [r["issue_type"] for r in quality.all_issues(numbers([0.1] * 20)).collect()]
    assert found.count("constant_column") == 1 and "outliers" not in found


def test_too_few_values_have_no_outliers(numbers):
    assert quality.issues_of(numbers([1.0] * 8 + [1e9]), "outliers").count() == 0


def test_highest_severity_is_by_rank(spark):
    rows = [(None if i < 60 else 1.0 * i, None if i < 10 else 1.0 * i) for i in range(100)]
    first = quality.prioritized(quality.detected(spark.createDataFrame(rows, "a double, b double"))).first()
    assert (first["issue_type"], first["issue_count"], first["highest_severity"]) == ("missing_values", 3, "critical")


def test_ids_follow_detection_and_order_follows_severity(spark):
    rows = [(i, None if i < 3 else "x", None if i < 60 else 1.0) for i in range(100)]
    issues = quality.all_issues(spark.createDataFrame(rows, "i int, s string, v double")).orderBy("display_order").collect()
    assert [r["severity"] for r in issues] == sorted(
        (r["severity"] for r in issues), key=quality.SEVERITIES.index)
    assert sorted(r["issue_id"] for r in issues) == [f"QI-{n:04d}" for n in range(1, len(issues) + 1)]
    assert issues[0]["issue_id"] == "QI-0002" and issues[0]["column_name"] == "v"


def test_duplicates_of_an_identifier(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 3), (None, 4)], "user_id int, n int")
    row = quality.issues_of(df, "duplicates").first()
    assert (row["column_name"], row["affected_rows"]) == ("user_id", 2)


def test_first_repeated_values(spark):
    rows = [(1, "a"), (2, None), (3, "a"), (4, "b"), (5, None), (5, None), (6, "a"), (7, "c")]
    found = quality.id_duplicate_samples(spark.createDataFrame(rows, "k int, code string"), "code", ["k"], 3)
    assert [tuple(r) for r in found.collect()] == [(3, "a"), (5, None), (5, None)]


def test_first_outliers_in_order(spark):
    rows = [(i, 0.0 if i % 2 else 1.0) for i in range(500)] + [(1000 + i, 1e6 + i) for i in range(4)]
    found = quality.outlier_samples(spark.createDataFrame(rows, "k long, v double"), ["k"], 3)
    assert [r["value"] for r in found.filter("column_name = 'v'").orderBy("rank").collect()] == [1e6, 1e6 + 1, 1e6 + 2]


def test_score_band(spark):
    df = spark.createDataFrame([(85.0,), (60.0,), (10.0,)], "s double")
    assert [r[0] for r in df.select(quality.score_band(df.s)).collect()] == ["high", "medium", "low"]


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.1), (2.0, 4.0, 0.1), (3.0, None, 0.1), (4.0, 9.0, 0.1)],
                               "a double, b double, c double")
    r = {(x["column_a"], x["column_b"]): x["r"] for x in charts.correlation(df).collect()}
    want = pd.DataFrame({"a": [1.0, 2, 3, 4], "b": [2.0, 4, None, 9]}).corr().loc["a", "b"]
    assert abs(r["a", "b"] - want) < 1e-12 and r["a", "b"] == r["b", "a"] and r["a", "c"] is None


def test_rank_correlation_is_that_of_pandas(spark):
    """Each pair over the rows in which both have a value, also when a third column has gaps."""
    rng = random.Random(3)
    rows = [tuple(None if rng.random() < share else float(rng.randint(0, 9)) for share in (0, 0, 0.2, 0.4)) for _ in range(40)]
    found = charts.rank_correlation(
        spark.createDataFrame(rows, "a double, b double, c double, d double"), rows_per_bucket=4)
    expected = pd.DataFrame(rows, columns=list("abcd"), dtype=float).corr(method="spearman")
    assert found.count() == 16
    for r in found.collect():
        assert r["r"] == pytest.approx(expected.loc[r["column_a"], r["column_b"]])


def test_rank_correlation_with_one_gap(spark):
    rows = [(1.0, 4.0, 1.0), (2.0, 6.0, 2.0), (3.0, 1.0, 3.0), (4.0, 5.0, 4.0), (5.0, 7.0, 5.0), (6.0, 8.0, None)]
    found = charts.rank_correlation(spark.createDataFrame(rows, "a double, b double, c double"))
    assert found.filter("column_a = 'a' AND column_b = 'b'").first()["r"] == pytest.approx(
        pd.DataFrame(rows, columns=list("abc"))[["a", "b"]].corr(method="spearman").iloc[0, 1])


def test_no_column_is_left_out(spark):
    wide = spark.range(30).selectExpr(*[f"(id * {k + 3}) % 17 AS n{k}" for k in range(18)], *[
        f"concat('t', id % {k + 2}) AS t{k}" for k in range(12)])
    assert charts.correlation(wide).count() == 18 * 18
    assert charts.correlation(wide, limit=4).count() == 16
    plan = {(r["chart_type"], r["column_name"]) for r in charts.chart_plan(wide).collect()}
    assert {("histogram", f"n{k}") for k in range(18)} | {("bar_chart", f"t{k}") for k in range(12)} <= plan
    gaps = spark.range(4).selectExpr(*[f"CASE WHEN id = 1 THEN NULL ELSE id END AS g{k}" for k in range(12)])
    first = quality.prioritized(quality.detected(gaps)).filter("issue_type = 'missing_values'").first()
    assert len(first["columns_affected"]) == 12 and len(first["specific_recommendations"]) == first["issue_count"]


def test_infinite_values_are_counted(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1.0, "a"), (2.0, None), (inf, "a"), (-inf, None), (None, "a")], "x double, g string")
    assert {r["bin"]: r["n"] for r in charts.histogram(df, "x", 2).collect()} == {-1: 1, 0: 1, 1: 1, 2: 1}
    assert charts.scatter_grid(df, "x", "x", bins=2).groupBy().sum("n").first()[0] == 4
    held = {(r["group"], r["bin"]): r["n"] for r in charts.violin(df, "x", "g", 2).collect()}
    assert held == {("a", 0): 1, ("a", 2): 1, (None, 1): 1, (None, -1): 1}


def test_top_values_behind_one_long_head(spark):
    """However many texts share a head, a task passes on a few rows per column."""
    head = "h" * 60
    df = spark.range(3_000).selectExpr(f"concat('{head}', lpad(id, 6, '0')) AS t")
    found = frequency.top_values(df, k=3)
    assert [r["value"] for r in found.orderBy("rank").collect()] == [f"{head}{i:06d}" for i in range(3)]
    assert found._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2


def test_histogram_edges(numbers):
    rows = charts.histogram(numbers([0.0, 1.0, 30.0]), "x").orderBy("bin").collect()
    assert len(rows) == 30 and rows[29]["n"] == 1 and sum(r["n"] for r in rows) == 3
    assert sum(r["n"] for r in charts.histogram(numbers([2.0, 2.0]), "x").collect()) == 2
    assert charts.histogram(numbers([None]), "x").count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(st.tuples(
    st.one_of(st.none(), st.floats(-100, 100)), st.one_of(st.none(), st.sampled_from(["a", "7", "x-1"])),
    st.integers(0, 2)), min_size=1, max_size=40))
def test_quality_properties(spark, rows):
    df = spark.createDataFrame(rows, "v double, s string, code int")
    pdf = pd.DataFrame(rows, columns=["v", "s", "code"])
    issues = quality.all_issues(df).collect()
    assert all(r["severity"] in quality.SEVERITIES and 0 <= r["affected_percentage"] <= 100 for r in issues)
    summary = quality.issue_summary(quality.detected(df)).first()
    assert summary["total_issues"] == len(issues) == sum(summary[s] for s in quality.SEVERITIES)
    gaps = {r["column_name"]: r["affected_rows"] for r in issues if r["issue_type"] == "missing_values" and r["column_name"]}
    assert gaps == {c: int(n) for c, n in pdf.isna().sum().items() if n}
    copies = [r["affected_rows"] for r in issues if r["issue_type"] == "duplicates" and r["column_name"] is None]
    assert copies == ([int(pdf.duplicated().sum())] if pdf.duplicated().any() else [])
    assert all(0 <= x <= 100 for x in quality.scores(df).first())
    assert set(by_column(quality.column_quality(df))) == {"v", "s", "code"}


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 40])
def test_rank_correlation_with_gaps_is_that_of_pandas(spark, rows_per_bucket):
    """Three columns with gaps, two without, one constant, one without any value; many ties."""
    rng = np.random.default_rng(4)
    n = 300
    base = rng.normal(size=n)
    frame = pd.DataFrame({
        "a": np.where(rng.random(n) < 0.3, np.nan, np.round(base, 1)), "b": np.where(rng.random(n) < 0.5, np.nan, base + rng.normal(size=n)),
        "c": np.where(base > 0.5, np.nan, np.floor(base * 3)), "d": rng.integers(0, 5, n).astype(float), "e": base ** 3,
        "flat": 1.0, "void": np.nan})
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None).values.tolist(), ", ".join(f"{c} double" for c in frame))
    got = {(r.column_a, r.column_b): r.r for r in charts.rank_correlation(df, rows_per_bucket=rows_per_bucket).collect()}
    assert len(got) == 49
    for a in frame:
        for b in frame:
            pair = frame[[a, b]].dropna() if a != b else frame[[a]].dropna()
            want = pair[a].rank().corr(pair[b].rank()) if len(pair) > 1 else np.nan
            assert got[a, b] is None if np.isnan(want) else got[a, b] == pytest.approx(want, abs=1e-9)


def test_rank_correlation_sorts_each_column_once(spark):
    df = spark.range(50).selectExpr(*[f"IF(id % {k} = 0, NULL, id * {k} % 17) AS c{k}" for k in (2, 3, 5, 7)])
    plan = charts.rank_correlation(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 4 and plan.count("Join ") == 4
