import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prepkit.operators import broadcasts
from prepkit.operators import transform as tr
from prepkit.operators.transform import Params
from prepkit.plans import pipeline
from prepkit.plans.pipeline import Dataset, Step, replay
from tests.conftest import column


def test_all_twenty_types_are_listed():
    menu = tr.transformation_types()
    assert sum(len(v) for v in menu.values()) == 20 and len(menu) == 5


def test_unknown_type(numbers):
    with pytest.raises(ValueError):
        tr.transform(numbers([1.0]), "no_such_type")


def test_onehot_with_null(spark):
    df = spark.createDataFrame(list(enumerate(["b", "a", None, "c"])), "i int, k string")
    out = tr.transform(df, "encode_onehot", Params(columns=["k"])).orderBy("i")
    assert out.columns == ["i", "k_b", "k_c"]
    assert [tuple(r)[1:] for r in out.collect()] == [(True, False), (False, False), (False, False), (False, True)]


def test_onehot_of_very_many_values(spark):
    many = spark.range(2_001).selectExpr("id AS i", "concat('v', id) AS k")
    out = tr.transform(many, "encode_onehot", Params(columns=["k"], onehot_form="index"))
    places = {r["i"]: r["k_hot"] for r in out.collect()}
    order = sorted(range(2_001), key=lambda i: f"v{i}")
    assert places == {i: None if n == 0 else n - 1 for n, i in enumerate(order)}
    assert len(tr.transform(many.limit(60), "encode_onehot", Params(columns=["k"])).columns) == 60


def test_constant_of_another_type_is_an_error(spark):
    df = spark.createDataFrame([(1, "a"), (None, None)], "n bigint, k string")
    with pytest.raises(ValueError):
        tr.transform(df, "impute_constant", Params(columns=["k", "n"], constant_value="Unknown"))


def test_modes_of_all_types_in_one_go(spark):
    df = spark.createDataFrame([(2, 1.5, "b"), (10, 1.5, "a"), (10, 0.5, "b"), (2, None, "a"), (None, None, None)],
                               "n int, v double, k string")
    assert tr.modes_of(df, ["n", "v", "k"]) == {"n": "2", "v": "1.5", "k": "a"}


def test_dedup_of_texts_shuffles_digests(spark):
    df = spark.createDataFrame([("x" * 200, None), ("x" * 200, None), ("y", 1.0)], "t string, v double")
    out = tr.transform(df, "remove_duplicates", Params())
    assert out.count() == 2 and out.columns == ["t", "v"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__digest" in plan and "hashpartitioning(t" not in plan


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 2])
@pytest.mark.parametrize("small", [1 << 25, 0])
def test_label_with_null(spark, rows_per_bucket, small, monkeypatch):
    monkeypatch.setattr(broadcasts, "SMALL_BYTES", small)
    df = spark.createDataFrame(list(enumerate(["b", "a", None, "c"])), "i int, k string")
    out = tr.transform(df, "encode_label", Params(columns=["k"], rows_per_bucket=rows_per_bucket))
    assert column(out, "k", "i") == [1, 0, -1, 2]


def test_int_with_a_fraction_changes_nothing(texts):
    df, p = texts(["1", "2.5"]), Params(columns=["k"], target_dtype="int")
    assert tr.transform(df, "convert_dtype", p).dtypes == [("k", "string")]
    assert tr.warnings_of(df, "convert_dtype", p)
    whole = tr.transform(texts(["1", "x", "9007199254740993", "2.0"]), "convert_dtype", p)
    assert sorted(column(whole, "k"), key=lambda v: v or 0) == [None, 1, 2, 9007199254740993]


def test_clip_keeps_null(numbers):
    out = tr.transform(numbers([1.0, 2.0, 3.0, 4.0, 100.0, None]), "cap_outliers_iqr", Params(columns=["x"]))
    assert sorted(column(out, "x"), key=lambda v: -1 if v is None else v) == [None, 1.0, 2.0, 3.0, 4.0, 7.0]


@pytest.mark.parametrize("kind", ["remove_outliers_zscore", "remove_outliers_iqr"])
def test_removal_keeps_null_and_constants(numbers, kind):
    assert tr.transform(numbers([0.1] * 3 + [None]), kind, Params(columns=["x"])).count() == 4


def test_removal_refits_on_what_is_left(spark):
    rows = [(float(i % 5), float(i % 7)) for i in range(100)] + [(1000.0, 1000.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert tr.transform(df, "remove_outliers_zscore", Params(columns=["a", "b"])).count() == 100


def test_scaling_a_constant_warns(numbers):
    df = numbers([1.0, 1.0])
    for kind in ("scale_standard", "scale_minmax"):
        assert column(tr.transform(df, kind, Params(columns=["x"])), "x") == [1.0, 1.0]
        assert tr.warnings_of(df, kind, Params(columns=["x"]))
        assert not tr.preview(df, kind, Params(columns=["x"])).can_apply


def test_impute(spark):
    df = spark.createDataFrame([(1, "b"), (None, None), (4, "a")], "n int, s string")
    assert sorted(column(tr.transform(df, "impute_mean", Params(columns=["n", "s"])), "n")) == [1.0, 2.5, 4.0]
    assert sorted(column(tr.transform(df, "impute_mode", Params(columns=["s", "n"])), "s")) == ["a", "a", "b"]
    assert tr.warnings_of(df, "impute_mean", Params(columns=["s"]))
    empty = df.filter("false")
    for kind in ("impute_mean", "impute_median", "impute_mode"):
        assert tr.transform(empty, kind, Params(columns=["n"])).count() == 0


def test_missing_columns_are_skipped(numbers):
    df = numbers([1.0, None])
    for kind in tr.KINDS:
        if kind not in ("drop_rows", "filter_rows"):
            assert tr.transform(df, kind, Params(columns=["nowhere"], order_by=["x"])).count() == 2


def test_fill_without_order_is_refused(numbers):
    with pytest.raises(ValueError):
        tr.transform(numbers([1.0]), "impute_forward_fill", Params(columns=["x"]))


def test_rename_needs_one_column_and_a_name(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert tr.transform(df, "rename_column", Params(columns=["a", "b"], new_name="c")).columns == ["a", "b"]
    assert tr.transform(df, "rename_column", Params(columns=["a"], new_name="c")).columns == ["c", "b"]


def test_same_step_twice_gives_the_same(numbers):
    df = numbers([3.0, None, 5.0, 5.0])
    for kind in ("impute_mean", "remove_duplicates"):
        once, again = (sorted(column(tr.transform(df, kind, Params(columns=["x"])), "x"), key=str) for _ in range(2))
        assert once == again


def test_apply_reports(numbers):
    df = numbers([1.0, None, 3.0])
    out, result = tr.apply(df, "impute_mean", Params(columns=["x"]))
    assert result.success and result.affected_rows == 1
    assert (result.before_stats[0]["missing"], result.after_stats[0]["missing"]) == (1, 0)
    same, failed = tr.apply(df, "filter_rows", Params(filter_condition="nowhere > 1"))
    assert not failed.success and same is df and failed.message.startswith("Failed")


def test_affected_rows(spark):
    rows = [(i, float(i % 10)) for i in range(50)] + [(50, 1e6), (51, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    def affected(kind, **params):
        p = Params(**params)
        return tr.affected_rows(df, tr.transform(df, kind, p), kind, p).first()[0]

    assert affected("impute_constant", columns=["v"], constant_value=0) == 1
    assert affected("remove_outliers_iqr", columns=["v"]) == 1
    assert affected("cap_outliers_iqr", columns=["v"]) == 1
    assert affected("drop_rows", columns=["v"]) == 1
    assert affected("scale_minmax", columns=["v"]) == 52
    assert affected("drop_column", columns=["nowhere"]) == 0


STEPS = [
    Step(kind, Params(columns=columns, order_by=("i",), constant_value=4, target_dtype="float", new_name="w",
                      filter_condition="v > 1 OR v IS NULL"))
    for kind, columns in [(k, ("s",) if k.startswith("encode") else ("v",)) for k in tr.KINDS]]


@pytest.fixture
def small(spark):
    rows = [(1, 1.0, "a"), (2, None, "b"), (3, 3.0, None), (3, 3.0, None), (5, 8.0, "a")]
    return spark.createDataFrame(rows, "i int, v double, s string")


def as_set(df):
    return sorted(map(tuple, df.collect()), key=str)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from(STEPS), max_size=4))
def test_replay_of_a_saved_pipeline_equals_its_steps(spark, small, steps):
    dataset = Dataset(small)
    for s in steps:
        dataset = dataset.apply(s.kind, s.params)
    if not steps:
        with pytest.raises(ValueError):
            pipeline.saved_row(spark, "p", "empty", steps)
        return
    row = pipeline.saved_row(spark, "p", "mine", steps, tags=["t"])
    loaded = pipeline.load_steps(row, "p")
    assert json.loads(row.first()["steps"]) == [s.to_dict() for s in steps] and loaded == steps
    out, report = replay(small, loaded, materialise_every=2)
    assert as_set(out) == as_set(dataset.table) and all(r["success"] for r in report)


def test_undo_and_clear(small):
    dataset = Dataset(small).apply("impute_mean", Params(columns=("v",))).apply("remove_duplicates")
    assert dataset.version == 2 and dataset.history().count() == 2
    back = dataset.undo()
    assert back.version == 1 and back.table.count() == 5 and back.history().count() == 1
    assert dataset.clear().version == 0 and as_set(dataset.clear().table) == as_set(small)
    with pytest.raises(ValueError):
        dataset.apply("no_such_type")


def test_a_failing_step_is_reported_and_skipped(small):
    mean = Step("impute_mean", Params(columns=("v",)))
    out, report = replay(small, [Step("filter_rows", Params(filter_condition="nowhere = 1")), mean])
    assert [r["success"] for r in report] == [False, True]
    assert out.filter("v IS NULL").count() == 0


def test_a_step_that_fails_at_run_time_is_reported(small):
    steps = [Step("filter_rows", Params(filter_condition="v / (i - i) > 1")), Step("remove_duplicates")]
    out, report = replay(small, steps, checked=True)
    assert [(r["success"], r.get("rows_after")) for r in report] == [(False, None), (True, 4)]
    assert "DIVIDE_BY_ZERO" in report[0]["error"] and out.count() == 4


def test_log_is_written_while_steps_are_applied(spark, tmp_path):
    from prepkit.plans.pipeline import apply_logged, read_log
    df = spark.createDataFrame([(1, 1.0, "a"), (1, 1.0, "a"), (2, None, "b"), (3, 5.0, None), (4, 900.0, "b")] + [
        (i, float(i % 7), "c") for i in range(5, 40)], "id long, v double, s string")
    steps = [Step("remove_duplicates"), Step("impute_median", Params(columns=("v", "s"))), Step("cap_outliers_iqr", Params(columns=("v",))),
             Step("drop_rows", Params(columns=("s",))), Step("encode_label", Params(columns=("s",)))]
    out = apply_logged(df, steps, str(tmp_path), "d")
    dataset = Dataset(df)
    for s in steps:
        dataset = dataset.apply(s.kind, s.params)
    assert as_set(out) == as_set(dataset.table)
    fields = ["sequence_order", "transformation_type", "columns", "affected_rows", "rows_after"]
    rows = lambda f: sorted(tuple(r) for r in f.select(*fields).collect())
    assert rows(read_log(spark, str(tmp_path), "d")) == rows(dataset.history())
    assert read_log(spark, str(tmp_path), "other").count() == 0


def test_limits_are_fitted_once_in_a_step(spark, monkeypatch):
    from prepkit.operators import transform as tr
    calls = []
    fit = tr.quantiles
    monkeypatch.setattr(tr, "quantiles", lambda df, names, *a, **k: calls.append(names) or fit(df, names, *a, **k))
    df = spark.createDataFrame([(float(i),) for i in range(30)] + [(900.0,)], "v double")
    _, result = tr.apply(df, "cap_outliers_iqr", Params(columns=("v",)))
    assert result.affected_rows == 1 and calls == [["v"], ["v"], ["v"]]  # the limits, then the medians before and after


def test_a_bug_is_not_a_failed_step(spark, monkeypatch):
    from prepkit.operators import transform as tr
    monkeypatch.setattr(tr, "affected_rows", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        tr.apply(spark.range(3), "drop_rows", Params(columns=("id",)))


def test_too_many_values_for_a_column_each(spark, monkeypatch):
    from prepkit.operators import transform as tr
    monkeypatch.setattr(tr, "MOST_ONEHOT", 9)
    df = spark.range(10).selectExpr("STRING(id) AS k")
    with pytest.raises(ValueError, match="onehot_form='index'"):
        tr.transform(df, "encode_onehot", Params(columns=("k",)))
    assert tr.transform(df.limit(9), "encode_onehot", Params(columns=("k",))).count() == 9
    assert tr.transform(df, "encode_onehot", Params(columns=("k",), onehot_form="index")).count() == 10


def test_results_follow_the_data(spark, tmp_path):
    from prepkit.plans import results
    path, runs = str(tmp_path / "results"), []
    now = F.lit("2024-01-02 08:00:00").cast("timestamp_ntz")
    df = spark.range(20).withColumn("v", F.col("id") * 2)

    def served(frame, at=now):
        rows, was_there = results.served(frame, path, "d", "counts", lambda d: runs.append(1) or d.groupBy().count(), at)
        return [r["results"] for r in rows.collect()], was_there

    assert served(df) == (['{"count":20}'], False) and served(df.repartition(3)) == (['{"count":20}'], True)
    changed = df.withColumn("v", F.when(F.col("id") == 7, 0).otherwise(F.col("v")))
    assert served(changed)[1] is False and served(df)[1] is True
    assert served(df, now + F.expr("INTERVAL 2 DAYS"))[1] is False and len(runs) == 3
