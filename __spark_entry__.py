"""

``queries()`` are thin calls into the package. ``oracle_sql()`` is in
``prepkit/oracle.py``, which states each result in plain SQL.
"""

from __future__ import annotations

import os
import sys
import tempfile
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from prepkit.functions.columns import union_all  # noqa: E402
from prepkit.operators import charts, frequency, metadata, profile, quality, recommend, state  # noqa: E402
from prepkit.operators import transform as tr  # noqa: E402
from prepkit.plans import catalog, results  # noqa: E402
from prepkit.plans.pipeline import Dataset, Step, apply_logged, read_log, replay  # noqa: E402
from prepkit.sources import delimited  # noqa: E402
from prepkit.sources.tables import read_parquet, scratch_path  # noqa: E402
from prepkit.oracle import DIRTY_EVENTS, SPARSE_CUSTOMERS, oracle_queries  # noqa: E402

try:
    from prepkit.llm import queries as llm
except ImportError as error:
    if error.name not in ("prepkit.llm", "prepkit.llm.queries", "prepkit", "corpus_pipeline"):
        raise
    llm = None

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, os.path.join(sf_dir, f"{name}.parquet"))


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = f"WITH {DIRTY_EVENTS} SELECT * FROM events_dirty".replace("FROM events)", "FROM {events})")
    return spark.sql(text, events=table(spark, sf_dir, "events"))


def sparse_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = f"WITH {SPARSE_CUSTOMERS} SELECT * FROM customer_sparse".replace(
        "FROM customer)", "FROM {customer})")
    return spark.sql(text, customer=table(spark, sf_dir, "customer"))


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select([F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def on(name: str, run: Callable[[DataFrame], DataFrame], digits: int = 4) -> Query:
    """A query over one driver table, or over one of the two dirty views."""
    views = {"events_dirty": dirty_events, "customer_sparse": sparse_customers}

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        source = views[name](spark, sf_dir) if name in views else table(spark, sf_dir, name)
        return rounded(run(source), digits)

    return query


def step(name: str, kind: str, **params) -> Query:
    """A transformation of a whole table, with all its columns."""
    return on(name, lambda df: tr.transform(df, kind, tr.Params(**params)))


def joined(df: DataFrame, *lists: str) -> DataFrame:
    """Lists as text, for comparison."""
    return df.select([F.array_join(c, "|").alias(c) if c in lists else F.col(c) for c in df.columns])


def detailed(df: DataFrame, **casts: str) -> DataFrame:
    """Issues with some of their details as columns."""
    return df.select(
        "issue_type", "severity", "column_name", "affected_rows", "affected_percentage",
        *[F.col("details")[k].cast(t).alias(k) for k, t in casts.items()])


PIPELINE = (
    Step("remove_duplicates"),
    Step("impute_median", tr.Params(columns=("value",))),
    Step("cap_outliers_iqr", tr.Params(columns=("value",))),
    Step("encode_label", tr.Params(columns=("event_type",))),
)
PIPELINE_COLUMNS = ["event_id", "event_type", "value", "mixed"]
NUMERIC_TABLES = ["customer", "supplier", "part", "orders"]


def with_steps(df: DataFrame) -> Dataset:
    dataset = Dataset(df)
    for s in PIPELINE:
        dataset = dataset.apply(s.kind, s.params)
    return dataset


def outlier_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = {
        "events": table(spark, sf_dir, "events"),
        "documents": table(spark, sf_dir, "documents").select("n_chars"),
        "labels": table(spark, sf_dir, "labels"),
    }
    return union_all([
        detailed(
            quality.issues_of(df, "outliers"), z_score_outliers="bigint", iqr_outliers="bigint",
            mean="double", std="double", q1="double", q3="double", iqr="double",
            lower_bound="double", upper_bound="double").withColumn("table_name", F.lit(name))
        for name, df in sources.items()])


def outlier_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = {"events": table(spark, sf_dir, "events").select("value"),
               "documents": table(spark, sf_dir, "documents").select("n_chars")}
    return rounded(union_all([
        recommend.for_outliers(df).select(
            "column_name", "priority", "affected_rows", "affected_percentage")
        for df in sources.values()]))


def multi_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.multi_table_profile({t: table(spark, sf_dir, t) for t in NUMERIC_TABLES}))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(union_all([
        charts.box_plot(table(spark, sf_dir, "events"), ["value"]),
        charts.box_plot(table(spark, sf_dir, "documents"), ["n_chars"])]))


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as CSV with all sorts of missing tokens, and read back."""
    k = F.col("c_custkey")
    text = table(spark, sf_dir, "customer").select(
        k,
        F.when(k % 8 == 0, "NULL").when(k % 9 == 0, "n/a").when(k % 10 == 0, "").otherwise(F.col("c_name"))
        .alias("c_name"),
        F.when(k % 7 == 0, "NaN").otherwise(F.col("c_nationkey").cast("string")).alias("c_nationkey"),
        F.when(k % 11 == 0, "#NULL!").otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"),
        "c_mktsegment")
    path = scratch(spark, "customer-csv")
    delimited.write_csv(text, path)
    return rounded(delimited.read_csv(spark, path))


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the cluster's shared folder; where none is set, as in a local run, one is made."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        return os.path.join(tempfile.mkdtemp(prefix="prepkit-"), name)
    return scratch_path(spark, name)


def csv_of_many_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in two sets of CSV files whose headers order the columns differently, one of
    them without the balance; columns are matched by name."""
    suppliers = table(spark, sf_dir, "supplier")
    path = scratch(spark, "supplier-csv")
    odd = F.col("s_suppkey") % 2 == 1
    delimited.write_csv(suppliers.filter(odd).select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), f"{path}/odd")
    delimited.write_csv(suppliers.filter(~odd).select("s_nationkey", "s_suppkey", "s_name"), f"{path}/even")
    return rounded(delimited.read_csv(spark, [f"{path}/odd", f"{path}/even"]))


def checked_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of steps of which one fails when planned and one when run."""
    steps = [
        Step("remove_duplicates"),
        Step("impute_constant", tr.Params(columns=("user_id",), constant_value="Unknown")),
        Step("filter_rows", tr.Params(filter_condition="value / (user_id - user_id) > 1")),
        Step("filter_rows", tr.Params(filter_condition="value > 20")),
    ]
    _, report = replay(dirty_events(spark, sf_dir), steps, checked=True)
    rows = [(i, r["transformation"], r["success"], r.get("rows_after")) for i, r in enumerate(report, 1)]
    return spark.createDataFrame(rows, "step int, transformation string, success boolean, rows_after bigint")


def filtered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_parquet(spark, os.path.join(sf_dir, "orders.parquet"), may_hold_nan=False)
    kept = tr.transform(orders, "filter_rows", tr.Params(
        filter_condition="o_orderstatus = 'F' AND o_totalprice > 100000"))
    return rounded(kept)


def assessed(name: str, read: Callable) -> Query:
    """A report read off an assessment of the table instead of the table."""
    return on(name, lambda df: read(df, state.assess(df)))


def distinct_sketches(df: DataFrame) -> DataFrame:
    """Whether distinct counts by sketch are within 4 % of the exact ones, and exact for few values."""
    about = frequency.approx_distinct_counts(df).withColumnRenamed("distinct_count", "about")
    exact = frequency.distinct_counts(df)
    n = F.col("distinct_count")
    near = F.abs(F.col("about") - n) <= F.when(n <= 200, 0).otherwise(n * 0.04)
    return exact.join(about, "column_name").select("column_name", n, near.alias("near"))


def slices_of_state(df: DataFrame) -> DataFrame:
    """Statistics of the whole from the states of its months, as if each had been stored on its own."""
    months = [state.column_state(df.where(F.month("o_orderdate") == m), ()) for m in (1, 2)]
    months.append(state.column_state(df.where(F.month("o_orderdate") > 2), ()))
    whole = state.finished(state.merged_states(union_all(months)))
    return whole.where("mean IS NOT NULL").select("column_name", "row_count", "non_null", "mean", "std", "min", "max", "skewness")


def step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log that steps leave while they are applied."""
    folder = scratch(spark, "step-log")
    apply_logged(dirty_events(spark, sf_dir), PIPELINE, folder, "events")
    return read_log(spark, folder, "events").select(
        "sequence_order", "transformation_type", "columns", "affected_rows", "rows_after")


def csv_of_many_charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in CSV files of three charsets, told apart file by file and read as one table."""
    text = table(spark, sf_dir, "customer").withColumn("c_name", F.concat(F.lit("é"), "c_name"))
    path = scratch(spark, "charset-csv")
    for i, charset in enumerate(("UTF-8", "UTF-16", "ISO-8859-1")):
        text.where(F.col("c_custkey") % 3 == i).write.options(header=True, escape='"', encoding=charset).csv(f"{path}/{i}")
    return rounded(delimited.read_csv(spark, path, encoding="detect"))


def same_fingerprints(df: DataFrame) -> DataFrame:
    """Fingerprints of a table, of its rows in another order, and of the table with a row repeated
    and with a cell changed: how often each occurs."""
    first = df.agg(F.min("doc_id").alias("least"))
    marked = df.crossJoin(F.broadcast(first))
    repeated = df.unionByName(marked.where("doc_id = least").select(*df.columns))
    changed = marked.withColumn("text", F.when(F.col("doc_id") == F.col("least"), "x").otherwise(F.col("text"))).select(*df.columns)
    # By the rows' places, as many rows share a value of any column.
    moved = df.repartition(F.monotonically_increasing_id())
    kinds = {"same": moved, "repeated": repeated, "changed": changed}
    own = results.fingerprints(df).select(F.col("fingerprint").alias("own"))
    return union_all([results.fingerprints(made).crossJoin(F.broadcast(own)).select(
        F.lit(kind).alias("kind"), "row_count", (F.col("fingerprint") == F.col("own")).alias("equal"))
        for kind, made in kinds.items()])


def stored_results(parts: DataFrame) -> DataFrame:
    """Result rows made from parts: several runs per dataset, some expired, some for ever."""
    created = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        mins=(F.col("p_partkey") % 1500).cast("int"))
    return parts.select(
        F.col("p_brand").alias("dataset_id"), (F.col("p_size") % 3).cast("bigint").alias("dataset_version"),
        F.col("p_type").alias("analysis_type"), F.col("p_partkey").cast("string").alias("results"),
        created.alias("created_at"),
        F.when(F.col("p_partkey") % 7 != 0, created + F.make_dt_interval(hours=F.lit(24))).alias("expires_at"))


def valid_results(parts: DataFrame) -> DataFrame:
    now = F.lit("2024-01-02 08:00:00").cast("timestamp_ntz")
    return results.still_valid(stored_results(parts), now)


def as_catalog(parts: DataFrame) -> DataFrame:
    return parts.select(
        F.col("p_partkey").alias("pipeline_id"), F.col("p_name").alias("pipeline_name"),
        F.col("p_type").alias("description"), F.col("p_brand").alias("category"),
        (F.col("p_partkey") % 3 == 0).alias("is_public"), F.col("p_size").alias("usage_count"))


def queries() -> dict[str, Query]:
    """All queries: the inventory's, and those of the corpus operators if they are here."""
    return core_queries() | (llm.queries() if llm else {})


def core_queries() -> dict[str, Query]:
    """One entry per operator of the inventory."""
    ed = "events_dirty"
    return {
        # sources
        "s_csv_null_tokens": csv_round_trip,
        "s_csv_many_files": csv_of_many_headers,
        "s_csv_many_charsets": csv_of_many_charsets,
        "s_preview": on("customer", lambda d: delimited.preview(d, ["c_custkey"])),
        # metadata
        "m_dataset_summary": on(ed, metadata.dataset_summary),
        "m_semantic_types": on(ed, metadata.semantic_types),
        "m_type_summary": on(ed, metadata.type_summary),
        "m_numeric_stats": on("lineitem", metadata.numeric_stats),
        "m_numeric_text_stats": on(ed, lambda d: metadata.numeric_stats(d.select("num_text", "value", "mixed"))),
        "m_distinct_sketch": on(ed, distinct_sketches),
        "m_merged_slices": on("orders", slices_of_state),
        "m_text_stats": on(ed, metadata.text_stats),
        "m_datetime_stats": on(ed, metadata.datetime_stats),
        # profile
        "p_missing": on("customer_sparse", metadata.missing_by_column),
        "p_completeness": on("customer_sparse", profile.completeness),
        "p_dtype_histogram": on(ed, profile.dtype_histogram),
        "p_uniqueness": on(ed, profile.uniqueness),
        "p_numeric_insights": on(ed, profile.numeric_insights),
        "p_categorical_insights": on(ed, profile.categorical_insights),
        "p_numeric_profile": on("lineitem", profile.numeric_profile),
        "p_string_profile": on("documents", profile.string_profile),
        "p_top_values": on("documents", profile.top_text_values),
        "p_quality_summary": on(ed, profile.quality_summary),
        "p_quality_score": on(ed, profile.quality_score),
        "p_recommendations": on(ed, profile.recommendations),
        "p_column_footprint": on(ed, profile.column_footprint),
        "p_column_lookup": on(ed, lambda d: profile.column_lookup(d, "value")),
        "p_basic_profile": on("orders", profile.basic_profile),
        "p_multi_table": multi_table,
        "p_report_columns": on("orders", lambda d: profile.report_columns(d, ["o_orderkey"])),
        "p_report_overview": on("customer_sparse", profile.report_overview),
        # quality
        "q_missing": on(ed, quality.missing_issues),
        "q_sparse_rows": on("customer_sparse", lambda d: detailed(
            quality.table_issues(d).filter("detector = 2"), rows_affected="bigint")),
        "q_duplicate_rows": on(ed, lambda d: detailed(
            quality.table_issues(d).filter("detector = 3"), duplicate_count="bigint", unique_rows="bigint")),
        "q_duplicate_samples": on(ed, lambda d: quality.duplicate_samples(d, ["event_id"])),
        "q_id_duplicates": on("lineitem", lambda d: detailed(quality.issues_of(d, "duplicates"))),
        "q_id_duplicate_samples": on("orders", lambda d: quality.id_duplicate_samples(
            d, "o_custkey", ["o_orderkey"])),
        "q_outliers": outlier_issues,
        "q_outlier_samples": on("events", lambda d: quality.outlier_samples(d, ["event_id"])),
        "q_type_issues": on(ed, lambda d: detailed(
            quality.issues_of(d, "type_inconsistency", "mixed_types"),
            numeric_values_pct="double", text_values_pct="double")),
        "q_sampled_types": on(ed, quality.type_checks),
        "q_constant": on(ed, lambda d: detailed(
            quality.issues_of(d, "constant_column"), constant_value="string")),
        "q_low_variance": on(ed, lambda d: detailed(
            quality.issues_of(d, "low_variance"), mean="double", std="double", unique_count="bigint")),
        "q_high_cardinality": on("documents", lambda d: detailed(
            quality.issues_of(d, "high_cardinality"),
            unique_count="bigint", cardinality_ratio="double")),
        "q_scores": on(ed, quality.scores),
        "q_all_issues": on(ed, lambda d: quality.all_issues(d).select(
            "issue_id", "display_order", "issue_type", "severity", "column_name", "affected_rows",
            "affected_percentage")),
        "q_assessed_issues": assessed(ed, lambda d, a: quality.all_issues(d, assessed=a).select(
            "issue_id", "display_order", "issue_type", "severity", "column_name", "affected_rows",
            "affected_percentage")),
        "q_assessed_scores": assessed(ed, lambda d, a: quality.scores(d, assessed=a)),
        "q_issue_summary": on(ed, lambda d: quality.issue_summary(quality.detected(d))),
        "q_prioritized": on(ed, lambda d: joined(
            quality.prioritized(quality.detected(d)).withColumn(
                "specific_recommendations", F.size("specific_recommendations")), "columns_affected")),
        "q_column_quality": on(ed, quality.column_quality),
        # transformations
        "t_impute_mean": step(ed, "impute_mean", columns=["value"]),
        "t_impute_median": step(ed, "impute_median", columns=["value", "sparse_user"]),
        "t_impute_mode": step(ed, "impute_mode", columns=["event_type", "value"]),
        "t_impute_constant": step(ed, "impute_constant", columns=["event_type"], constant_value="Unknown"),
        "t_ffill": on(ed, lambda d: tr.transform(d.dropDuplicates(), "impute_forward_fill", tr.Params(
            columns=["value", "event_type"], order_by=["event_id"]))),
        "t_bfill": on(ed, lambda d: tr.transform(d.dropDuplicates(), "impute_backward_fill", tr.Params(
            columns=["value", "event_type"], order_by=["event_id"]))),
        "t_remove_z": step("events", "remove_outliers_zscore", columns=["value", "user_id"]),
        "t_remove_iqr": step("events", "remove_outliers_iqr", columns=["value"]),
        "t_remove_iqr_documents": step("documents", "remove_outliers_iqr", columns=["n_chars"]),
        "t_cap_z": step("events", "cap_outliers_zscore", columns=["value"]),
        "t_cap_iqr": step("events", "cap_outliers_iqr", columns=["value"]),
        "t_onehot": step(ed, "encode_onehot", columns=["event_type"]),
        "t_label": step(ed, "encode_label", columns=["event_type", "mixed"]),
        "t_freq_encode": on(ed, lambda d: tr.frequency_encode(d, "event_type")),
        "t_convert_int": step(ed, "convert_dtype", columns=["num_text", "mixed"], target_dtype="int"),
        "t_convert_float": step(ed, "convert_dtype", columns=["mixed"], target_dtype="float"),
        "t_convert_str": step(ed, "convert_dtype", columns=["sparse_user"], target_dtype="str"),
        "t_convert_datetime": step(ed, "convert_dtype", columns=["date_text", "mixed"], target_dtype="datetime"),
        "t_drop_column": step("orders", "drop_column", columns=["o_orderdate", "o_custkey", "missing"]),
        "t_drop_rows": step(ed, "drop_rows", columns=["value", "event_type"]),
        "t_filter_rows": filtered_orders,
        "t_dedup": step(ed, "remove_duplicates"),
        "t_rename": step("orders", "rename_column", columns=["o_orderpriority"], new_name="priority"),
        "t_scale_standard": step("lineitem", "scale_standard", columns=["l_quantity", "l_extendedprice"]),
        "t_scale_minmax": step("lineitem", "scale_minmax", columns=["l_quantity", "l_extendedprice"]),
        "t_before_after": on(ed, lambda d: tr.before_after(
            d, "impute_median", tr.Params(columns=["value"]))),
        "t_preview": on(ed, lambda d: tr.preview(
            d, "impute_mean", tr.Params(columns=["value"], order_by=["event_id"])).after),
        # recommendations
        "r_missing": on(ed, lambda d: recommend.for_missing(d).select(
            "column_name", "priority", "suggested_action", "affected_rows", "affected_percentage")),
        "r_outliers": outlier_advice,
        "r_encoding": on(ed, lambda d: recommend.for_encoding(d).select(
            "column_name", "priority", "suggested_action", "affected_rows")),
        "r_scaling": on("lineitem", lambda d: recommend.for_scaling(d).select(
            "rec_type", "priority", "affected_rows", "why")),
        "r_duplicates": on(ed, lambda d: recommend.for_duplicates(d).select(
            "priority", "affected_rows", "affected_percentage")),
        "r_type_conversion": on(ed, lambda d: recommend.for_type_conversion(d).select(
            "column_name", "priority", "affected_rows")),
        "r_all": on(ed, lambda d: recommend.all_recommendations(d).select(
            "rec_id", "display_order", "column_name", "rec_type", "priority", "affected_rows")),
        "r_assessed": assessed(ed, lambda d, a: recommend.all_recommendations(d, assessed=a).select(
            "rec_id", "display_order", "column_name", "rec_type", "priority", "affected_rows")),
        "r_summary": on(ed, lambda d: recommend.summary(recommend.all_recommendations(d))),
        # charts
        "v_histogram": on("lineitem", lambda d: charts.histogram(d, "l_extendedprice")),
        "v_box": boxes,
        "v_bar": on("documents", lambda d: charts.bar_chart(d, "source")),
        "v_correlation": on("lineitem", charts.correlation),
        "v_rank_correlation": on(ed, charts.rank_correlation),
        "v_missing_matrix": on(ed, lambda d: charts.missing_matrix(d.dropDuplicates(), ["event_id"])),
        "v_missing_patterns": on(ed, charts.missing_patterns),
        "v_scatter_grid": on("lineitem", lambda d: charts.scatter_grid(
            d, "l_quantity", "l_extendedprice", "l_returnflag")),
        "v_violin": on("events", lambda d: charts.violin(d, "value", "event_type")),
        "v_chart_plan": on(ed, charts.chart_plan),
        # lifecycle and catalog
        "l_history": on(ed, lambda d: with_steps(d).history()),
        "l_step_log": step_log,
        "l_fingerprint": on("documents", same_fingerprints),
        "l_undo": on(ed, lambda d: with_steps(d).undo().table.select(*PIPELINE_COLUMNS)),
        "l_replay_report": checked_replay,
        "l_pipeline_replay": on(ed, lambda d: replay(d, PIPELINE)[0].select(*PIPELINE_COLUMNS)),
        "l_cache_valid": on("part", valid_results),
        "l_cache_summary": on("part", lambda d: results.summary(stored_results(d)).select(
            "dataset_id", F.inline("analyses"))),
        "c_browse": on("part", lambda d: catalog.page(
            catalog.where(as_catalog(d), category="Brand#2"), "usage_count", "pipeline_id", 2, 20)),
        "c_search": on("part", lambda d: catalog.search(
            catalog.where(as_catalog(d), is_public=True), "RING", "pipeline_name", "description")),
    }


def oracle_sql() -> dict[str, str]:
    """SQL that gives the same rows on the same tables."""
    return oracle_queries() | (llm.oracle_sql() if llm else {})


def entry(spark: SparkSession) -> DataFrame:
    """Missing-value issues of the dirty events."""
    return queries()["q_missing"](spark, "/root/testdata/sf0.001")
