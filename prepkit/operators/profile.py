"""The profile of a table: completeness, uniqueness, distributions, footprint."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepkit.functions.columns import (
    FRACTIONAL_TYPES,
    col,
    numeric_columns,
    percent,
    require_columns,
    text_columns,
    union_all,
)
from prepkit.operators.frequency import row_counts, text_counts, top_values, with_distinct
from prepkit.operators.metadata import BYTES_PER_MB, dataset_summary
from prepkit.operators.quantiles import quantiles
from prepkit.operators.stats import column_stats, one_row_per_column

# Weights and penalties of the profile score.
COMPLETENESS_WEIGHT = 40
UNIQUENESS_WEIGHT = 30
CONSISTENCY_WEIGHT = 30
PENALTY_PER_NUMERIC_TEXT = 5
VERY_HIGH_CARDINALITY = 0.9


def missing_cells(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Number of missing cells in a row."""
    count = F.lit(0)
    for name in df.columns if columns is None else columns:
        absent = col(name).isNull()
        if isinstance(df.schema[name].dataType, FRACTIONAL_TYPES):
            absent = absent | F.coalesce(F.isnan(col(name)), F.lit(False))
        count = count + absent.cast("int")
    return count


def completeness(df: DataFrame) -> DataFrame:
    """One row: share of filled cells, columns and rows with or without any value."""
    rows = df.select(missing_cells(df).alias("gaps")).agg(
        F.count_if(F.col("gaps") > 0).alias("rows_with_missing"),
        F.count_if(F.col("gaps") == len(df.columns)).alias("empty_rows"),
    )
    by_column = column_stats(df, []).agg(
        F.round(F.lit(100.0) - percent(F.sum("missing"), F.sum("row_count")), 2)
        .alias("overall_completeness"),
        F.count_if(F.col("missing") > 0).alias("columns_with_missing"),
        F.count_if((F.col("non_null") == 0)).alias("empty_columns"),
    )
    return by_column.crossJoin(F.broadcast(rows)).select(
        "overall_completeness", "columns_with_missing", "rows_with_missing",
        "empty_columns", "empty_rows",
    )


def dtype_histogram(df: DataFrame) -> DataFrame:
    """Columns and filled cells per physical type."""
    return column_stats(df, []).groupBy("dtype").agg(
        F.count(F.lit(1)).alias("column_count"), F.sum("non_null").alias("filled_cells"))


def uniqueness(df: DataFrame) -> DataFrame:
    stats = with_distinct(column_stats(df, []), df)
    ratio = F.try_divide(F.col("distinct_count").cast("double"), F.col("non_null"))
    return stats.select(
        "column_name", "position", F.col("distinct_count").alias("unique_values"),
        F.round(F.coalesce(ratio, F.lit(0.0)), 4).alias("uniqueness_ratio"),
        (F.col("distinct_count") == F.col("non_null")).alias("is_unique"),
        (F.col("distinct_count") < F.col("non_null")).alias("has_duplicates"),
    )


def numeric_insights(df: DataFrame) -> DataFrame:
    stats = column_stats(df, ["moments", "signs"], numeric_columns(df))
    return stats.filter(F.col("non_null") > 0).select(
        "column_name", "zero_count", "negative_count", "positive_count", "infinite_count",
        F.when(F.col("non_null") > 1, F.col("max") - F.col("min")).otherwise(0.0).alias("range"),
    )


def categorical_insights(df: DataFrame) -> DataFrame:
    counts = text_counts(df)
    totals = one_row_per_column(counts.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("cardinality"), F.sum("n").alias("held")))
    return top_values(df, k=1).join(totals, "column_name").select(
        "column_name", F.col("value").alias("most_frequent_value"),
        F.col("n").alias("most_frequent_count"), "cardinality",
        F.round(percent(F.col("n"), F.col("held")), 2).alias("mode_frequency"),
    )


def numeric_profile(
    df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False
) -> DataFrame:
    """All statistics of the numeric columns."""
    names = numeric_columns(df, columns)
    if not names:
        raise ValueError("no numeric columns")
    stats = with_distinct(column_stats(df, ["moments", "shape"], names), df, names)
    quarters = one_row_per_column(quantiles(df, names, approx=approx))
    one_value = (F.col("non_null") == 1)
    return stats.join(quarters, "column_name", "left").select(
        "column_name", "position", "dtype", F.col("row_count").alias("count"),
        F.col("missing").alias("missing_count"),
        F.round(percent(F.col("missing"), F.col("row_count")), 2).alias("missing_percentage"),
        F.col("distinct_count").alias("unique_count"),
        "mean", "median", F.when(one_value, 0.0).otherwise(F.col("std")).alias("std"),
        "min", "max", "q25", "q75",
        F.when(one_value, 0.0).otherwise(F.col("skewness")).alias("skewness"),
        F.when(one_value, 0.0).otherwise(F.col("kurtosis")).alias("kurtosis"),
    )


def string_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """All statistics of the text columns."""
    names = text_columns(df, columns)
    if not names:
        raise ValueError("no text columns")
    counts = text_counts(df, names)
    distinct = one_row_per_column(
        counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_count")))
    mode = one_row_per_column(
        top_values(df, names, 1).select("column_name", F.col("value").alias("mode")))
    return (
        column_stats(df, ["length"], names)
        .join(distinct, "column_name", "left")
        .join(mode, "column_name", "left")
        .select(
            "column_name", "position", "dtype", F.col("row_count").alias("count"),
            F.col("missing").alias("missing_count"),
            F.round(percent(F.col("missing"), F.col("row_count")), 2).alias("missing_percentage"),
            F.coalesce("distinct_count", F.lit(0)).cast("bigint").alias("unique_count"),
            "min_length", "max_length", F.round("mean_length", 2).alias("mean_length"), "mode",
        )
    )


def top_text_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """(column_name, rank, value, n): the k most frequent values of each text column."""
    return top_values(df, columns, k)


def top_values_map(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """(column_name, top_values map): at most k entries per column."""
    return top_text_values(df, columns, k).groupBy("column_name").agg(
        F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias("top_values"))


def quality_summary(df: DataFrame) -> DataFrame:
    """One row of counts that the profile score is made of."""
    by_column = column_stats(df, ["parse"]).agg(
        F.count_if(F.col("missing") > 0).alias("columns_with_missing"),
        F.sum("missing").alias("total_missing"),
        F.sum("row_count").alias("total_cells"),
        F.count_if(F.col("numeric_plain") == F.col("non_null")).alias("numeric_text_columns"),
    )
    return row_counts(df).select("row_count", "duplicate_rows").crossJoin(F.broadcast(by_column))


def quality_score(df: DataFrame) -> DataFrame:
    """One row: the 0 to 100 profile score and its three parts."""
    c, u = COMPLETENESS_WEIGHT, UNIQUENESS_WEIGHT
    missing_ratio = F.coalesce(
        F.try_divide(F.col("total_missing").cast("double"), F.col("total_cells")), F.lit(0.0))
    duplicate_ratio = F.coalesce(
        F.try_divide(F.col("duplicate_rows").cast("double"), F.col("row_count")), F.lit(0.0))
    parts = quality_summary(df).select(
        ((F.lit(1.0) - missing_ratio) * c).alias("completeness"),
        (F.lit(float(u)) - F.least(duplicate_ratio * u, F.lit(float(u)))).alias("uniqueness"),
        F.greatest(
            F.lit(CONSISTENCY_WEIGHT) - F.col("numeric_text_columns") * PENALTY_PER_NUMERIC_TEXT,
            F.lit(0)).cast("double").alias("consistency"),
    )
    total = F.col("completeness") + F.col("uniqueness") + F.col("consistency")
    return parts.select(
        F.round(F.least(total, F.lit(100.0)), 2).alias("score"),
        *[F.round(p, 2).alias(p) for p in ("completeness", "uniqueness", "consistency")],
    )


def recommendations(df: DataFrame) -> DataFrame:
    """(step, column_name, advice): what to do first, in order."""
    stats = with_distinct(column_stats(df, ["parse"]), df)
    gaps = stats.filter(F.col("missing") > 0).agg(
        F.count(F.lit(1)).alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("position", "column_name"))),
                    lambda s: s["column_name"]).alias("names"),
    ).filter(F.col("n") > 0)
    missing = gaps.select(
        F.lit(1).alias("step"), F.lit(0).alias("position"), F.lit(None).cast("string").alias("column_name"),
        F.concat(
            F.lit("Fill or drop missing values in "), F.col("n").cast("string"), F.lit(" columns: "),
            F.array_join(F.slice("names", 1, 3), ", "),
            F.when(F.col("n") > 3, "...").otherwise(""),
        ).alias("advice"),
    )
    copies = row_counts(df).filter(F.col("duplicate_rows") > 0).select(
        F.lit(2), F.lit(0), F.lit(None).cast("string"),
        F.concat(F.lit("Drop "), F.col("duplicate_rows").cast("string"), F.lit(" duplicate rows")),
    )
    numeric_text = stats.filter(F.col("numeric_plain") == F.col("non_null")).select(
        F.lit(3), "position", "column_name", F.lit("Store this column as a number"))
    many = stats.filter(
        (F.col("dtype") == "string")
        & (F.try_divide(F.col("distinct_count").cast("double"), F.col("row_count")) > VERY_HIGH_CARDINALITY)
    ).select(F.lit(4), "position", "column_name", F.lit("Nearly every value differs: is this an identifier?"))
    return missing.union(copies).union(numeric_text).union(many)


def column_footprint(df: DataFrame) -> DataFrame:
    """Bytes per column, its share of the table, and whether it is the largest."""
    stats = column_stats(df, ["bytes"])
    whole = Window.partitionBy()  # one row per column of the schema
    return stats.select("column_name", "position", "bytes").select(
        "*",
        F.sum("bytes").over(whole).alias("total_bytes"),
        F.round(F.col("bytes") / BYTES_PER_MB, 2).alias("megabytes"),
        (F.row_number().over(Window.orderBy(F.desc("bytes"), "position")) == 1).alias("is_largest"),
    )


def column_lookup(df: DataFrame, column: str | None = None, approx: bool = False) -> DataFrame:
    """Statistics of one column, or of all; an unknown name is an error."""
    names = df.columns if column is None else [column]
    require_columns(df, names)
    parts = []
    if numeric_columns(df, names):
        parts.append(numeric_profile(df, names, approx))
    if text_columns(df, names):
        parts.append(string_profile(df, names))
    rest = [c for c in names if c not in numeric_columns(df) + text_columns(df)]
    if rest:
        parts.append(with_distinct(column_stats(df, [], rest), df, rest).select(
            "column_name", "position", "dtype", F.col("row_count").alias("count"),
            F.col("missing").alias("missing_count"),
            F.round(percent(F.col("missing"), F.col("row_count")), 2).alias("missing_percentage"),
            F.col("distinct_count").alias("unique_count")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def basic_profile(df: DataFrame) -> DataFrame:
    """The reduced profile: presence, distinct values and plain numeric moments."""
    stats = with_distinct(column_stats(df, ["moments"]), df)
    names = numeric_columns(df)
    if names:
        medians = one_row_per_column(quantiles(df, names, {"median": 0.5}))
        stats = stats.join(medians, "column_name", "left")
    else:
        stats = stats.withColumn("median", F.lit(None).cast("double"))
    return stats.select(
        "column_name", "position", "dtype", F.col("row_count").alias("count"),
        F.col("missing").alias("missing_count"),
        F.round(percent(F.col("missing"), F.col("row_count")), 2).alias("missing_percentage"),
        F.col("distinct_count").alias("unique_count"), "mean", "median",
        F.when(F.col("non_null") == 1, 0.0).otherwise(F.col("std")).alias("std"), "min", "max",
    )


def multi_table_profile(tables: Mapping[str, DataFrame], approx: bool = False) -> DataFrame:
    """Numeric profiles of several tables, keyed by table name."""
    return union_all([
        numeric_profile(df, approx=approx).withColumn("table_name", F.lit(name))
        for name, df in tables.items()
    ])


def profile_tables(tables: Mapping[str, DataFrame]) -> tuple[DataFrame | None, dict]:
    """Profile what can be profiled; report names that succeeded and failed."""
    good, failed = {}, {}
    for name, df in tables.items():
        try:
            numeric_profile(df).schema  # analysis only, nothing runs
            good[name] = df
        except Exception as error:
            failed[name] = str(error)
    report = {
        "total": len(tables), "successful": list(good), "failed": failed,
        "success_rate": 100.0 * len(good) / len(tables) if tables else None,
    }
    return (multi_table_profile(good) if good else None), report


def report_columns(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """The column table of a report, with the first three values in row order."""
    require_columns(df, order_by)
    stats = with_distinct(column_stats(df, []), df)
    firsts = []
    for name in df.columns:
        rows = df.filter(col(name).isNotNull()).select(
            *[col(c).alias(f"__o{i}") for i, c in enumerate(order_by)],
            F.substring(col(name).cast("string"), 1, 20).alias("value"),
        ).orderBy(*[f"__o{i}" for i in range(len(order_by))], "value").limit(3)
        order = [f"__o{i}" for i in range(len(order_by))]
        listed = F.transform(
            F.array_sort(F.collect_list(F.struct(*order, "value"))), lambda s: s["value"])
        firsts.append(rows.agg(F.array_join(listed, ", ").alias("sample_values"))
                      .withColumn("column_name", F.lit(name)))
    return stats.join(one_row_per_column(union_all(firsts)), "column_name").select(
        "column_name", "position", "dtype", "non_null",
        F.round(percent(F.col("missing"), F.col("row_count")), 2).alias("missing_percentage"),
        F.col("distinct_count").alias("unique_count"), "sample_values",
    )


def report_overview(df: DataFrame) -> DataFrame:
    return dataset_summary(df).select(
        "row_count", "column_count", "megabytes", "missing_percent", "duplicate_rows",
        "numeric_column_count")
