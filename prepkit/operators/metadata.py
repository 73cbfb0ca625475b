"""What a table is made of: sizes, semantic types, statistics by type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepkit.functions import parsing
from prepkit.functions.columns import (
    FRACTIONAL_TYPES,
    col,
    is_integral,
    is_temporal,
    is_text,
    names_where,
    numeric_columns,
    percent,
    text_columns,
)
from prepkit.operators.frequency import (
    distinct_counts,
    row_counts,
    top_values,
)
from prepkit.operators.quantiles import quantiles
from prepkit.operators.stats import column_stats, one_row_per_column

BYTES_PER_MB = 1024 * 1024
# A text column is categorical below both limits.
CATEGORICAL_RATIO = 0.1
CATEGORICAL_DISTINCT = 50


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row: sizes, missing cells, duplicate rows, bytes held by the cells."""
    cells = column_stats(df, ["bytes"]).agg(
        F.sum("missing").alias("missing_cells"),
        F.sum("row_count").alias("cells"),
        F.sum("bytes").alias("bytes"),
    )
    return row_counts(df).crossJoin(F.broadcast(cells)).select(
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(len(numeric_columns(df))).alias("numeric_column_count"),
        "missing_cells",
        F.coalesce(percent(F.col("missing_cells"), F.col("cells")), F.lit(0.0)).alias("missing_percent"),
        "duplicate_rows",
        "bytes",
        F.round(F.col("bytes") / BYTES_PER_MB, 2).alias("megabytes"),
    )


def missing_by_column(df: DataFrame) -> DataFrame:
    return column_stats(df, []).select(
        "column_name", "position", "missing",
        percent(F.col("missing"), F.col("row_count")).alias("missing_percent"),
    )


def semantic_types(df: DataFrame) -> DataFrame:
    """(column_name, position, dtype, semantic_type, nullable)."""
    by_type = {}
    for field in df.schema.fields:
        t = field.dataType
        if is_integral(t):
            by_type[field.name] = "integer"
        elif isinstance(t, FRACTIONAL_TYPES) or t.typeName() == "decimal":
            by_type[field.name] = "float"
        elif is_temporal(t):
            by_type[field.name] = "datetime"
        elif t.typeName() == "boolean":
            by_type[field.name] = "boolean"
        elif not is_text(t):
            by_type[field.name] = "unknown"
    stats = column_stats(df, ["parse"])
    texts = text_columns(df)
    if texts:
        stats = stats.join(F.broadcast(distinct_counts(df, texts)), "column_name", "left")
    else:
        stats = stats.withColumn("distinct_count", F.lit(None).cast("bigint"))
    held = F.col("non_null")
    semantic = F.when(held == 0, "empty")
    for kind in dict.fromkeys(by_type.values()):
        semantic = semantic.when(
            F.col("column_name").isin([c for c, k in by_type.items() if k == kind]), kind)
    semantic = (
        semantic.when(F.col("numeric_plain") == held, "numeric_string")
        .when(F.col("moment_like") == held, "datetime_string")
        .when((F.try_divide(F.col("distinct_count"), held) < CATEGORICAL_RATIO)
              & (F.col("distinct_count") < CATEGORICAL_DISTINCT), "categorical")
        .otherwise("text")
    )
    return stats.select(
        "column_name", "position", "dtype", semantic.alias("semantic_type"),
        (F.col("missing") > 0).alias("nullable"),
    )


def type_summary(df: DataFrame) -> DataFrame:
    return semantic_types(df).groupBy("semantic_type").agg(F.count(F.lit(1)).alias("column_count"))


def _of_type(frame: DataFrame, df: DataFrame, kinds: list[str]) -> DataFrame:
    types = semantic_types(df).filter(F.col("semantic_type").isin(kinds))
    return frame.join(one_row_per_column(types.select("column_name", "semantic_type")), "column_name")


def numeric_stats(df: DataFrame, approx: bool = False) -> DataFrame:
    """Statistics of numeric columns and of text columns that hold only numbers."""
    texts = text_columns(df)
    numbers = numeric_columns(df)
    if not numbers and not texts:
        raise ValueError("no column can hold numbers")
    values = df.select(
        *[col(c) for c in numbers], *[parsing.to_number(col(c)).alias(c) for c in texts]
    )
    stats = column_stats(values, ["moments"])
    quarters = one_row_per_column(quantiles(values, values.columns, approx=approx))
    found = stats.join(quarters, "column_name", "left").filter(F.col("non_null") > 0)
    if texts:
        found = _of_type(found, df, ["integer", "float", "numeric_string"])
    return found.select(
        "column_name", F.col("non_null").alias("count"),
        "mean", "median", "std", "min", "max", "q25", "q75",
    )


def text_stats(df: DataFrame) -> DataFrame:
    """Mode and lengths of text and categorical columns."""
    texts = text_columns(df)
    if not texts:
        raise ValueError("no text columns")
    stats = column_stats(df, ["length"], texts).filter(F.col("non_null") > 0)
    mode = top_values(df, k=1).select(
        "column_name", F.col("value").alias("most_frequent"), F.col("n").alias("frequency"))
    return _of_type(stats.join(one_row_per_column(mode), "column_name"), df, ["text", "categorical"]).select(
        "column_name", F.col("non_null").alias("count"), "most_frequent", "frequency",
        F.col("mean_length").alias("avg_length"), "max_length", "min_length",
    )


def datetime_stats(df: DataFrame) -> DataFrame:
    """First and last moment and the whole days between them."""
    candidates = names_where(df, lambda t: is_temporal(t) or is_text(t))
    if not candidates:
        raise ValueError("no column can hold dates")
    stats = column_stats(df, ["moments_in_time"], candidates).filter(F.col("non_null") > 0)
    return _of_type(stats, df, ["datetime", "datetime_string"]).select(
        "column_name", F.col("non_null").alias("count"),
        F.col("min_moment").alias("min_date"), F.col("max_moment").alias("max_date"),
        F.timestamp_diff("DAY", F.col("min_moment"), F.col("max_moment")).alias("range_days"),
    )
