"""Preprocessing advice drawn from the statistics of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepkit.functions.columns import numeric_columns, percent, text_columns
from prepkit.operators.frequency import row_counts, with_distinct
from prepkit.operators.quality import FEWEST_VALUES, IQR_REACH, outlier_profile, severity_rank
from prepkit.operators.state import Assessment
from prepkit.operators.stats import column_stats
from prepkit.operators.transform import CONVERSIONS, KINDS

# Limits of the advice. They differ from those of the issues.
SKEWED = 1.0
MANY_CATEGORIES = 50
SCALE_RATIO = 10
MOSTLY_NUMERIC = 90

FIELDS = [
    "column_name", "rec_type", "priority", "title", "suggested_action", "alternative_actions",
    "why", "affected_rows", "affected_percentage",
]


def _above(share: Column, *rungs: tuple[float, str], otherwise: str) -> Column:
    priority = F.lit(otherwise)
    for limit, name in reversed(rungs):
        priority = F.when(share > limit, name).otherwise(priority)
    return priority


def _others(group: str, *taken: str) -> Column:
    """What else this package can do about it: the transformations of a group, by label."""
    return F.array(*[F.lit(k.label) for name, k in KINDS.items() if k.group == group and name not in taken])


def _rows(source: DataFrame, group: int, rec_type: str, priority: Column, title: Column,
          action: Column, alternatives: Column, why: Column, rows: Column, share: Column,
          whole_table: bool = False) -> DataFrame:
    return source.select(
        F.lit(group).alias("group"),
        (F.lit(0) if whole_table else F.col("position")).alias("position"),
        (F.lit(None).cast("string") if whole_table else F.col("column_name")).alias("column_name"),
        F.lit(rec_type).alias("rec_type"), priority.alias("priority"), title.alias("title"),
        action.alias("suggested_action"), alternatives.alias("alternative_actions"),
        why.alias("why"), rows.cast("bigint").alias("affected_rows"), share.alias("affected_percentage"))


# Every kind of advice is read off the table, or off an assessment's row per column.


def for_missing(df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    numeric = F.col("column_name").isin(numeric_columns(df))
    stats = (column_stats(df, ["shape"]) if stats is None else stats).filter(F.col("missing") > 0)
    share = percent(F.col("missing"), F.col("row_count"))
    skew = F.when(F.col("non_null") > 2, F.coalesce("skewness", F.lit(0.0))).otherwise(0.0)
    method = F.when(numeric & (F.abs(skew) > SKEWED), "median").when(numeric, "mean").otherwise("mode")
    return _rows(
        stats, 1, "imputation",
        _above(share, (50, "critical"), (20, "high"), (5, "medium"), otherwise="low"),
        F.format_string("Fill %d missing values in '%s'", "missing", "column_name"),
        F.concat(F.lit("Use "), method, F.lit(" imputation")),
        F.when(method == "median", _others("imputation", "impute_median"))
        .when(method == "mean", _others("imputation", "impute_mean"))
        .otherwise(_others("imputation", "impute_mode", "impute_mean", "impute_median")),
        F.when(method == "median", F.format_string("Skewness %.2f would pull the mean", skew))
        .when(method == "mean", F.lit("The distribution is about symmetric, so the mean is typical"))
        .otherwise(F.lit("The most frequent value keeps the categories as they are")),
        F.col("missing"), share)


def for_outliers(df: DataFrame, approx: bool = False, stats: DataFrame | None = None) -> DataFrame:
    found = (outlier_profile(df, approx=approx) if stats is None else _among(stats, numeric_columns(df))).filter(
        (F.col("non_null") >= FEWEST_VALUES) & (F.col("iqr_outliers") > 0))
    share = percent(F.col("iqr_outliers"), F.col("non_null"))
    reach = (F.col("q75") - F.col("q25")) * IQR_REACH
    return _rows(
        found, 2, "outlier_treatment", _above(share, (10, "high"), (5, "medium"), otherwise="low"),
        F.format_string("Treat %d outliers in '%s'", "iqr_outliers", "column_name"),
        F.lit("Cap outliers by IQR"),
        _others("outlier_treatment", "cap_outliers_iqr"),
        F.format_string("Values below %.2f or above %.2f are far from the middle half",
                        F.col("q25") - reach, F.col("q75") + reach),
        F.col("iqr_outliers"), share)


def _among(stats: DataFrame, names: list[str]) -> DataFrame:
    return stats.filter(F.col("column_name").isin(names))


def for_encoding(df: DataFrame, approx: bool = False, stats: DataFrame | None = None) -> DataFrame:
    texts = text_columns(df)
    stats = with_distinct(column_stats(df, [], texts), df, texts, approx) if stats is None else _among(stats, texts)
    n = F.col("distinct_count")
    many = n > MANY_CATEGORIES
    return _rows(
        stats, 3, "encoding", F.when(many, "medium").otherwise("low"),
        F.format_string("Encode '%s'", "column_name"),
        F.when(many, "Use target encoding").otherwise("Use one-hot encoding"),
        F.when(many, _others("encoding", "encode_onehot")).otherwise(_others("encoding")),
        F.format_string("%d categories", n), F.col("row_count"), F.lit(100.0))


def for_scaling(df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Numeric columns whose ranges differ more than tenfold."""
    names = numeric_columns(df)
    if len(names) < 2:
        names_frame = (column_stats(df, []) if stats is None else stats).filter(F.lit(False)).withColumn("ratio", F.lit(0.0))
    else:
        width = F.col("max") - F.col("min")
        narrowest = F.when(F.min(width) > 0, F.min(width)).otherwise(1.0)
        names_frame = (column_stats(df, ["moments"], names) if stats is None else _among(stats, names)).groupBy().agg(
            F.max("row_count").alias("row_count"),
            (F.max(width) / narrowest).alias("ratio"),
        ).filter(F.col("ratio") > SCALE_RATIO)
    return _rows(
        names_frame, 4, "scaling", F.lit("medium"), F.lit("Bring numeric columns to similar ranges"),
        F.lit("Use standard scaling"),
        _others("scaling", "scale_standard"),
        F.format_string("The widest range is %.0f times the narrowest", "ratio"),
        F.col("row_count"), F.lit(100.0), whole_table=True)


def for_duplicates(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    found = (row_counts(df) if counts is None else counts).filter(F.col("duplicate_rows") > 0)
    share = percent(F.col("duplicate_rows"), F.col("row_count"))
    return _rows(
        found, 5, "duplicate_handling", _above(share, (5, "high"), otherwise="medium"),
        F.format_string("Remove %d duplicate rows", "duplicate_rows"), F.lit("Remove duplicate rows"),
        F.array().cast("array<string>"),
        F.format_string("%d of %d rows are left", "distinct_rows", "row_count"),
        F.col("duplicate_rows"), share, whole_table=True)


def for_type_conversion(df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    texts = text_columns(df)
    stats = column_stats(df, ["parse"], texts) if stats is None else _among(stats, texts)
    share = percent(F.col("numeric_plain"), F.col("row_count"))
    return _rows(
        stats.filter(share > MOSTLY_NUMERIC), 6, "type_conversion", F.lit("medium"),
        F.format_string("Convert '%s' to a number", "column_name"), F.lit("Convert to numeric"),
        F.array(*map(F.lit, CONVERSIONS)),
        F.format_string("%.1f%% of the values are numbers", share), F.col("row_count"), F.lit(100.0))


def all_recommendations(df: DataFrame, approx: bool = False, assessed: Assessment | None = None) -> DataFrame:
    """Numbered in order of generation, ranked by priority. A few rows per column: small."""
    stats, counts = (assessed.columns, assessed.table) if assessed else (None, None)
    parts = [for_missing(df, stats)]
    if numeric_columns(df):
        parts.append(for_outliers(df, approx, stats))
    if text_columns(df):
        parts += [for_encoding(df, approx, stats)]
    parts += [for_scaling(df, stats), for_duplicates(df, counts)]
    if text_columns(df):
        parts.append(for_type_conversion(df, stats))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    numbered = whole.withColumn("number", F.row_number().over(Window.orderBy("group", "position")))
    return numbered.select(
        F.concat(F.lit("rec_"), F.col("number").cast("string")).alias("rec_id"),
        F.row_number().over(Window.orderBy(severity_rank(F.col("priority")), "number"))
        .alias("display_order"),
        *FIELDS)


def summary(recommended: DataFrame) -> DataFrame:
    return recommended.groupBy("priority").agg(F.count(F.lit(1)).alias("recommendations"))
