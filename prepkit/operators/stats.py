"""Fused per-column aggregates: one scan, one row per column of the table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepkit.functions import parsing
from prepkit.functions.columns import (
    FIXED_WIDTHS,
    chunks,
    col,
    is_numeric,
    is_temporal,
    is_text,
    nan_to_null,
    union_all,
)

Builder = Callable[[str, T.DataType], "Column | None"]


def _numeric(make: Callable[[Column], Column]) -> Builder:
    return lambda name, t: make(col(name).cast("double")) if is_numeric(t) else None


def _text(make: Callable[[Column], Column]) -> Builder:
    return lambda name, t: make(col(name)) if is_text(t) else None


def _moment(make: Callable[[Column], Column]) -> Builder:
    def build(name, t):
        if is_temporal(t):
            return make(col(name).cast("timestamp_ntz"))
        return make(parsing.to_moment(col(name))) if is_text(t) else None

    return build


def _skewness(x: Column) -> Column:
    """Bias-adjusted third moment; 0 for a constant, NULL below three values."""
    n = F.count(x).cast("double")
    adjusted = F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n < 3, None).when(F.stddev_samp(x) == 0, 0.0).otherwise(adjusted)


def _kurtosis(x: Column) -> Column:
    """Bias-adjusted excess kurtosis; 0 for a constant, NULL below four values."""
    n = F.count(x).cast("double")
    adjusted = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)
    return F.when(n < 4, None).when(F.stddev_samp(x) == 0, 0.0).otherwise(adjusted)


def _bytes(name: str, t: T.DataType) -> Column:
    width = FIXED_WIDTHS.get(type(t))
    if width is not None:
        return F.count(F.lit(1)) * width
    if isinstance(t, T.DecimalType):
        return F.count(F.lit(1)) * (8 if t.precision <= 18 else 16)
    text = col(name) if isinstance(t, (T.StringType, T.BinaryType)) else F.to_json(F.struct(col(name)))
    return F.coalesce(F.sum(F.octet_length(text)), F.lit(0))


#: measure -> fields as (name, SQL type, builder). A builder gives None where the
#: field has no meaning for the type of the column.
MEASURES: dict[str, list[tuple[str, str, Builder]]] = {
    "presence": [
        ("row_count", "bigint", lambda name, t: F.count(F.lit(1))),
        ("non_null", "bigint", lambda name, t: F.count(col(name))),
    ],
    "moments": [
        ("mean", "double", _numeric(F.avg)),
        ("std", "double", _numeric(F.stddev_samp)),
        ("min", "double", _numeric(F.min)),
        ("max", "double", _numeric(F.max)),
    ],
    "shape": [
        ("skewness", "double", _numeric(_skewness)),
        ("kurtosis", "double", _numeric(_kurtosis)),
    ],
    "signs": [
        ("zero_count", "bigint", _numeric(lambda x: F.count_if(x == 0))),
        ("negative_count", "bigint", _numeric(lambda x: F.count_if(x < 0))),
        ("positive_count", "bigint", _numeric(lambda x: F.count_if(x > 0))),
        ("infinite_count", "bigint", _numeric(lambda x: F.count_if(F.abs(x) == float("inf")))),
    ],
    "length": [
        ("min_length", "int", _text(lambda c: F.min(F.length(c)))),
        ("max_length", "int", _text(lambda c: F.max(F.length(c)))),
        ("mean_length", "double", _text(lambda c: F.avg(F.length(c)))),
    ],
    "parse": [
        ("numeric_plain", "bigint", _text(lambda c: F.count_if(parsing.looks_numeric(c)))),
        ("moment_like", "bigint", _text(lambda c: F.count_if(parsing.to_moment(c).isNotNull()))),
    ],
    "inconsistency": [
        ("numeric_loose", "bigint",
         _text(lambda c: F.count_if(parsing.looks_numeric(parsing.without_commas_and_spaces(c))))),
        ("date_like", "bigint", _text(lambda c: F.count_if(parsing.hints_at_date(c)))),
    ],
    "comma_numeric": [
        ("numeric_comma", "bigint",
         _text(lambda c: F.count_if(parsing.looks_numeric(parsing.without_commas(c))))),
    ],
    "moments_in_time": [
        ("min_moment", "timestamp_ntz", _moment(F.min)),
        ("max_moment", "timestamp_ntz", _moment(F.max)),
    ],
    "bytes": [("bytes", "bigint", _bytes)],
    "least": [("least_value", "string", lambda name, t: _least(name, t))],
}


#: Buffer fields of the aggregates that need more than one.
_BUFFERS = {"mean": 2, "std": 3, "skewness": 7, "kurtosis": 5, "mean_length": 2}


def _least(name: str, t: T.DataType) -> Column:
    if isinstance(t, T.MapType):
        return F.lit(None).cast("string")
    value = F.min(col(name))
    if isinstance(t, (T.ArrayType, T.StructType)):
        return F.to_json(F.struct(value))
    return value.cast("string")


def dtype_name(data_type: T.DataType) -> str:
    return data_type.simpleString()


def column_stats(
    df: DataFrame, measures: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """(column_name, position, dtype, fields of the measures...), one row per column.

    Only the asked-for measures are computed, and each aggregate reads only the
    columns it needs. Wide tables are split into several aggregates.
    """
    fields = [field for m in dict.fromkeys(["presence", *measures]) for field in MEASURES[m]]
    positions = {name: i for i, name in enumerate(df.columns)}
    wanted = df.columns if columns is None else list(columns)
    if not wanted:
        raise ValueError("no columns to profile")
    def buffers(name: str) -> int:
        data_type = df.schema[name].dataType
        return sum(_BUFFERS.get(f, 1) for f, _, build in fields if build(name, data_type) is not None)

    parts = []
    for chunk in chunks(wanted, buffers):
        aggregates, rows = [], []
        for i, name in enumerate(chunk):
            data_type = df.schema[name].dataType
            fixed = [
                F.lit(name).alias("column_name"),
                F.lit(positions[name]).alias("position"),
                F.lit(dtype_name(data_type)).alias("dtype"),
            ]
            for field, sql_type, build in fields:
                measure = build(name, data_type)
                if measure is None:
                    fixed.append(F.lit(None).cast(sql_type).alias(field))
                else:
                    label = f"{field}_{i}"
                    aggregates.append(measure.cast(sql_type).alias(label))
                    fixed.append(F.col(label).alias(field))
            rows.append(F.struct(*fixed))
        cells = nan_to_null(df.select(*[col(c) for c in chunk]))  # once per cell, not per aggregate
        parts.append(cells.agg(*aggregates).select(F.inline(F.array(*rows))))
    return union_all(parts).withColumn("missing", F.col("row_count") - F.col("non_null"))


def one_row_per_column(stats: DataFrame) -> DataFrame:
    """Mark a frame whose size is the number of columns of a table: it fits everywhere."""
    return F.broadcast(stats)
