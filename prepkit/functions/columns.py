"""Column families and the small helpers every operator uses to name columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL_TYPES = (T.FloatType, T.DoubleType)
NUMERIC_TYPES = INTEGRAL_TYPES + FRACTIONAL_TYPES + (T.DecimalType,)
TEXT_TYPES = (T.StringType,)
TEMPORAL_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType)

#: Bytes one value of a fixed-width type takes in a column store.
FIXED_WIDTHS = {
    T.BooleanType: 1,
    T.ByteType: 1,
    T.ShortType: 2,
    T.IntegerType: 4,
    T.FloatType: 4,
    T.DateType: 4,
    T.LongType: 8,
    T.DoubleType: 8,
    T.TimestampType: 8,
    T.TimestampNTZType: 8,
}

#: An aggregate with more buffer fields than this falls out of whole-stage codegen
#: (the limit is 100 with the fields of the scan) and runs several times slower.
FIELDS_PER_AGGREGATE = 80


def col(name: str) -> Column:
    """Reference a top-level column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, NUMERIC_TYPES)


def is_integral(data_type: T.DataType) -> bool:
    return isinstance(data_type, INTEGRAL_TYPES)


def is_text(data_type: T.DataType) -> bool:
    return isinstance(data_type, TEXT_TYPES)


def is_temporal(data_type: T.DataType) -> bool:
    return isinstance(data_type, TEMPORAL_TYPES)


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def names_where(df: DataFrame, test, columns: Iterable[str] | None = None) -> list[str]:
    wanted = set(df.columns if columns is None else columns)
    return [f.name for f in df.schema.fields if f.name in wanted and test(f.dataType)]


def numeric_columns(df: DataFrame, columns: Iterable[str] | None = None) -> list[str]:
    return names_where(df, is_numeric, columns)


def text_columns(df: DataFrame, columns: Iterable[str] | None = None) -> list[str]:
    return names_where(df, is_text, columns)


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown column(s): {', '.join(unknown)}")


def chunks(items: Sequence, weight=lambda item: 2, most: int = FIELDS_PER_AGGREGATE) -> list[list]:
    """Split into runs whose weights, the buffer fields they need, stay within a limit.

    Each run becomes an aggregate that scans its own columns only.
    """
    runs: list[list] = []
    held = most + 1
    for item in items:
        need = weight(item)
        if held + need > most:
            runs.append([])
            held = 0
        runs[-1].append(item)
        held += need
    return runs


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and NULL are one kind of missing: keep only NULL."""
    fractional = set(names_where(df, lambda t: isinstance(t, FRACTIONAL_TYPES)))
    if not fractional:
        return df
    return df.select([
        F.when(~F.isnan(col(c)), col(c)).alias(c) if c in fractional else col(c)
        for c in df.columns
    ])


def percent(part, whole) -> Column:
    """100 * part / whole, NULL on an empty whole."""
    return F.try_divide(part * F.lit(100.0), whole)


def present_double(name: str) -> Column:
    """A numeric cell as double, NULL when it is NaN."""
    c = col(name).cast("double")
    return F.when(~F.isnan(c), c)


def long_doubles(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column_name, value double), one row per non-missing numeric cell."""
    wide = df.select(
        *[col(b) for b in by],
        *[col(c).cast("double").alias(c) for c in columns],
    )
    return wide.unpivot(
        [col(b) for b in by], [col(c) for c in columns], "column_name", "value"
    ).filter(F.col("value").isNotNull() & ~F.isnan("value"))
