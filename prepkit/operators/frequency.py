"""How often values and rows occur."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepkit.functions.columns import (
    FRACTIONAL_TYPES,
    NESTED_TYPES,
    chunks,
    col,
    is_integral,
    is_numeric,
    is_text,
    names_where,
    present_double,
    text_columns,
    union_all,
)
from prepkit.functions.keys import _printable, _settled, row_key, text_key

#: Characters of a text that are kept in its grouping key.
HEAD_LENGTH = 48
#: Up to this many candidates for the most frequent texts are broadcast.
MOST_CANDIDATES = 10_000


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of one column in its own type, without missing values."""
    data_type = df.schema[column].dataType
    value = F.when(~F.isnan(col(column)), col(column)) if isinstance(
        data_type, FRACTIONAL_TYPES) else col(column)
    return (
        df.select(value.alias("value")).filter(F.col("value").isNotNull())
        .groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    )


def _text_cells(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """(column_name, head, tail, value) of the filled text cells. A text is told apart
    by its first characters and, when it is longer, by its SHA-256."""
    names = text_columns(df, columns)
    long = df.select(*[col(c) for c in names]).unpivot(
        [], [col(c) for c in names], "column_name", "value"
    ).filter(F.col("value").isNotNull())
    is_long = F.length("value") > HEAD_LENGTH
    return long.select(
        "column_name", F.substring("value", 1, HEAD_LENGTH).alias("head"),
        F.when(is_long, F.sha2("value", 256)).alias("tail"), "value")


def text_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, head, tail, n) over text columns, without missing values.

    Heads and digests are shuffled, not whole texts.
    """
    return _text_cells(df, columns).groupBy("column_name", "head", "tail").agg(
        F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """(column_name, rank, value, n): the k most frequent texts per column, ties by value.

    What can be among the best is found in two steps that keep k rows per column and task:
    the count of the k-th most frequent text, and, as texts sort by their heads first, the k-th
    smallest head among those with just that count. Only texts at least as good are looked
    up whole, however many of them share the last head.
    """
    counts = text_counts(df, columns)
    by_count = Window.partitionBy("column_name").orderBy(F.desc("n"))
    least = counts.select("column_name", "n").withColumn("place", F.row_number().over(by_count)).filter(
        F.col("place") <= k).groupBy("column_name").agg(F.min("n").alias("least"))
    able = counts.join(F.broadcast(least), "column_name").filter(F.col("n") >= F.col("least"))  # a row per column
    by_head = Window.partitionBy("column_name").orderBy("head")
    edge = able.filter(F.col("n") == F.col("least")).select("column_name", "head").withColumn(
        "place", F.row_number().over(by_head)).filter(F.col("place") <= k).groupBy("column_name").agg(
        F.max("head").alias("edge"))
    best = able.join(F.broadcast(edge), "column_name").filter(
        (F.col("n") > F.col("least")) | (F.col("head") <= F.col("edge"))).drop("least", "edge")
    whole = best.filter(F.col("tail").isNotNull()).select("column_name", "tail")
    held = whole.limit(MOST_CANDIDATES + 1).count()
    value = F.col("head")
    if held:
        # the digest stands for one text, so any of its rows will do
        few = F.broadcast(whole) if held <= MOST_CANDIDATES else whole
        texts = _text_cells(df, columns).filter(F.col("tail").isNotNull()).join(
            few, ["column_name", "tail"], "left_semi"
        ).groupBy("column_name", "tail").agg(F.min("value").alias("whole"))
        best = best.join(texts, ["column_name", "tail"], "left")
        value = F.coalesce("whole", "head")
    by_value = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("value"))
    return best.withColumn("value", value).withColumn("rank", F.row_number().over(by_value)).filter(
        F.col("rank") <= k).select("column_name", "rank", "value", "n")


#: Logarithm of the registers of a distinct sketch: a relative standard error of 0.8 %.
DISTINCT_REGISTERS = 14


def distinct_sketch(df: DataFrame, name: str) -> Column:
    """The aggregate that sketches the distinct values of a column, in some ten kilobytes."""
    data_type = df.schema[name].dataType
    value = _printable(name, data_type) if isinstance(data_type, NESTED_TYPES) else _settled(name, data_type)
    return F.hll_sketch_agg(F.when(col(name).isNotNull() & value.isNotNull(), F.xxhash64(value)), F.lit(DISTINCT_REGISTERS))


def approx_distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Like :func:`distinct_counts`, from sketches: one scan, no shuffle of values, off by 0.8 %
    in the standard deviation, and exact in practice for a few hundred values."""
    names = df.columns if columns is None else list(columns)
    parts = []
    for chunk in chunks(names, lambda _: 1, 256):
        sketches = df.agg(*[F.hll_sketch_estimate(distinct_sketch(df, c)).alias(f"n_{i}") for i, c in enumerate(chunk)])
        parts.append(sketches.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(f"n_{i}").alias("distinct_count")) for i, c in enumerate(chunk)]))))
    return union_all(parts).where("distinct_count > 0")


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """(column_name, distinct_count) without missing values.

    Columns are counted family by family, so that numbers stay numbers and only
    long texts are replaced by a digest. A column without values gives no row.
    """
    if approx:
        return approx_distinct_counts(df, columns)
    wanted = df.columns if columns is None else list(columns)
    integral = names_where(df, is_integral, wanted)
    numeric = [c for c in names_where(df, is_numeric, wanted)
               if c not in integral and isinstance(df.schema[c].dataType, FRACTIONAL_TYPES)]
    other = [c for c in wanted if c not in integral and c not in numeric]
    families = [
        (integral, lambda c: col(c).cast("bigint")),
        (numeric, lambda c: present_double(c)),
        (other, lambda c: text_key(
            col(c) if is_text(df.schema[c].dataType) else _printable(c, df.schema[c].dataType))),
    ]
    parts = []
    for names, key in families:
        if names:
            keyed = df.select(*[key(c).alias(c) for c in names])
            parts.append(
                keyed.unpivot([], [col(c) for c in names], "column_name", "value")
                .filter(F.col("value").isNotNull())
                .groupBy("column_name", "value").agg(F.lit(1).alias("one"))
                .groupBy("column_name").agg(F.count("one").alias("distinct_count"))
            )
    return union_all(parts)


def row_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row (row_count, distinct_rows, duplicate_rows); NULLs count as equal."""
    keys = row_key(df, list(columns) if columns is not None else None)
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    return groups.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).cast("bigint").alias("row_count"),
        F.count(F.lit(1)).alias("distinct_rows"),
    ).withColumn("duplicate_rows", F.col("row_count") - F.col("distinct_rows"))


def with_distinct(
    stats: DataFrame, df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False
) -> DataFrame:
    """Add ``distinct_count`` to a one-row-per-column frame."""
    counts = F.broadcast(distinct_counts(df, columns, approx))  # one row per column of the schema
    return stats.join(counts, "column_name", "left").withColumn(
        "distinct_count", F.coalesce("distinct_count", F.lit(0).cast("bigint"))
    )
