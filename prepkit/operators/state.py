"""What a table is like, in one small row per column that adds up over slices.

A state holds counts, moments about the mean, extremes, lengths, counts of what texts look like,
and two sketches: one of the distribution, one of the distinct values. States of slices, of
days say, are stored and merged; statistics are finished from a merged state without
looking at the rows again. Where exact distinct counts, quartiles and outliers are asked for,
:func:`assess` takes one more look, in which all of them are read off the same counts of values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepkit.functions.columns import (
    FRACTIONAL_TYPES,
    chunks,
    col,
    is_integral,
    is_numeric,
    nan_to_null,
    numeric_columns,
    present_double,
    union_all,
)
from prepkit.functions.keys import _printable, row_digest, text_key
from prepkit.operators.frequency import distinct_sketch, row_counts
from prepkit.operators.quantiles import (
    COLUMN_ACCURACY,
    MERGES,
    SKETCHES_PER_SCAN,
    quantiles_of_counts,
    sketch_size,
)
from prepkit.operators.stats import MEASURES, dtype_name
from prepkit.sources.tables import materialise

#: Measures whose fields are plain counts, sums and extremes, by how they add up.
SUMS = ("row_count", "non_null", "zero_count", "negative_count", "positive_count", "infinite_count", "numeric_plain",
        "moment_like", "numeric_loose", "date_like", "numeric_comma", "bytes", "length_sum")
#: Checks of texts.
TEXT_FIELDS = ("numeric_plain", "moment_like", "numeric_loose", "date_like", "numeric_comma", "min_moment", "max_moment")
#: Those that issues, scores and advice look at.
CHECKS = ("numeric_plain", "numeric_loose", "date_like")
LEAST, MOST = ("min", "min_length", "min_moment", "least_value"), ("max", "max_length", "max_moment")
POWERS = ("m2", "m3", "m4")
_TAKEN = ("presence", "signs", "parse", "inconsistency", "comma_numeric", "moments_in_time", "bytes", "least")
#: Buffers of a column's plain aggregates, which have to stay few to be compiled.
NUMERIC_FIELDS, OTHER_FIELDS = 24, 14


def column_state(df: DataFrame, texts: Sequence[str] = TEXT_FIELDS) -> DataFrame:
    """One row per column: ``column_name``, ``position``, ``dtype`` and the fields of the state.
    ``texts`` are the checks made of texts, the dear part; the others are NULL.

    Plain sums of some columns at a time, which read these columns alone, and all sketches at
    once. What the scan's tasks have is merged by MERGES tasks and then column by column, never
    all by one task.
    """
    cells = nan_to_null(df)

    def weight(name: str) -> int:
        return NUMERIC_FIELDS if is_numeric(df.schema[name].dataType) else OTHER_FIELDS

    plain = [_partial(df, cells, chunk, lambda d, c: _fields(d, c, texts)) for chunk in chunks(df.columns, weight)]
    drawn = [_partial(df, cells, chunk, _sketches) for chunk in chunks(df.columns, lambda _: 1, SKETCHES_PER_SCAN)]
    # Columns of a table without rows have a state too.
    nothing = df.sparkSession.createDataFrame(
        [(c, i, dtype_name(df.schema[c].dataType), 0, 0) for i, c in enumerate(df.columns)],
        "column_name string, position int, dtype string, row_count bigint, non_null bigint")
    parts = [union_all(plain), union_all(drawn), nothing]
    return merged_states(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


def _partial(df: DataFrame, cells: DataFrame, names: Sequence[str], fields) -> DataFrame:
    aggregates, rows = [], []
    for i, name in enumerate(names):
        fixed = {"column_name": F.lit(name), "position": F.lit(df.columns.index(name)),
                 "dtype": F.lit(dtype_name(df.schema[name].dataType))}
        for field, made in fields(df, name).items():
            aggregates.append(made.alias(f"{field}_{i}"))
            fixed[field] = F.col(f"{field}_{i}")
        rows.append(F.struct(*[v.alias(k) for k, v in fixed.items()]))
    merged = cells.select((F.spark_partition_id() % MERGES).alias("__merge"), *[col(c) for c in names]).groupBy(
        "__merge").agg(*aggregates)
    return merged.select(F.inline(F.array(*rows)))


def _sketches(df: DataFrame, name: str) -> dict[str, Column]:
    size = F.lit(sketch_size(COLUMN_ACCURACY))
    numeric = is_numeric(df.schema[name].dataType)
    return {"sketch": F.kll_sketch_agg_double(present_double(name), size) if numeric else F.max(F.lit(None).cast("binary")),
            "distinct_sketch": distinct_sketch(df, name)}


def _fields(df: DataFrame, name: str, texts: Sequence[str]) -> dict[str, Column]:
    """The plain aggregates of a column's state; NULL where its type has no such thing."""
    t = df.schema[name].dataType
    out = {}
    for measure in _TAKEN:
        for field, sql_type, build in MEASURES[measure]:
            made = build(name, t) if field not in TEXT_FIELDS or field in texts else None
            out[field] = (F.lit(None) if made is None else made).cast(sql_type)
    length = MEASURES["length"][0][2](name, t) is not None
    x = present_double(name) if is_numeric(t) else F.lit(None).cast("double")
    n, sd = F.count(x), F.stddev_pop(x)
    numeric = is_numeric(t)
    out |= {
        "min_length": F.min(F.length(col(name))) if length else F.lit(None).cast("int"),
        "max_length": F.max(F.length(col(name))) if length else F.lit(None).cast("int"),
        "length_sum": F.sum(F.length(col(name)).cast("long")) if length else F.lit(None).cast("bigint"),
        "mean": F.avg(x), "min": F.min(x), "max": F.max(x), "m2": F.var_pop(x) * n,
        "m3": F.coalesce(F.skewness(x), F.lit(0.0)) * n * F.pow(sd, F.lit(3.0)),
        "m4": F.coalesce(F.kurtosis(x) + 3, F.lit(0.0)) * n * F.pow(sd, F.lit(4.0)),
    }
    return {k: v if numeric or k not in ("mean", "min", "max", *POWERS) else F.lit(None).cast("double") for k, v in out.items()}


def merged_states(states: DataFrame) -> DataFrame:
    """One row per column from those of any number of slices of a table.

    Moments are moved to the common mean before they are added. The least value is that of the
    values as text; it stands for a column of one value. Slices must have the same columns.
    """
    whole = Window.partitionBy("column_name")  # one row per slice
    weight = F.when(F.col("mean").isNotNull(), F.col("non_null"))
    mean = F.sum(weight * F.col("mean")).over(whole) / F.sum(weight).over(whole)
    moved = states.withColumn("__mean", mean).withColumn("__d", F.col("mean") - F.col("__mean"))
    n, d, m2, m3, m4 = (F.col(c) for c in ("non_null", "__d", *POWERS))
    grown = {"m2": m2 + n * d ** 2, "m3": m3 + 3 * d * m2 + n * d ** 3, "m4": m4 + 4 * d * m3 + 6 * d ** 2 * m2 + n * d ** 4}
    # A slice without values has an empty sketch of the default size, which does not unite with others.
    counted = F.when(F.hll_sketch_estimate("distinct_sketch") > 0, F.col("distinct_sketch"))
    return moved.groupBy("column_name", "position", "dtype").agg(
        *[F.sum(c).alias(c) for c in SUMS], *[F.min(c).alias(c) for c in LEAST], *[F.max(c).alias(c) for c in MOST],
        F.first("__mean").alias("mean"), *[F.sum(v).alias(k) for k, v in grown.items()],
        F.kll_merge_agg_double("sketch").alias("sketch"), F.hll_union_agg(counted).alias("distinct_sketch"))


def finished(state: DataFrame) -> DataFrame:
    """The statistics that follow from a merged state, with the names that other operators
    give them; ``distinct_count`` and quartiles are estimates from the sketches."""
    n, m2 = F.col("non_null").cast("double"), F.col("m2")
    std = F.when(n > 1, F.sqrt(m2 / (n - 1)))
    g1, g2 = (F.try_divide(F.col("m3") * F.sqrt(n), F.pow(m2, F.lit(1.5))), F.try_divide(F.col("m4") * n, m2 * m2) - 3)
    held = F.col("sketch").isNotNull() & F.col("mean").isNotNull()
    quartiles = F.when(held, F.kll_sketch_get_quantile_double("sketch", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))
    return state.select(
        "column_name", "position", "dtype", *SUMS[:-1], *LEAST, *MOST, "mean", std.alias("std"),
        F.when(n < 3, None).when(std == 0, 0.0).otherwise(g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
        F.when(n < 4, None).when(std == 0, 0.0).otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("kurtosis"),
        F.try_divide(F.col("length_sum").cast("double"), n).alias("mean_length"),
        F.coalesce(F.hll_sketch_estimate("distinct_sketch"), F.lit(0)).alias("distinct_count"),
        *[F.get(quartiles, F.lit(i)).alias(q) for i, q in enumerate(("q25", "median", "q75"))],
        (F.col("row_count") - F.col("non_null")).alias("missing"), "sketch")


@dataclass(frozen=True)
class Assessment:
    """``columns`` has one row per column: all statistics, ``z_outliers`` and ``iqr_outliers``;
    ``table`` is one row: ``row_count``, ``distinct_rows``, ``duplicate_rows``, ``sparse_rows``.
    Both are small and in hand, whatever is read off them starts no work on the rows."""

    columns: DataFrame
    table: DataFrame


def assess(df: DataFrame, approx: bool = False, z_limit: float = 3.0, iqr_reach: float = 1.5) -> Assessment:
    """All that issues, scores and advice look at, from two scans.

    The first makes the state. The second counts how often every value and every row occurs,
    in one shuffle, and writes the counts to the shared folder: distinct counts, quartiles,
    outliers, repeated and mostly empty rows come from them. Without such a folder the second scan
    is done for each of these. With ``approx`` distinct counts and quartiles are the state's estimates, and the
    second scan counts outliers only; repeated rows are still counted exactly.
    """
    if not df.columns:
        raise ValueError("no columns to profile")
    state = finished(column_state(df, CHECKS))
    state = df.sparkSession.createDataFrame(state.collect(), state.schema)  # one row per column of the schema
    looked = _approximately if approx else _exactly
    return looked(df, state, z_limit, iqr_reach)


def _exactly(df: DataFrame, state: DataFrame, z_limit: float, iqr_reach: float) -> Assessment:
    counts = _value_counts(df)
    if df.sparkSession.conf.get("spark.checkpoint.dir", None):
        counts = materialise(counts, "counts")  # several plans read them; without a folder each makes its own
    numbers = counts.where("value IS NOT NULL AND column_name >= 0")
    sketches = state.where("mean IS NOT NULL").select(F.col("position").alias("column_name"), "sketch")
    quartiles = quantiles_of_counts(numbers, sketches)
    bounds = F.broadcast(quartiles.join(state.select(  # a row per column
        F.col("position").alias("column_name"), "mean", "std"), "column_name"))
    value, reach = F.col("value"), (F.col("q75") - F.col("q25")) * iqr_reach
    beyond = numbers.join(bounds, "column_name").groupBy("column_name").agg(
        F.max("q25").alias("q25"), F.max("median").alias("median"), F.max("q75").alias("q75"),
        F.sum(F.when(F.abs(value - F.col("mean")) / F.nullif("std", F.lit(0.0)) > z_limit, F.col("n")).otherwise(0)).alias("z_outliers"),
        F.sum(F.when((value < F.col("q25") - reach) | (value > F.col("q75") + reach), F.col("n")).otherwise(0)).alias("iqr_outliers"))
    distinct = counts.groupBy("column_name").agg(
        F.sum(F.when(F.col("n") > 0, 1)).alias("distinct_count"), F.sum("n").alias("held"),
        F.sum(F.col("n") * F.col("value")).alias("summed"))
    found = distinct.join(beyond, "column_name", "left")
    rows = found.collect()  # one row per column of the schema, and one for whole rows
    spark = df.sparkSession
    found = spark.createDataFrame([r for r in rows if r["column_name"] >= 0], found.schema)
    whole = next((r for r in rows if r["column_name"] == ROW), None)
    estimates = ("distinct_count", "q25", "median", "q75", "sketch")
    columns = state.drop(*estimates).join(F.broadcast(found.withColumnRenamed("column_name", "position").drop("held", "summed")),
                                          "position", "left").fillna(0, ["distinct_count", "z_outliers", "iqr_outliers"])
    table = (whole["held"], whole["distinct_count"], whole["held"] - whole["distinct_count"], int(whole["summed"])) if whole else (0,) * 4
    return Assessment(_ordered(spark, columns), _table(spark, table))


ROW = -1


def _value_counts(df: DataFrame) -> DataFrame:
    """(column_name, value, n): how often every value occurs, numbers as such and others without
    a value, by the column's position; whole rows are column ROW, with 1 where most cells are missing.

    """
    cells = nan_to_null(df)
    gaps = sum((col(c).isNull().cast("int") for c in cells.columns), F.lit(0))
    sparse = (gaps > len(df.columns) * 0.5).cast("double")
    kept = [F.struct(F.lit(ROW).alias("at"), sparse.alias("number"), F.hex(row_digest(df)).alias("key"))]
    for i, field in enumerate(cells.schema.fields):
        name, t = field.name, field.dataType
        number, key = F.lit(None).cast("double"), F.lit(None).cast("string")
        if is_numeric(t):
            number = col(name).cast("double") + F.lit(0.0)
        if is_integral(t):  # beyond 2 ** 53 a double does not tell whole numbers apart
            key = F.when(F.abs(number) >= 2.0 ** 53, col(name).cast("string"))
        elif not isinstance(t, FRACTIONAL_TYPES):
            key = text_key(_printable(name, t))
        kept.append(F.when(col(name).isNotNull(), F.struct(F.lit(i).alias("at"), number.alias("number"), key.alias("key"))))
    exploded = cells.select(F.explode(F.array(*kept)).alias("cell")).where("cell IS NOT NULL").select("cell.*")
    counted = exploded.groupBy("at", "number", "key").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("at").alias("column_name"), F.col("number").alias("value"), "n")


def _approximately(df: DataFrame, state: DataFrame, z_limit: float, iqr_reach: float) -> Assessment:
    known = {r["column_name"]: r for r in state.collect()}
    counts = []
    for name in numeric_columns(df):
        r, x = known[name], present_double(name)
        z = F.abs(x - r["mean"]) / r["std"] > z_limit if r["std"] else F.lit(False)
        reach = (r["q75"] - r["q25"]) * iqr_reach if r["q25"] is not None else None
        fenced = (x < r["q25"] - reach) | (x > r["q75"] + reach) if reach is not None else F.lit(False)
        counts += [(name, F.count_if(z), F.count_if(fenced))]
    gaps = sum((col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    found = nan_to_null(df).agg(F.count_if(gaps > len(df.columns) * 0.5).alias("sparse"), *[
        v.alias(f"{kind}_{i}") for i, (_, z, iqr) in enumerate(counts) for kind, v in (("z", z), ("iqr", iqr))]).first()
    spark = df.sparkSession
    rows = [(c, found[f"z_{i}"], found[f"iqr_{i}"]) for i, (c, *_) in enumerate(counts)]
    beyond = spark.createDataFrame(rows, "column_name string, z_outliers bigint, iqr_outliers bigint")
    copies = row_counts(df).first()
    table = (copies["row_count"], copies["distinct_rows"], copies["duplicate_rows"], found["sparse"])
    columns = state.drop("sketch").join(F.broadcast(beyond), "column_name", "left").fillna(0, ["z_outliers", "iqr_outliers"])
    return Assessment(_ordered(spark, columns), _table(spark, table))


def _ordered(spark, columns: DataFrame) -> DataFrame:
    """In hand: one row per column of the schema."""
    columns = columns.orderBy("position")
    return spark.createDataFrame(columns.collect(), columns.schema)


def _table(spark, row: tuple) -> DataFrame:
    return spark.createDataFrame([row], "row_count bigint, distinct_rows bigint, duplicate_rows bigint, sparse_rows bigint")
