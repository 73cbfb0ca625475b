"""Operators that need a global row order, spread over many tasks.

The order key is cut into buckets at two levels of sampled edges: a few coarse edges, and
within each coarse part edges of its own. Buckets follow each other in order, so whatever has to
pass from one to the next (a running count, the last value seen) is one small row per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepkit.functions.columns import FRACTIONAL_TYPES, col, is_text, require_columns

ROWS_PER_BUCKET = 1_000_000
#: Buckets of a coarse part, as long as the coarse parts are fewer than that too.
FINE = 1_024
#: Sampled keys per edge, within the coarse parts and between them; more gives evener buckets.
SAMPLES_PER_EDGE, SAMPLES_PER_COARSE_EDGE = 8, 64
#: Letters of a text that an edge keeps. A shortened text is an edge as good as any.
EDGE_LETTERS = 64
#: Values of the hash that picks the sampled keys.
HASHES = 1 << 40

BUCKET, COARSE, EDGES = "__bucket", "__coarse", "__edges"


def with_bucket(
    df: DataFrame, order_by: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Add the bucket number of each row under ``order_by``, ascending with the order.

    Keys are sampled by their hash, so the sample follows from the data and not from how it
    lies in partitions, and a key counts once however often it occurs. It decides how even
    the buckets are, not what any operator returns. There are as many buckets as the rows
    ask for. To the driver come the coarse edges, as many as the root of the number of
    buckets, and an edge of bounded length per bucket, which is broadcast.
    """
    require_columns(df, order_by)
    rows = df.count()
    buckets = -(-rows // rows_per_bucket)
    if buckets <= 1:
        return df.withColumn(BUCKET, F.lit(0).cast("long"))
    parts = max(-(-buckets // FINE), 1 if buckets <= FINE else int(buckets ** 0.5))
    fine = -(-buckets // parts)
    keys, edge_type = _edge_keys(df, order_by)
    sampled = df.select(F.struct(*keys).alias("key")).where(_sampled(order_by, buckets / rows)).distinct()
    coarse = _coarse_edges(sampled, parts, min(rows, buckets * SAMPLES_PER_EDGE))
    spark = df.sparkSession
    in_parts = sampled.withColumn(COARSE, _edges_passed(F.from_json(F.lit(coarse), edge_type), F.col("key"), parts))
    tables = in_parts.groupBy(COARSE).agg(F.to_json(_spaced(F.array_sort(F.collect_list("key")), fine)).alias("json"))
    rows_of = spark.createDataFrame(tables.collect(), tables.schema)  # an edge of bounded length per bucket
    table = F.broadcast(rows_of.select(COARSE, F.from_json("json", edge_type).alias(EDGES)))
    key = F.struct(*[col(c).alias(f"k{i}") for i, c in enumerate(order_by)])
    cut = df.withColumn(COARSE, _edges_passed(F.from_json(F.lit(coarse), edge_type), key, parts)).join(table, COARSE, "left")
    passed = F.coalesce(_edges_passed(F.col(EDGES), key, fine), F.lit(0))
    return cut.withColumn(BUCKET, F.col(COARSE).cast("long") * (1 << 32) + passed).select(*[col(c) for c in df.columns], BUCKET)


def _edge_keys(df: DataFrame, order_by: Sequence[str]) -> tuple[list[Column], T.ArrayType]:
    types = [df.schema[c].dataType for c in order_by]
    keys = [(F.substring(col(c), 1, EDGE_LETTERS) if is_text(t) else col(c)).alias(f"k{i}")
            for i, (c, t) in enumerate(zip(order_by, types))]
    return keys, T.ArrayType(T.StructType([T.StructField(f"k{i}", t) for i, t in enumerate(types)]))


def _sampled(order_by: Sequence[str], edges_per_row: float) -> Column:
    share = min(1.0, edges_per_row * SAMPLES_PER_EDGE)
    return F.pmod(F.xxhash64(*[col(c) for c in order_by]), F.lit(HASHES)) < int(share * HASHES)


def _coarse_edges(sampled: DataFrame, parts: int, held: int) -> str:
    """Edges between the coarse parts, from so much of the sample, of some ``held`` keys, as they need."""
    if parts == 1:
        return "[]"
    share = min(1.0, parts * SAMPLES_PER_COARSE_EDGE / held)
    few = sampled.where(F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(HASHES)) < int(share * HASHES))
    ordered = few.agg(F.array_sort(F.collect_list("key")).alias("keys"))
    return ordered.select(F.to_json(_spaced(F.col("keys"), parts))).first()[0]


def _spaced(keys: Column, parts: int) -> Column:
    """At most ``parts`` - 1 of the sorted keys, at even distances, each once."""
    step = F.ceil(F.size(keys) / parts)
    return F.array_distinct(F.filter(keys, lambda _, i: (F.pmod(i + 1, step) == 0) & (i + 1 < F.size(keys))))


def _edges_passed(edges: Column, key: Column, most: int) -> Column:
    """Number of sorted edges at or below the key, by halving steps; there are ``most`` at most."""
    steps = [1 << power for power in reversed(range(max(1, most).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda passed, step: F.when(F.get(edges, passed + step - 1) <= key, passed + step)
        .otherwise(passed),
    )


def _carried(per_bucket: DataFrame, columns: Sequence[str], backward: bool) -> DataFrame:
    """Last known value before each bucket (next one after it when backward).

    The window has one row per bucket.
    """
    order = F.desc(BUCKET) if backward else F.asc(BUCKET)
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return per_bucket.select(
        BUCKET, *[F.last(col(c), True).over(before).alias(c) for c in columns]
    )


def fill(
    df: DataFrame,
    columns: Sequence[str],
    order_by: Sequence[str],
    backward: bool = False,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Fill NULLs with the previous (next) value in the order of ``order_by``.

    Rows that share one order key count as one moment: a value present at the key
    fills the other rows of that key, and the greatest one stands for the key.
    Only rows that miss a value are moved; the lookup table is built from the
    order key and the filled columns alone, one row per key.
    """
    require_columns(df, [*order_by, *columns])
    clash = set(columns) & set(order_by)
    if clash:
        raise ValueError(f"cannot fill order column(s): {', '.join(sorted(clash))}")

    def value(c: str) -> Column:
        return F.when(~F.isnan(col(c)), col(c)) if isinstance(
            df.schema[c].dataType, FRACTIONAL_TYPES) else col(c)

    slots = [f"__fill_{i}" for i in range(len(columns))]
    names = [f"__key_{i}" for i in range(len(order_by))]
    bucketed = with_bucket(df, order_by, rows_per_bucket)
    keyed = bucketed.groupBy(
        BUCKET, *[col(c).alias(k) for c, k in zip(order_by, names)]
    ).agg(*[F.max(value(c)).alias(s) for c, s in zip(columns, slots)])

    order = [F.desc_nulls_last(k) if backward else F.asc_nulls_first(k) for k in names]
    within = Window.partitionBy(BUCKET).orderBy(*order)
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    point = F.struct(*[F.col(k) for k in names])
    latest = F.min_by if backward else F.max_by
    ends = keyed.groupBy(BUCKET).agg(*[
        latest(F.col(s), F.when(F.col(s).isNotNull(), point)).alias(s) for s in slots
    ])
    carried = F.broadcast(_carried(ends, slots, backward))  # one row per bucket
    # every bucket has a carried row; a left join keeps the filter an inner join would add
    # out of one of the two uses of ``keyed``, so that its shuffle is done once
    lookup = (
        keyed.select(BUCKET, *names, *[F.last(F.col(s), True).over(running).alias(s) for s in slots])
        .join(carried.select(BUCKET, *[F.col(s).alias(f"{s}_carried") for s in slots]), BUCKET, "left")
        .select(*names, *[F.coalesce(s, f"{s}_carried").alias(s) for s in slots])
    )

    lacks = F.lit(False)
    for c in columns:
        lacks = lacks | value(c).isNull()
    same_key = None
    for c, k in zip(order_by, names):
        match = col(c).eqNullSafe(F.col(k))
        same_key = match if same_key is None else same_key & match
    slot_of = dict(zip(columns, slots))
    filled = df.filter(lacks).join(lookup, same_key, "left").select(*[
        F.coalesce(value(c), F.col(slot_of[c])).alias(c) if c in slot_of else col(c)
        for c in df.columns
    ])
    return df.filter(~lacks).unionByName(filled)


def dense_codes(
    values: DataFrame, column: str = "value", rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Number distinct values 0, 1, 2... in sorted order: (column, code)."""
    bucketed = with_bucket(values.select(col(column)), [column], rows_per_bucket)
    sizes = bucketed.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("held"))
    earlier = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    offsets = sizes.select(
        BUCKET, F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("offset")
    )
    within = Window.partitionBy(BUCKET).orderBy(col(column))
    return (
        bucketed.withColumn("__place", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), BUCKET, "left")
        .select(col(column), (F.col("offset") + F.col("__place")).cast("bigint").alias("code"))
    )


def average_ranks(
    counts: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET, gaps: Sequence[str] = (), most: int | None = None
) -> DataFrame:
    """(value, rank) from (value, n): equal values share the mean of their places.

    ``gaps`` are columns like ``n`` that count those rows of a value that a partner column has no
    value for. Each is replaced by the rank among the other rows: its running count is taken off
    the running count of all, so one sort serves every partner. Where there are known to be ``most``
    values and those fit one bucket, nothing is counted first.
    """
    held = ["n", *gaps]
    if most is not None and most <= rows_per_bucket:
        whole = Window.partitionBy(F.lit(0)).orderBy("value")
        return _ranked(counts.select("value", *held, *[F.sum(c).over(whole).alias(f"__upto_{c}") for c in held],
                                     *[F.lit(0).alias(f"__before_{c}") for c in held]), gaps)
    bucketed = with_bucket(counts, ["value"], rows_per_bucket)
    sizes = bucketed.groupBy(BUCKET).agg(*[F.sum(c).alias(c) for c in held])
    earlier = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    offsets = sizes.select(
        BUCKET, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__before_{c}") for c in held])
    within = Window.partitionBy(BUCKET).orderBy("value")
    placed = bucketed.select(
        BUCKET, "value", *held, *[F.sum(c).over(within).alias(f"__upto_{c}") for c in held]
    ).join(F.broadcast(offsets), BUCKET, "left")
    return _ranked(placed, gaps)


def _ranked(placed: DataFrame, gaps: Sequence[str]) -> DataFrame:
    def below(c: str) -> Column:
        return F.col(f"__before_{c}") + F.col(f"__upto_{c}") - F.col(c)

    return placed.select(
        "value",
        (below("n") + (F.col("n") + 1) / 2.0).alias("rank"),
        *[(below("n") - below(g) + (F.col("n") - F.col(g) + 1) / 2.0).alias(g) for g in gaps],
    )
