"""Exact quantiles of whole columns without bringing a column to one task.

Three steps; without groups the first one runs at once, the others are lazy:

1. One scan builds bounded sketches of all columns. They are merged in levels: those of
   some tasks by one task, and then, column by column, what these hold. A bracket of
   values around every wanted rank is read from each column's sketch.
2. A second scan counts what lies below each bracket and tallies the values
   inside it. Only the tallies are shuffled; equal values are merged on the map
   side, so a value that fills a third of the table is one row.
3. The bracket is cut into cells by value. Cell totals find the cell that holds
   the rank, and only that cell is sorted.

The sketch decides how much work step 2 and 3 have, never what the answer is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepkit.functions.columns import chunks, col, long_doubles, present_double, union_all

#: Relative rank error is at most 1 / ACCURACY in the sketches of groups, and in those of whole
#: columns, which are kept smaller, 1 / COLUMN_ACCURACY (in 99 of 100 sketches). The cells
#: below make up for the wider bracket.
ACCURACY, COLUMN_ACCURACY = 1_000, 500
#: The bracket reaches this many rank errors to either side of the wanted rank.
MARGIN = 4
#: Tasks that merge the sketches of the scan, each an equal part of them.
MERGES = 64
#: Sketches built by one aggregate; more columns are another scan.
SKETCHES_PER_SCAN = 256
#: Cells a bracket is cut into.
CELLS = 4_096

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    wanted: Mapping[str, float] = QUARTILES,
    by: Sequence[str] = (),
) -> DataFrame:
    """(by..., column_name, one column per wanted quantile), linear interpolation.

    Columns or groups without any value give no row.
    """
    keys = [*by, "column_name"]
    labels = list(wanted)
    values = long_doubles(df, columns, by)

    shares = [wanted[k] for k in labels]
    if by:
        reach = MARGIN / ACCURACY
        sketched = values.groupBy(*[col(k) for k in keys]).agg(
            F.percentile_approx("value", _probes(shares, reach), ACCURACY).alias("probe"))
        brackets = _brackets(sketched, keys, shares, reach)
    else:
        reach = MARGIN / COLUMN_ACCURACY
        brackets = _brackets(_read(column_sketches(df, columns), _probes(shares, reach)), keys, shares, reach)
        # collected: one row per column of the schema, constants for the second scan
        brackets = F.broadcast(df.sparkSession.createDataFrame(brackets.collect(), brackets.schema))
    return _exact(values, brackets, keys, wanted, F.lit(1), broadcast=not by)


def quantiles_of_counts(counts: DataFrame, sketches: DataFrame, wanted: Mapping[str, float] = QUARTILES) -> DataFrame:
    """(column_name, one column per wanted quantile), exact, from (column_name, value, n) and the
    columns' sketches."""
    reach, shares = MARGIN / COLUMN_ACCURACY, list(wanted.values())
    brackets = F.broadcast(_brackets(_read(sketches, _probes(shares, reach)), ["column_name"], shares, reach))
    return _exact(counts, brackets, ["column_name"], wanted, F.col("n"), broadcast=True)


def _exact(values: DataFrame, brackets: DataFrame, keys: list[str], wanted: Mapping[str, float],
           weight: Column, broadcast: bool) -> DataFrame:
    labels, shares = list(wanted), list(wanted.values())
    tallies = _tallies(values, brackets, keys, len(labels), weight)
    located = _locate(tallies, keys, shares)
    if broadcast:
        located = F.broadcast(located)  # at most two cells per column and quantile
    return _pick(tallies, located, keys, labels)


def approx_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    wanted: Mapping[str, float] = QUARTILES,
    by: Sequence[str] = (),
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Same shape as :func:`exact_quantiles`, one scan, ranks within 1 / accuracy."""
    keys = [*by, "column_name"]
    if by:
        found = long_doubles(df, columns, by).groupBy(*[col(k) for k in keys]).agg(
            F.percentile_approx("value", list(wanted.values()), accuracy).alias("found"))
    else:
        found = _read(column_sketches(df, columns, accuracy), list(wanted.values())).withColumnRenamed("probe", "found")
    return found.select(
        *[col(k) for k in keys], *[F.get("found", F.lit(i)).alias(k) for i, k in enumerate(wanted)]
    )


def quantiles(df, columns, wanted=QUARTILES, by=(), approx=False) -> DataFrame:
    return (approx_quantiles if approx else exact_quantiles)(df, columns, wanted, by)


def _probes(shares: list[float], reach: float) -> list[float]:
    return [p for share in shares for p in (max(share - reach, 0.0), min(share + reach, 1.0))]


def sketch_size(accuracy: int) -> int:
    """The size parameter of a sketch whose rank error stays within 1 / accuracy in 99 of 100 cases,
    with half of that to spare; the formula is that of the sketch's makers."""
    return min(65_535, int((2.296 * 1.5 * accuracy) ** (1 / 0.9021)) + 1)


def column_sketches(df: DataFrame, columns: Sequence[str], accuracy: int = COLUMN_ACCURACY) -> DataFrame:
    """(column_name, sketch): one mergeable sketch of each column that has a value.

    The aggregate is over the wide table, so no row is multiplied by the column count. No task
    merges the sketches of all scan tasks: each of MERGES tasks takes a part of them, and then
    each column's few are merged on their own.
    """
    size = sketch_size(accuracy)
    parts = []
    for chunk in chunks(list(columns), lambda _: 1, SKETCHES_PER_SCAN):
        wide = df.select((F.spark_partition_id() % MERGES).alias("merge"), *[
            present_double(c).alias(f"x_{i}") for i, c in enumerate(chunk)])
        merged = wide.groupBy("merge").agg(*[
            F.kll_sketch_agg_double(f"x_{i}", F.lit(size)).alias(f"sketch_{i}") for i in range(len(chunk))])
        parts.append(merged.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(f"sketch_{i}").alias("sketch"))
            for i, c in enumerate(chunk)]))))
    return merged_sketches(union_all(parts))


def merged_sketches(sketches: DataFrame) -> DataFrame:
    """One sketch per column from any number of them, say those of a table's slices."""
    merged = sketches.where("sketch IS NOT NULL").groupBy("column_name").agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.where(F.kll_sketch_get_n_double("sketch") > 0)


def _read(sketches: DataFrame, shares: list[float]) -> DataFrame:
    return sketches.select("column_name", F.kll_sketch_get_quantile_double(
        "sketch", F.array(*map(F.lit, shares))).alias("probe"))


def _brackets(sketched: DataFrame, keys: list[str], shares: list[float], reach: float) -> DataFrame:
    bounds = []
    for i, share in enumerate(shares):
        # at the ends of the range the sketch gives no guarantee: leave it open
        lo = F.lit(float("-inf")) if share - reach <= 0 else F.get("probe", F.lit(2 * i))
        hi = F.lit(float("inf")) if share + reach >= 1 else F.get("probe", F.lit(2 * i + 1))
        bounds += [lo.alias(f"lo_{i}"), hi.alias(f"hi_{i}")]
    return sketched.select(*[col(k) for k in keys], *bounds)


def _tallies(values: DataFrame, brackets: DataFrame, keys: list[str], slots: int, weight: Column) -> DataFrame:
    """(keys..., slot, lo, hi, side, value, n) where side is -1 below, 0 inside, 1 above.

    Outside rows are merged into one row per side that keeps the value nearest to
    the bracket, because a rank may sit right at its edge.
    """
    v = F.col("value")
    placed = values.join(brackets, keys)
    side = [
        F.when(v < F.col(f"lo_{i}"), -1).when(v > F.col(f"hi_{i}"), 1).otherwise(0)
        for i in range(slots)
    ]
    code = F.lit(0)
    inside = F.lit(False)
    for i in range(slots):
        code = code + (side[i] + 1) * (3 ** i)
        inside = inside | (side[i] == 0)
    merged = (
        placed.select(
            *[col(k) for k in keys], code.alias("code"), F.when(inside, v).alias("inner"), v, weight.alias("n")
        )
        .groupBy(*[col(k) for k in keys], "code", "inner")
        .agg(F.sum("n").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
        .join(brackets, keys)
    )
    per_slot = merged.select(
        *[col(k) for k in keys], "n", "least", "most",
        F.explode(F.array(*[
            F.struct(
                F.lit(i).alias("slot"),
                F.col(f"lo_{i}").alias("lo"),
                F.col(f"hi_{i}").alias("hi"),
                (F.pmod(F.floor(F.col("code") / (3 ** i)), F.lit(3)).cast("int") - 1).alias("side"),
            )
            for i in range(slots)
        ])).alias("at"),
    ).select(*[col(k) for k in keys], "n", "least", "most", "at.*")
    return per_slot.groupBy(
        *[col(k) for k in keys], "slot", "lo", "hi", "side",
        F.when(F.col("side") == 0, F.col("least")).alias("inner"),
    ).agg(
        F.sum("n").alias("n"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
    ).withColumn(
        "value", F.when(F.col("side") < 0, F.col("most")).otherwise(F.col("least"))
    ).select(*[col(k) for k in keys], "slot", "n", "value", _cell().alias("cell"))


def _cell() -> Column:
    """Position of an inside value among CELLS equal cuts of its bracket.

    It is taken from the same value that is sorted later, so that the plan that adds up
    cells and the plan that sorts one of them need the same shuffle, which is done once.
    """
    lo, hi, v = F.col("lo"), F.col("hi"), F.col("value")
    width = hi - lo
    cut = F.floor(F.try_divide(v - lo, width) * CELLS)
    bounded = (width > 0) & (width < float("inf"))
    inner = F.when(bounded, F.least(cut, F.lit(CELLS - 1))).otherwise(F.lit(0))
    return F.when(F.col("side") < 0, F.lit(-1)).when(F.col("side") > 0, F.lit(CELLS)).otherwise(
        inner).cast("int")


def _locate(tallies: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """The cells that hold the ranks to both sides of the wanted position."""
    slot_keys = [*[col(k) for k in keys], F.col("slot")]
    share = F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("slot") + 1)
    by_slot = Window.partitionBy(*slot_keys)  # at most CELLS + 2 rows
    cells = tallies.groupBy(*slot_keys, "cell").agg(F.sum("n").alias("held"))
    position = share * (F.col("total") - 1)
    return (
        cells.withColumn("total", F.sum("held").over(by_slot))
        .withColumn("before", F.sum("held").over(by_slot.orderBy("cell")) - F.col("held"))
        .withColumn("low_rank", F.floor(position) + 1)
        .withColumn("high_rank", F.ceil(position) + 1)
        .withColumn("fraction", position - F.floor(position))
        .filter(_holds("low_rank", F.col("before"), F.col("held"))
                | _holds("high_rank", F.col("before"), F.col("held")))
        .drop("held", "total")
    )


def _pick(tallies: DataFrame, located: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    in_cell = Window.partitionBy(*[col(k) for k in keys], "slot", "cell").orderBy("value")
    ranked = tallies.join(located, [*keys, "slot", "cell"]).withColumn(
        "preceding", F.col("before") + F.sum("n").over(in_cell) - F.col("n")
    )
    ends = ranked.groupBy(*[col(k) for k in keys]).agg(*[
        made
        for i in range(len(labels))
        for made in (
            F.max(F.when((F.col("slot") == i) & _is_at("low_rank"), F.col("value"))).alias(f"low_{i}"),
            F.max(F.when((F.col("slot") == i) & _is_at("high_rank"), F.col("value"))).alias(f"high_{i}"),
            F.max(F.when(F.col("slot") == i, F.col("fraction"))).alias(f"fraction_{i}"),
        )
    ])
    return ends.select(
        *[col(k) for k in keys],
        *[
            F.when(F.col(f"low_{i}").isNull() | F.col(f"high_{i}").isNull(),
                   F.raise_error(F.lit("rank outside the sketched bracket")).cast("double"))
            .when(F.col(f"low_{i}") == F.col(f"high_{i}"), F.col(f"low_{i}"))
            .otherwise(F.col(f"low_{i}")
                       + (F.col(f"high_{i}") - F.col(f"low_{i}")) * F.col(f"fraction_{i}"))
            .alias(label)
            for i, label in enumerate(labels)
        ],
    )


def _holds(rank: str, preceding: Column, n: Column) -> Column:
    return (F.col(rank) > preceding) & (F.col(rank) <= preceding + n)


def _is_at(rank: str) -> Column:
    """A merged outside row only knows its value nearest to the bracket."""
    preceding, n = F.col("preceding"), F.col("n")
    return (
        F.when(F.col("cell") == -1, F.col(rank) == preceding + n)
        .when(F.col("cell") == CELLS, F.col(rank) == preceding + 1)
        .otherwise(_holds(rank, preceding, n))
    )
