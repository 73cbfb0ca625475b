"""Chart-ready tables: binned, counted and summarised where the data is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepkit.functions.columns import (
    FRACTIONAL_TYPES,
    chunks,
    col,
    numeric_columns,
    present_double,
    require_columns,
    text_columns,
    union_all,
)
from prepkit.operators.broadcasts import broadcast_if_small, fitted, with_row
from prepkit.operators.frequency import value_counts, with_distinct
from prepkit.operators.ordered import ROWS_PER_BUCKET, average_ranks
from prepkit.operators.quantiles import QUARTILES, quantiles
from prepkit.operators.stats import column_stats

HISTOGRAM_BINS = 30
BAR_CATEGORIES = 20
MATRIX_ROWS = 100
FENCE = 1.5


INFINITY = float("inf")


def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0 to bins - 1 for finite values: the maximum falls in the last bin, a constant in the
    first. Minus infinity is bin -1, infinity is bin ``bins``."""
    share = F.try_divide(value - low, high - low)
    inside = F.coalesce(F.least(F.floor(share * bins), F.lit(bins - 1)), F.lit(0))
    return F.when(value == -INFINITY, -1).when(value == INFINITY, bins).otherwise(inside).cast("int")


def _ends(values: DataFrame, *names: str) -> DataFrame:
    """One row with the least and the greatest finite value of each column."""
    finite = {c: F.when(F.abs(c) < INFINITY, F.col(c)) for c in names}
    return values.agg(*[f(x).alias(f"{end}_{c}") for c, x in finite.items() for end, f in (("low", F.min), ("high", F.max))])


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(bin, bin_start, bin_end, n) with empty bins; no rows without values.

    Infinite values, where there are any, are counted in bin -1 and in bin ``bins``, beyond
    the finite ends.
    """
    require_columns(df, [column])
    values = df.select(present_double(column).alias("x")).filter(F.col("x").isNotNull())
    ends = _ends(values, "x")
    low, high = F.col("low_x"), F.col("high_x")
    counted = with_row(values, ends).groupBy(_bin(F.col("x"), low, high, bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    width = (high - low) / bins
    grid = ends.select("low_x", "high_x", F.explode(F.sequence(F.lit(-1), F.lit(bins))).alias("bin"))
    below, above = F.col("bin") == -1, F.col("bin") == bins
    return grid.join(F.broadcast(counted), "bin", "left").filter(  # at most one row per bin
        F.col("n").isNotNull() | (~below & ~above & low.isNotNull())
    ).select(
        "bin", F.when(below, -INFINITY).when(above, high).otherwise(low + F.col("bin") * width).alias("bin_start"),
        F.when(below, low).when(above, INFINITY).otherwise(low + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def box_plot(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Quartiles, whiskers at the outermost values inside the fences, outlier counts."""
    names = numeric_columns(df, columns)
    boxes = fitted(quantiles(df, names, approx=approx), list(QUARTILES))
    parts = []
    for chunk in chunks(list(boxes.items()), lambda _: 3):
        aggregates, rows = [], []
        for i, (name, box) in enumerate(chunk):
            x, reach = present_double(name), (box["q75"] - box["q25"]) * FENCE
            inside = (x >= box["q25"] - reach) & (x <= box["q75"] + reach)
            aggregates += [
                F.min(F.when(inside, x)).alias(f"low_{i}"), F.max(F.when(inside, x)).alias(f"high_{i}"),
                F.count_if(~inside).alias(f"out_{i}")]
            rows.append(F.struct(
                F.lit(name).alias("column_name"), *[F.lit(box[q]).alias(q) for q in QUARTILES],
                F.col(f"low_{i}").alias("whisker_low"), F.col(f"high_{i}").alias("whisker_high"),
                F.col(f"out_{i}").alias("outliers")))
        parts.append(df.agg(*aggregates).select(F.inline(F.array(*rows))))
    if not parts:
        raise ValueError("no values to draw a box for")
    return union_all(parts)


def bar_chart(df: DataFrame, column: str, top_n: int = BAR_CATEGORIES) -> DataFrame:
    """(rank, label, n) of the most frequent values, ties by value."""
    require_columns(df, [column])
    best = value_counts(df, column).orderBy(F.desc("n"), F.asc("value")).limit(top_n)
    return best.select(
        F.row_number().over(Window.orderBy(F.desc("n"), F.asc("value"))).alias("rank"),  # top_n rows
        F.col("value").cast("string").alias("label"), "n")


def _pearson(df: DataFrame, names: Sequence[str], of: dict[str, dict]) -> DataFrame:
    """(column_a, column_b, r) over rows where both have a value; NULL for a constant.

    ``of`` holds the mean of each column and whether it has gaps. Values are taken
    relative to the mean, so that plain sums, the cheapest aggregate there is, keep
    their precision. A pair without gaps needs three sums, one with gaps six.
    """
    centred = df.select(*[
        (present_double(c) - F.lit(of[c]["mean"] or 0.0)).alias(f"c_{i}") for i, c in enumerate(names)])

    def gaps(pair: tuple[str, str]) -> bool:
        return any(of[c]["missing"] for c in pair)

    at = {c: i for i, c in enumerate(names)}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    parts = []
    for chunk in chunks(pairs, lambda pair: 6 if gaps(pair) else 2):
        sums: dict[str, Column] = {}
        rows = []
        for k, (a, b) in enumerate(chunk):
            x, y = F.col(f"c_{at[a]}"), F.col(f"c_{at[b]}")
            sums[f"xy_{k}"] = F.sum(x * y)
            if gaps((a, b)):
                both = x.isNotNull() & y.isNotNull()
                sums[f"n_{k}"] = F.count_if(both)
                sums[f"x_{k}"], sums[f"y_{k}"] = F.sum(F.when(both, x)), F.sum(F.when(both, y))
                sums[f"xx_{k}"], sums[f"yy_{k}"] = F.sum(F.when(both, x * x)), F.sum(F.when(both, y * y))
                n, sx, sy = F.col(f"n_{k}"), F.col(f"x_{k}"), F.col(f"y_{k}")
                cross = F.col(f"xy_{k}") - F.try_divide(sx * sy, n)
                wide = F.col(f"xx_{k}") - F.try_divide(sx * sx, n)
                tall = F.col(f"yy_{k}") - F.try_divide(sy * sy, n)
            else:
                sums[f"own_{at[a]}"], sums[f"own_{at[b]}"] = F.sum(x * x), F.sum(y * y)
                cross, wide, tall = F.col(f"xy_{k}"), F.col(f"own_{at[a]}"), F.col(f"own_{at[b]}")
            varies = (wide > 0) & (tall > 0) & F.lit(not any(of[c]["constant"] for c in (a, b)))
            r = F.when(varies, cross / F.when(varies, F.sqrt(wide) * F.sqrt(tall)))
            rows += [F.struct(F.lit(one).alias("column_a"), F.lit(other).alias("column_b"), r.alias("r"))
                     for one, other in dict.fromkeys([(a, b), (b, a)])]
        wide_row = centred.agg(*[made.alias(label) for label, made in sums.items()])
        parts.append(wide_row.select(F.inline(F.array(*rows))))
    return union_all(parts)


def _correlated(df: DataFrame, columns: Sequence[str] | None, limit: int | None) -> list[str]:
    names = numeric_columns(df, columns)[:limit]
    if len(names) < 2:
        raise ValueError("a correlation needs two numeric columns")
    return names


def correlation(df: DataFrame, columns: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Pearson matrix of the numeric columns, or of the first ``limit``, long form, both triangles."""
    names = _correlated(df, columns, limit)
    of = fitted(column_stats(df, ["moments"], names), ["mean", "min", "max", "missing"])
    for found in of.values():
        found["constant"] = found["min"] == found["max"]
    return _pearson(df, names, of)


def rank_correlation(
    df: DataFrame, columns: Sequence[str] | None = None, limit: int | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Spearman matrix, long form, both triangles; each pair over the rows in which both
    columns have a value.

    Ranks depend on the rows they are taken over. A column's distinct values are sorted once;
    beside the count of its rows each carries, for every partner with gaps, the count of rows the
    partner misses, and the running sums give the ranks towards all partners.
    """
    names = _correlated(df, columns, limit)
    places = range(len(names))
    values = df.select(*[present_double(c).alias(f"x_{i}") for i, c in enumerate(names)])
    held = values.agg(F.count(F.lit(1)).alias("rows"), *[F.count(f"x_{i}").alias(f"n_{i}") for i in places]).first()
    gapped = [i for i in places if held[f"n_{i}"] < held["rows"]]
    shared = _shared_rows(values, gapped)

    def rows_of(i: int, j: int) -> int:
        return shared[i, j] if (i, j) in shared else min(held[f"n_{i}"], held[f"n_{j}"])

    def rank(i: int, j: int) -> str:
        """The column that holds the ranks of i among the rows that j has a value in."""
        return f"r_{i}_{j}" if j in gapped and j != i else f"r_{i}"

    ranked = values
    for i in places:
        partners = [j for j in gapped if j != i]
        counts = values.where(F.col(f"x_{i}").isNotNull()).groupBy(F.col(f"x_{i}").alias("value")).agg(
            F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"x_{j}").isNull()).alias(f"r_{i}_{j}") for j in partners])
        most = held[f"n_{i}"]
        ranks = average_ranks(counts, rows_per_bucket, [f"r_{i}_{j}" for j in partners], most).withColumnsRenamed(
            {"value": f"x_{i}", "rank": f"r_{i}"})
        lookup = broadcast_if_small(ranks, known=16 * most * (2 + len(partners)))
        ranked = ranked.join(lookup, f"x_{i}", "left" if i in gapped else "inner")
    parts = []
    for chunk in chunks([(i, j) for i in places for j in places[i:]], lambda _: 6):
        sums, rows = [], []
        for i, j in chunk:
            # Relative to the mean of ranks 1 to n, so the sums keep their precision.
            middle = (rows_of(i, j) + 1) / 2
            x, y = F.col(rank(i, j)) - middle, F.col(rank(j, i)) - middle
            both = F.col(f"x_{i}").isNotNull() & F.col(f"x_{j}").isNotNull()
            own = [x * y, x * x, y * y]
            sums += [F.sum(F.when(both, v)).alias(f"{kind}_{i}_{j}") for kind, v in zip(("xy", "xx", "yy"), own)]
            xy, xx, yy = (F.col(f"{kind}_{i}_{j}") for kind in ("xy", "xx", "yy"))
            varies = (xx > 0) & (yy > 0)
            r = F.when(varies, xy / F.when(varies, F.sqrt(xx) * F.sqrt(yy)))
            rows += [F.struct(F.lit(names[a]).alias("column_a"), F.lit(names[b]).alias("column_b"), r.alias("r"))
                     for a, b in dict.fromkeys([(i, j), (j, i)])]
        parts.append(ranked.agg(*sums).select(F.inline(F.array(*rows))))
    return union_all(parts)


def _shared_rows(values: DataFrame, gapped: Sequence[int]) -> dict[tuple[int, int], int]:
    """Rows in which both columns have a value, for pairs of columns with gaps."""
    found = {}
    pairs = [(i, j) for i in gapped for j in gapped if i < j]
    for chunk in chunks(pairs, lambda _: 1):
        counted = values.agg(*[F.count_if(F.col(f"x_{i}").isNotNull() & F.col(f"x_{j}").isNotNull()).alias(f"n_{i}_{j}")
                               for i, j in chunk]).first()
        for i, j in chunk:
            found[i, j] = found[j, i] = counted[f"n_{i}_{j}"]
    return found


def _gap(df: DataFrame, name: str) -> Column:
    gap = col(name).isNull()
    if isinstance(df.schema[name].dataType, FRACTIONAL_TYPES):
        gap = gap | F.coalesce(F.isnan(col(name)), F.lit(False))
    return gap.cast("int")


def missing_matrix(df: DataFrame, key: Sequence[str], rows: int = MATRIX_ROWS, seed: int = 42) -> DataFrame:
    """(key..., column_name, is_missing) for a repeatable sample of rows.

    The sample follows a hash of the key; columns without a gap in it are left out.
    """
    require_columns(df, key)
    keys = [col(c) for c in key]
    place = F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))
    sampled = df.select(*keys, *[_gap(df, c).alias(f"gap_{i}") for i, c in enumerate(df.columns)],
                        place.alias("place")).orderBy("place", *key).limit(rows)
    long = sampled.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"gap_{i}").alias("is_missing"))
        for i, c in enumerate(df.columns)])))
    per_column = Window.partitionBy("column_name")  # one row per sampled row
    return long.withColumn("any", F.max("is_missing").over(per_column)).filter(F.col("any") == 1).drop("any")


def missing_patterns(df: DataFrame) -> DataFrame:
    """(pattern, n) over the whole table, one character per column, 1 for a gap."""
    pattern = F.concat(*[_gap(df, c).cast("string") for c in df.columns])
    return df.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def scatter_grid(
    df: DataFrame, x_column: str, y_column: str, color_column: str | None = None,
    bins: int = HISTOGRAM_BINS,
) -> DataFrame:
    """(x_bin, y_bin[, color], n) of the cells that hold points; infinite coordinates fall
    in bins -1 and ``bins``."""
    require_columns(df, [c for c in (x_column, y_column, color_column) if c])
    color = [col(color_column).cast("string").alias("color")] if color_column else []
    points = df.select(present_double(x_column).alias("x"), present_double(y_column).alias("y"), *color).filter(
        F.col("x").isNotNull() & F.col("y").isNotNull())
    return with_row(points, _ends(points, "x", "y")).groupBy(
        _bin(F.col("x"), F.col("low_x"), F.col("high_x"), bins).alias("x_bin"),
        _bin(F.col("y"), F.col("low_y"), F.col("high_y"), bins).alias("y_bin"),
        *(["color"] if color else []),
    ).agg(F.count(F.lit(1)).alias("n"))


def violin(
    df: DataFrame, column: str, group_column: str | None = None, bins: int = HISTOGRAM_BINS,
    approx: bool = False,
) -> DataFrame:
    """(group, bin, density, n, q25, median, q75): density and quartiles per group.

    All groups share the bins of the whole column; density sums to 1 per group. Rows without
    a group are a group of their own, NULL; infinite values fall in bins -1 and ``bins``.
    """
    require_columns(df, [c for c in (column, group_column) if c])
    group = col(group_column).cast("string") if group_column else F.lit("all")
    values = df.select(group.alias("group"), present_double(column).alias("x")).filter(F.col("x").isNotNull())
    # A name for every group, so that rows without one are ranked and joined like others.
    named = values.select(F.when(F.col("group").isNull(), "-").otherwise(F.concat(F.lit("="), "group")).alias("name"), "x")
    binned = with_row(named, _ends(named, "x")).groupBy(
        "name", _bin(F.col("x"), F.col("low_x"), F.col("high_x"), bins).alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))
    of_group = Window.partitionBy("name")  # at most one row per bin
    quarters = quantiles(named, ["x"], by=["name"], approx=approx).drop("column_name")
    return binned.withColumn("density", F.col("n") / F.sum("n").over(of_group)).join(quarters, "name").select(
        F.when(F.col("name") != "-", F.substr("name", F.lit(2))).alias("group"), "bin", "n", "density", "q25", "median", "q75")


def chart_plan(df: DataFrame, per_family: int | None = None) -> DataFrame:
    """(chart_id, chart_type, column_name): the charts worth drawing, in order; with
    ``per_family`` only those of the first numeric and the first text columns."""
    numbers = numeric_columns(df)
    stats = with_distinct(column_stats(df, []), df, text_columns(df)[:per_family]) if text_columns(df) \
        else column_stats(df, []).withColumn("distinct_count", F.lit(0))
    shown = numbers[:per_family]
    texts = text_columns(df)[:per_family]
    filled = F.col("non_null") > 0
    kinds = F.array(
        F.when(F.col("column_name").isin(shown) & filled,
               F.struct(F.lit(0).alias("block"), F.lit(0).alias("part"), F.lit("histogram").alias("chart_type"))),
        F.when(F.col("column_name").isin(shown) & filled,
               F.struct(F.lit(0).alias("block"), F.lit(1).alias("part"), F.lit("box_plot").alias("chart_type"))),
        F.when(F.col("column_name").isin(texts) & (F.col("distinct_count") > 1)
               & (F.col("distinct_count") <= BAR_CATEGORIES),
               F.struct(F.lit(1).alias("block"), F.lit(0).alias("part"), F.lit("bar_chart").alias("chart_type"))))
    single = stats.select("column_name", "position", F.explode(
        F.filter(kinds, lambda k: k.isNotNull())).alias("k")).select(
        "k.block", "position", "k.part", "k.chart_type", "column_name")
    whole = stats.groupBy().agg(F.sum("missing").alias("missing"))
    tables = whole.select(F.explode(F.filter(F.array(
        F.when(F.lit(len(numbers) >= 2), F.struct(F.lit(2).alias("block"), F.lit("correlation_matrix").alias("chart_type"))),
        F.when(F.col("missing") > 0,
               F.struct(F.lit(3).alias("block"), F.lit("missing_value_heatmap").alias("chart_type"))),
    ), lambda k: k.isNotNull())).alias("k")).select(
        "k.block", F.lit(0).alias("position"), F.lit(0).alias("part"), "k.chart_type",
        F.lit(None).cast("string").alias("column_name"))
    order = F.row_number().over(Window.orderBy("block", "position", "part"))  # a few rows per column
    return single.unionByName(tables).select(
        F.concat(F.lit("chart-"), F.lpad(order.cast("string"), 4, "0")).alias("chart_id"),
        "chart_type", "column_name")
