"""Quality issues of a table, their scores and the advice that follows from them.

Every column-level issue is read off one frame with one row per column, so the
table is scanned once per kind of statistic and not once per detector.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepkit.functions.columns import (
    chunks,
    col,
    numeric_columns,
    percent,
    present_double,
    require_columns,
    text_columns,
    union_all,
)
from prepkit.functions.keys import row_key
from prepkit.operators.frequency import row_counts, with_distinct
from prepkit.operators.profile import missing_cells
from prepkit.operators.quantiles import quantiles
from prepkit.operators.state import Assessment
from prepkit.operators.stats import MEASURES, column_stats, one_row_per_column

SEVERITIES = ["critical", "high", "medium", "low", "info"]
# Advice order of the issue types and their titles.
ADVICE = [
    ("missing_values", "Handle Missing Values"),
    ("duplicates", "Remove Duplicate Records"),
    ("type_inconsistency", "Fix Data Type Issues"),
    ("mixed_types", "Standardize Mixed Type Columns"),
    ("outliers", "Address Outliers"),
    ("constant_column", "Remove Constant Columns"),
    ("high_cardinality", "Review High Cardinality Columns"),
    ("low_variance", "Consider Low Variance Features"),
]
ID_MARKS = ("id", "key", "code")
# Detection limits.
Z_LIMIT = 3.0
IQR_REACH = 1.5
FEWEST_VALUES = 10
MOSTLY_NUMERIC = 0.9
MOSTLY_DATES = 0.8
LOW_VARIANCE = 0.01
HIGH_CARDINALITY = 0.9
HIGH_CARDINALITY_DISTINCT = 100
SCORE_WEIGHTS = {"completeness": 0.35, "uniqueness": 0.25, "consistency": 0.25, "validity": 0.15}

ISSUE_FIELDS = [
    "issue_type", "severity", "column_name", "description", "affected_rows",
    "affected_percentage", "recommendation", "details",
]


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def _ladder(percentage: Column, *rungs: tuple[float, str], otherwise: str) -> Column:
    severity = F.lit(otherwise)
    for least, name in reversed(rungs):
        severity = F.when(percentage >= least, name).otherwise(severity)
    return severity


def outlier_counts(df: DataFrame, bounds: dict[str, dict]) -> DataFrame:
    """(column_name, z_outliers, iqr_outliers) given mean, std, q25 and q75 per column."""
    parts = []
    for chunk in chunks(list(bounds.items())):
        aggregates, rows = [], []
        for i, (name, b) in enumerate(chunk):
            x = present_double(name)
            z, fenced = F.lit(False), F.lit(False)
            if b["std"]:
                z = F.abs(x - b["mean"]) / b["std"] > Z_LIMIT
            if b["q25"] is not None:
                reach = (b["q75"] - b["q25"]) * IQR_REACH
                fenced = (x < b["q25"] - reach) | (x > b["q75"] + reach)
            aggregates += [F.count_if(z).alias(f"z_{i}"), F.count_if(fenced).alias(f"iqr_{i}")]
            rows.append(F.struct(
                F.lit(name).alias("column_name"),
                F.col(f"z_{i}").alias("z_outliers"), F.col(f"iqr_{i}").alias("iqr_outliers")))
        parts.append(df.agg(*aggregates).select(F.inline(F.array(*rows))))
    return union_all(parts)


def outlier_profile(
    df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False
) -> DataFrame:
    """(column_name, non_null, mean, std, q25, q75, z_outliers, iqr_outliers) of numeric columns."""
    names = numeric_columns(df, columns)
    quarters = one_row_per_column(quantiles(df, names, {"q25": 0.25, "q75": 0.75}, approx=approx))
    frame = column_stats(df, ["moments"], names).join(quarters, "column_name", "left").select(
        "column_name", "position", "non_null", "mean", "std", "q25", "q75")
    rows = frame.collect()  # one row per column of the schema
    bounds = df.sparkSession.createDataFrame(rows, frame.schema)
    counts = one_row_per_column(outlier_counts(df, {r["column_name"]: r.asDict() for r in rows}))
    return bounds.join(counts, "column_name")


# What each kind of issue is read from: measures, and the costlier parts.
NEEDS: dict[str, tuple[list[str], set[str]]] = {
    "missing_values": ([], set()),
    "duplicates": ([], {"distinct"}),
    "outliers": (["moments"], {"outliers"}),
    "type_inconsistency": (["inconsistency"], set()),
    "mixed_types": (["inconsistency"], set()),
    "constant_column": (["least"], {"distinct"}),
    "low_variance": (["moments"], {"distinct"}),
    "high_cardinality": ([], {"distinct"}),
}
_OUTLIER_FIELDS = {"q25": "double", "q75": "double", "z_outliers": "bigint", "iqr_outliers": "bigint"}


def column_profile(
    df: DataFrame, issue_types: Sequence[str] | None = None, approx: bool = False
) -> DataFrame:
    """What the detectors of the wanted issue types look at, one row per column."""
    wanted = list(NEEDS) if issue_types is None else list(issue_types)
    measures = [m for t in wanted for m in NEEDS[t][0]]
    parts = {p for t in wanted for p in NEEDS[t][1]}
    stats = column_stats(df, measures)
    if "distinct" in parts:
        stats = with_distinct(stats, df, _told_apart(df, wanted), approx)
    names = numeric_columns(df)
    if "outliers" in parts and names:
        extra = outlier_profile(df, names, approx).select("column_name", *_OUTLIER_FIELDS)
        stats = stats.join(one_row_per_column(extra), "column_name", "left")
    fields = {f: t for m in ("moments", "inconsistency", "least") for f, t, _ in MEASURES[m]}
    absent = {"distinct_count": "bigint", **fields, **_OUTLIER_FIELDS}
    return stats.select("*", *[
        F.lit(None).cast(t).alias(f) for f, t in absent.items() if f not in stats.columns])


def _told_apart(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The columns whose distinct values an issue type of the wanted ones looks at."""
    of = {
        "duplicates": [c for c in df.columns if any(mark in c.lower() for mark in ID_MARKS)],
        "low_variance": numeric_columns(df), "high_cardinality": text_columns(df), "constant_column": df.columns,
    }
    needed = {c for issue_type in wanted for c in of.get(issue_type, [])}
    return [c for c in df.columns if c in needed] or df.columns[:1]


def _details(**entries: Column) -> Column:
    """String map without the entries that are NULL."""
    pairs = [x for name, value in entries.items() for x in (F.lit(name), value.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def _issue(when: Column, detector: int, part: int, issue_type: str, severity, description: Column,
           rows: Column, share: Column, recommendation, **details: Column) -> Column:
    def text(v):
        return v if isinstance(v, Column) else F.lit(v)

    return F.when(when, F.struct(
        F.lit(detector).alias("detector"), F.lit(part).alias("part"),
        text(issue_type).alias("issue_type"), text(severity).alias("severity"),
        description.alias("description"), rows.cast("bigint").alias("affected_rows"),
        F.round(share, 2).alias("affected_percentage"),
        text(recommendation).alias("recommendation"), _details(**details).alias("details")))


def _about(text: str, *values: str) -> Column:
    return F.format_string(text, F.col("column_name"), *[F.col(v) for v in values])


def _r4(c: Column) -> Column:
    return F.round(c, 4)


def _column_issues(wanted: Sequence[str]) -> list[Column]:
    rows, held, missing = F.col("row_count"), F.col("non_null"), F.col("missing")
    distinct, dtype = F.col("distinct_count"), F.col("dtype")
    numeric = dtype.rlike("^(tinyint|smallint|int|bigint|float|double|decimal.*)$")
    text = dtype == "string"

    gap = percent(missing, rows)
    fill = (
        F.when(numeric & (gap < 10), "Fill with the median, or with the mean if there are no outliers")
        .when(numeric, "Too many gaps for one value: use multiple or model-based imputation")
        .when(text, "Fill with the mode or with a category of its own")
        .otherwise("Look at the column and choose how to fill it"))
    copies = rows - distinct - F.when(missing > 0, 1).otherwise(0)
    named_like_id = F.lit(False)
    for mark in ID_MARKS:
        named_like_id = named_like_id | F.lower("column_name").contains(mark)

    iqr = F.col("q75") - F.col("q25")
    z = F.when(F.col("std") > 0, F.col("z_outliers")).otherwise(F.lit(0))
    fenced = F.when(iqr > 0, F.col("iqr_outliers")).otherwise(F.lit(0))
    outliers = F.greatest(z, fenced)
    outlying = percent(outliers, held)

    loose = F.col("numeric_loose")
    mostly_numeric = (held > 0) & (loose >= held * MOSTLY_NUMERIC)
    mixed = (loose > 0) & (loose < held * MOSTLY_NUMERIC) & (loose < held)
    dates = (held > 0) & (F.col("date_like") >= held * MOSTLY_DATES)

    constant = distinct == 1
    spread = F.try_divide(F.col("std"), F.abs("mean") + 1e-10)
    steady = numeric & ~constant & (held > 0) & ((F.col("std") == 0) | (spread < LOW_VARIANCE))
    varied = percent(distinct, held)
    many = text & (F.try_divide(distinct.cast("double"), held) > HIGH_CARDINALITY) \
        & (distinct > HIGH_CARDINALITY_DISTINCT)
    rules = [
        _issue(missing > 0, 1, 0, "missing_values",
               _ladder(gap, (50, "critical"), (20, "high"), (5, "medium"), otherwise="low"),
               _about("'%s' lacks %d values", "missing"), missing, gap, fill,
               missing_count=missing, missing_percentage=F.round(gap, 2), column_dtype=dtype,
               non_null_count=held),
        _issue(named_like_id & (copies > 0), 4, 0, "duplicates", "medium",
               _about("'%s' is named like an identifier but repeats values"), copies,
               percent(copies, rows), "Check whether the column has to be unique"),
        _issue((held >= FEWEST_VALUES) & (outliers > 0), 5, 0, "outliers",
               _ladder(outlying, (10, "high"), (5, "medium"), otherwise="low"),
               _about("'%s' has values far from the rest"), outliers, outlying,
               "Look at the outliers; cap, drop or transform them where that is right",
               z_score_outliers=z, iqr_outliers=fenced, mean=_r4(F.col("mean")),
               std=_r4(F.col("std")), q1=_r4(F.col("q25")), q3=_r4(F.col("q75")), iqr=_r4(iqr),
               lower_bound=F.when(iqr > 0, _r4(F.col("q25") - iqr * IQR_REACH)),
               upper_bound=F.when(iqr > 0, _r4(F.col("q75") + iqr * IQR_REACH))),
        _issue(mostly_numeric, 6, 0, "type_inconsistency", "medium",
               _about("'%s' holds numbers as text"), held, F.lit(100.0), "Convert to a number",
               current_dtype=dtype, suggested_dtype=F.lit("double or bigint")),
        _issue(mixed, 6, 0, "mixed_types", "high", _about("'%s' mixes numbers and text"),
               held - loose, percent(held - loose, held),
               "Bring the values to one form or split the column",
               numeric_values_pct=F.round(percent(loose, held), 2),
               text_values_pct=F.round(percent(held - loose, held), 2)),
        _issue(dates, 6, 1, "type_inconsistency", "low", _about("'%s' holds dates as text"), held,
               F.lit(100.0), "Convert to a timestamp"),
        _issue(constant, 7, 0, "constant_column", "medium", _about("'%s' has a single value"), held,
               F.lit(100.0), "Drop the column: it tells nothing apart",
               constant_value=F.col("least_value")),
        _issue(steady, 7, 0, "low_variance", "info", _about("'%s' hardly varies"), held,
               F.lit(100.0), "Check whether the column is of use",
               mean=_r4(F.col("mean")), std=_r4(F.col("std")), unique_count=distinct),
        _issue(many, 7, 1, "high_cardinality", "info",
               _about("'%s' has %d different values", "distinct_count"), distinct, varied,
               "An identifier or free text: do not encode it as a category",
               unique_count=distinct,
               cardinality_ratio=_r4(F.try_divide(distinct.cast("double"), held))),
    ]
    kinds = [
        "missing_values", "duplicates", "outliers", "type_inconsistency", "mixed_types",
        "type_inconsistency", "constant_column", "low_variance", "high_cardinality"]
    return [rule for kind, rule in zip(kinds, rules, strict=True) if kind in wanted]


def column_issues(profile: DataFrame, issue_types: Sequence[str] | None = None) -> DataFrame:
    """Issues of single columns, read off :func:`column_profile`."""
    rules = _column_issues(list(NEEDS) if issue_types is None else issue_types)
    found = profile.select("column_name", "position", F.explode(
        F.filter(F.array(*rules), lambda i: i.isNotNull())).alias("issue"))
    return found.select(
        "issue.detector", "position", "issue.part", "issue.issue_type", "issue.severity",
        "column_name", "issue.description", "issue.affected_rows", "issue.affected_percentage",
        "issue.recommendation", "issue.details")


def table_issues(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Mostly empty rows and exact duplicate rows; ``counts`` is the one row of an assessment."""
    if counts is None:
        gaps = missing_cells(df)
        sparse = df.select((gaps > len(df.columns) * 0.5).alias("sparse")).agg(
            F.count(F.lit(1)).alias("row_count"), F.count_if("sparse").alias("n"))
    else:
        sparse = counts.select("row_count", F.col("sparse_rows").alias("n"))
    share = percent(F.col("n"), F.col("row_count"))
    empty_rows = sparse.select(_issue(
        F.col("n") > 0, 2, 0, "missing_values",
        F.when(share > 10, "high").otherwise("medium"),
        F.format_string("%d rows lack more than half of their cells", "n"), F.col("n"), share,
        "Drop these rows or find out why they are empty",
        threshold=F.lit("50% missing"), rows_affected=F.col("n")).alias("issue"))
    copies, total = F.col("duplicate_rows"), F.col("row_count")
    repeated = percent(copies, total)
    duplicates = (row_counts(df) if counts is None else counts).select(_issue(
        copies > 0, 3, 0, "duplicates",
        _ladder(repeated, (10, "high"), (5, "medium"), otherwise="low"),
        F.format_string("%d rows repeat an earlier row", "duplicate_rows"), copies, repeated,
        "Drop the repeated rows",
        duplicate_count=copies, unique_rows=F.col("distinct_rows")).alias("issue"))
    return empty_rows.unionByName(duplicates).filter(F.col("issue").isNotNull()).select(
        "issue.detector", F.lit(0).alias("position"), "issue.part", "issue.issue_type",
        "issue.severity", F.lit(None).cast("string").alias("column_name"), "issue.description",
        "issue.affected_rows", "issue.affected_percentage", "issue.recommendation", "issue.details")


def detected(df: DataFrame, approx: bool = False, assessed: Assessment | None = None) -> DataFrame:
    """All issues with the order in which they are detected, read off the table or off what was
    :func:`~prepkit.operators.state.assess`-ed of it before."""
    if assessed:
        return column_issues(assessed.columns).unionByName(table_issues(df, assessed.table))
    return column_issues(column_profile(df, approx=approx)).unionByName(table_issues(df))


def numbered(found: DataFrame) -> DataFrame:
    """Give ids in detection order and a rank by severity. One row per issue: small."""
    detection = Window.orderBy("detector", "position", "part")
    return found.withColumn("number", F.row_number().over(detection)).select(
        F.concat(F.lit("QI-"), F.lpad(F.col("number").cast("string"), 4, "0")).alias("issue_id"),
        F.row_number().over(Window.orderBy(severity_rank(F.col("severity")), "number"))
        .alias("display_order"),
        *ISSUE_FIELDS)


def all_issues(df: DataFrame, approx: bool = False, assessed: Assessment | None = None) -> DataFrame:
    return numbered(detected(df, approx, assessed))


def issues_of(df: DataFrame, *issue_types: str, approx: bool = False) -> DataFrame:
    """Issues of some types; computes only what these are read from."""
    found = column_issues(column_profile(df, issue_types, approx), issue_types)
    if {"missing_values", "duplicates"} & set(issue_types):
        found = found.unionByName(table_issues(df).filter(F.col("issue_type").isin(*issue_types)))
    return found.select(*ISSUE_FIELDS)


def missing_issues(df: DataFrame) -> DataFrame:
    """Missing values per column; reads nothing but null counts."""
    gap = percent(F.col("missing"), F.col("row_count"))
    return column_stats(df, []).filter(F.col("missing") > 0).select(
        "column_name", "position", "dtype",
        _ladder(gap, (50, "critical"), (20, "high"), (5, "medium"), otherwise="low").alias("severity"),
        F.col("missing").alias("affected_rows"), F.round(gap, 2).alias("affected_percentage"),
        F.col("non_null").alias("non_null_count"))


def issue_summary(found: DataFrame) -> DataFrame:
    """One row: issues in all and per severity."""
    return found.agg(
        F.count(F.lit(1)).alias("total_issues"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def prioritized(found: DataFrame) -> DataFrame:
    """One row per issue type that occurs, in the fixed order of advice."""
    order = F.array_position(F.array(*[F.lit(t) for t, _ in ADVICE]), F.col("issue_type"))
    titles = F.create_map(*[x for t, title in ADVICE for x in (F.lit(t), F.lit(title))])
    rank = severity_rank(F.col("severity"))
    shown = F.struct(
        rank.alias("rank"), "detector", "position", "part", "column_name", "recommendation")
    grouped = found.groupBy("issue_type").agg(
        F.count(F.lit(1)).alias("issue_count"),
        F.array_sort(F.collect_list(shown)).alias("shown"),  # a few issues per column of the schema
        F.min_by("severity", rank).alias("highest_severity"))
    columns = F.filter(F.transform("shown", lambda s: s["column_name"]), lambda c: c.isNotNull())
    return grouped.select(
        F.row_number().over(Window.orderBy(order)).alias("priority"),  # at most eight rows
        titles[F.col("issue_type")].alias("action"), "issue_type", "issue_count",
        columns.alias("columns_affected"), "highest_severity",
        F.transform("shown", lambda s: s["recommendation"]).alias("specific_recommendations"))


def scores(df: DataFrame, approx: bool = False, assessed: Assessment | None = None) -> DataFrame:
    """One row: overall score and its four parts, each 0 to 100."""
    counts = assessed.table if assessed else row_counts(df)
    kinds = ["type_inconsistency", "mixed_types", "outliers"]
    found = column_issues(assessed.columns if assessed else column_profile(df, kinds, approx), kinds)
    from_issues = found.agg(
        F.count_if(F.col("issue_type").isin("type_inconsistency", "mixed_types")).alias("type_issues"),
        F.coalesce(F.sum(F.when(F.col("issue_type") == "outliers", F.col("affected_percentage"))),
                   F.lit(0.0)).alias("outlying"))
    cells = (assessed.columns if assessed else column_stats(df, [])).agg(
        F.sum("row_count").alias("cells"), F.sum("missing").alias("missing"))
    whole = counts.crossJoin(F.broadcast(from_issues)).crossJoin(F.broadcast(cells))
    parts = whole.select(
        F.coalesce(percent(F.col("cells") - F.col("missing"), F.col("cells")), F.lit(100.0))
        .alias("completeness"),
        F.coalesce(percent(F.col("distinct_rows"), F.col("row_count")), F.lit(100.0))
        .alias("uniqueness"),
        F.greatest(F.lit(0.0), F.lit(100.0) - F.col("type_issues") * 10).alias("consistency"),
        F.greatest(F.lit(0.0), F.lit(100.0) - F.col("outlying")).alias("validity"))
    overall = sum(F.col(name) * weight for name, weight in SCORE_WEIGHTS.items())
    return parts.select(F.round(overall, 2).alias("overall"),
                        *[F.round(name, 2).alias(name) for name in SCORE_WEIGHTS])


def score_band(score: Column) -> Column:
    """Report colour of an overall score."""
    return F.when(score >= 80, "high").when(score >= 60, "medium").otherwise("low")


def column_quality(df: DataFrame) -> DataFrame:
    """Score of each column from its completeness and the unity of its type."""
    stats = with_distinct(column_stats(df, ["comma_numeric"]), df)
    filled = F.coalesce(percent(F.col("non_null"), F.col("row_count")), F.lit(0.0))
    as_number = F.col("numeric_comma")
    unity = F.when((as_number > 0) & (as_number < F.col("non_null")), 60.0).otherwise(100.0)
    return stats.select(
        "column_name", "position", F.round(filled * 0.6 + unity * 0.4, 2).alias("quality_score"),
        F.round(filled, 2).alias("completeness"), unity.alias("type_quality"),
        F.col("missing").alias("missing_count"),
        F.coalesce(F.round(percent(F.col("missing"), F.col("row_count")), 2), F.lit(0.0))
        .alias("missing_percentage"),
        F.col("distinct_count").alias("unique_count"), "dtype")


# Samples: the first rows, in a given order, that show an issue.

def duplicate_samples(df: DataFrame, order_by: Sequence[str], k: int = 10) -> DataFrame:
    """Order keys of the first k rows that repeat an earlier row.

    Groups are counted first, so only rows of repeated groups are ordered.
    """
    require_columns(df, order_by)
    order = [col(c).alias(f"__o{i}") for i, c in enumerate(order_by)]
    names = [f"__o{i}" for i in range(len(order_by))]
    keyed = df.select(*[k_.alias(f"__k{i}") for i, k_ in enumerate(row_key(df))], *order)
    key_names = [c for c in keyed.columns if c.startswith("__k")]
    # copies of one row share their order key when that is part of the row
    tallied = keyed.groupBy(*key_names, *names).agg(F.count(F.lit(1)).alias("copies"))
    repeated = tallied.filter(F.col("copies") > 1)
    surplus = F.explode(F.sequence(F.lit(2), F.least(F.col("copies"), F.lit(k + 1)))).alias("copy")
    return repeated.select(*names, surplus).orderBy(*names, "copy").limit(k).select(
        *[F.col(n).alias(c) for n, c in zip(names, order_by)])


def id_duplicate_samples(
    df: DataFrame, column: str, order_by: Sequence[str], k: int = 10
) -> DataFrame:
    """(order keys..., column) of the first k rows whose value an earlier row has."""
    require_columns(df, [column, *order_by])
    names = [f"__o{i}" for i in range(len(order_by))]
    point = F.struct(*[F.col(n) for n in names])
    tallied = df.select(
        col(column).alias("__value"), *[col(c).alias(n) for c, n in zip(order_by, names)]
    ).groupBy("__value", *names).agg(F.count(F.lit(1)).alias("copies"))
    firsts = tallied.groupBy("__value").agg(
        F.min(point).alias("first"), F.sum("copies").alias("held")).filter(F.col("held") > 1)
    surplus = F.col("copies") - F.when(point == F.col("first"), 1).otherwise(0)
    later = tallied.withColumnRenamed("__value", "__of").join(
        firsts, F.col("__of").eqNullSafe(F.col("__value"))).withColumn("surplus", surplus)
    return later.filter(F.col("surplus") > 0).select(
        *names, "__value", F.explode(F.sequence(F.lit(1), F.least(F.col("surplus"), F.lit(k)))).alias("copy")
    ).orderBy(*names, "__value", "copy").limit(k).select(
        *[F.col(n).alias(c) for n, c in zip(names, order_by)], F.col("__value").alias(column))


def outlier_samples(df: DataFrame, order_by: Sequence[str], k: int = 10) -> DataFrame:
    """(column_name, rank, value): the first k z-score outliers of each numeric column."""
    names = numeric_columns(df)
    bounds = one_row_per_column(
        column_stats(df, ["moments"], names).select("column_name", "non_null", "mean", "std"))
    keys = [f"__o{i}" for i in range(len(order_by))]
    long = df.select(
        *[col(c).alias(n) for c, n in zip(order_by, keys)],
        *[present_double(c).alias(c) for c in names],
    ).unpivot([col(n) for n in keys], [col(c) for c in names], "column_name", "value")
    z = F.try_divide(F.abs(F.col("value") - F.col("mean")), F.col("std"))
    first = Window.partitionBy("column_name").orderBy(*keys, "value")
    return (
        long.filter(F.col("value").isNotNull()).join(bounds, "column_name")
        .filter((F.col("non_null") >= FEWEST_VALUES) & (z > Z_LIMIT))
        .withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
        .select("column_name", "rank", F.round("value", 4).alias("value")))


def text_samples(df: DataFrame, order_by: Sequence[str], k: int = 5) -> DataFrame:
    """(column_name, rank, value): the first k texts of each text column."""
    names = text_columns(df)
    keys = [f"__o{i}" for i in range(len(order_by))]
    long = df.select(
        *[col(c).alias(n) for c, n in zip(order_by, keys)], *[col(c) for c in names],
    ).unpivot([col(n) for n in keys], [col(c) for c in names], "column_name", "value")
    first = Window.partitionBy("column_name").orderBy(*keys, "value")
    return (
        long.filter(F.col("value").isNotNull())
        .withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
        .select("column_name", "rank", "value"))


def type_checks(df: DataFrame) -> DataFrame:
    """(column_name, checked, numeric_loose) over all texts of each text column."""
    return column_stats(df, ["inconsistency"], text_columns(df)).select(
        "column_name", F.col("non_null").alias("checked"), "numeric_loose")
