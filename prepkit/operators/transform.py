"""The twenty table transformations, each DataFrame in, DataFrame out.

Columns that do not exist are skipped. Statistics a transformation needs are fitted
when it is called, one row per column; the change itself stays a lazy plan with the
statistics as constants. With several columns the steps act one after the other on
the changed table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from typing import Any
from uuid import uuid4

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepkit.functions import parsing
from prepkit.functions.columns import (
    FRACTIONAL_TYPES,
    col,
    is_integral,
    is_numeric,
    is_text,
    present_double,
    union_all,
)
from prepkit.functions.keys import row_digest
from prepkit.operators.broadcasts import broadcast_if_small, fitted, with_row
from prepkit.operators.frequency import top_values, value_counts, with_distinct
from prepkit.operators.ordered import ROWS_PER_BUCKET, dense_codes, fill
from prepkit.operators.quantiles import quantiles
from prepkit.operators.stats import column_stats, one_row_per_column

#: Beyond so many one-hot columns a preview warns.
ONEHOT_WARNING = 20
#: Beyond so many there is no form with a column per value.
MOST_ONEHOT = 5_000
# What convert_dtype converts to.
CONVERSIONS = ("int", "float", "str", "datetime")
PREVIEW_ROWS = 10


@dataclass(frozen=True)
class Params:
    """Parameters of a transformation; ``order_by`` names the row order for fills."""

    columns: Sequence[str] = ()
    constant_value: Any = None
    threshold: float = 3.0
    iqr_multiplier: float = 1.5
    target_dtype: str | None = None
    filter_condition: str | None = None
    new_name: str | None = None
    order_by: Sequence[str] = ()
    approx: bool = False
    rows_per_bucket: int = ROWS_PER_BUCKET
    #: "columns": a flag per category; "index": the place of the one flag that is set.
    onehot_form: str = "columns"

    def to_dict(self) -> dict[str, Any]:
        return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}

    def existing(self, df: DataFrame) -> list[str]:
        return [c for c in self.columns if c in df.columns]

    def numeric(self, df: DataFrame) -> list[str]:
        return [c for c in self.existing(df) if is_numeric(df.schema[c].dataType)]


def _present(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, FRACTIONAL_TYPES):
        return F.when(~F.isnan(col(name)), col(name))
    return col(name)


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else col(c) for c in df.columns])


# Imputation

def _fill_type(data_type: T.DataType) -> str:
    """A mean or median of whole numbers need not be whole."""
    return "double" if not isinstance(data_type, FRACTIONAL_TYPES) else data_type.simpleString()


def _impute(df: DataFrame, per_column: DataFrame, field: str) -> DataFrame:
    found = fitted(per_column, [field])
    return _replace(df, {
        c: F.coalesce(_present(df, c), F.lit(v[field])).cast(_fill_type(df.schema[c].dataType))
        for c, v in found.items()})


def impute_mean(df: DataFrame, p: Params) -> DataFrame:
    names = p.numeric(df)
    return _impute(df, column_stats(df, ["moments"], names), "mean") if names else df


def impute_median(df: DataFrame, p: Params) -> DataFrame:
    names = p.numeric(df)
    return _impute(df, quantiles(df, names, {"median": 0.5}, approx=p.approx), "median") if names else df


def _constant(text: str, data_type: T.DataType) -> Column:
    """A collected value, back in the type of its column."""
    return F.lit(text).cast(data_type)


def modes_of(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """The most frequent value of each column, the smallest of several, as text: one job.
    Texts are counted by head and digest."""
    texts = [c for c in columns if is_text(df.schema[c].dataType)]
    parts = [top_values(df, texts, 1).select("column_name", "value")] if texts else []
    for c in columns:
        if c not in texts:
            best = value_counts(df, c).agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("best"))
            parts.append(best.select(F.lit(c).alias("column_name"), F.col("best.value").cast("string").alias("value")))
    rows = union_all(parts).collect() if parts else []
    return {r["column_name"]: r["value"] for r in rows if r["value"] is not None}


def impute_mode(df: DataFrame, p: Params) -> DataFrame:
    return _replace(df, {
        c: F.coalesce(_present(df, c), _constant(mode, df.schema[c].dataType))
        for c, mode in modes_of(df, p.existing(df)).items()})


def impute_constant(df: DataFrame, p: Params) -> DataFrame:
    names = p.existing(df)
    if p.constant_value is None:
        return df
    types = {c: df.schema[c].dataType for c in names}
    if names:
        one = df.sparkSession.range(1).select(*[F.lit(p.constant_value).try_cast(t).alias(c) for c, t in types.items()]).first()
        unfit = [c for c in names if one[c] is None]
        if unfit:
            raise ValueError(f"{p.constant_value!r} is no {types[unfit[0]].simpleString()}, the type of '{unfit[0]}'")
    return _replace(df, {
        c: F.coalesce(_present(df, c), F.lit(p.constant_value).cast(df.schema[c].dataType)) for c in names})


def _directional(backward: bool):
    def run(df: DataFrame, p: Params) -> DataFrame:
        names = p.existing(df)
        if not names:
            return df
        if not p.order_by:
            raise ValueError("a fill needs order_by: rows have no order of their own")
        return fill(df, names, list(p.order_by), backward, p.rows_per_bucket)

    return run


impute_forward_fill = _directional(False)
impute_backward_fill = _directional(True)


# Outliers

def _z_bounds(df: DataFrame, name: str, p: Params) -> DataFrame:
    s = column_stats(df, ["moments"], [name])
    # a constant has no outliers, whatever rounding does to its mean
    reach = F.when(F.col("min") < F.col("max"), F.col("std") * p.threshold)
    return s.select("column_name", (F.col("mean") - reach).alias("low"), (F.col("mean") + reach).alias("high"))


def _iqr_bounds(df: DataFrame, name: str, p: Params) -> DataFrame:
    q = quantiles(df, [name], {"q25": 0.25, "q75": 0.75}, approx=p.approx)
    reach = (F.col("q75") - F.col("q25")) * p.iqr_multiplier
    return q.select("column_name", (F.col("q25") - reach).alias("low"), (F.col("q75") + reach).alias("high"))


#: Limits fitted within one step, by column and kind of bounds.
_FITTED: ContextVar[dict | None] = ContextVar("fitted", default=None)


@contextmanager
def fitted_once() -> Iterator[None]:
    """Inside, what a step fits is kept: its plan and the report on it are made from one fit."""
    token = _FITTED.set({})
    try:
        yield
    finally:
        _FITTED.reset(token)


def _limits(df: DataFrame, name: str, p: Params, bounds_of) -> tuple[float, float] | None:
    held = _FITTED.get()
    if held is not None and (name, bounds_of) in held:
        return held[name, bounds_of]
    found = fitted(bounds_of(df, name, p), ["low", "high"]).get(name)
    limits = None if not found or found["low"] is None else (found["low"], found["high"])
    if held is not None:
        held[name, bounds_of] = limits
    return limits


def _remove(bounds_of) -> Callable[[DataFrame, Params], DataFrame]:
    """Keep missing values and what lies inside; each column is fitted on the rows left."""
    def run(df: DataFrame, p: Params) -> DataFrame:
        for name in p.numeric(df):
            limits = _limits(df, name, p, bounds_of)
            if limits:
                x = _present(df, name)
                df = df.filter(x.isNull() | ((x >= limits[0]) & (x <= limits[1])))
        return df

    return run


def _cap(bounds_of) -> Callable[[DataFrame, Params], DataFrame]:
    def run(df: DataFrame, p: Params) -> DataFrame:
        for name in p.numeric(df):
            limits = _limits(df, name, p, bounds_of)
            if limits:
                x = present_double(name)
                df = _replace(df, {name: F.when(x < limits[0], limits[0]).when(x > limits[1], limits[1])
                                   .otherwise(x)})
        return df

    return run


remove_outliers_zscore = _remove(_z_bounds)
remove_outliers_iqr = _remove(_iqr_bounds)
cap_outliers_zscore = _cap(_z_bounds)
cap_outliers_iqr = _cap(_iqr_bounds)


# Encoding

def categories(df: DataFrame, column: str) -> list[str]:
    """Sorted distinct values as text, collected because they become columns: MOST_ONEHOT at most."""
    counts = value_counts(df, column)
    held = counts.limit(MOST_ONEHOT + 1).count()
    if held > MOST_ONEHOT:
        raise ValueError(f"'{column}' has more than {MOST_ONEHOT} values to make columns of: use onehot_form='index'")
    rows = counts.orderBy("value")
    return [r[0] for r in rows.select(F.col("value").cast("string")).collect()]


def encode_onehot(df: DataFrame, p: Params) -> DataFrame:
    """One flag column per category but the first. For columns of very many values there
    is the sparse form: ``<column>_hot`` is the place of the flag that would be set, NULL where
    none would be."""
    if p.onehot_form == "index":
        return _onehot_index(df, p)
    for name in p.existing(df):
        data_type = df.schema[name].dataType
        flags = [
            F.coalesce(col(name) == _constant(v, data_type), F.lit(False)).alias(f"{name}_{v}")
            for v in categories(df, name)[1:]]
        df = df.select(*[col(c) for c in df.columns if c != name], *flags)
    return df


def _onehot_index(df: DataFrame, p: Params) -> DataFrame:
    names = p.existing(df)
    coded = encode_label(df, p)
    return coded.select(*[col(c) for c in df.columns if c not in names], *[
        F.when(col(c) > 0, col(c) - 1).alias(f"{c}_hot") for c in names])


def encode_label(df: DataFrame, p: Params) -> DataFrame:
    out = df
    for name in p.existing(df):
        codes = dense_codes(value_counts(df, name), "value", p.rows_per_bucket).select(
            F.col("value").alias("__value"), F.col("code").alias("__code"))
        coded = out.join(broadcast_if_small(codes), _present(out, name) == F.col("__value"), "left")
        out = coded.select(*[
            F.coalesce("__code", F.lit(-1).cast("bigint")).alias(c) if c == name else col(c)
            for c in df.columns])
    return out


def frequency_encode(df: DataFrame, column: str) -> DataFrame:
    """Add ``<column>_encoded``: the share of filled rows that have the row's value."""
    counts = value_counts(df, column)
    total = counts.agg(F.sum("n").alias("total"))
    shares = with_row(counts, total).select(
        F.col("value").alias("__value"), F.try_divide(F.col("n").cast("double"), F.col("total")).alias(f"{column}_encoded"))
    return df.join(broadcast_if_small(shares), _present(df, column) == F.col("__value"), "left").drop("__value")


# Types and structure

def _as_number(df: DataFrame, name: str) -> Column:
    t = df.schema[name].dataType
    if is_text(t):
        return parsing.to_number(col(name))
    if is_numeric(t) or isinstance(t, T.BooleanType):
        return _present(df, name).cast("double")
    return F.lit(None).cast("double")


def has_fractions(df: DataFrame, column: str) -> bool:
    """Whether any parsed value is not whole (one aggregate)."""
    x = _as_number(df, column)
    return bool(df.agg(F.coalesce(F.bool_or(x != F.floor(x)), F.lit(False))).first()[0])


def _as_whole(df: DataFrame, name: str) -> Column:
    t = df.schema[name].dataType
    if is_integral(t):
        return col(name).cast("bigint")
    if is_text(t):  # digits beyond 2^53 stay exact
        return F.coalesce(parsing.to_integer(col(name)), parsing.to_number(col(name)).try_cast("bigint"))
    return _as_number(df, name).try_cast("bigint")


def _as_moment(df: DataFrame, name: str) -> Column:
    t = df.schema[name].dataType
    return parsing.to_moment(col(name)) if is_text(t) else col(name).try_cast("timestamp_ntz")


def convert_dtype(df: DataFrame, p: Params) -> DataFrame:
    new: dict[str, Column] = {}
    for name in p.existing(df):
        if p.target_dtype == "int":
            if not has_fractions(df, name):
                new[name] = _as_whole(df, name)
        elif p.target_dtype == "float":
            new[name] = _as_number(df, name)
        elif p.target_dtype == "str":
            new[name] = col(name).cast("string")
        elif p.target_dtype == "datetime":
            new[name] = _as_moment(df, name)
    return _replace(df, new) if new else df


def drop_column(df: DataFrame, p: Params) -> DataFrame:
    gone = set(p.existing(df))
    return df.select(*[col(c) for c in df.columns if c not in gone])


def drop_rows(df: DataFrame, p: Params) -> DataFrame:
    """Drop rows that miss a value in any of the columns (any column if none given)."""
    keep = F.lit(True)
    for name in (p.existing(df) if p.columns else df.columns):
        keep = keep & _present(df, name).isNotNull()
    return df.filter(keep)


def filter_rows(df: DataFrame, p: Params) -> DataFrame:
    return df.filter(F.expr(p.filter_condition)) if p.filter_condition else df


def remove_duplicates(df: DataFrame, p: Params) -> DataFrame:
    """One of each set of equal rows, told by a digest: no text is a shuffle key."""
    return df.withColumn("__digest", row_digest(df)).dropDuplicates(["__digest"]).drop("__digest")


def rename_column(df: DataFrame, p: Params) -> DataFrame:
    if len(p.columns) != 1 or not p.new_name or not p.existing(df):
        return df
    return df.withColumnRenamed(p.columns[0], p.new_name)


# Scaling

def _scale(df: DataFrame, p: Params, center: str, width) -> DataFrame:
    names = p.numeric(df)
    if not names:
        return df
    found = fitted(column_stats(df, ["moments"], names), ["mean", "std", "min", "max"])
    new = {}
    for name, v in found.items():
        if v[center] is not None and (width(v) or 0) > 0:
            new[name] = (present_double(name) - v[center]) / width(v)
    return _replace(df, new)


def scale_standard(df: DataFrame, p: Params) -> DataFrame:
    return _scale(df, p, "mean", lambda v: v["std"])


def scale_minmax(df: DataFrame, p: Params) -> DataFrame:
    return _scale(df, p, "min", lambda v: v["max"] - v["min"])


@dataclass(frozen=True)
class Kind:
    """A transformation type as users see it."""

    run: Callable[[DataFrame, Params], DataFrame]
    group: str
    label: str
    purpose: str


KINDS: dict[str, Kind] = {
    "impute_mean": Kind(impute_mean, "imputation", "Mean", "Fill gaps with the column mean"),
    "impute_median": Kind(impute_median, "imputation", "Median", "Fill gaps with the column median"),
    "impute_mode": Kind(impute_mode, "imputation", "Mode", "Fill gaps with the most frequent value"),
    "impute_constant": Kind(impute_constant, "imputation", "Constant", "Fill gaps with a given value"),
    "impute_forward_fill": Kind(impute_forward_fill, "imputation", "Forward fill",
                                "Fill gaps with the value before"),
    "impute_backward_fill": Kind(impute_backward_fill, "imputation", "Backward fill",
                                 "Fill gaps with the value after"),
    "remove_outliers_zscore": Kind(remove_outliers_zscore, "outlier_treatment", "Remove by z-score",
                                   "Drop rows too many standard deviations from the mean"),
    "remove_outliers_iqr": Kind(remove_outliers_iqr, "outlier_treatment", "Remove by IQR",
                                "Drop rows outside the quartile fences"),
    "cap_outliers_zscore": Kind(cap_outliers_zscore, "outlier_treatment", "Cap by z-score",
                                "Pull values back to a number of standard deviations"),
    "cap_outliers_iqr": Kind(cap_outliers_iqr, "outlier_treatment", "Cap by IQR",
                             "Pull values back to the quartile fences"),
    "encode_onehot": Kind(encode_onehot, "encoding", "One-hot", "One flag column per category but the first"),
    "encode_label": Kind(encode_label, "encoding", "Label", "Number the categories in sorted order"),
    "scale_standard": Kind(scale_standard, "scaling", "Standard", "Shift to mean 0 and deviation 1"),
    "scale_minmax": Kind(scale_minmax, "scaling", "Min-max", "Stretch to the range 0 to 1"),
    "drop_column": Kind(drop_column, "data_management", "Drop column", "Remove columns"),
    "drop_rows": Kind(drop_rows, "data_management", "Drop rows", "Remove rows with gaps"),
    "filter_rows": Kind(filter_rows, "data_management", "Filter rows", "Keep rows that meet a condition"),
    "remove_duplicates": Kind(remove_duplicates, "data_management", "Remove duplicates",
                              "Keep one of each set of equal rows"),
    "rename_column": Kind(rename_column, "data_management", "Rename column", "Give a column a new name"),
    "convert_dtype": Kind(convert_dtype, "data_management", "Convert type", "Change the type of columns"),
}


def transformation_types() -> dict[str, list[dict[str, str]]]:
    """All types by group."""
    menu: dict[str, list[dict[str, str]]] = {}
    for value, kind in KINDS.items():
        menu.setdefault(kind.group, []).append(
            {"value": value, "label": kind.label, "description": kind.purpose})
    return menu


def transform(df: DataFrame, kind: str, params: Params | None = None) -> DataFrame:
    """The transformed table; an unknown type is an error."""
    if kind not in KINDS:
        raise ValueError(f"unknown transformation type: {kind}")
    return KINDS[kind].run(df, params or Params())


# Reporting around a transformation

def affected_rows(df: DataFrame, after: DataFrame, kind: str, params: Params) -> DataFrame:
    """One row (affected): cells filled, rows removed, values capped, or rows touched."""
    names = params.existing(df)
    if kind.startswith("impute_"):
        wanted = params.numeric(df) if kind in ("impute_mean", "impute_median") else names
        gaps = sum((F.count_if(_present(df, c).isNull()) for c in wanted), F.lit(0))
        return df.agg(gaps.cast("bigint").alias("affected"))
    if kind.startswith("remove_") or kind in ("drop_rows", "filter_rows"):
        before = df.agg(F.count(F.lit(1)).alias("before"))
        return with_row(after.agg(F.count(F.lit(1)).alias("after")), before).select(
            (F.col("before") - F.col("after")).alias("affected"))
    if kind.startswith("cap_outliers_"):
        return df.agg(capped_cells(df, kind, params).alias("affected"))
    touched = touches_rows(df, kind, params)
    return df.agg((F.count(F.lit(1)) if touched else F.lit(0).cast("bigint")).alias("affected"))


def capped_cells(df: DataFrame, kind: str, params: Params) -> Column:
    """The aggregate that counts the cells a capping step changes."""
    bounds_of = _z_bounds if kind.endswith("zscore") else _iqr_bounds
    beyond = F.lit(0).cast("bigint")
    for name in params.numeric(df):
        limits = _limits(df, name, params, bounds_of)
        if limits:
            x = present_double(name)
            beyond = beyond + F.count_if((x < limits[0]) | (x > limits[1]))
    return beyond


def touches_rows(df: DataFrame, kind: str, params: Params) -> bool:
    """Whether a step that is neither a fill, a filter nor a cap does anything."""
    return bool(params.existing(df)) and not (
        (kind == "rename_column" and (len(params.columns) != 1 or not params.new_name))
        or (kind == "convert_dtype" and not params.target_dtype)
        or (kind in ("scale_standard", "scale_minmax") and not params.numeric(df)))


def warnings_of(df: DataFrame, kind: str, params: Params) -> list[str]:
    """Why parts of a transformation would be skipped or ill-advised."""
    if kind in ("impute_mean", "impute_median"):
        return [f"'{c}' is not numeric and is skipped" for c in params.columns if c not in params.numeric(df)]
    if kind == "encode_onehot":
        sizes = {c: value_counts(df, c).count() for c in params.existing(df)}
        return [f"'{c}' has {n} values and becomes as many columns"
                for c, n in sizes.items() if n > ONEHOT_WARNING]
    if kind == "convert_dtype" and params.target_dtype == "int":
        return [f"'{c}' has fractions and stays as it is" for c in params.existing(df) if has_fractions(df, c)]
    if kind in ("scale_standard", "scale_minmax") and params.numeric(df):
        stats = column_stats(df, ["moments"], params.numeric(df)).collect()
        flat = [r["column_name"] for r in stats
                if not ((r["std"] if kind == "scale_standard" else (r["max"] or 0) - (r["min"] or 0)) or 0) > 0]
        return [f"'{c}' does not vary and stays as it is" for c in flat]
    return []


def step_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Statistics shown before and after a step, one row per column."""
    names = [c for c in columns if c in df.columns]
    stats = with_distinct(column_stats(df, ["moments"], names), df, names)
    numeric = [c for c in names if is_numeric(df.schema[c].dataType)]
    if numeric:
        stats = stats.join(one_row_per_column(quantiles(df, numeric, {"median": 0.5})), "column_name", "left")
    else:
        stats = stats.withColumn("median", F.lit(None).cast("double"))
    return stats.select(
        "column_name", F.col("row_count").alias("count"), "missing", F.col("distinct_count").alias("unique"),
        *[F.round(f, 4).alias(f) for f in ("mean", "std", "min", "max", "median")])


def before_after(df: DataFrame, kind: str, params: Params, after: DataFrame | None = None) -> DataFrame:
    """(phase, column_name, statistics...) of the columns a step names; ``after`` is the step's
    table where it has been made already."""
    after = transform(df, kind, params) if after is None else after
    frames = [
        step_stats(frame, params.columns).select(F.lit(phase).alias("phase"), "*")
        for phase, frame in (("before", df), ("after", after))
        if any(c in frame.columns for c in params.columns)]
    return union_all(frames)


def explain(kind: str, affected: int) -> str:
    return f"{KINDS[kind].purpose}. This affects {affected} rows."


@dataclass
class Preview:
    kind: str
    can_apply: bool
    affected: int
    columns: list[str]
    before: DataFrame
    after: DataFrame
    stats: DataFrame | None
    warnings: list[str]
    explanation: str


def _head(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    keys = [c for c in order_by if c in df.columns]
    return (df.orderBy(*[col(c) for c in keys]) if keys else df).limit(PREVIEW_ROWS)


def preview(df: DataFrame, kind: str, params: Params) -> Preview:
    """What a step would do. The input is a plan and cannot be changed by it."""
    with fitted_once():
        after = transform(df, kind, params)
        affected = affected_rows(df, after, kind, params).first()[0] or 0
    warnings = warnings_of(df, kind, params)
    return Preview(
        kind, not warnings, affected, list(params.columns), _head(df, params.order_by),
        _head(after, params.order_by), before_after(df, kind, params, after) if params.existing(df) else None,
        warnings, explain(kind, affected))


@dataclass
class Result:
    transformation_id: str
    transformation_type: str
    success: bool
    affected_rows: int
    affected_columns: list[str]
    before_stats: list[dict]
    after_stats: list[dict]
    message: str
    timestamp: str
    parameters: dict[str, Any] = field(default_factory=dict)


def apply(df: DataFrame, kind: str, params: Params) -> tuple[DataFrame, Result]:
    """Run a step and report on it. A step that its parameters or the data make impossible is
    reported and leaves the table as it was; other errors, such as lost executors, are raised."""
    def result(success: bool, affected: int, before, after, message: str) -> Result:
        return Result(str(uuid4()), kind, success, affected, list(params.columns), before, after,
                      message, datetime.now(timezone.utc).isoformat(), params.to_dict())

    try:
        with fitted_once():
            out = transform(df, kind, params)
            affected = affected_rows(df, out, kind, params).first()[0] or 0
        stats = [r.asDict() for r in before_after(df, kind, params, out).collect()] if params.existing(df) else []
        by_phase = {ph: [s for s in stats if s["phase"] == ph] for ph in ("before", "after")}
        return out, result(True, affected, by_phase["before"], by_phase["after"], f"Applied {kind}")
    except ValueError as error:
        return df, result(False, 0, [], [], f"Failed: {error}")
    except PySparkException as error:
        if error.getCondition() is None:
            raise
        return df, result(False, 0, [], [], f"Failed: {error}")
