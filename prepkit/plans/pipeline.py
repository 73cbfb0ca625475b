"""Recorded steps: replay, history, undo, saving, and use on other tables."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, fields
from typing import Any
from uuid import uuid4

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from prepkit.functions.columns import FRACTIONAL_TYPES, col, union_all
from prepkit.operators.transform import (
    KINDS,
    Params,
    affected_rows,
    capped_cells,
    fitted_once,
    touches_rows,
    transform,
)
from prepkit.sources.tables import materialise


@dataclass(frozen=True)
class Step:
    kind: str
    params: Params = Params()

    def to_dict(self) -> dict[str, Any]:
        return {"transformation_type": self.kind, "parameters": self.params.to_dict()}

    @staticmethod
    def from_dict(record: dict[str, Any]) -> Step:
        known = {f.name for f in fields(Params)}
        given = {
            k: tuple(v) if isinstance(v, list) else v
            for k, v in record.get("parameters", {}).items() if k in known}
        return Step(record["transformation_type"], Params(**given))


def replay(
    df: DataFrame, steps: Sequence[Step], materialise_every: int | None = None, checked: bool = False
) -> tuple[DataFrame, list[dict[str, Any]]]:
    """Run the steps one after the other; their statistics are taken from ``df``.

    A step that cannot be planned is reported and skipped, and with ``checked`` also one whose
    table cannot be computed: every step is then run once to its end and the report says
    how many rows it leaves. Failures that are not the step's, such as lost executors, are
    raised. Every later step reads what came before, so a long pipeline over large data
    should be cut now and then with ``materialise_every``.
    """
    report = []
    for number, step in enumerate(steps, 1):
        line: dict[str, Any] = {"transformation": step.kind, "success": True}
        try:
            after = transform(df, step.kind, step.params)
            if checked:
                line["rows_after"] = computed_rows(after)
            df = after
        except ValueError as error:
            line |= {"success": False, "error": str(error)}
        except PySparkException as error:
            if error.getCondition() is None:
                raise
            line |= {"success": False, "error": str(error)}
        report.append(line)
        if materialise_every and number % materialise_every == 0:
            df = materialise(df)
    return df, report


def computed_rows(df: DataFrame) -> int:
    """The number of rows, found by computing every cell of them."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    return seen.get["rows"]


@dataclass(frozen=True)
class Dataset:
    """A source table, the steps applied to it, and the plan of every version.

    A version is a plan, not a copy of the data, so keeping all of them costs nothing
    and undo is going back to the one before.
    """

    source: DataFrame
    steps: tuple[Step, ...] = ()
    versions: tuple[DataFrame, ...] = ()

    @property
    def version(self) -> int:
        return len(self.steps)

    @property
    def table(self) -> DataFrame:
        return self.versions[-1] if self.versions else self.source

    def apply(self, kind: str, params: Params = Params(), materialised: bool = False) -> Dataset:
        """A new version, by choice written to the shared folder. A step that fails
        leaves none behind."""
        after = transform(self.table, kind, params)
        if materialised:
            after = materialise(after)
        return Dataset(self.source, (*self.steps, Step(kind, params)), (*self.versions, after))

    def undo(self) -> Dataset:
        return Dataset(self.source, self.steps[:-1], self.versions[:-1])

    def clear(self) -> Dataset:
        return Dataset(self.source)

    def history(self) -> DataFrame:
        """(sequence_order, transformation_type, columns, affected_rows, rows_after) per step."""
        if not self.steps:
            raise ValueError("no steps applied yet")
        lines, before = [], self.source
        for number, (step, after) in enumerate(zip(self.steps, self.versions), 1):
            counted = after.agg(F.count(F.lit(1)).alias("rows_after"))
            affected = affected_rows(before, after, step.kind, step.params)
            lines.append(counted.crossJoin(F.broadcast(affected)).select(
                F.lit(number).alias("sequence_order"), F.lit(step.kind).alias("transformation_type"),
                F.lit(", ".join(step.params.columns)).alias("columns"),
                F.col("affected").cast("bigint").alias("affected_rows"), "rows_after"))
            before = after
        return union_all(lines)


LOG = ("dataset_id string, sequence_order int, transformation_type string, columns string, parameters string, "
       "affected_rows bigint, rows_after bigint, version_path string")


def apply_logged(df: DataFrame, steps: Sequence[Step], folder: str, dataset_id: str) -> DataFrame:
    """Apply steps one after the other, each version written once to ``folder``, and log them.

    What the log says is observed while the versions are written: rows, and gaps by column, of
    which those before a fill are the cells it fills; capped cells are counted as they are
    capped. No version is read again to be counted, and limits are fitted once.
    """
    spark = df.sparkSession
    run = uuid4().hex
    df, before = _written(df, f"{folder}/versions/{run}-0")
    for number, step in enumerate(steps, 1):
        capped = Observation() if step.kind.startswith("cap_outliers_") else None
        with fitted_once():
            after = transform(df, step.kind, step.params)
            if capped:  # the limits are known now, so this fits nothing again
                counted = df.observe(capped, capped_cells(df, step.kind, step.params).alias("cells"))
                after = transform(counted, step.kind, step.params)
        path = f"{folder}/versions/{run}-{number}"
        after, now = _written(after, path)
        if step.kind.startswith("impute_"):
            numeric = step.kind in ("impute_mean", "impute_median")
            affected = sum(before[c] for c in (step.params.numeric(df) if numeric else step.params.existing(df)))
        elif step.kind.startswith("remove_") or step.kind in ("drop_rows", "filter_rows"):
            affected = before[ROWS] - now[ROWS]
        elif capped:
            affected = capped.get["cells"]
        else:
            affected = before[ROWS] if touches_rows(df, step.kind, step.params) else 0
        row = (dataset_id, number, step.kind, ", ".join(step.params.columns), json.dumps(step.params.to_dict()),
               affected, now[ROWS], path)
        spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(f"{folder}/log")
        df, before = after, now
    return df


#: The key of the row count among the gaps by column; no column has an empty name.
ROWS = ""


def _written(df: DataFrame, path: str) -> tuple[DataFrame, dict[str, int]]:
    """Write a version and observe its rows and the gaps of each column in the same pass."""
    seen = Observation()
    gaps = [_gaps(df, c) for c in df.columns]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *[g.alias(f"gaps_{i}") for i, g in enumerate(gaps)]).write.parquet(path)
    found = seen.get
    return df.sparkSession.read.schema(df.schema).parquet(path), {
        ROWS: found["rows"], **{c: found[f"gaps_{i}"] for i, c in enumerate(df.columns)}}


def _gaps(df: DataFrame, name: str) -> Column:
    gap = col(name).isNull()
    if isinstance(df.schema[name].dataType, FRACTIONAL_TYPES):
        gap = gap | F.coalesce(F.isnan(col(name)), F.lit(False))
    return F.count_if(gap)


def read_log(spark: SparkSession, folder: str, dataset_id: str | None = None) -> DataFrame:
    """The log's rows; nothing but the log is read."""
    log = spark.read.schema(LOG).parquet(f"{folder}/log")
    return log if dataset_id is None else log.filter(F.col("dataset_id") == dataset_id)


SAVED = (
    "pipeline_id string, pipeline_name string, description string, category string, steps string, "
    "is_public boolean, usage_count bigint, tags array<string>"
)


def saved_row(
    spark: SparkSession, pipeline_id: str, name: str, steps: Sequence[Step], description: str | None = None,
    category: str | None = None, is_public: bool = False, tags: Sequence[str] = (),
) -> DataFrame:
    """A catalog row of a pipeline; one without steps cannot be saved."""
    if not steps:
        raise ValueError("no steps to save")
    unknown = [s.kind for s in steps if s.kind not in KINDS]
    if unknown:
        raise ValueError(f"unknown transformation type: {unknown[0]}")
    text = json.dumps([s.to_dict() for s in steps])
    return spark.createDataFrame(
        [(pipeline_id, name, description, category, text, is_public, 0, list(tags))], SAVED)


def load_steps(catalog: DataFrame, pipeline_id: str) -> list[Step]:
    row = catalog.filter(F.col("pipeline_id") == pipeline_id).select("steps").first()
    if row is None:
        raise ValueError(f"no pipeline {pipeline_id}")
    return [Step.from_dict(r) for r in json.loads(row["steps"])]
