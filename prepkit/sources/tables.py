"""Parquet in and out, and scratch space every executor can see."""

from __future__ import annotations

import os
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from prepkit.functions.columns import nan_to_null


def read_parquet(spark: SparkSession, path: str, may_hold_nan: bool = True) -> DataFrame:
    """A table with one kind of missing value.

    Columns and filters are pruned down to the files. Filters on fractional columns
    get there only when the table is known to be free of NaN.
    """
    df = spark.read.parquet(path)
    return nan_to_null(df) if may_hold_nan else df


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the cluster names it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_folder(spark), f"{name}-{uuid4().hex}")


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut the lineage by way of a table in the shared folder; it outlives executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
