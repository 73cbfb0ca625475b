"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
from functools import lru_cache
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where it is unset, as in a local test, a folder is made,
    one per application."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return (folder or _own_folder(spark.sparkContext.applicationId)).rstrip("/")


@lru_cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"prepkit-{application}-")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: the lineage ends there, and the
    table outlives any executor. The folder belongs to the job and is emptied with it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key list up to this many rows (8 to 16 bytes each) is copied to every executor.
FEW_KEYS = 2_000_000


def small_if_few(keys: DataFrame, most: int = FEW_KEYS) -> DataFrame:
    """Broadcast a list of narrow keys after counting it; a longer one is left to a shuffle
    join, whose hot keys adaptive execution splits."""
    return F.broadcast(keys) if keys.count() <= most else keys
