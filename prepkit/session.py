"""A session for tests, benchmarks and laptops. On a cluster bring your own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(
    cpus: str | int = "*", name: str = "prepkit", memory: str | None = None, scratch: str | None = None
) -> SparkSession:
    partitions = os.cpu_count() if cpus == "*" else int(cpus)
    builder = SparkSession.builder
    if scratch:
        builder = builder.config("spark.checkpoint.dir", scratch)
    return (
        builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory or os.environ.get("PREPKIT_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # call-site capture costs more than planning when expressions are built by rule
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
