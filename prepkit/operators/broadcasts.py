"""Hand statistics of a table back to its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: A dictionary up to this many bytes of text is copied to every executor.
SMALL_BYTES = 32 * 1024 * 1024


def broadcast_if_small(frame: DataFrame, most: int | None = None, known: int | None = None) -> DataFrame:
    """Broadcast a lookup table after measuring it; a larger one is left to a shuffle
    join, whose hot keys adaptive execution splits. The measuring pass is cheap beside
    shuffling the table that looks things up, and left out where the table is ``known`` to
    take no more than so many bytes and that is little enough."""
    if known is not None and known <= (SMALL_BYTES if most is None else most):
        return F.broadcast(frame)
    size = sum((F.octet_length(F.col(c).cast("string")) + 8 for c in frame.columns), F.lit(0))
    held = frame.agg(F.coalesce(F.sum(F.coalesce(size, F.lit(8))), F.lit(0))).first()[0]
    return F.broadcast(frame) if held <= (SMALL_BYTES if most is None else most) else frame


def with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the cells of a single-row frame beside every row; one row always fits."""
    return df.crossJoin(F.broadcast(one_row))


def fitted(per_column: DataFrame, fields: Sequence[str]) -> dict[str, dict]:
    """Collect the statistics of each column: one row per column of the schema.

    What is built from them is a constant in the plan, so a filter on it reaches the
    files and a chain of steps does not nest one query inside the next.
    """
    rows = per_column.select("column_name", *fields).collect()
    return {r["column_name"]: {f: r[f] for f in fields} for r in rows}
