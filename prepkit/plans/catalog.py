"""Browsing a catalog table of datasets or pipelines."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepkit.functions.columns import col


def where(catalog: DataFrame, **equal: Any) -> DataFrame:
    """Rows that match every given value; None means no condition."""
    for name, value in equal.items():
        if value is not None:
            catalog = catalog.filter(col(name) == F.lit(value))
    return catalog


def search(catalog: DataFrame, text: str | None, *fields: str) -> DataFrame:
    """Rows with the text in any of the fields, in whatever case."""
    if not text:
        return catalog
    hit = F.lit(False)
    for name in fields:
        hit = hit | F.coalesce(F.lower(col(name)).contains(text.lower()), F.lit(False))
    return catalog.filter(hit)


def page(catalog: DataFrame, newest_by: str, key: str, number: int = 1, size: int = 20) -> DataFrame:
    """One page in descending order, ties by key, with the total beside each row.

    Rows before the page are sorted and skipped; to go far, take :func:`page_after`.
    """
    if number < 1 or size < 1:
        raise ValueError("pages start at 1 and hold a row at least")
    total = catalog.agg(F.count(F.lit(1)).alias("total"))
    shown = catalog.orderBy(F.desc(newest_by), F.asc(key)).offset((number - 1) * size).limit(size)
    return shown.crossJoin(F.broadcast(total))


def page_after(catalog: DataFrame, newest_by: str, key: str, last: tuple[Any, Any] | None = None, size: int = 20) -> DataFrame:
    """The page that follows the row with these values of ``newest_by`` and ``key``: a filter
    that reaches the files and a top list, however far down the page is."""
    if last is not None:
        value, name = F.lit(last[0]), F.lit(last[1])
        catalog = catalog.filter((col(newest_by) < value) | ((col(newest_by) == value) & (col(key) > name)))
    return catalog.orderBy(F.desc(newest_by), F.asc(key)).limit(size)


def get(catalog: DataFrame, key: str, value: Any, **owner: Any) -> DataFrame:
    return where(catalog, **{key: value}, **owner)
