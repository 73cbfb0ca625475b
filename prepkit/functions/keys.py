"""Grouping keys that stay narrow however wide the value or the row is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepkit.functions.columns import FIXED_WIDTHS, FRACTIONAL_TYPES, col

#: Text up to this many bytes is its own key. A longer text is replaced by its
#: SHA-256 in hex, which is longer than this limit, so the two cannot meet.
LONGEST_PLAIN_KEY = 48
#: Rows of at most this many fixed-width bytes are grouped as they are.
WIDEST_PLAIN_ROW = 40


def text_key(text: Column) -> Column:
    return F.when(F.octet_length(text) <= LONGEST_PLAIN_KEY, text).otherwise(F.sha2(text, 256))


def _settled(name: str, data_type: T.DataType) -> Column:
    """One form for equal cells: minus zero is zero and NaN is NULL."""
    c = col(name)
    if not isinstance(data_type, FRACTIONAL_TYPES):
        return c
    return F.when(~F.isnan(c), c + F.lit(0).cast(data_type)).alias(name)


def _printable(name: str, data_type: T.DataType) -> Column:
    c = col(name)
    if isinstance(data_type, T.BinaryType):
        return F.base64(c)
    if isinstance(data_type, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(c)))
    if isinstance(data_type, (T.ArrayType, T.StructType)):
        return F.to_json(F.struct(c))
    if isinstance(data_type, FRACTIONAL_TYPES):
        return _settled(name, data_type).cast("string")
    return c.cast("string")


def row_digest(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 of all cells: each is written with its length in front, so no two
    different rows read the same, and a NULL reads like no value."""
    wanted = df.columns if columns is None else columns
    cells = []
    for name in wanted:
        text = _printable(name, df.schema[name].dataType)
        cells.append(F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("~")))
    return F.unhex(F.sha2(F.concat(*cells), 256))


def row_key(df: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """Columns to group whole rows by: the cells themselves when all are narrow,
    else a 32-byte digest, so the shuffle moves 32 bytes instead of a row."""
    wanted = df.columns if columns is None else columns
    widths = [FIXED_WIDTHS.get(type(df.schema[c].dataType)) for c in wanted]
    if all(w is not None for w in widths) and sum(widths) <= WIDEST_PLAIN_ROW:
        return [_settled(c, df.schema[c].dataType) for c in wanted]
    return [row_digest(df, wanted).alias("row_digest")]
