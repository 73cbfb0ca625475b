"""Deciding what a piece of text looks like, with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A decimal number with optional sign and exponent. Text such as
# 1d, inf, nan or 1_000 is not a number here.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"
BOOLEAN_PATTERN = r"^(true|false|True|False|TRUE|FALSE)$"

# Date layouts that count as a date when every value has them.
ISO_DATE_PATTERN = r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?\s*$"
SLASH_MONTH_FIRST_PATTERN = r"^\d{1,2}/\d{1,2}/\d{4}$"
SLASH_YEAR_FIRST_PATTERN = r"^\d{4}/\d{1,2}/\d{1,2}$"


def looks_numeric(text: Column) -> Column:
    return text.rlike(NUMBER_PATTERN)


def without_commas(text: Column) -> Column:
    return F.regexp_replace(text, ",", "")


def without_commas_and_spaces(text: Column) -> Column:
    return F.translate(text, ", ", "")


def to_number(text: Column) -> Column:
    """The number a text holds, else NULL."""
    return F.when(looks_numeric(text), F.trim(text).try_cast("double"))


def to_integer(text: Column) -> Column:
    return F.when(text.rlike(INTEGER_PATTERN), F.trim(text).try_cast("bigint"))


def to_moment(text: Column) -> Column:
    """The point in time a text holds, else NULL."""
    return (
        F.when(text.rlike(ISO_DATE_PATTERN), F.trim(text).try_cast("timestamp_ntz"))
        .when(text.rlike(SLASH_MONTH_FIRST_PATTERN),
              F.try_to_timestamp(text, F.lit("M/d/yyyy")).cast("timestamp_ntz"))
        .when(text.rlike(SLASH_YEAR_FIRST_PATTERN),
              F.try_to_timestamp(text, F.lit("yyyy/M/d")).cast("timestamp_ntz"))
    )


def hints_at_date(text: Column) -> Column:
    """A separator and a digit: the loose sign of a date kept as text."""
    return text.rlike("[/-]") & text.rlike("[0-9]")
