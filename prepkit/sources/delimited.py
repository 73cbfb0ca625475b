"""CSV in and out, with types found from the whole data."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepkit.functions import parsing
from prepkit.functions.columns import col
from prepkit.sources.intake import encoding_audit

# Cell texts that mean a missing value.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "#NULL!", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "none", "null",
]
PREVIEW_ROWS = 1000
# Charsets that the encoding audit tells apart, and those whose line feed is more
# than one byte, so a file cannot be cut at one.
CHARSETS = {"ascii": "UTF-8", "utf-8": "UTF-8", "utf-16": "UTF-16", "utf-32": "UTF-32", "iso-8859-1": "ISO-8859-1"}
WIDE = ("utf-16", "utf-32")
SURPLUS, LINE = "__surplus", "__line"


class CsvError(ValueError):
    """The files are empty or not rectangular."""


def null_tokens_to_null(df: DataFrame) -> DataFrame:
    return df.select([F.when(~col(c).isin(NULL_TOKENS), col(c)).alias(c) for c in df.columns])


def headers(spark: SparkSession, path: str | Sequence[str], **options) -> dict[str, list[str]]:
    """The header of each file that has one. A header is the start of one file, so each is a
    job of one task; they run side by side."""
    files = [unquote(f) for f in spark.read.text(path).inputFiles()]

    def header(file: str) -> list[str]:
        names = spark.read.options(**options).csv(file).columns
        return [names[0].lstrip("\ufeff"), *names[1:]] if names else names

    with ThreadPool(16) as pool:
        return {f: names for f, names in zip(files, pool.map(header, files)) if names}


def read_text_cells(
    spark: SparkSession, path: str | Sequence[str], encoding: str = "UTF-8", multi_line: bool = False,
    separator: str = ",", keep_line: bool = False,
) -> DataFrame:
    """All cells as text, missing tokens as NULL, short rows padded with NULL.

    Columns are matched by the header of each file: files may order them differently, lack
    some (then NULL) or have more. One more column than the header has is read, so fields
    beyond the header show up in ``__surplus`` instead of being lost; ``keep_line`` puts the
    whole line there when there are several. Files with line breaks inside quotes need
    ``multi_line``, which makes each file one task. With ``encoding="detect"`` the encoding audit
    tells the charset of each file, and files of each charset are read together.
    """
    if encoding == "detect":
        audited = encoding_audit(spark, path).filter("has_content").groupBy("encoding").agg(
            F.collect_list("path").alias("files")).collect()  # names of files, as any listing
        if not audited:
            raise CsvError("no header: the files are empty")
        groups = [read_text_cells(spark, r["files"], CHARSETS[r["encoding"]], multi_line or r["encoding"] in WIDE, separator, keep_line)
                  for r in sorted(audited)]
        whole = groups[0]
        for group in groups[1:]:
            whole = whole.unionByName(group, allowMissingColumns=True)
        return whole.select(*[col(c) for c in whole.columns if c != SURPLUS], SURPLUS)
    options = {
        "header": True, "encoding": encoding, "multiLine": multi_line, "sep": separator,
        "escape": '"', "nullValue": "\u0000",
    }
    try:
        found = headers(spark, path, **options)
    except Exception as error:
        raise CsvError(f"cannot read a header: {error}") from error
    if not found:
        raise CsvError("no header: the files are empty")
    alike: dict[tuple[str, ...], list[str]] = {}
    for file, names in found.items():
        alike.setdefault(tuple(names), []).append(file)
    parts = []
    for names, files in alike.items():
        extra = [SURPLUS, LINE] if keep_line else [SURPLUS]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, *extra]])
        cells = spark.read.options(
            **options, mode="PERMISSIVE", enforceSchema=True, columnNameOfCorruptRecord=LINE,
            columnPruning=not keep_line).schema(schema).csv(files)
        if keep_line:
            cells = cells.withColumn(SURPLUS, F.when(
                F.col(SURPLUS).isNotNull(), F.coalesce(LINE, SURPLUS))).drop(LINE)
        parts.append(null_tokens_to_null(cells))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole.select(*[col(c) for c in whole.columns if c != SURPLUS], SURPLUS)


_PARSERS: list[tuple[str, object]] = [
    ("bigint", parsing.to_integer),
    ("double", parsing.to_number),
    ("boolean", lambda c: F.when(c.rlike(parsing.BOOLEAN_PATTERN), F.lower(c) == "true")),
]


def inspect(cells: DataFrame) -> tuple[dict[str, str], int]:
    """Narrowest type that takes every filled cell of each column, and the number of
    rows with surplus fields. One scan: a CSV file is parsed whole for any column."""
    names = [c for c in cells.columns if c != SURPLUS]
    counts = cells.agg(
        F.count(col(SURPLUS)).alias("surplus"),
        *[
            F.struct(
                F.count(col(c)).alias("filled"),
                *[F.count(parse(col(c))).alias(t) for t, parse in _PARSERS],
            ).alias(str(i)) for i, c in enumerate(names)
        ],
    ).first()
    found: dict[str, str] = {}
    for i, name in enumerate(names):
        n = counts[str(i)]
        fits = [t for t, _ in _PARSERS if n["filled"] > 0 and n[t] == n["filled"]]
        found[name] = fits[0] if fits else "string"
    return found, counts["surplus"]


def typed(cells: DataFrame, types: dict[str, str], with_surplus: bool = False) -> DataFrame:
    parsers = dict(_PARSERS)

    def cell(name: str) -> Column:
        parse = parsers.get(types[name])
        return (parse(col(name)) if parse else col(name)).alias(name)

    beyond = [col(SURPLUS)] if with_surplus else []
    return cells.select(*[cell(c) for c in cells.columns if c != SURPLUS], *beyond)


def read_csv(
    spark: SparkSession, path: str | Sequence[str], encoding: str = "UTF-8", multi_line: bool = False,
    types: dict[str, str] | None = None, on_surplus: str = "error", separator: str = ",",
) -> DataFrame:
    """A typed table. Without ``types``, or when surplus fields are an error, one scan
    looks at the whole data first. With ``on_surplus="keep"`` a column ``__surplus`` holds
    what a row has beyond the header: the field, or the whole line if there are several."""
    if on_surplus not in ("error", "keep"):
        raise ValueError('on_surplus is "error" or "keep"')
    keep = on_surplus == "keep"
    cells = read_text_cells(spark, path, encoding, multi_line, separator, keep)
    if types is None or not keep:
        found, bad = inspect(cells)
        if bad and not keep:
            raise CsvError(f"{bad} rows have more fields than the header")
        types = found if types is None else types
    return typed(cells, types, keep)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def preview(df: DataFrame, order_by: Sequence[str], rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows as text with '' for missing cells."""
    first = df.orderBy(*[col(c) for c in order_by]).limit(rows)
    return first.select([F.coalesce(col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def preview_summary(df: DataFrame, rows: int = PREVIEW_ROWS) -> dict:
    total = df.count()
    return {"columns": df.columns, "total_rows": total, "sample_rows": min(rows, total),
            "dtypes": dict(df.dtypes)}
