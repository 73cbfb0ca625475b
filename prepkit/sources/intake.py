"""Checks on files before they are read: listing, size, name, encoding, content."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Intake rules.
ALLOWED_EXTENSIONS = (".csv",)
# Byte order marks in hex and what they stand for, longer ones first.
BYTE_ORDER_MARKS = [
    ("FFFE0000", "utf-32"), ("0000FEFF", "utf-32"), ("EFBBBF", "utf-8"), ("FFFE", "utf-16"), ("FEFF", "utf-16"),
]


def _plain(path: Column) -> Column:
    """One way to write a path of the local file system."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def list_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, length) of all files, empty ones too: the listing only, no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    # A scan leaves out files of zero bytes; the listing, which the driver holds anyway, has them.
    listed = spark.createDataFrame([(unquote(f),) for f in files.inputFiles()], "path string")
    sizes = files.select(_plain(F.col("path")).alias("path"), "length")
    return listed.select(_plain(F.col("path")).alias("path")).join(sizes, "path", "left").select(
        "path", F.coalesce("length", F.lit(0).cast("bigint")).alias("length"))


def intake_audit(
    files: DataFrame, max_bytes: int | None = None, extensions=ALLOWED_EXTENSIONS
) -> DataFrame:
    """(path, length, accepted, reason) by name and size; no limit unless one is given."""
    extension = F.lower(F.regexp_extract(F.col("path"), r"(\.[^./\\]*)$", 1))
    reason = F.when(~extension.isin(list(extensions)), "extension not allowed")
    if max_bytes is not None:
        reason = reason.when(F.col("length") > max_bytes, "file too large")
    reason = reason.when(F.col("length") == 0, "file is empty")
    return files.select(
        "path", "length", reason.isNull().alias("accepted"), reason.alias("reason"))


def encoding_audit(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, encoding, confidence, has_content) of each file that is not empty.

    All bytes are looked at, line by line and in as many tasks as the files have blocks. A
    byte order mark decides; else a file is ASCII, valid UTF-8, or taken for Latin-1.
    """
    lines = spark.read.option("recursiveFileLookup", recursive).text(path).select(
        _plain(F.col("_metadata.file_path")).alias("path"), "value",
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = lines.select(
        "path", "block", "row", F.hex(F.substring(F.col("value").cast("binary"), 1, 4)).alias("start"),
        F.is_valid_utf8("value").alias("valid"),
        (F.octet_length("value") == F.length(F.regexp_replace(F.make_valid_utf8("value"), "[^\\x00-\\x7f]", ""))).alias("ascii"),
        F.col("value").rlike("[^\\s\\x00]").alias("filled"))
    files = lines.groupBy("path").agg(
        F.min_by("start", F.struct("block", "row")).alias("start"), F.bool_and("valid").alias("valid"),
        F.bool_and("ascii").alias("ascii"), F.bool_or("filled").alias("has_content"))
    encoding, confidence = F, F
    for mark, name in BYTE_ORDER_MARKS:
        encoding = encoding.when(F.col("start").startswith(mark), name)
        confidence = confidence.when(F.col("start").startswith(mark), 1.0)
    encoding = encoding.when(F.col("ascii"), "ascii").when(F.col("valid"), "utf-8").otherwise("iso-8859-1")
    confidence = confidence.when(F.col("ascii"), 1.0).when(F.col("valid"), 0.9).otherwise(0.5)
    # File paths of scans are escaped as in a URL.
    return files.select(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("path"),
                        encoding.alias("encoding"), confidence.alias("confidence"), "has_content")
