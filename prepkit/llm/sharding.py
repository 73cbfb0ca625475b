"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly over buckets by a seeded hash, as many as keep a
bucket small enough for one task's memory. Pass two shuffles each bucket by Fisher and Yates
with a seed of its own. Laid end to end the buckets are one random order of all records;
dealing it out in turn gives every shard the same number of records, give or take one.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARDS, SEED = 16, 20240229
#: Text bytes of a bucket, on average.
BUCKET_BYTES = 16 * 1024 * 1024


def shuffled_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, doc_id: str = "doc_id",
                    text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows with all columns, and ``shard`` (0 to ``shards - 1``) and ``slot`` (0, 1, 2 ...
    without a gap, within the shard). Shards differ by one row at most.

    Columns of the input called ``shard`` or ``slot`` are replaced. NULL and empty texts are
    records like others. A NULL id is hashed by the text alone; rows that are alike in id and
    text meet in one bucket, in the order of their other columns' hash, so reruns agree. An
    empty table gives an empty one. No record is larger than itself: a bucket that holds one
    giant text is that text.
    """
    docs = docs.drop("shard", "slot")
    if not docs.columns:
        raise ValueError("a table without columns has no records to deal")
    length = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    total = docs.agg(F.sum(length)).first()[0] or 0
    n = max(1, -(-total // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)), F.lit(n))
    scattered = docs.withColumn(BUCKET, bucket)
    # One row of two numbers per bucket of many megabytes.
    sizes = scattered.groupBy(BUCKET).agg(F.count("*").alias("rows"))
    start = F.sum("rows").over(Window.orderBy(BUCKET)) - F.col("rows")
    starts = sizes.select(BUCKET, start.alias(START))
    held = scattered.join(F.broadcast(starts), BUCKET)
    # The order that the Fisher-Yates walk starts from must not hang on how rows arrive.
    held = held.withColumn(RANK, F.xxhash64(F.lit(~seed), *[F.col(f"`{c}`").cast("string") if isinstance(
        docs.schema[c].dataType, T.MapType) else F.col(f"`{c}`") for c in docs.columns]))
    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return held.groupBy(BUCKET).applyInArrow(_fisher_yates(docs.columns, shards, seed), schema)


BUCKET, START, RANK = "__bucket", "__start", "__rank"


def _fisher_yates(columns: list[str], shards: int, seed: int):
    def shuffle(bucket: pa.Table) -> pa.Table:
        n = bucket.num_rows
        order = np.argsort(bucket.column(RANK).to_numpy(), kind="stable").tolist()
        pick = random.Random(f"{seed}/{bucket.column(BUCKET)[0].as_py()}").random
        for i in range(n - 1, 0, -1):
            j = int(pick() * (i + 1))
            order[i], order[j] = order[j], order[i]
        place = bucket.column(START)[0].as_py() + np.arange(n, dtype=np.int64)
        out = bucket.select(columns).take(pa.array(order, pa.int64()))
        return (out.append_column("shard", pa.array((place % shards).astype(np.int32)))
                .append_column("slot", pa.array(place // shards)))
    return shuffle


def write_shards(dealt: DataFrame, path: str) -> None:
    """One folder per shard, its rows by slot. Each task writes a range of one shard, so a
    shard is as many files as its size asks for, in order of their slots."""
    (dealt.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
