"""Words, word hashes and word n-grams, as Spark expressions and inside Arrow tasks.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return. ``bytes.split()`` cuts at just these, so both sides agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
#: Texts are taken into numpy in pieces of about so many bytes; a longer text is a piece alone.
PIECE_BYTES = 500_000
#: Odd multipliers of the two polynomial hashes.
FIRST, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words(text: Column) -> Column:
    """All words of a text; none of a NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def keyed(docs: DataFrame, doc_id: str, text: str, *more: str) -> DataFrame:
    """``id``, ``mark`` and ``text``: a NULL id counts as the largest, and the mark, a hash
    of the text, tells rows apart that share an id."""
    return docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(F.col(text)).alias("mark"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), *more)


NO_ID = 2**63 - 1


def real_id(name: str = "id") -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name))


def in_pieces(run: Callable[[pa.RecordBatch], pa.RecordBatch], limit: int = PIECE_BYTES,
              name: str = "text") -> Callable:
    """For ``mapInArrow``: hand the rows to ``run`` in pieces of bounded text size."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pc.binary_length(batch.column(name)).fill_null(0), dtype=np.int64)
            piece = np.cumsum(sizes) // limit
            edges = [0, *(np.flatnonzero(np.diff(piece)) + 1), len(sizes)]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    yield run(batch.slice(a, b - a))
    return task


class Words:
    """The words of a piece of texts as arrays: ``hashes`` of all words in a row, ``counts``
    per text, and where each word lies in ``bytes``. With ``lower`` A-Z count as a-z.

    A word's hash is a polynomial in a fixed random number per byte, mixed afterwards, so
    it is the same on every machine.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b" ".join([*texts, b""])
        self.bytes = np.frombuffer(joined, np.uint8)
        blank = IS_BLANK[self.bytes]
        edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
        self.starts, self.ends = edge[::2], edge[1::2]
        past = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.counts = np.diff(np.searchsorted(self.starts, past), prepend=0)
        values = (LOWER_VALUES if lower else BYTE_VALUES)[self.bytes]
        self.hashes = mixed(span_hashes(values, self.starts, self.ends, FIRST))

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.counts)])

    @property
    def owner(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(h: np.ndarray, n: int, base: np.uint64 = FIRST) -> np.ndarray:
    """Polynomial hash of each ``n`` consecutive entries; blocks of powers of two are joined."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    block, width, out, done = h, 1, None, 0
    while True:
        if n & width:
            part = block[done:len(h) - n + 1 + done]
            out = part if out is None else out * power(base, width) + part
            done += width
        if done == n:
            return out
        block = block[:-width] * power(base, width) + block[width:]
        width *= 2


def power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 2**64))


def span_hashes(h: np.ndarray, first: np.ndarray, past: np.ndarray, base: np.uint64) -> np.ndarray:
    """Polynomial hashes of the stretches ``h[first:past]`` by prefix sums."""
    powers, inverse = power_tables(len(h), base)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers[:len(h)], out=sums[1:])
    return (sums[past] - sums[first]) * inverse[first]


@lru_cache(4)
def _tables(size: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    turned = np.uint64(pow(int(base), -1, 2**64))
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))]) for b in (base, turned))


def power_tables(size: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse; only usual sizes are kept between pieces."""
    usual = PIECE_BYTES + PIECE_BYTES // 4
    return _tables(usual, base) if size <= usual else _tables.__wrapped__(size, base)


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


IS_BLANK = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * FIRST)
LOWER_VALUES = np.concatenate([BYTE_VALUES[:65], BYTE_VALUES[97:123], BYTE_VALUES[91:]])


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """Texts as bytes; a NULL is an empty one."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]
