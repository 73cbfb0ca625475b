"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A benchmark item of m characters that occurs in a text with at most k edits shares at least
m - q + 1 - k * q of its q-grams with the text, all of them on diagonals that lie at most k
apart. So shared q-grams are counted in diagonal bands of k + 1, each taken together with the
next one; a pair of bands that reaches the bound is a region worth looking at, and a
banded alignment there tells the number of edits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from prepkit.llm.text import FIRST, PIECE_BYTES, gram_hashes, mixed

Q = 10
#: Edits allowed per character of an item.
EDITS = 0.07
#: The benchmark is taken in blocks of about so many bytes; every block scans the documents once.
BLOCK_BYTES = 8_000_000
FILTER_BITS = 22


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
          item_id: str = "item_id", item_text: str = "text", q: int = Q, edits: float = EDITS,
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and benchmark item that occurs in it: ``doc_id``, ``item_id``,
    ``edits``, ``first`` and ``n_chars`` (the best occurrence, in characters of the text with
    letters lowered and blanks joined to one space).

    An item may differ from the text by ``edits`` per character, fewer where the bound would be
    empty. NULL and empty texts leak nothing; items with less than ``q`` characters are too
    short to be told from prose and match nothing. Documents and items with NULL ids are
    compared like others. Equal rows and equal items give a row each. Other columns are not read.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kinds = dict(base.dtypes)["doc_id"], benchmark.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, edits int, first long, n_chars long"
    id_type = to_arrow_type(benchmark.schema[item_id].dataType)
    found = None
    for items in _blocks(base, benchmark, item_id, item_text, q, edits, block_bytes):
        rows = base.mapInArrow(_reporter(items, id_type), schema)
        found = rows if found is None else found.union(rows)
    if found is None:
        found = base.sparkSession.createDataFrame([], schema)
    return found.withColumnsRenamed({"doc_id": doc_id, "item_id": item_id})


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", q: int = Q, edits: float = EDITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows, with all their columns, whose text holds no item; see ``leaks``."""
    for items in _blocks(docs, benchmark, item_id, item_text, q, edits, block_bytes):
        docs = docs.mapInArrow(_filter(items, text), docs.schema)
    return docs


def _blocks(docs: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, q: int, edits: float, block_bytes: int):
    """The benchmark as broadcast indexes of bounded size, one after the other."""
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    n = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes)
    for block in range(n):
        rows = items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == block).collect()
        index = _Index([(r["item_id"], plain(r["text"])) for r in rows], q, edits)
        yield docs.sparkSession.sparkContext.broadcast(index)


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Index:
    """The q-grams of the items of a block."""

    def __init__(self, items: list[tuple], q: int, edits: float):
        self.q = q
        self.items = [(i, characters(t)) for i, t in items if len(t) >= q]
        sizes = np.array([len(t) for _, t in self.items], np.int64)
        # As many edits as asked for, as long as the lemma still asks for a shared q-gram.
        self.budget = np.minimum((sizes * edits).astype(np.int64), (sizes - q) // q)
        self.need = sizes - q + 1 - self.budget * q
        hashes = [self.grams(t) for _, t in self.items]
        every = np.concatenate([*hashes, np.empty(0, np.uint64)])
        item = np.repeat(np.arange(len(self.items)), [len(h) for h in hashes])
        place = np.concatenate([*(np.arange(len(h)) for h in hashes), np.empty(0, np.int64)])
        order = np.argsort(every, kind="stable")
        self.item, self.place = item[order], place[order].astype(np.int64)
        self.known, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every))
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[(self.known >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def grams(self, chars: np.ndarray) -> np.ndarray:
        return mixed(gram_hashes(chars.astype(np.uint64), self.q, FIRST))

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, first, characters) of each item that occurs in each text."""
        if not self.items:
            return []
        gap = "\0" * self.q
        joined = characters(gap.join([*texts, ""]))
        past = np.cumsum([len(t) + self.q for t in texts])
        start = past - [len(t) + self.q for t in texts]
        h = self.grams(joined)
        at = np.flatnonzero(self.seen[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        place = np.searchsorted(self.known, h[at])
        place = np.minimum(place, len(self.known) - 1)
        hit = self.known[place] == h[at]
        at, place = at[hit], place[hit]
        if not len(at):
            return []
        n = self.first[place + 1] - self.first[place]
        at = np.repeat(at, n)
        entry = np.repeat(self.first[place] - np.cumsum(n) + n, n) + np.arange(len(at))
        item = self.item[entry]
        # Bands count from the first diagonal that a piece can have.
        width = self.budget[item] + 1
        band = (at - self.place[entry] + SHIFT) // width
        key, count = np.unique(item * BANDS + band, return_counts=True)
        both = count + np.where(np.append(key[1:], -1) == key + 1, np.append(count[1:], 0), 0)
        # The first of two bands may be empty.
        lead = key[np.insert(key[1:] != key[:-1] + 1, 0, True)] - 1
        lead_count = count[np.searchsorted(key, lead + 1)]
        key, both = np.concatenate([key, lead]), np.concatenate([both, lead_count])
        item = key // BANDS
        rich = both >= self.need[item]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for i, b in zip(item[rich].tolist(), (key % BANDS)[rich].tolist()):
            k = int(self.budget[i])
            low, high = b * (k + 1) - SHIFT, (b + 2) * (k + 1) - SHIFT  # diagonals
            pattern = self.items[i][1]
            t = int(np.searchsorted(past, max(0, low), side="right"))
            while t < len(texts) and start[t] < high + len(pattern):
                a, z = max(low - k, int(start[t])), min(high + len(pattern) + k, int(past[t]) - self.q)
                got = align(pattern, joined[a:z], k) if z > a else None
                if got and got < best.get((t, i), (k + 1, 0, 0)):
                    best[t, i] = (got[0], got[1] + a - int(start[t]), got[2])
                t += 1
        return [(t, i, e, int(f), n) for (t, i), (e, f, n) in sorted(best.items())]


#: Diagonals are made positive by SHIFT; an item has fewer than BANDS bands in a piece.
SHIFT, BANDS = 1 << 32, 1 << 34


def align(pattern: np.ndarray, region: np.ndarray, k: int) -> tuple[int, int, int] | None:
    """(edits, first, characters) of the best occurrence with at most ``k`` edits in a region."""
    end = _best_end(pattern, region, k, anywhere=True)
    if end is None:
        return None
    edits, stop = end
    back = _best_end(pattern[::-1], region[:stop][::-1], edits, anywhere=False)
    n = back[1] if back else len(pattern)
    return edits, stop - n, n


def _best_end(pattern: np.ndarray, region: np.ndarray, k: int, anywhere: bool) -> tuple[int, int] | None:
    """Edits and end of the best alignment of the pattern, which may begin anywhere in the
    region or has to begin at its start. A row holds the diagonals that the region leaves room
    for (or 2 k + 1 of them around the start)."""
    m, n = len(pattern), len(region)
    low, high = (-k, n - m + k) if anywhere else (-k, k)
    if high < low:
        return None
    diagonals = np.arange(low, high + 1)
    far = m + n + 1
    row = np.where(diagonals >= 0, 0 if anywhere else diagonals, far)
    slots = np.arange(len(diagonals))
    padded = np.concatenate([np.full(max(0, -low), NOTHING, np.uint32), region,
                             np.full(max(0, high + m - n), NOTHING, np.uint32)])
    base = max(0, -low) + low
    for i in range(m):
        ahead = padded[base + i:base + i + len(diagonals)]
        inside = (diagonals + i >= 0) & (diagonals + i < n)
        new = np.where(inside, row + (ahead != pattern[i]), far)
        new = np.minimum(new, np.append(row[1:], far) + 1)  # a character of the pattern is missing
        row = np.minimum.accumulate(new - slots) + slots  # characters of the text are extra
    ends = diagonals + m
    row = np.where((ends >= 0) & (ends <= n), row, far)
    at = int(np.argmin(row))
    return (int(row[at]), int(ends[at])) if row[at] <= k else None


NOTHING = 0xFFFFFFFF


def _pieces(texts: list[str | None]):
    """Plain texts in pieces of bounded size, each with the number of its first row."""
    piece, size, first = [], 0, 0
    for i, t in enumerate(texts):
        p = plain(t)
        if piece and size + len(p) > PIECE_BYTES:
            yield first, piece
            piece, size, first = [], 0, i
        piece.append(p)
        size += len(p)
    if piece:
        yield first, piece


def _reporter(index, id_type: pa.DataType):
    def report(batches):
        for batch in batches:
            for first, texts in _pieces(batch.column("text").to_pylist()):
                found = index.value.search(texts)
                if found:
                    text, item, edits, at, n = zip(*found)
                    yield pa.record_batch([
                        batch.column("doc_id").take(pa.array([first + t for t in text])),
                        pa.array([index.value.items[i][0] for i in item], id_type), pa.array(edits, pa.int32()),
                        pa.array(at, pa.int64()), pa.array(n, pa.int64())],
                        names=["doc_id", "item_id", "edits", "first", "n_chars"])
    return report


def _filter(index, text: str):
    def clean(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for first, texts in _pieces(batch.column(text).to_pylist()):
                keep[[first + t for t, *_ in index.value.search(texts)]] = False
            yield batch.filter(pa.array(keep))
    return clean
