"""N-gram Jaccard self-join as a T-occurrence search.

Two sets can reach the similarity only if they share at least T = ceil(similarity * size)
entries, for the size of either. DivideSkip sets the T - 1 longest inverted lists of a set
aside and merges the others: whatever is similar shows up in at least one of these. The lists
of all documents are merged at once by a shuffle on the shingle, sorted, so that a task reads
list after list and holds nothing of them but their head. Candidates then probe the other
party's sorted set by binary search, the long lists last, and give up as soon as T is out of reach.

"Long" needs the lists' lengths, which are counted over all documents. The order of the lists is
(long, hash), the same for every document, so the bound holds whatever is called long.

Equal sets are one node from the start. Links are found up to connection: every list links its
members to its head, the set that has the fewest shingles before this one and so, among near
copies, the one with the fewest changes of its own. Where members are then still in different
components, these are compared with the head of the whole list, and in what is left after that with
each other, across components only. There a shingle counts as the first that two
sets share, so what stands before it in either set is not shared: whoever has it too late
can only link to smaller sets that have it early. No link between components is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepkit.llm.components import components
from prepkit.llm.scratch import small_if_few, stored
from prepkit.llm.text import (
    NO_ID, Words, gram_hashes, in_pieces, keyed, mixed, real_id, signed, texts_of)

PERCENT, GRAM = 85, 4
#: Lists longer than this are long, unless more than MOST_LONG would be.
LONG_LIST, MOST_LONG = 64, 1_000_000
#: Long lists are merged in so many parts, whose heads are merged in turn.
PARTS = 64
#: Cells of the count profile that rules candidates out before their texts are fetched.
CELLS = 256


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                       percent: int = PERCENT, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest
    id that links reach.

    A set is the distinct ``gram``-word shingles of the text with A-Z lowered, or the whole word
    sequence when there are fewer words. Two rows link when 100 * |A & B| >= percent * |A | B|.
    NULL, empty and blank texts have no shingle and link with nothing. A NULL id counts as larger
    than any other, is returned as NULL, and is a component id only where all members have none.
    Rows that share an id are different documents. Other columns are not read.
    """
    base = keyed(docs, doc_id, text)
    nodes, rooted = jaccard_rooted(base, percent, gram)
    least = (nodes.where("n > 0").groupBy("node").agg(F.min("id").alias("low"))
             .join(rooted, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root")))
    lowest = least.groupBy("root").agg(F.min("low").alias("component"))
    named = least.join(lowest, "root").select("node", "component")
    return nodes.join(named, "node", "left").select(
        real_id().alias(doc_id), F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, real_id()).otherwise(real_id("component")).alias("component_id"))


def jaccard_rooted(base: DataFrame, percent: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """``nodes`` (id, mark, node, n, profile; a node is a distinct set), and ``node`` and ``root``
    of those that links connect with another."""
    nodes = stored(base.mapInArrow(in_pieces(_nodes(gram)), NODE), "sets")
    long_lists = _long_lists(base, gram)
    members = stored(
        base.select("text").mapInArrow(in_pieces(_short_lists(gram, percent, long_lists)), POSTING)
        .repartition("shingle", "part").sortWithinPartitions("shingle", "part", "at", "node")
        .mapInArrow(_merge, "shingle long, head long, node long, at int, parted boolean"), "lists")
    # A long list was merged in parts: the heads of its parts are a list again.
    heads = members.where("parted and node = head").select("shingle", "node", "at").distinct()
    tops = heads.groupBy("shingle").agg(F.min_by("node", F.struct("at", "node")).alias("head"))
    across = heads.join(tops, "shingle").select("head", "node")
    stars = members.select("head", "node").union(across).where("head != node").distinct()

    one = nodes.groupBy("node").agg(F.min(F.struct("id", "mark")).alias("at"), F.first("n").alias("n"),
                                    F.first("profile").alias("profile"))
    one = stored(one.select("node", "at.*", "n", "profile"), "nodes")
    first = stored(_verified(base, one, _possible(stars.select(
        F.col("head").alias("a"), F.col("node").alias("b")), one, percent), percent, gram), "links")

    # Heads of whole lists first: they join most components of near copies, so that few pairs are
    # left to compare across. What was tried is not tried again.
    tried = stars.select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b"))
    sized = members.select("shingle", "node", "at").join(one.select("node", "n"), "node")
    rooted, apart = components(first), sized
    for heads_only in (True, False):
        apart = stored(_apart(apart, rooted), "apart")
        pairs = stored(_near_pairs(apart, percent, heads_only).join(tried, ["a", "b"], "left_anti"), "pairs")
        found = stored(_verified(base, one, _possible(pairs, one, percent), percent, gram), "links")
        rooted = components(rooted.toDF("a", "b").union(found))
        tried = tried.union(pairs)
    return nodes, rooted


def _apart(members: DataFrame, rooted: DataFrame) -> DataFrame:
    """Members of lists that span several components, with their ``root``."""
    held = members.select("shingle", "node", "at", "n").join(rooted, "node", "left")
    held = held.withColumn("root", F.coalesce("root", "node"))
    split = (held.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"))
             .where("low < high").select("shingle"))
    # What a set can share from this shingle on.
    return held.join(split, "shingle", "left_semi").withColumn("left", F.col("n") - F.col("at"))


def _near_pairs(apart: DataFrame, percent: int, heads_only: bool) -> DataFrame:
    """Pairs of a list, across components, whose sizes and places leave the overlap within reach:
    all of them, or those with the list's head."""
    x = apart
    if heads_only:
        x = apart.groupBy("shingle").agg(F.min_by(F.struct(*(c for c in apart.columns if c != "shingle")),
                                                  F.struct("at", "n", "node")).alias("head")).select("shingle", "head.*")
    x, y = x.alias("x"), apart.alias("y")
    near = ((F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.root") != F.col("y.root"))
            & (F.col("x.n") * 100 >= F.col("y.n") * percent) & (F.col("y.n") * 100 >= F.col("x.n") * percent)
            & (F.least("x.left", "y.left") * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent))
    if not heads_only:  # one of the two directions
        near &= F.struct("x.n", "x.node") < F.struct("y.n", "y.node")
        x = x.where(F.col("x.left") * (100 + percent) >= F.col("x.n") * (2 * percent))
    return x.join(y, near).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


NODE = "id long, mark long, node long, n long, profile binary"
POSTING = "shingle long, part int, node long, at int"


class _Sets:
    """The sorted distinct shingle hashes of each text of a piece."""

    def __init__(self, texts: list[bytes], gram: int):
        w = Words(texts, lower=True)
        grams = gram_hashes(w.hashes, gram)
        offsets = w.offsets
        self.sets = []
        for a, n in zip(offsets[:-1].tolist(), w.counts.tolist()):
            if n >= gram:
                h = np.unique(mixed(grams[a:a + n - gram + 1]))
            elif n:  # fewer words: the sequence itself, with its length
                h = mixed(gram_hashes(w.hashes[a:a + n], n) + np.uint64(n))
            else:
                h = w.hashes[:0]
            self.sets.append(h)
        sizes = np.array([len(h) for h in self.sets], np.uint64)
        self.nodes = np.array([np.bitwise_xor.reduce(mixed(h + SALT)) for h in self.sets], np.uint64) + sizes * SALT


SALT = np.uint64(0xD6E8FEB86659FD93)


def _nodes(gram: int):
    def nodes(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = _Sets(texts_of(batch), gram)
        profile = [np.minimum(np.bincount(h & np.uint64(CELLS - 1), minlength=CELLS), 255).astype(np.uint8).tobytes()
                   for h in s.sets]
        return pa.record_batch([
            batch.column("id"), batch.column("mark"), signed(s.nodes),
            pa.array([len(h) for h in s.sets], pa.int64()), pa.array(profile, pa.binary())],
            names=["id", "mark", "node", "n", "profile"])
    return nodes


def _long_lists(base: DataFrame, gram: int) -> np.ndarray:
    """The hashes, sorted, of shingles whose lists are long; at most MOST_LONG of them, so that
    every task can hold them."""
    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = _Sets(texts_of(batch), gram)
        sets = [s.sets[i] for i in np.unique(s.nodes, return_index=True)[1]]
        h, n = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_counts=True)
        return pa.record_batch([signed(h), pa.array(n, pa.int64())], names=["shingle", "n"])

    # A piece has counted its own; most shingles occur once, so hashing them again before the
    # shuffle would only fill memory.
    lists = (base.select("text").mapInArrow(in_pieces(count, 4_000_000), "shingle long, n long")
             .repartition("shingle").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") > LONG_LIST))
    lists = stored(lists, "long")
    by_size = {r["size"]: r["count"] for r in lists.groupBy(F.floor(F.log2("n")).alias("size")).count().collect()}
    least, held = 0, 0
    for size in sorted(by_size, reverse=True):
        held += by_size[size]
        if held > MOST_LONG:
            least = 2 ** (size + 1)
            break
    found = lists.where(F.col("n") >= least).select("shingle").toArrow()["shingle"].to_numpy()
    return np.sort(found.view(np.uint64))


def _short_lists(gram: int, percent: int, long_lists: np.ndarray):
    shared = pa.py_buffer(long_lists.tobytes())

    def postings(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = np.frombuffer(shared, np.uint64)
        s = _Sets(texts_of(batch), gram)
        shingles, nodes, counts = [], [], []
        for i in np.unique(s.nodes, return_index=True)[1]:
            h = s.sets[i]
            keep = len(h) - (-(-percent * len(h) // 100)) + 1 if len(h) else 0
            is_long = _within(known, h)
            shingles.append(np.concatenate([h[~is_long], h[is_long]])[:keep])
            nodes.append(s.nodes[i])
            counts.append(keep)
        h = np.concatenate([*shingles, np.empty(0, np.uint64)])
        node = np.repeat(np.array(nodes, np.uint64), counts)
        parted = _within(known, h)
        part = np.where(parted, 1 + (node >> np.uint64(40)) % np.uint64(PARTS), np.uint64(0)).astype(np.int32)
        at = np.concatenate([*map(np.arange, counts), np.empty(0, np.int64)]).astype(np.int32)
        return pa.record_batch([signed(h), pa.array(part), signed(node), pa.array(at)], names=["shingle", "part", "node", "at"])
    return postings


def _within(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    at = np.searchsorted(known, h)
    return known[np.minimum(at, len(known) - 1)] == h


def _merge(batches):
    """Walk over sorted lists: each entry gets the head of its list; a list in parts keeps its
    single entries, another one drops them."""
    last, head = None, None
    pending = None  # the head of the list at the end of a batch, not yet given out
    for batch in batches:
        if not batch.num_rows:
            continue
        shingle, part, node, at = (np.asarray(batch.column(i)) for i in range(4))
        new = np.ones(len(shingle), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (part[1:] != part[:-1])
        goes_on = last == (shingle[0], part[0])
        new[0] = not goes_on
        begin = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        heads = np.where(begin >= 0, node[np.maximum(begin, 0)], head if goes_on else 0)
        out = np.ones(len(new), bool)
        out[1:] = node[1:] != node[:-1]  # the same set again
        out[1:] |= new[1:]
        if goes_on:
            out[0] = node[0] != previous
        single = new & np.append(new[1:], False) & (part == 0)
        columns = [shingle, heads, node, at, part > 0]
        if new[-1] and part[-1] == 0:
            single[-1] = True  # decided by the next batch
        rows = [c[out & ~single] for c in columns]
        if pending is not None and goes_on and (out & ~single)[:_first(new)].any():
            rows = [np.insert(c, 0, p) for c, p in zip(rows, pending)]
            pending = None
        if new[-1] and part[-1] == 0:
            pending = [shingle[-1], node[-1], node[-1], at[-1], False]
        elif not goes_on or new.any():
            pending = None
        last, head, previous = (shingle[-1], part[-1]), heads[-1], node[-1]
        yield pa.record_batch([pa.array(c) for c in rows], names=["shingle", "head", "node", "at", "parted"])


def _first(new: np.ndarray) -> int:
    """Where the first new list begins."""
    at = np.flatnonzero(new)
    return int(at[0]) if len(at) else len(new)


def _possible(pairs: DataFrame, one: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and count profiles leave the overlap within reach."""
    side = one.select("node", "n", "profile")
    both = pairs
    for end in "ab":
        both = both.join(side.toDF(end, f"n_{end}", f"profile_{end}"), end)
        if end == "b":
            both = both.where((F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent))

    def bound(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(f"profile_{e}").to_pylist()), np.uint8).reshape(-1, CELLS) for e in "ab")
            n = np.asarray(batch.column("n_a")) + np.asarray(batch.column("n_b"))
            most = np.minimum(a, b).sum(axis=1, dtype=np.int64)
            full = ((a == 255) | (b == 255)).any(axis=1)  # a cell that stopped counting
            keep = full | (100 * most >= percent * (n - most))
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(bound, "a long, b long")


def _verified(base: DataFrame, one: DataFrame, pairs: DataFrame, percent: int, gram: int) -> DataFrame:
    """The pairs that reach the similarity, by exact overlap of their shingles."""
    pairs = stored(pairs, "candidates")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    places = one.join(wanted, "node", "left_semi").select("node", "id", "mark")
    texts = base.join(small_if_few(places), ["id", "mark"]).select("node", "text").dropDuplicates(["node"])
    texts = stored(texts, "texts")
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text"), "b").sortWithinPartitions("a")

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        ones = batch.column("a").to_pylist()
        left: dict[int, np.ndarray] = {}
        for a, t in zip(ones, batch.column("text_a").to_pylist()):
            if a not in left:
                left[a] = _Sets([t], gram).sets[0]
        keep = []
        for a, right in zip(ones, _Sets(texts_of(batch), gram).sets):
            keep.append(_reaches(left[a], right, percent))
        return pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(in_pieces(verify), "a long, b long")


def _reaches(a: np.ndarray, b: np.ndarray, percent: int, step: int = 256) -> bool:
    """Probe the larger set for the entries of the smaller, and stop when too many were missed."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return False
    # 100 * x >= percent * (|a| + |b| - x)
    need = -(-percent * (len(a) + len(b)) // (100 + percent))
    found = 0
    for i in range(0, len(a), step):
        if found + len(a) - i < need:
            return False
        found += int(_within(b, a[i:i + step]).sum())
    return found >= need
