"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: every window of ``length`` words has one anchor, the smallest
hash of its ``gram``-word pieces, which depends on nothing but the window's words. So two
equal windows always meet at their anchor. A stretch of windows that share an anchor is a
seed; documents are joined on the anchors that two of them hold.

A seed is extended both ways at once, and without pairs of documents. First as far as its
stretch goes: stretches of equal words form a class whose owner is its smallest document, and
every other member repeats the owner's words from end to end. Where an anchor joins
several classes, the owners' stretches are compared window by window, which finds how far
the extension goes before the texts part. Runs of repeated windows are the maximal repeats
over the length threshold. Equal words are told by two 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepkit.llm.scratch import stored
from prepkit.llm.text import (
    FIRST, SECOND, Words, gram_hashes, in_pieces, keyed, mixed, real_id, signed, span_hashes,
    texts_of)

LENGTH, GRAM = 50, 16


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_removed``, ``kept_text`` (kept words
    joined by one space) and ``removed`` (first word and number of words of each maximal repeat).

    A word goes when a window of ``length`` words over it also starts in a document with a
    smaller id. NULL and empty texts have no words and come back as "". A NULL id counts as
    larger than any other. Rows with the same id do not remove words from each other, and
    equal rows get equal results. Columns other than the two named are not read, whatever
    their names.
    """
    base = keyed(docs, doc_id, text)
    spans = repeated_spans(base, length, gram)
    grouped = spans.groupBy("id", "mark").agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    out = base.join(grouped, ["id", "mark"], "left").mapInArrow(
        in_pieces(_cutter()), "id long, n_words long, n_removed long, kept_text string, "
        "removed array<struct<first: long, n: long>>")
    return out.select(real_id().alias(doc_id), "n_words", "n_removed", "kept_text", "removed")


def repeated_spans(base: DataFrame, length: int, gram: int) -> DataFrame:
    """``id, mark, first, n``: stretches of words that a smaller document holds as well."""
    runs = stored(base.mapInArrow(
        in_pieces(_seeds(length, gram)), "id long, mark long, anchor long, run_a long, run_b long, "
        "first long, windows long"), "seeds")
    joined = runs.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    seeds = runs.join(joined.select("anchor"), "anchor", "left_semi")
    run = ["anchor", "run_a", "run_b"]
    classes = seeds.groupBy(*run).agg(F.min("id").alias("owner"))
    owned = stored(seeds.join(classes, run), "classes")
    n = (F.col("windows") + (length - 1)).alias("n")
    whole = owned.where("id > owner").select("id", "mark", "first", n)

    contested = (owned.where("id = owner").groupBy("anchor")
                 .agg(F.min(F.struct("run_a", "run_b")).alias("x"), F.max(F.struct("run_a", "run_b")).alias("y"))
                 .where("x != y").select("anchor"))
    parting = (owned.where("id = owner").join(contested, "anchor", "left_semi")
               .groupBy("id", "mark").agg(F.collect_list(F.struct("first", "windows")).alias("spans")))
    windows = stored(base.join(parting, ["id", "mark"]).mapInArrow(
        in_pieces(_windows(length)), "id long, mark long, a long, b long, first long"), "windows")
    owners = (windows.groupBy("a", "b").agg(F.min("id").alias("owner"), F.max("id").alias("high"))
              .where("owner < high").drop("high"))
    part = windows.join(owners, ["a", "b"]).where("id > owner").select(
        "id", "mark", "first", F.lit(length).cast("long").alias("n"))
    return whole.union(part)


def _seeds(length: int, gram: int):
    def seeds(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(texts_of(batch))
        first = np.empty(0, np.int64)
        if len(w.hashes) >= length:
            owner = w.owner
            fits = owner[:len(owner) - length + 1] == owner[length - 1:]
            anchor = _least(gram_hashes(w.hashes, gram), length - gram + 1)
            new = fits.copy()
            new[1:] &= ~fits[:-1] | (anchor[1:] != anchor[:-1])
            first = np.flatnonzero(new)
        if not len(first):
            return pa.record_batch([pa.array([], pa.int64())] * 7, names=SEED_NAMES)
        stop = np.flatnonzero(~fits)
        ends = np.append(first[1:], len(fits))
        gap = np.append(stop, len(fits))
        ends = np.minimum(ends, gap[np.searchsorted(gap, first)])
        past = ends + length - 1
        doc = owner[first]
        return pa.record_batch([
            batch.column("id").take(pa.array(doc)), batch.column("mark").take(pa.array(doc)),
            signed(anchor[first]), signed(span_hashes(w.hashes, first, past, FIRST)),
            signed(span_hashes(mixed(w.hashes + SECOND), first, past, SECOND)),
            pa.array(first - w.offsets[doc]), pa.array(ends - first)], names=SEED_NAMES)
    return seeds


SEED_NAMES = ["id", "mark", "anchor", "run_a", "run_b", "first", "windows"]


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each ``n`` consecutive entries, by blocks of doubling width."""
    width = 1
    while width * 2 <= n:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[:len(h) - (n - width)], h[n - width:]) if n > width else h


def _windows(length: int):
    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(texts_of(batch))
        offsets = w.offsets
        places, docs = [], []
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            for s in spans:
                places.append(np.arange(s["first"], s["first"] + s["windows"]) + offsets[i])
                docs.append(np.full(s["windows"], i))
        at, doc = np.concatenate(places), np.concatenate(docs)
        a = gram_hashes(w.hashes, length)[at]
        b = gram_hashes(mixed(w.hashes + SECOND), length, SECOND)[at]
        return pa.record_batch([
            batch.column("id").take(pa.array(doc)), batch.column("mark").take(pa.array(doc)),
            signed(a), signed(b), pa.array(at - offsets[doc])], names=["id", "mark", "a", "b", "first"])
    return windows


def _cutter():
    removed_type = pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        total, gone, kept, removed = [], [], [], []
        for t, spans in zip(texts_of(batch), batch.column("spans").to_pylist()):
            held = t.split()
            out = np.zeros(len(held) + 1, np.int64)
            for s in spans or ():
                out[s["first"]] += 1
                out[s["first"] + s["n"]] -= 1
            covered = np.cumsum(out[:-1]) > 0
            edge = np.flatnonzero(np.diff(covered, prepend=False, append=False))
            pieces, at = [], 0
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                pieces += held[at:a]
                at = b
            total.append(len(held))
            gone.append(int(covered.sum()))
            kept.append(b" ".join(pieces + held[at:]).decode())
            removed.append([{"first": a, "n": b - a} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())])
        return pa.record_batch([
            batch.column("id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
            pa.array(kept, pa.string()), pa.array(removed, removed_type)],
            names=["id", "n_words", "n_removed", "kept_text", "removed"])
    return cut
