"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Random indexing gives every unit a sparse random index vector; a unit's context vector is the
sum of the index vectors of the units around it. Units are the frequent words of the training
texts; all other words stand for their shape (kind of first and last characters, capitals,
length). A document is the mean of its words' context vectors, the mean over its distinct words,
and two numbers on length and repetition. A two-layer network reads that, and a temperature
fitted on documents kept apart turns its output into a probability.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepkit.llm.text import FIRST, PIECE_BYTES, SECOND, Words, in_pieces, mixed, texts_of

#: The classifier is fitted on a sample of labelled rows: so many at most, the ones with the
#: smallest seeded hash, if their texts fit into what is left of so many bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 6_000, 16_000_000
SIZE, NONZERO, REACH, UNITS = 64, 4, 2, 20_000
HIDDEN, EPOCHS, RATE, BATCH, DECAY, SEED = 32, 60, 2e-3, 64, 1e-4, 5
#: Neighbours counted at a time.
AT_ONCE = 500_000
#: One training document in so many is kept apart for the temperature.
CALIBRATION = 5


@dataclass
class Model:
    units: np.ndarray  # hashes of units, sorted
    vectors: np.ndarray  # their context vectors
    centre: np.ndarray
    scale: np.ndarray
    layers: tuple
    temperature: float

    def inputs(self, texts: list[bytes]) -> np.ndarray:
        return (_pooled(texts, self.units, self.vectors) - self.centre) / self.scale

    def score(self, texts: list[bytes]) -> np.ndarray:
        logit = _forward(self.inputs(texts), self.layers)[1] / self.temperature
        return (1 / (1 + np.exp(-np.clip(logit, -30, 30)))).astype(np.float64)


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows and columns, and ``score`` (0 to 1, how likely the quality label is 1) and
    ``predicted`` (1 from 0.5 on). NULL texts score as empty ones, which have a score too; only
    the text is read. Columns of the input with these names are replaced."""
    held = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = held.columns

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = shared.value.score(texts_of(batch, text))
        return pa.record_batch([*(batch.column(c) for c in names), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                               names=[*names, "score", "predicted"])

    schema = held.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema
    return held.mapInArrow(in_pieces(score, name=text), schema)


def fitted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
           label: str = "quality", rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on documents that ``labels`` marks 0 or 1. Rows without an id, a text or a label are
    not learnt from; an id labelled twice counts with its smaller label. An id whose texts do not
    fit into what is left of the bytes is passed over. Without both labels every document scores
    one half."""
    marked = (labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
              .groupBy(F.col(doc_id).alias("id")).agg(F.min(label).alias("label"))
              .orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(rows))
    found = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(marked), "id")
    place = F.xxhash64("id", F.lit(SEED))
    sizes = found.groupBy("id", place.alias("place")).agg(F.sum(F.octet_length("text")).alias("size")).collect()
    chosen, held = [], 0
    for r in sorted(sizes, key=lambda r: (r["place"], r["id"])):  # what does not fit is passed over
        if held + r["size"] <= most_bytes:
            chosen.append((r["id"],))
            held += r["size"]
    keep = docs.sparkSession.createDataFrame(chosen, "id long")
    sample = found.join(F.broadcast(keep), "id", "left_semi").select(
        place.alias("place"), F.col("text").cast("binary").alias("text"), "label")
    # Trained where there is memory for it, in one task, as the sample is bounded.
    made = sample.repartition(1).mapInArrow(_trained, "fields binary").collect()
    return Model(*pickle.loads(made[0]["fields"])) if made else _train([], np.zeros(0, np.float32))


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fields of the model, pickled, of the only partition's rows; none without rows."""
    batches = list(batches)
    if not any(b.num_rows for b in batches):
        return
    sample = pa.Table.from_batches(batches).sort_by([("place", "ascending"), ("text", "ascending"), ("label", "ascending")])
    del batches
    model = _train(sample["text"].to_pylist(), sample["label"].to_numpy().astype(np.float32))
    values = [getattr(model, f.name) for f in fields(Model)]
    yield pa.record_batch([pa.array([pickle.dumps(values)], pa.binary())], names=["fields"])


def _units(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and the hash of its shape."""
    kind, size = BYTE_KIND[w.bytes].astype(np.uint64), w.ends - w.starts
    first, last, before = kind[w.starts], kind[w.ends - 1], kind[np.maximum(w.ends - 2, w.starts)]
    capitals = np.concatenate([[0], np.cumsum(kind == 1)])
    loud = (capitals[w.ends] - capitals[w.starts]) * 2 > size
    length = np.minimum(np.log2(size), 5).astype(np.uint64)
    shape = (((first * np.uint64(8) + last) * np.uint64(8) + before) * np.uint64(8) + length) * np.uint64(2) + loud.astype(np.uint64)
    return w.hashes, mixed(shape + SECOND)


#: Kinds of bytes: 0 other, 1 capitals, 2 small letters, 3 digits, 4 marks of a sentence, 5 other
#: printable ASCII, 6 parts of a character beyond ASCII.
BYTE_KIND = np.zeros(256, np.uint8)
BYTE_KIND[33:127], BYTE_KIND[128:] = 5, 6
BYTE_KIND[65:91], BYTE_KIND[97:123], BYTE_KIND[48:58] = 1, 2, 3
BYTE_KIND[list(b".,;:'\"?!-()")] = 4


def _ids(word: np.ndarray, shape: np.ndarray, units: np.ndarray) -> np.ndarray:
    """The unit of each word: itself, else its shape, else the last one, a vector of zeros."""
    at = np.minimum(np.searchsorted(units, word), len(units) - 1)
    other = units[at] != word
    odd = np.minimum(np.searchsorted(units, shape[other]), len(units) - 1)
    at[other] = np.where(units[odd] == shape[other], odd, len(units))
    return at


def _pooled(texts: list[bytes], units: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    w = Words(texts)
    out = np.zeros((len(texts), 2 * vectors.shape[1] + 2), np.float32)
    if not len(w.hashes):
        return out
    ids, owner, some = _ids(*_units(w), units), w.owner, w.counts > 0
    starts = w.offsets[:-1][some]
    out[some, :SIZE] = np.add.reduceat(vectors[ids], starts) / w.counts[some, None]
    # A word again in the same text: sort words within texts and keep the first of equals.
    order = np.lexsort((w.hashes, owner))
    new = np.ones(len(order), bool)
    new[1:] = (w.hashes[order][1:] != w.hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    once = order[new]
    distinct = np.bincount(owner[once], minlength=len(texts))
    begin = np.concatenate([[0], np.cumsum(distinct)])[:-1][some]
    out[some, SIZE:2 * SIZE] = np.add.reduceat(vectors[ids[once]], begin) / distinct[some, None]
    out[:, 2 * SIZE] = np.log1p(w.counts)
    out[some, 2 * SIZE + 1] = distinct[some] / w.counts[some]
    return out


def _context_vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Random indexing over the training texts: units, and their context vectors of length one."""
    parts = [(*_units(w), w.counts) for w in map(Words, _pieces(texts))]
    word, shape, counts = (np.concatenate(x) for x in zip(*parts))
    del parts
    seen, count = np.unique(word, return_counts=True)
    frequent = seen[np.argsort(-count, kind="stable")[:UNITS]]
    units = np.unique(np.concatenate([frequent[np.isin(frequent, seen[count >= 5])], shape, [np.uint64(0)]]))
    ids, owner = _ids(word, shape, units), np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    del word, shape
    keys = mixed(units[:, None] + np.arange(1, NONZERO + 1, dtype=np.uint64) * FIRST)
    place = (keys % np.uint64(SIZE)).astype(np.int64)
    sign = np.where(keys >> np.uint64(63), 1.0, -1.0)
    flat = np.zeros(len(units) * SIZE)
    for step in range(1, REACH + 1):
        for at in range(0, len(ids) - step, AT_ONCE):
            near, far = ids[at:at + AT_ONCE][:len(ids) - step - at], ids[at + step:at + step + AT_ONCE]
            same = owner[at:at + AT_ONCE][:len(near)] == owner[at + step:at + step + AT_ONCE]
            for a, b in ((near[same], far[same]), (far[same], near[same])):
                for k in range(NONZERO):
                    flat += np.bincount(a * SIZE + place[b, k], sign[b, k], len(flat))
    vectors = flat.reshape(-1, SIZE)
    # A unit's own index vector tells it from others in the same surroundings.
    own = np.zeros_like(vectors)
    for k in range(NONZERO):
        np.add.at(own, (np.arange(len(units)), place[:, k]), sign[:, k])
    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9) + own / np.sqrt(NONZERO)
    return units, np.vstack([vectors, np.zeros((1, SIZE))]).astype(np.float32)


def _pieces(texts: list[bytes]):
    """The texts in pieces of bounded size; a longer text is a piece alone."""
    piece, size = [], 0
    for t in texts:
        if piece and size + len(t) > PIECE_BYTES:
            yield piece
            piece, size = [], 0
        piece.append(t)
        size += len(t)
    if piece:
        yield piece


def _forward(x: np.ndarray, layers: tuple) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    hidden = np.tanh(x @ w1 + b1)
    return hidden, hidden @ w2 + b2


def _train(texts: list[bytes], y: np.ndarray) -> Model:
    if len(set(y.tolist())) < 2:
        none = np.zeros(2 * SIZE + 2, np.float32)
        zero = (np.zeros((len(none), 1), np.float32), np.zeros(1), np.zeros(1, np.float32), 0.0)
        return Model(np.zeros(1, np.uint64), np.zeros((2, SIZE), np.float32), none, none + 1, zero, 1.0)
    units, vectors = _context_vectors(texts)
    x = np.vstack([_pooled(p, units, vectors) for p in _pieces(texts)])
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - centre) / scale
    apart = np.arange(len(y)) % CALIBRATION == 0
    layers = _descend(x[~apart], y[~apart])
    logit, held = _forward(x[apart], layers)[1], y[apart]
    losses = {t: np.mean(np.logaddexp(0, np.where(held > 0, -logit, logit) / t)) for t in np.geomspace(0.25, 8, 60)}
    return Model(units, vectors, centre, scale, layers, min(losses, key=losses.get))


def _descend(x: np.ndarray, y: np.ndarray) -> tuple:
    """Adam on the cross entropy of a tanh layer and a logistic output."""
    rng = np.random.default_rng(SEED)
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32),
              rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN).astype(np.float32), np.zeros(1, np.float32)]
    mean, square, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for rows in np.array_split(order, max(1, len(y) // BATCH)):
            hidden, logit = _forward(x[rows], layers)
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[rows]) / len(rows)
            back = np.outer(error, layers[2]) * (1 - hidden**2)
            slopes = [x[rows].T @ back + DECAY * layers[0], back.sum(axis=0), hidden.T @ error + DECAY * layers[2], np.array([error.sum()])]
            step += 1
            for p, g, m, v in zip(layers, slopes, mean, square):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return tuple(layers)
