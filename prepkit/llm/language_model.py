"""Language-model scores from a log-bilinear model over word classes.

A token's probability is that of its class in its context, times its own within the class. The
classes follow from the token's letters alone, so one pass over the corpus counts tokens and
class trigrams together. A log-bilinear network predicts the class from the two classes before:
their vectors, each through a matrix of its position, add up to a prediction whose product with
a class's vector, plus a bias, is the class's score. It is trained in numpy by noise-contrastive
estimation on the trigrams of all training tokens, a table that never exceeds CLASSES ** 3
counts. Batched matrix products then give the normalised log-probabilities of every class in
every context. Within a class tokens follow their smoothed counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepkit.llm.scratch import stored
from prepkit.llm.text import SECOND, Words, in_pieces, keyed, mixed, real_id, signed, texts_of

#: Tokens of up to SHORT bytes are dealt over SHORT_CLASSES classes by their hash, longer ones by
#: their last two bytes over the others; the last class is the end of a text.
CLASSES, SHORT, SHORT_CLASSES = 128, 3, 48
END = CLASSES - 1
SMOOTH = 0.1
SIZE, NOISE, BATCH, STEPS, RATE, SEED = 32, 10, 4096, 1500, 0.01, 11
#: Counts of so many tokens at most, the most frequent ones, are copied to every executor;
#: those of all others are joined.
MOST_COPIED = 300_000


def scored(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: ``doc_id``, ``n_tokens`` (words with A-Z lowered, and one end), ``n_known``
    (tokens that training holds), ``train_tokens`` (all training tokens), ``base_score`` (log10
    probability under smoothed token counts) and ``score`` (that of the model).

    ``train`` says of which rows the counts and the model are learnt; NULL means not. NULL and
    empty texts consist of the end alone. Equal rows get equal results. Without training
    tokens every token is unknown and all classes are as likely. Other columns are not read.
    """
    base = keyed(docs, doc_id, text, F.coalesce(train, F.lit(False)).alias("__train"))
    counts = stored(base.where("__train").select("text").mapInArrow(in_pieces(_count, 4_000_000), COUNT)
                    .groupBy("trigram", "key").agg(F.sum("n").alias("n"), F.first("class").alias("class")), "counts")
    tokens = counts.where("not trigram")
    totals = tokens.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()
    n = np.zeros(CLASSES)
    kinds = np.zeros(CLASSES)
    for r in totals:
        n[r["class"]], kinds[r["class"]] = r["n"], r["kinds"]
    # As Arrow: rows of Python numbers would take thirty times the room.
    trigrams = counts.where("trigram").select("key", "n").toArrow()
    table = class_table(trigrams["key"].to_numpy(), trigrams["n"].to_numpy().astype(np.float64))
    del trigrams
    copied = _most_frequent(tokens)
    model = base.sparkSession.sparkContext.broadcast((table, np.log10(n + SMOOTH * (kinds + 1)), *copied))

    # Main rows carry what the copied counts give; the others wait for theirs.
    parts = base.select("id", "mark", "text").mapInArrow(in_pieces(_scorer(model), 4_000_000), PART)
    rare = tokens.where(F.col("n") < copied[2]).select("key", F.col("n").alias("count"))
    joined = parts.join(rare, "key", "left")
    own = F.col("times") > 0
    count = F.coalesce("count", F.lit(0))
    sums = joined.groupBy("id", "mark").agg(
        F.count_if(~own).alias("rows"), F.max("n_tokens").alias("n_tokens"),
        F.sum(F.when(~own, F.col("n_known")).otherwise(F.when(count > 0, F.col("times")).otherwise(0))).alias("n_known"),
        F.sum(F.when(~own, F.col("counts")).otherwise(F.col("times") * F.log10(count + SMOOTH))).alias("counts"),
        F.sum("classes").alias("classes"))
    train_tokens, total = int(n.sum()), float(n.sum() + SMOOTH * (kinds.sum() + 1))
    # Equal rows have been summed together.
    each = sums.withColumn("__row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return each.select(
        real_id().alias(doc_id), "n_tokens", (F.col("n_known") / F.col("rows")).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("counts") / F.col("rows") - F.col("n_tokens") * float(np.log10(total))).alias("base_score"),
        ((F.col("counts") + F.col("classes")) / F.col("rows")).alias("score"))


COUNT = "trigram boolean, key long, n long, class int"
PART = "key long, id long, mark long, times long, n_tokens long, n_known long, counts double, classes double"


class _Tokens:
    """The tokens of a piece of texts in a row, each text with its end: hashes, classes, texts."""

    def __init__(self, texts: list[bytes]):
        w = Words(texts, lower=True)
        size = w.ends - w.starts
        tail = mixed(LOWER[w.bytes[w.ends - 1]] * np.uint64(256) + LOWER[w.bytes[np.maximum(w.ends - 2, w.starts)]] + SECOND)
        kind = np.where(size <= SHORT, w.hashes % np.uint64(SHORT_CLASSES),
                        np.uint64(SHORT_CLASSES) + tail % np.uint64(END - SHORT_CLASSES)).astype(np.int64)
        places = w.offsets[1:]
        self.hashes = np.insert(w.hashes, places, END_HASH)
        self.classes = np.insert(kind, places, END)
        self.counts = w.counts + 1
        self.owner = np.repeat(np.arange(len(texts)), self.counts)
        # The two classes before; a text begins after ends.
        first = np.concatenate([[0], np.cumsum(self.counts)])[:-1]
        before = np.full((2, len(self.classes)), END)
        before[0, 1:], before[1, 2:] = self.classes[:-1], self.classes[:-2]
        before[0, first] = END
        before[1, first] = END
        second = first[self.counts > 1] + 1
        before[1, second] = END
        self.trigrams = (before[1] * CLASSES + before[0]) * CLASSES + self.classes


END_HASH = np.uint64(0xE7037ED1A0B428DB)
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += np.uint64(32)


def _count(batch: pa.RecordBatch) -> pa.RecordBatch:
    t = _Tokens(texts_of(batch))
    keys, first, n = np.unique(t.hashes, return_index=True, return_counts=True)
    grams, times = np.unique(t.trigrams, return_counts=True)
    return pa.record_batch([
        pa.array(np.repeat([False, True], [len(keys), len(grams)])), pa.concat_arrays([signed(keys), pa.array(grams)]),
        pa.array(np.concatenate([n, times])), pa.array(np.concatenate([t.classes[first], np.zeros(len(grams), np.int64)]).astype(np.int32))],
        names=["trigram", "key", "n", "class"])


def _most_frequent(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes, sorted, and counts of the most frequent tokens, and the count that they begin at."""
    by_size = {r["size"]: r["count"] for r in tokens.groupBy(F.floor(F.log2("n") * 8).alias("size")).count().collect()}
    held, least = 0, None
    for size in sorted(by_size, reverse=True):
        held += by_size[size]
        if held > MOST_COPIED:
            break
        least = size
    if least is None:
        return np.empty(0, np.uint64), np.empty(0), 2**62
    found = tokens.where(F.floor(F.log2("n") * 8) >= least).select("key", "n").toArrow()
    keys, n = found["key"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order].astype(np.float64), int(n.min())


def _scorer(model):
    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        table, class_totals, known, n, _ = model.value
        t = _Tokens(texts_of(batch))
        rows = batch.num_rows
        if len(known):
            at = np.minimum(np.searchsorted(known, t.hashes), len(known) - 1)
            hit = known[at] == t.hashes
            count = np.where(hit, n[at], 0)
        else:
            hit, count = np.zeros(len(t.hashes), bool), np.zeros(len(t.hashes))
        known_here = np.bincount(t.owner, hit, rows)
        counts = np.bincount(t.owner, np.where(hit, np.log10(count + SMOOTH), 0.0), rows)
        classes = np.bincount(t.owner, table[t.trigrams] - class_totals[t.classes], rows)
        # Tokens that wait: once per text, with how often.
        owner, hashes = t.owner[~hit], t.hashes[~hit]
        order = np.lexsort((hashes, owner))
        owner, hashes = owner[order], hashes[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
        begin = np.flatnonzero(new)
        times = np.diff(np.append(begin, len(owner)))
        back = np.concatenate([np.arange(rows), owner[begin]])
        late = np.zeros(len(begin), np.int64)
        marks = batch.column("mark")
        return pa.record_batch([
            pa.concat_arrays([marks, signed(hashes[begin])]), batch.column("id").take(pa.array(back)), marks.take(pa.array(back)),
            pa.array(np.concatenate([np.zeros(rows, np.int64), times])),
            pa.array(np.concatenate([t.counts, late])), pa.array(np.concatenate([known_here.astype(np.int64), late])),
            pa.array(np.concatenate([counts, late])), pa.array(np.concatenate([classes, late]))],
            names=["key", "id", "mark", "times", "n_tokens", "n_known", "counts", "classes"])
    return score


def class_table(trigrams: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 P(class | two classes before) at ``(older * CLASSES + newer) * CLASSES + class``."""
    if not len(n):
        return np.full(CLASSES**3, -np.log10(CLASSES), np.float32)
    vectors, bias, newer, older = train(trigrams, n)
    sums = (vectors @ older)[:, None, :] + (vectors @ newer)[None, :, :]
    table = np.empty((CLASSES, CLASSES, CLASSES), np.float32)
    for k in range(CLASSES):
        s = sums[k] @ vectors.T + bias
        top = s.max(axis=1, keepdims=True)
        table[k] = (s - top - np.log(np.exp(s - top).sum(axis=1, keepdims=True))) / np.log(10)
    return table.reshape(-1)


def train(trigrams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Noise-contrastive estimation with Adam: tell the class that followed from classes drawn
    by their frequency. Trigrams are drawn in proportion to their counts in the corpus."""
    rng = np.random.default_rng(SEED)
    order = np.argsort(trigrams)
    trigrams, n = trigrams[order], n[order]
    share = np.bincount(trigrams % CLASSES, n, CLASSES) + 1.0
    share /= share.sum()
    noise_log = np.log(share * NOISE)
    upto = np.cumsum(n)
    vectors = rng.normal(0, 0.1, (CLASSES, SIZE))
    params = [vectors, np.log(share), np.eye(SIZE) * 0.5, np.eye(SIZE) * 0.25]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    noise_upto = np.cumsum(share)
    for step in range(1, STEPS + 1):
        vectors, bias, newer, older = params
        drawn = trigrams[np.searchsorted(upto, rng.random(BATCH) * upto[-1], side="right").clip(max=len(upto) - 1)]
        b, a, c = drawn // CLASSES**2, drawn // CLASSES % CLASSES, drawn % CLASSES
        guess = vectors[a] @ newer + vectors[b] @ older
        # Noise is drawn once a step and shared by the batch, so that scores are one matrix product.
        noise = np.searchsorted(noise_upto, rng.random(NOISE) * noise_upto[-1]).clip(max=CLASSES - 1)
        real = np.einsum("ij,ij->i", guess, vectors[c]) + bias[c] - noise_log[c]
        fake = guess @ vectors[noise].T + bias[noise] - noise_log[noise]
        real_slope = -1 / (1 + np.exp(np.clip(real, -30, 30))) / BATCH
        fake_slope = 1 / (1 + np.exp(-np.clip(fake, -30, 30))) / BATCH
        to_guess = real_slope[:, None] * vectors[c] + fake_slope @ vectors[noise]
        slopes = [np.zeros_like(p) for p in params]
        onto = np.zeros((CLASSES, BATCH))
        onto[c, np.arange(BATCH)] = real_slope
        np.add.at(onto, noise, fake_slope.T)
        slopes[0] += onto @ guess
        slopes[1] += onto.sum(axis=1)
        slopes[2] += vectors[a].T @ to_guess
        slopes[3] += vectors[b].T @ to_guess
        for old, matrix in ((a, newer), (b, older)):
            picked = np.zeros((CLASSES, BATCH))
            picked[old, np.arange(BATCH)] = 1
            slopes[0] += picked @ (to_guess @ matrix.T)
        rate = RATE * (1 - step / (STEPS + 1))
        for p, g, m, v in zip(params, slopes, mean, square):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return tuple(params)
