"""The classifier by held-out accuracy, the language model by brute force and by its gain."""

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepkit.llm import language_model, quality
from tests.llm import cases


def fold(doc, of):
    return zlib.crc32(str(doc).encode()) % of


def graded(n=600):
    """Prose, and three kinds of junk."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        w = cases.prose(rng, rng.randint(15, 80))
        good = i % 4 != 0
        if not good:
            kind = i // 4 % 3
            w = [x + "###" for x in w] if kind == 0 else [x.upper() + "!!" for x in w] if kind == 1 else [y for x in w for y in (x, "|")]
        rows.append((i, " ".join(w), 3.5, "p"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = graded()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted string")
    marks = spark.createDataFrame(labels + [(None, 1, 1), (5000, 0, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fitted(docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1), marks)
    got = quality.scored(docs, model).collect()
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if fold(r.doc_id, 3) == 1]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    loss = np.mean([-math.log(max(1e-9, r.score if truth[r.doc_id] else 1 - r.score)) for r in held])
    assert loss < 0.2


def test_classifier_on_awkward_rows(spark):
    rows = cases.awkward_rows()
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    marks = spark.createDataFrame([(r[0], i % 2) for i, r in enumerate(rows)], "doc_id long, quality int")
    model = quality.fitted(docs, marks)
    got = quality.scored(docs, model)
    assert got.columns == [*(c for c in docs.columns if c != "score"), "score", "predicted"]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(r[:2] for r in rows)
    empty = {r.score for r in got.where("text is null or text = ''").collect()}
    assert len(empty) == 1 and 0 <= empty.pop() <= 1
    assert quality.scored(docs.where("false"), model).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 1)]):
        model = quality.fitted(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert {r.score for r in quality.scored(docs, model).collect()} == {0.5}


def tokens(text):
    return [*cases.words(cases.lowered(text)), None]


@pytest.mark.parametrize("copied", [0, 5, 10**6])
def test_base_score(spark, copied, monkeypatch):
    monkeypatch.setattr(language_model, "MOST_COPIED", copied)
    monkeypatch.setattr(language_model, "STEPS", 20)  # the base score needs no good model
    rows = cases.awkward_rows()
    docs = spark.createDataFrame(rows, cases.SCHEMA).repartition(3)
    got = language_model.scored(docs, F.crc32(F.col("doc_id").cast("string")) % 10 != 0).collect()
    counts = Counter(t for r in rows if r[0] is not None and fold(r[0], 10) for t in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in rows:
        held = tokens(r[1])
        want.append((r[0], len(held), sum(t in counts for t in held), n,
                     sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in held)))
    key = lambda r: (r[0] is None, r[0] or 0, r[4])
    got.sort(key=key)
    want.sort(key=key)
    assert [tuple(r)[:4] for r in got] == [w[:4] for w in want]
    assert [r.base_score for r in got] == pytest.approx([w[4] for w in want])
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_classes_follow_their_context(monkeypatch):
    """A cycle of classes is learnt, and every context's probabilities add up to one."""
    monkeypatch.setattr(language_model, "STEPS", 500)
    k = language_model.CLASSES
    cycle = [3, 9, 4, 77, 9, 5]
    grams = Counter()
    for i in range(600):
        a, b, c = (cycle[(i + d) % len(cycle)] for d in range(3))
        grams[(a * k + b) * k + c] += 10
    keys = np.array(list(grams), np.int64)
    table = language_model.class_table(keys, np.array([grams[x] for x in grams], np.float64))
    assert np.allclose((10.0 ** table.reshape(k * k, k)).sum(axis=1), 1, atol=1e-3)
    assert (10.0 ** table[keys]).min() > 0.5


def test_model_beats_the_base_on_held_out_texts(spark, monkeypatch):
    monkeypatch.setattr(language_model, "STEPS", 500)
    rng = random.Random(6)
    after = {w: rng.sample(cases.prose(rng, 60), 3) for w in cases.prose(rng, 60)}
    rows = []
    for i in range(300):
        w = [rng.choice(list(after))]
        while len(w) < 120:
            w.append(rng.choice(after[w[-1]]) if w[-1] in after and rng.random() < 0.9 else rng.choice(list(after)))
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r for r in language_model.scored(docs, F.crc32(F.col("doc_id").cast("string")) % 10 != 0).collect() if fold(r.doc_id, 10) == 0]
    assert got and sum(r.score for r in got) > sum(r.base_score for r in got)


def test_no_training_tokens(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = sorted(map(tuple, language_model.scored(docs, F.lit(False)).collect()))
    assert [g[:4] for g in got] == [(1, 3, 0, 0), (2, 1, 0, 0)] and got[0][4] == pytest.approx(0)
    assert language_model.scored(docs.where("false"), F.lit(True)).count() == 0


def test_a_giant_labelled_text_does_not_end_the_sample(spark):
    from prepkit.llm import quality
    rows = [(i, ("good words here and there " if i % 2 else "$$$ ### !!! ") * 5) for i in range(60)] + [(1000 + i, "x y " * 50_000) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2) for d, _ in rows], "doc_id long, quality int")
    model = quality.fitted(docs, labels, most_bytes=30_000)
    scores = {r.doc_id: r.score for r in quality.scored(docs.where("doc_id < 60"), model).collect()}
    assert all((s > 0.5) == bool(d % 2) for d, s in scores.items())


def test_the_classifier_is_not_trained_on_the_driver(spark, monkeypatch):
    rows, labels = graded(60)
    docs = spark.createDataFrame([(d, t) for d, t, *_ in rows], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    none = np.zeros(1)
    monkeypatch.setattr(quality, "_train", lambda texts, y: quality.Model(none, none, none, none, (len(texts),), os.getpid()))
    model = quality.fitted(docs, marks)
    assert model.layers == (60,) and model.temperature != os.getpid()
