"""Token counts against the tokenizer library, and the transducers' own laws."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from prepkit.llm import token_counts as tc
from tests.llm import cases

with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
    VOCABULARY = file.read()

ODD = ["a", "s", "'", "'s", "'re", "'LL", "l", "e", "v", "r", "t", "!", " ", "\n", "1", "9", "é", "é", "İ", "Σ",
       "ς", "日", "本", "😀", "́", "ͅ", "﻿", "​", " ", "\x85", "\x1c", "᠎", "<|endoftext|>",
       "<|startoftext|>", "<|", "</w>", "ﬁ", "K", "가", "가", "ð", "Ж", "the", "ING", "_", "-", "क़"]


LIBRARY = Tokenizer.from_str(VOCABULARY)


@pytest.fixture
def library():
    return LIBRARY


def by_library(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def counted(texts):
    return tc.Counter.of(VOCABULARY).counts(pa.array(texts, pa.string())).tolist()


def test_whole_table_equals_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r for r in tc.token_counts(docs, VOCABULARY).collect()}
    for (doc, text), n in zip(rows, by_library(library, [r.text for r in rows])):
        assert tuple(got[doc]) == (doc, len((text or "").encode()), n, n > 2048)


def test_awkward_rows(spark, library):
    rows = cases.awkward_rows()
    docs = spark.createDataFrame(rows, cases.SCHEMA).repartition(3).withColumnRenamed("n", "n_tokens")
    got = sorted(map(tuple, tc.token_counts(docs, VOCABULARY).collect()), key=str)
    want = [(r[0], len((r[1] or "").encode()), n, n > 2048) for r, n in zip(rows, by_library(library, [r[1] for r in rows]))]
    assert got == sorted(want, key=str)
    assert tc.token_counts(docs.where("false"), VOCABULARY).count() == 0


def test_random_texts(library):
    rng = random.Random(5)
    texts = ["".join(rng.choices(ODD, k=rng.randint(0, 50))) for _ in range(3000)]
    texts += ["".join(rng.choices("ab", k=rng.randint(1, 60))) for _ in range(500)] + ["a" * n for n in range(1, 150)]
    texts += ["".join(chr(rng.randrange(0x20, 0x3000)) for _ in range(20)) for _ in range(1000)]
    assert counted(texts) == by_library(library, texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=4))
def test_any_texts(texts):
    assert counted(texts) == by_library(LIBRARY, texts)


def test_pieces_and_forgetting_change_nothing(library, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("thearings'!19é", k=rng.randint(1, 12))) for _ in range(400)) for _ in range(5)]
    texts += ["x" * 3000, " " * 500 + "end", "nothing\tbut\tother\tblanks" * 50]
    want = by_library(library, texts)
    for piece, moves, words in ((50, 10, 3), (7, 1, 1), (10**6, 10**6, 10**6)):
        monkeypatch.setattr(tc, "PIECE_CHARS", piece)
        monkeypatch.setattr(tc, "MOST_TRANSITIONS", moves)
        monkeypatch.setattr(tc, "MOST_WORDS", words)
        assert tc.Counter(VOCABULARY).counts(pa.array(texts)).tolist() == want


def test_state_maps_compose_as_the_segmenter_steps(monkeypatch):
    rng = np.random.default_rng(2)
    kinds = rng.integers(0, 6, 1000).astype(np.uint8)
    state, marks = tc.BETWEEN, []
    for kind in kinds:
        marks.append(bool(tc.SEGMENTER.start[state, kind]))
        state = tc.SEGMENTER.step[state, kind]
    for chunk in (1, 3, 64, 999, 1000, 4000):
        monkeypatch.setattr(tc, "CHUNK", chunk)
        assert tc.SEGMENTER.starts(kinds).tolist() == marks


def test_other_tokenizer_files_are_refused(spark):
    spec = json.loads(VOCABULARY)
    spec["model"]["dropout"] = 0.1
    with pytest.raises(ValueError):
        tc.token_counts(spark.range(1).selectExpr("id AS doc_id", "'x' AS text"), json.dumps(spec))
