"""Substring dedup, Jaccard components and components of graphs against brute force."""

import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from prepkit.llm.components import components
from prepkit.llm.jaccard import _merge, jaccard_components
from prepkit.llm.repeats import remove_repeats
from tests.llm import cases


@pytest.fixture(scope="module")
def rows():
    return cases.awkward_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, cases.SCHEMA).repartition(5)


def test_repeats_match_brute_force(docs, rows):
    want = cases.repeats(rows)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(docs).collect())
    assert got == Counter((r[0], *want[r[0], r[1]]) for r in rows)


def test_removed_spans_are_maximal(docs):
    for r in remove_repeats(docs).collect():
        ends = [(s["first"], s["first"] + s["n"]) for s in r.removed]
        assert sum(b - a for a, b in ends) == r.n_removed
        assert all(b < c for (_, b), (c, _) in zip(ends, ends[1:]))


def test_repeats_with_other_lengths(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))) for i in range(30)]
    want = cases.repeats(rows, 6)
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=6, gram=3).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == {i: want[i, t] for i, t in rows}


def test_jaccard_matches_all_pairs(docs, rows):
    want = Counter((r[0], *w) for r, w in zip(rows, cases.jaccard(rows)))
    assert Counter(tuple(r) for r in jaccard_components(docs).collect()) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_of_chains_and_hot_shingles(spark, seed, monkeypatch):
    """Near copies of near copies, and long lists: more members than LONG_LIST."""
    import prepkit.llm.jaccard as module
    monkeypatch.setattr(module, "LONG_LIST", 5)
    rng = random.Random(seed)
    rows, common = [], cases.prose(rng, 40)
    for g in range(6):
        text = cases.prose(rng, 90) + common
        for _ in range(14):
            text = list(text)
            text[rng.randrange(len(text))] = f"w{rng.random()}"
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in
           jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {r[0]: w for r, w in zip(rows, cases.jaccard(rows))}


def test_lists_are_merged_across_batches():
    import numpy as np
    import pyarrow as pa
    rng = random.Random(5)
    entries = sorted((s, p, n, 7) for s in range(40) for p in ((0,) if s % 3 else (1, 2)) for n in
                     [rng.randrange(6) for _ in range(rng.choice((1, 1, 2, 5)))])
    for size in (1, 2, 3, 7, 1000):
        batches = [pa.record_batch([pa.array([e[i] for e in entries[a:a + size]], t) for i, t in enumerate(
            (pa.int64(), pa.int32(), pa.int64(), pa.int32()))], names=["shingle", "part", "node", "at"]) for a in range(0, len(entries), size)]
        got = Counter((r["shingle"], r["head"], r["node"], r["parted"]) for b in _merge(batches) for r in b.to_pylist())
        want = Counter()
        for s, p in {e[:2] for e in entries}:
            nodes = sorted({n for a, b, n, _ in entries if (a, b) == (s, p)})
            if p or len(nodes) > 1:
                want.update((s, nodes[0], n, p > 0) for n in nodes)
        got = Counter(set(got))
        alone = {(s, n) for s, h, n, p in got if not p and not any(o[0] == s and o[2] != n for o in got)}
        assert {k for k in got if (k[0], k[2]) not in alone} == {k for k in want}
        assert np.all([v == 1 for v in got.values()])


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_components_of_any_graph(spark, edges):
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    held = {n for a, b in edges if a != b for n in (a, b)}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((n, find(n)) for n in held)


def test_long_path(spark):
    got = components(spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(i, 0) for i in range(61)]


def test_stars_take_no_round(spark, monkeypatch):
    monkeypatch.setattr("prepkit.llm.components._large_star", None)
    edges = [(1, 5), (5, 1), (6, 1), (2, 2), (3, 9), (None, 4)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (3, 3), (5, 1), (6, 1), (9, 3)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], cases.SCHEMA)
    assert remove_repeats(none).collect() == []
    assert jaccard_components(none).collect() == []
