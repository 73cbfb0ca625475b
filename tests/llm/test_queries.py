"""The registered corpus queries: against SQL where there is some, and the pipeline's stages."""

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from prepkit.llm import queries
from tests.test_oracle import SF_DIR, TABLES, rows_of


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = queries.queries()[name](spark, SF_DIR)
    columns = sorted(got.columns)
    want = duck.sql(queries.oracle_sql()[name])
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert rows_of(columns, [tuple(r) for r in got.select(*columns).collect()]) == rows_of(
        columns, [tuple(r[i] for i in order) for r in want.fetchall()])


@pytest.mark.parametrize("name", [n for n in queries.queries() if n not in queries.oracle_sql() and n != "pipeline"])
def test_query_has_every_document(spark, name):
    got = queries.queries()[name](spark, SF_DIR)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    if name == "op1_decontamination":
        assert 0 < got.count() < docs.count()
    else:
        assert Counter(r[0] for r in got.select("doc_id").collect()) == Counter(r[0] for r in docs.select("doc_id").collect())


def test_pipeline_stages_keep_their_word(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    held = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, held[-1], SF_DIR).write.parquet(str(tmp_path / str(i)))
        held.append(spark.read.parquet(str(tmp_path / str(i))))
    for before, after in zip(held[:-2], held[1:-1]):
        assert after.columns == before.columns and after.dtypes == before.dtypes
    ids = [Counter(r[0] for r in d.select("doc_id").collect()) for d in held]
    quality_kept, one_each, clean, mix, shards = ids[1:]
    assert set(quality_kept) < set(ids[0]) and set(one_each) <= set(quality_kept) and set(clean) <= set(one_each)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in quality_kept for d in good) >= 0.95 * len(good)
    assert set(mix) <= set(clean) and max(mix.values()) <= 3 and shards == mix
    assert set(held[-1].columns) == {*docs.columns, "shard", "slot"}


def test_pipeline_takes_five_words_and_80_percent(spark):
    """Two of 100 words changed: 86 of 106 five-word shingles, but 89 of 105 of four words. With
    three changed, 81 of 111."""
    base = [f"w{i}" for i in range(100)]
    changed = lambda places: " ".join(f"x{w}" if i in places else w for i, w in enumerate(base))
    docs = spark.createDataFrame([(1, " ".join(base)), (2, changed((30, 60))), (3, changed((10, 50, 80)))], "doc_id long, text string")
    docs = docs.selectExpr("doc_id", "text", "'en' AS lang", "'web' AS source", "1L AS n_chars")
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, SF_DIR).collect()) == [1, 3]


def test_pipeline_with_awkward_rows(spark):
    from tests.llm import cases
    rows = [(i, t, lang, s, n) for i, t, lang, s, n, *_ in cases.awkward_rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            got = stage(spark, table, SF_DIR)
            assert got.count() <= 3 * len(rows) and set(table.columns) <= set(got.columns)
