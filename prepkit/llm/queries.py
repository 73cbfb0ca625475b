"""The corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from prepkit.llm import language_model, quality, rules
from prepkit.llm.curriculum import planned
from prepkit.llm.decontamination import leaks
from prepkit.llm.filter_audit import filter_audit
from prepkit.llm.jaccard import jaccard_components
from prepkit.llm.licences import KNOWN, SPELLINGS, licences
from prepkit.llm.lines import kept_lines
from prepkit.llm.merkle import altered_text, manifest
from prepkit.llm.repeats import remove_repeats
from prepkit.llm.sharding import shuffled_shards
from prepkit.llm.token_counts import token_counts

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(of: int) -> Column:
    """The documents' fold: CRC-32 of the id as text, modulo ``of``."""
    return F.crc32(F.col("doc_id").cast("string")) % of


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences(table(spark, sf_dir, "documents"))
    return found.withColumn("noted", F.array_join("noted", "|"))


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(table(spark, sf_dir, "documents"), kept=["doc_id"]).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "positions")


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_lines(table(spark, sf_dir, "documents"))


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fitted(docs.where(remainder(3) != 1), table(spark, sf_dir, "labels"))
    return quality.scored(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = language_model.scored(table(spark, sf_dir, "documents"), remainder(10) != 0)
    return scores.withColumn("held_out", F.coalesce(remainder(10) == 0, F.lit(False)))


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shuffled_shards(table(spark, sf_dir, "documents"))
    return dealt.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"), altered_text(F.col("doc_id"), F.col("text")))


def counted_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return token_counts(table(spark, sf_dir, "documents"), file.read())


def filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_decontamination": decontamination,
        "op2_substring_dedup": substring_dedup,
        "op3_license_scan": licence_scan,
        "op4_source_mix": source_mix,
        "op5_line_dedup": line_dedup,
        "op6_ngram_jaccard": ngram_jaccard,
        "op7_quality_classifier": quality_classifier,
        "op8_quality_rules": quality_rules,
        "op9_lm_scoring": lm_scoring,
        "op10_sharding": sharding,
        "op11_merkle_manifest": merkle_manifest,
        "op12_token_counts": counted_tokens,
        "op13_filter_audit": filter_interactions,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": REPEATS_SQL,
        "op3_license_scan": licence_sql(),
        "op6_ngram_jaccard": JACCARD_SQL,
        "op8_quality_rules": RULES_SQL,
        "op11_merkle_manifest": merkle_sql(),
        "op13_filter_audit": AUDIT_SQL,
    }


REPEATS_SQL = f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
win AS (
  SELECT doc_id, i, list_slice(words, i, i + 49) AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)),
firsts AS (SELECT win, min(doc_id) AS first_doc FROM win GROUP BY win),
hits AS (SELECT doc_id, i FROM win JOIN firsts USING (win) WHERE first_doc < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hits),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN words
    ELSE list_filter(words, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN lists USING (doc_id)"""

JACCARD_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 4
    THEN [array_to_string(words[i:i + 3], ' ') FOR i IN range(1, len(words) - 2)]
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
  WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN links ON x = r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)"""


def licence_sql() -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def form(text: str) -> str:
        lines = f"regexp_replace(lower({text}), '(?m)^\\s*(copyright\\b|\\(c\\)|©|all rights reserved).*$', '', 'g')"
        out = f"trim(regexp_replace({lines}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
        for old, new in SPELLINGS:
            out = f"replace({out}, '{old}', '{new}')"
        return out

    known = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in KNOWN)
    return f"""
WITH known AS (
  SELECT sha256(f) AS digest, min(license) AS license
  FROM (SELECT license, {form('text')} AS f FROM (VALUES {known}) v(license, text)) GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
noted AS (
  SELECT doc_id, string_agg(DISTINCT license, '|' ORDER BY license) AS noted
  FROM (SELECT doc_id, sha256({form('line')}) AS digest FROM lines WHERE {form('line')} <> '') JOIN known USING (digest)
  GROUP BY doc_id),
whole AS (SELECT doc_id, CASE WHEN f <> '' THEN sha256(f) END AS digest FROM (SELECT doc_id, {form('text')} AS f FROM documents))
SELECT doc_id, digest, license, coalesce(noted, '') AS noted
FROM whole LEFT JOIN known USING (digest) LEFT JOIN noted USING (doc_id)"""


RULES_SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
win AS (
  SELECT doc_id, i, list_slice(words, i, i + 7) AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
twice AS (SELECT doc_id, win FROM win GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS p FROM win JOIN twice USING (doc_id, win)),
repeats AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
m AS (
  SELECT doc_id, text, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 100 > n_words * 20
    OR len(regexp_extract_all(text, '!!')) * 100 > n_words * 33
    OR word_chars < n_words * 2 OR word_chars > n_words * 25
    OR n_dup_lines * 100 > len(string_split(text, chr(10))) * 50
    OR len(regexp_extract_all(text, '\\p{{L}}')) * 100 < word_chars * 60
    OR len(regexp_extract_all(text, '\\p{{Lu}}')) > len(regexp_extract_all(text, '\\p{{Ll}}'))) AS kept
FROM f"""


def checksum(text: str) -> str:
    """CRC-32 of a short text in SQL: a step per bit; every eighth takes in the next byte."""
    steps = f"flatten([[ord(c), 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split({text}, '')])"
    fold = ("list_reduce(list_prepend(CAST(4294967295 AS BIGINT), CAST(" + steps + " AS BIGINT[])), lambda h, x: "
            "xor(xor(h, x) >> 1, (xor(h, x) & 1) * 3988292384))")
    return f"xor({fold}, 4294967295)"


def merkle_sql(heights: tuple[int, int] = (6, 4)) -> str:
    """Trees of up to 16 ** 6 documents a source and 16 ** 4 sources, level by level. A node
    alone is carried up as it is."""
    fields = " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in (
        "CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", "{text}"))
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

    def levels(name: str, group: str, height: int) -> str:
        return "".join(f"""
{name}{k + 1} AS (
  SELECT {group}, i // 16 AS i, CASE WHEN max(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE min(d) END AS d,
    (max(n) + 15) // 16 AS n
  FROM {name}{k} GROUP BY {group}, i // 16),""" for k in range(height))

    def steps(name: str, group: str, height: int) -> str:
        """Per lowest node and level the siblings on both sides."""
        return " UNION ALL ".join(f"""
  SELECT x.{group} AS g, x.i, {k} AS k, coalesce(string_agg(s.d, '' ORDER BY s.i) FILTER (s.i < x.i // {16 ** k}), '') AS l,
    coalesce(string_agg(s.d, '' ORDER BY s.i) FILTER (s.i > x.i // {16 ** k}), '') AS r
  FROM {name}0 x JOIN {name}{k} s ON s.{group} = x.{group} AND s.i // 16 = x.i // {16 ** (k + 1)} AND s.n > 1
  GROUP BY ALL""" for k in range(height))

    low, high = heights
    return f"""
WITH leaves AS (
  SELECT doc_id, coalesce('+' || source, '') AS g, sha256({fields.format(text='text')}) AS d,
    CASE WHEN {checksum('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN sha256({fields.format(text=f'translate(text, {letters})')}) END AS t
  FROM documents),
a0 AS (SELECT doc_id, g, d, t, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY g) AS n
  FROM leaves WINDOW w AS (PARTITION BY g ORDER BY doc_id NULLS FIRST, d)),{levels('a', 'g', low)}
b0 AS (SELECT 0 AS z, g AS member, d, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM a{low}),{levels('b', 'z', high)}
a_steps AS ({steps('a', 'g', low)}),
b_steps AS ({steps('b', 'z', high)}),
path AS (
  SELECT g, i, k, l, r FROM a_steps
  UNION ALL SELECT a0.g, a0.i, 100 + k, l, r FROM a0 JOIN b0 ON member = a0.g JOIN b_steps s ON s.i = b0.i),
ways AS (SELECT g, i, string_agg(l || r, '' ORDER BY k) AS siblings, list({{l: l, r: r}} ORDER BY k) AS way FROM path GROUP BY g, i),
folds AS (
  SELECT a0.doc_id, a0.d AS leaf, b0.d AS subroot, top.d AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
    CASE WHEN a0.t IS NULL THEN top.d ELSE list_reduce(
      list_prepend({{l: a0.t, r: ''}}, coalesce(way, [])), lambda x, y: {{l: sha256(y.l || x.l || y.r), r: ''}}).l END AS folded_root
  FROM a0 JOIN b0 ON member = a0.g CROSS JOIN b{high} top LEFT JOIN ways ON ways.g = a0.g AND ways.i = a0.i)
SELECT *, folded_root = root AS verified FROM folds"""


AUDIT_SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
said AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
     100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'),
     coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false)] AS fails
  FROM w LEFT JOIN said USING (doc_id)),
f AS (SELECT unnest(range(1, 6)) AS f),
o AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
masks AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, fails),
steps AS (
  SELECT part, o, s, o[s] AS f,
    sum(n) FILTER (NOT list_bool_or([fails[x] FOR x IN o[:s]])) AS kept,
    sum(n) FILTER (fails[o[s]] AND NOT coalesce(list_bool_or([fails[x] FOR x IN o[:s - 1]]), false)) AS removed,
    sum(n) FILTER (fails[o[s]] AND coalesce(list_bool_or([fails[x] FOR x IN o[:s - 1]]), false)) AS redundant,
    sum(n) FILTER (fails[o[s]] AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails,
    sum(good) FILTER (fails[o[s]] AND NOT coalesce(list_bool_or([fails[x] FOR x IN o[:s - 1]]), false)) AS good_lost,
    sum(toxic) FILTER (fails[o[s]] AND NOT coalesce(list_bool_or([fails[x] FOR x IN o[:s - 1]]), false)) AS toxic_lost
  FROM masks, o, (SELECT unnest(range(1, 6)) AS s) GROUP BY part, o, s)
SELECT part, array_to_string([substr('ABCDE', CAST(x AS INTEGER), 1) FOR x IN o], '') AS filter_order, CAST(s AS INTEGER) AS step,
  {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley
FROM steps"""
