"""Decontamination, licences, rules, line dedup, mixing and sharding on awkward tables."""

import random
import time
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from prepkit.llm import curriculum, decontamination, licences, lines, queries, rules, sharding
from tests.llm import cases


@pytest.fixture(scope="module")
def rows():
    return cases.awkward_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, cases.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], cases.SCHEMA)


# --- decontamination

ITEM = "Which of the seven bridges did the walker cross twice, and on which day of the week was that noted down?"


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(1, len(out) - 1)
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = "~"
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, "^")
    return "".join(out)


def leak_table(spark):
    rng = random.Random(9)
    items = [(1, ITEM), (2, " ".join(cases.prose(rng, 30))), (3, " ".join(cases.prose(rng, 90))), (4, "short"),
             (None, None), (5, ""), (None, " ".join(cases.prose(rng, 25)))]
    docs = [(0, None), (1, ""), (2, " ".join(cases.prose(rng, 400))), (None, "x " + ITEM)]
    for item, text in items[:3]:
        for n in (0, 1, 2, 3, 5, 7, 9, 12):
            before, after = cases.prose(rng, rng.randint(0, 50)), cases.prose(rng, rng.randint(0, 50))
            docs.append((len(docs), " ".join(before) + " " + edited(rng, text.upper(), n) + "  \n" + " ".join(after)))
    docs += [(90, ITEM), (90, ITEM), (91, ITEM[:60]), (92, ITEM + " " + items[1][1]), (93, " ".join(["of the"] * 500))]
    return (docs, items, spark.createDataFrame([(i, t, 1, "e") for i, t in docs], "doc_id long, text string, edits int, first string"),
            spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, n_chars int"))


def expected_leaks(docs, items):
    want = Counter()
    for d, t in docs:
        for i, x in items:
            text, item = decontamination.plain(t), decontamination.plain(x)
            if len(item) >= decontamination.Q and text:
                budget = min(int(len(item) * decontamination.EDITS), (len(item) - decontamination.Q) // decontamination.Q)
                got = cases.edit_distance_within(item, text)
                if got <= budget:
                    want[d, i, got] += 1
    return want


def test_leaks_are_those_of_the_full_alignment(spark):
    docs, items, table, benchmark = leak_table(spark)
    want = expected_leaks(docs, items)
    found = decontamination.leaks(table, benchmark).collect()
    assert Counter((r.doc_id, r.item_id, r.edits) for r in found) == want
    texts = dict(docs)
    for r in found:
        if r.item_id == 1:
            part = decontamination.plain(texts[r.doc_id])[r.first:r.first + r.n_chars]
            assert cases.edit_distance_within(decontamination.plain(ITEM), part) == r.edits
    left = Counter(r.doc_id for r in decontamination.without_leaks(table, benchmark).collect())
    dirty = {d for d, *_ in want}
    assert left == Counter(d for d, _ in docs if d not in dirty)


def test_benchmark_blocks_give_the_same(spark):
    docs, items, table, benchmark = leak_table(spark)
    whole = Counter(map(tuple, decontamination.leaks(table, benchmark).collect()))
    assert Counter(map(tuple, decontamination.leaks(table, benchmark, block_bytes=150).collect())) == whole


def test_no_documents_or_no_items(spark, none):
    _, _, table, benchmark = leak_table(spark)
    assert decontamination.leaks(none, benchmark).count() == 0
    assert decontamination.leaks(table, benchmark.where("false")).count() == 0
    assert decontamination.without_leaks(table, benchmark.where("false")).count() == table.count()


# --- licences

def test_licences(spark):
    noted = "Code by us\nReleased under  the mit LICENCE.\n\nLicensed under CC BY-NC 4.0"
    table = spark.createDataFrame([
        (1, "Copyright (c) 2020 Someone\n" + licences.MIT.upper().replace("SUBLICENSE", "sub-licence"), 1), (2, noted, 1), (3, None, 1),
        (4, "", 1), (5, "?!", 1), (6, licences.MIT + " and more", 1), (None, noted, 1), (2, noted, 1)],
        "doc_id long, text string, license int")
    got = sorted(((r.doc_id or -1, r.license, tuple(r.noted), r.digest is None) for r in licences.licences(table).collect()), key=str)
    two = ("CC-BY-NC-4.0", "MIT")
    assert got == sorted([(1, "MIT", (), False), (2, None, two, False), (3, None, (), True), (4, None, (), True), (5, None, (), True),
                          (6, None, (), False), (-1, None, two, False), (2, None, two, False)], key=str)


def test_usual_licences_are_known(spark):
    from prepkit.llm import known_licences as known
    by = "Copyright (c) 2020 Some One"
    bsd = [t for name, t in known.TEXTS if name == "BSD-3-Clause"]
    whole = [("MIT", f"{by} {licences.MIT}".replace("\n", " ")), ("MIT", f"MIT License {by} {licences.MIT}".replace("\n", " ")),
             ("MIT", f"{by}. All rights reserved. " + licences.MIT.replace("\n", " ")), ("BSD-3-Clause", f"{by}\nAll rights reserved.\n\n{bsd[0]}"),
             ("BSD-3-Clause", bsd[0].replace(" ", "\n")), ("Unlicense", known.UNLICENSE), ("MPL-2.0", known.MPL_HEADER.format(scheme="http")),
             ("GPL-2.0", f"{by}\n\n" + known.GNU_HEADER.format(what="program", kind="", version="2"))]
    for name, held in (("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("Apache-2.0", "Apache-2.0"), ("MPL-2.0", "MPL-2.0"), ("LGPL-3.0", "LGPL-3")):
        if (path := Path("/usr/share/common-licenses", held)).exists():
            whole.append((name, path.read_text()))
    docs = [(i, t) for i, (_, t) in enumerate(whole)] + [(100, "code\nLicensed under the BSD 3-Clause License.\n// SPDX-License-Identifier: GPL-2.0-or-later")]
    got = {r.doc_id: r for r in licences.licences(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[i].license for i in range(len(whole))] == [name for name, _ in whole]
    assert got[100].license is None and got[100].noted == ["BSD-3-Clause", "GPL-2.0"]


def test_licences_of_no_documents(none):
    assert licences.licences(none).count() == 0


# --- rules

def test_rule_counts(docs, rows):
    want = Counter((r[0], *cases.rule_counts(r[1])) for r in rows)
    got = rules.measured(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert Counter(map(tuple, got)) == want


def test_verdict_does_not_hang_on_the_order(docs, rows):
    names = list(rules.rules(F.lit("")))
    verdicts = []
    for order in (names, names[::-1], None):
        got = rules.judged(docs, order=order).select("doc_id", "kept", "base_failed", F.col("failed_rule").isNull()).collect()
        assert all(r[1] == (not r[2] and r[3]) for r in got)
        verdicts.append(Counter(map(tuple, got)))
    assert verdicts[0] == verdicts[1] == verdicts[2]


def test_rules_are_ordered_by_rejections_per_cost(spark):
    sample = spark.range(1000)
    order = rules.ordered(sample, {"none": F.col("id") < 0, "all": F.col("id") >= 0})
    assert order == ["all", "none"]


def test_rules_of_no_documents(none):
    assert rules.judged(none).count() == 0


# --- line dedup

def line_table():
    rng = random.Random(4)
    base = [" ".join(cases.prose(rng, rng.randint(4, 40))) for _ in range(25)]
    docs = [(None, "\n".join(base[:3])), (0, None), (1, ""), (2, " \n\t"), (3, "tiny\ntiny\n\nother"), (4, base[20] * 40)]
    for i in range(5, 40):
        held = rng.sample(base, 4) + [" ".join(cases.prose(rng, 20))]
        held = [x if rng.random() < 0.6 else edited(rng, x, 1) for x in held]
        docs.append((i, "\n".join(held)))
    return docs + [docs[10], docs[10]]


def similar(a, b):
    x, y = ({s[i:i + lines.SHINGLE] for i in range(len(s) - lines.SHINGLE + 1)} for s in (a, b))
    return a == b or bool(x and y) and 100 * len(x & y) >= lines.PERCENT * len(x | y)


def test_lines_kept(spark):
    """Banding may miss a pair, so lines are held against all pairs by how many they are; what
    goes is always like an earlier line that its component links."""
    docs = line_table()
    table = spark.createDataFrame([(i, t, 5, "k") for i, t in docs], "doc_id long, text string, n_lines int, line string")
    got = {}
    for r in lines.kept_lines(table).collect():
        assert got.setdefault(r.doc_id, (r.n_lines, r.kept)) == (r.n_lines, r.kept)
    placed = sorted({(2**63 if i is None else i, k, x.strip(" \t")) for i, t in docs for k, x in enumerate((t or "").split("\n")) if x.strip(" \t")})
    root = list(range(len(placed)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in range(len(placed)):
        for b in range(a):
            if similar(placed[a][2], placed[b][2]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = defaultdict(set)
    for n, (i, k, _) in enumerate(placed):
        if find(n) == n:
            want[i].add(k)
    for i, t in docs:
        n, kept = got[i]
        assert n == len([x for x in (t or "").split("\n") if x.strip(" \t")])
        assert set(kept) >= want[2**63 if i is None else i]
    extra = sum(len(got[i][1]) for i in dict(docs)) - sum(map(len, want.values()))
    assert extra <= 0.02 * len(placed)


def test_lines_are_cut_once_for_what_stays(spark, capsys):
    docs = [(1, "one line of it\n \none line of it"), (2, "one line of it\nmore"), (2, "one line of it\nmore"), (None, "more\nmost\n"), (3, None)]
    kept = lines.kept_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    kept.explain()
    assert capsys.readouterr().out.count("Generate posexplode") == 1
    assert Counter((r.doc_id, r.n_lines, tuple(r.kept)) for r in kept.collect()) == Counter(
        {(1, 2, (0,)): 1, (2, 2, (1,)): 2, (None, 2, (1,)): 1, (3, 0, ()): 1})


@pytest.mark.parametrize("leaders", [None, 1])
def test_lines_like_a_matched_line(spark, monkeypatch, leaders):
    """Chains L ~ A ~ B with L and B apart, and buckets of several such lines."""
    if leaders:
        monkeypatch.setattr(lines, "LEADERS", leaders)
    rng = random.Random(12)
    chains = []
    for _ in range(100):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(148)]
        chain = ["".join(["s", *base, "t"])]
        for at in (40, 100):
            chain.append(chain[-1][:at] + "#" + chain[-1][at + 1:])
        assert similar(chain[0], chain[1]) and similar(chain[1], chain[2]) and not similar(chain[0], chain[2])
        chains.append(chain)
    docs = [(i, "\n".join(chain)) for i, chain in enumerate(chains)]
    got = {r.doc_id: r.kept for r in lines.kept_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: [0] for i, _ in docs}


def test_firsts_from_points_on():
    """Against a search over all hashes, with lines that leave most parts of the range empty."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc é") for _ in range(n)) for n in (8, 9, 12, 40, 600)] + ["a" * 50]
    h, owner = lines._shingles(texts)
    sizes = lines._sizes(h, owner, len(texts))
    for points in (lines.ROWS, lines.POINTS):
        got = lines._firsts(h, owner, len(texts), points)
        for t, text in enumerate(texts):
            own = sorted(set(h[owner == t].tolist()))
            assert len(own) == sizes[t] == len({text[i:i + lines.SHINGLE] for i in range(len(text) - lines.SHINGLE + 1)})
            for k in range(points):
                assert got[t, k] == min(own, key=lambda v: (v - k * 2**64 // points) % 2**64)


def test_lines_of_few_shingles(spark):
    """Pairs of 12 to 90 characters just at the similarity or above: few may be missed."""
    rng = random.Random(4)
    pairs = []
    while len(pairs) < 300:
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(12, 90)))
        other = rng.choice((line + rng.choice("ABC"), rng.choice("ABC") + line[1:], line[:-1] + "XY"))
        if similar(line, other):
            pairs.append(line + "\n" + other)
    got = {r.doc_id: r.kept for r in lines.kept_lines(spark.createDataFrame(list(enumerate(pairs)), "doc_id long, text string")).collect()}
    assert sum(len(k) == 2 for k in got.values()) <= 0.02 * len(pairs)
    assert all(k[0] == 0 for k in got.values())


def test_lines_of_a_hundred_thousand_characters(spark):
    rng = random.Random(5)
    line = "".join(rng.choice("abcdefgh ") for _ in range(100_000))
    rows = [(1, "x" + line), (2, "x" + line[:50_000] + "#" + line[50_000:]), (3, "x" + line[:50_000] + line[:50_000:-1])]
    start = time.monotonic()
    got = {r.doc_id: r.kept for r in lines.kept_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [0], 2: [], 3: [0]}
    assert time.monotonic() - start < 60


def test_text_of_kept_lines(spark):
    table = spark.createDataFrame([(2, "one line of text\nanother one here\n\nshort"), (1, "One line of text\nshort"), (3, None)],
                                  "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.kept_text) for r in lines.without_repeated_lines(table).collect()}
    assert got == {1: (2, "One line of text\nshort"), 2: (3, "another one here"), 3: (0, "")}


def test_lines_of_no_documents(none):
    assert lines.kept_lines(none).count() == 0


def test_lines_below_the_similarity_are_ruled_out_by_parities(spark, monkeypatch):
    """Lines that share buckets but not enough shingles (66 %) do not meet pair by pair."""
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    stem = "".join(rng.choices(letters, k=150))
    texts = [stem + "".join(rng.choices(letters, k=30)) for _ in range(150)]
    compared, alike = [], lines._alike

    def counted(pairs, contents):
        compared.append(pairs.select("leader", "line").distinct().count())
        return alike(pairs, contents)

    monkeypatch.setattr(lines, "_alike", counted)
    got = lines.kept_lines(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert all(r.kept == [0] for r in got)
    assert sum(compared) <= 150


def test_parities_differ_in_no_more_bits_than_sets():
    rng = random.Random(12)
    for size in (8, 30, 300, 5000):
        one = "".join(rng.choices("abcdef ", k=size))
        other = "".join(c if rng.random() > 0.02 else "x" for c in one) + "y" * rng.randint(0, 9)
        h, owner = lines._shingles([one, other])
        once = lines._once(h, owner)
        a, b = lines._parities(h[once], owner[once], 2)
        bits = sum(int(x ^ y).bit_count() for x, y in zip(a, b))
        apart = len({one[i:i + 8] for i in range(len(one) - 7)} ^ {other[i:i + 8] for i in range(len(other) - 7)})
        assert bits <= apart and (bits - apart) % 2 == 0


def test_lines_need_no_python_on_executors(spark, monkeypatch):
    plans, stored = [], lines.stored

    def noted(df, name):
        plans.append(df._jdf.queryExecution().toString())
        return stored(df, name)

    monkeypatch.setattr(lines, "stored", noted)
    docs = spark.createDataFrame([(1, "one line of this text\nmore"), (2, "one line of this text.")], "doc_id long, text string")
    got = lines.kept_lines(docs)
    plans.append(got._jdf.queryExecution().toString())
    assert {r.doc_id: r.kept for r in got.collect()} == {1: [0, 1], 2: []}
    assert len(plans) > 5 and not any("Arrow" in p or "Python" in p for p in plans)


def test_lines_of_one_shingle_again_and_again(spark):
    """Equal sets in lines of any length, also where only few of the places would be looked at."""
    texts = [mark * n for mark in ("-", "=-", "abc é") for n in (40, 71, 100, 3000)]
    got = {r.doc_id: r.kept for r in lines.kept_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: [0] if i % 4 == 0 else [] for i in range(len(texts))}


def test_sets_in_sql_have_the_sizes_of_those_in_numpy(spark):
    rng = random.Random(13)
    texts = ["".join(rng.choice("abc é\U0001f600") for _ in range(n)) for n in (8, 9, 40, 600)] + ["a" * 50, "ab" * 900]
    rows = lines._counted(spark.createDataFrame(list(enumerate(texts)), "line long, content string")).collect()
    assert {r.line: r.n for r in rows} == dict(enumerate(lines._sizes(*lines._shingles(texts), len(texts)).tolist()))
    assert all(sum((r[w] & 2**64 - 1).bit_count() for w in lines.WORDS) % 2 == r.n % 2 for r in rows)


# --- mixing

def test_targets_are_filled_by_weight(spark):
    sizes = [("a", 100), ("b", 5), ("c", 40), (None, 30), ("d", 0)]
    table = spark.createDataFrame([(s, 0.0) for s, _ in sizes], "source string, x double").drop("x")
    rows = [(s, n) for s, n in sizes]
    del table
    held = spark.createDataFrame([("n" if s is None else "s" + s, n, 1) for s, n in rows],
                                 f"{curriculum.KEY} string, source_size long, {curriculum.ROWS} long")
    got = {r[0]: r["target"] for r in curriculum.targets(held, (1.0, 2.0, 3.0)).collect()}
    weights = {"sa": 1, "sb": 2, "sc": 3, "sd": 1, "n": 2}
    caps = {("n" if s is None else "s" + s): 3 * n for s, n in rows}
    want, free, left = {}, dict(weights), sum(n for _, n in rows)
    while True:
        level = left / sum(free.values())
        full = [k for k in free if level * free[k] > caps[k]]
        if not full:
            break
        for k in full:
            want[k] = caps[k]
            left -= caps[k]
            del free[k]
    want |= {k: level * w for k, w in free.items()}
    assert got == pytest.approx(want)


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 9)), rng.choice(["a", "a", "a", "b", None])) for i in range(4000)]
    table = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, size int, rate double")
    got = curriculum.planned(table).collect()
    assert sorted(r.doc_id for r in got) == list(range(4000))
    taken, target = Counter(), {}
    for r in got:
        assert r.taken == r.copies * r["size"] <= 3 * r["size"] and len(r.positions) == r.copies
        assert all(0 <= p <= 1 for p in r.positions) and list(r.positions) == sorted(r.positions)
        taken[r.source] += r.taken
        target[r.source] = r.target
    for s, t in target.items():
        assert abs(taken[s] - t) <= 9
    assert sorted(map(str, got)) == sorted(map(str, curriculum.planned(table.repartition(7)).collect()))


def test_mix_counts_words_once(spark, docs, tmp_path):
    """With the columns named that are kept, the same plan from sizes that are written once."""
    narrow = curriculum.planned(docs, kept=["doc_id"])
    assert narrow.columns == ["doc_id", *curriculum.PLAN]
    same = curriculum.planned(docs).select(*narrow.columns)
    assert Counter(map(str, narrow.collect())) == Counter(map(str, same.collect()))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for plan in (narrow, queries.source_mix(spark, str(tmp_path))):
        assert "regexp_count" not in plan._jdf.queryExecution().optimizedPlan().toString().lower()
    assert curriculum.planned(docs, kept=["lang"]).columns == ["lang", *curriculum.PLAN]


def test_time_follows_the_schedule(spark):
    """The share of a source's words before a time is the integral of its rate up to it."""
    knots = ((0.0, 0.5), (0.25, 2.0), (1.0, 0.5))
    ys = [(i / 50, 0) for i in range(51)]
    got = spark.createDataFrame(ys, "y double, k int").select("y", curriculum.when_demanded(F.col("y"), F.col("k"), (knots,)).alias("t")).collect()

    def area(t):
        total, done = 0.0, 0.0
        for (a, x), (b, y) in zip(knots, knots[1:]):
            total += (b - a) * (x + y) / 2
            u = min(max(t - a, 0), b - a)
            done += u * (x + x + (y - x) / (b - a) * u) / 2
        return done / total

    for r in got:
        assert area(r.t) == pytest.approx(r.y, abs=1e-9)


def test_training_order_is_sorted_over_partitions(docs, rows):
    mix = curriculum.in_training_order(docs)
    at = mix.select(F.spark_partition_id().alias("p"), "position").collect()
    assert [r.position for r in at] == sorted(r.position for r in at)
    assert set(mix.columns) == {*docs.columns, "position"} - {"size"}


def test_awkward_mix(docs, rows, none):
    got = curriculum.planned(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert curriculum.planned(none).count() == 0
    blank = docs.withColumn("text", F.lit(None).cast("string"))
    assert {r.taken for r in curriculum.planned(blank).collect()} == {0}


# --- sharding

def test_shards(docs, rows, none):
    got = sharding.shuffled_shards(docs, bucket_bytes=20_000).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(r[:2] for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[i]) for i in range(sharding.SHARDS)]
    assert max(sizes) - min(sizes) <= 1
    again = sharding.shuffled_shards(docs.repartition(2), bucket_bytes=20_000).collect()
    assert Counter((r.doc_id, r.text, r.shard, r.slot) for r in got) == Counter((r.doc_id, r.text, r.shard, r.slot) for r in again)
    assert sharding.shuffled_shards(none).count() == 0


def test_order_is_shuffled(spark):
    dealt = sharding.shuffled_shards(spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), shards=1, bucket_bytes=1000)
    order = [r.doc_id for r in dealt.orderBy("slot").collect()]
    assert sorted(order) == list(range(2000))
    rises = sum(a < b for a, b in zip(order, order[1:]))
    assert 880 < rises < 1120


def test_written_shards(spark, docs, rows, tmp_path):
    sharding.write_shards(sharding.shuffled_shards(docs, shards=3), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and {r[0] for r in back.select("shard").distinct().collect()} == {0, 1, 2}


@pytest.mark.parametrize("blank", ["\n", "\r\n", " \n", "\r", "\n\t\f"])
def test_licence_scan_takes_long_runs_of_blank_lines(spark, blank):
    texts = [blank * 100_000 + licences.MIT, "Copyright (c) 2020 X\n" + blank * 100_000 + "\n" + licences.MIT,
             "copyright (c) 2020 x " * 20_000, blank * 100_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.license for r in licences.licences(rows).collect()}
    assert found == {0: "MIT", 1: "MIT", 2: None, 3: None}
