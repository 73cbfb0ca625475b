"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from prepkit.llm import merkle
from tests.llm import cases


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc, source, lang, n_chars, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n_chars, text)))


def tree(digests):
    """The top and, for each digest, the (left, right) siblings on its way."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for path, i in zip(paths, range(len(at))):
            run, first = level[at[i] // 16 * 16:][:16], at[i] // 16 * 16
            path.append(("".join(run[:at[i] - first]), "".join(run[at[i] - first + 1:])))
        at = [i // 16 for i in at]
        level = [H("".join(level[i:i + 16])) for i in range(0, len(level), 16)]
    return level[0], paths


def brute(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[3]].append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    held = []
    for name in names:
        # An id that is missing comes first; rows of one id by their leaves.
        members = sorted(((r[0] is not None, r[0] or 0, leaf(r[0], r[3], r[2], r[4], r[1]), r) for r in groups[name]), key=lambda m: m[:3])
        held.append((members, *tree([m[2] for m in members])))
    root, upper = tree([top for _, top, _ in held])
    out = []
    for (members, top, paths), rest in zip(held, upper):
        for (_, _, own, r), path in zip(members, paths):
            digest = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                digest = leaf(r[0], r[3], r[2], r[4], r[1] and cases.lowered(r[1]))
            for left, right in path + rest:
                digest = H(left + digest + right)
            out.append((r[0], own, top, root, H("".join(a + b for a, b in path + rest)), digest, digest == root))
    return out


def manifested(spark, rows, partitions=3):
    docs = spark.createDataFrame(rows, cases.SCHEMA).repartition(partitions)
    found = merkle.manifest(docs, merkle.altered_text(F.col("doc_id"), F.col("text")))
    return Counter(map(tuple, found.collect()))


def many(n, source="web"):
    return [(i * 7, f"Text Number {i}", "en", source, i, 1, None, 7, None, "x") for i in range(n)]


@pytest.mark.parametrize("rows", [
    cases.awkward_rows(),
    # One row, sixteen, seventeen (a run of one), over two levels, beside a lone one and many sources.
    many(1), many(16), many(17), many(257) + many(1, "a"), [r for i in range(20) for r in many(i % 3 + 1, f"s{i}")],
    # Equal rows are more than a range of the order holds.
    many(3) + [many(1, None)[0]] * 40,
], ids=["awkward", "1", "16", "17", "257", "sources", "equal"])
def test_manifest_equals_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(merkle, "RUN_LEAST", 5)
    assert manifested(spark, rows) == Counter(brute([r[:5] for r in rows]))


def test_manifest_of_nothing(spark):
    assert manifested(spark, []) == Counter()


def test_tampering_is_noticed_unless_nothing_changes(spark):
    found = manifested(spark, many(200))
    assert {r[-1] for r in found} == {True, False}
    assert all(r[-1] == (r[5] == r[3]) and (r[-1] or zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in found)


def test_every_row_is_checked_by_its_proof(spark, monkeypatch):
    # With a sibling that is not in the tree no row folds to the root, altered or not.
    wrong = F.array(F.struct(F.lit("").alias("left"), F.lit("0" * 64).alias("right")))
    monkeypatch.setattr(merkle, "no_path", lambda: wrong)
    found = manifested(spark, many(40) + many(1, "a"))
    assert sum(found.values()) == 41
    assert not any(r[-1] or r[5] == r[3] for r in found)
