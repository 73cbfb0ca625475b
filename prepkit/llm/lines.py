"""Fuzzy line deduplication by MinHash.

Each line is a set of character shingles; its signature holds, for each of a number of parts of
the range of a 64-bit hash, the first hash of a shingle there, or from there on, around the end of
the range. That is the smallest under the hash less the part's begin, a permutation of the range, and
costs one minimum for each part of the range instead of one for each point. Of lines with many shingles
only hashes early in a part are looked at, as others are hardly the first. In lines with few shingles, also
in long ones, one is the first from many points on, so they have a hash of its own for each point. Lines
that agree on a band of the signature meet in a bucket. There every line is held against the
bucket's leader by exact Jaccard similarity, and distributed union-find over the matches gives
components. In buckets that then still span several components, lines of different components are
compared, matched or not: all with all where that is few pairs, else all with a share of them that grows
every round until it is all. Shingles are hashed as rows and sets intersected as arrays, by SQL functions
alone. Of each component the first line stays.
"""

from __future__ import annotations

from functools import reduce
from math import log
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepkit.llm.components import components
from prepkit.llm.scratch import small_if_few, stored
from prepkit.llm.text import gram_hashes, mixed

#: Characters of a shingle, and the similarity (percent) of lines that are the same line.
SHINGLE, PERCENT = 8, 80
#: The parts of the range of a hash, and the shingles of a part that are looked at, on average.
POINTS, PART = 16, 3
RANGE = 2**64 // POINTS - 1
#: The points of each band. Lines of similarity 0.8 miss each other in all bands with a chance of 1.1 %,
#: of 0.9 with 0.04 %.
BANDS = ((8, 10, 6), (11, 0, 3), (1, 5, 2), (15, 7, 13), (12, 4, 14), (9, 8, 2), (1, 10, 9), (14, 6, 13))
ROWS = 4
#: Lines with fewer shingles have a hash of its own for each point.
FEW = 64
#: Longs of a line's parities. A shingle flips one bit, so two lines differ in no more bits than
#: their sets differ in shingles, and a pair with more than the similarity leaves is none.
PARITIES = 16
#: Leaders of a bucket in the first round across components, on average; GROWTH times as many in
#: each further one. Buckets with no more pairs across components than half as many for each of
#: their lines are compared in full.
LEADERS, GROWTH = 32, 8


def kept_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_lines`` (lines with a character other than blanks) and
    ``kept`` (the numbers, from 0, of those that stay): of every group of equal or similar lines of
    the whole table only the first stays (smallest id, then place in the text; NULL ids last).

    Lines lie between line feeds and are compared without blanks at either end. Lines of fewer
    than SHINGLE characters are only like equal ones. NULL, empty and blank texts have no lines.
    Rows alike in id and text count as one document, and each gets its result. Other columns
    are not read.
    """
    named = _line_names(_keyed(docs, doc_id, text))
    rows = named.select("id", "mark", F.size(F.filter("names", lambda n: n.isNotNull())).alias("n_lines"))
    rows = rows.join(_kept(_keyed(docs, doc_id, text), named), ["id", "mark"], "left")
    return rows.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(doc_id), *_counts())


def without_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``kept_lines``, with ``kept_text``: the lines that stay, joined by line feeds."""
    base = _keyed(docs, doc_id, text)
    rows = base.withColumn("n_lines", _n_lines()).join(_kept(base, _line_names(base)), ["id", "mark"], "left")
    kept = F.coalesce("kept", F.array().cast("array<int>"))
    lines = F.transform(kept, lambda i: F.get(F.split("text", "\n"), i))
    return rows.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(doc_id), *_counts(),
                       F.array_join(lines, "\n").alias("kept_text"))


NO_ID = 2**63 - 1


def _counts() -> list[Column]:
    return [F.col("n_lines").cast("long").alias("n_lines"), F.coalesce("kept", F.array().cast("array<int>")).alias("kept")]


def _n_lines() -> Column:
    return F.size(F.filter(F.split("text", "\n"), lambda line: _trimmed(line) != "")).alias("n_lines")


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\x0b\x0c\r"))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"),
                       F.xxhash64(F.col(text)).alias("mark"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def _line_names(base: DataFrame) -> DataFrame:
    """``id, mark`` and ``names``: the 64-bit name of each line of a document, NULL where it is blank."""
    names = F.transform(F.transform(F.split("text", "\n"), _trimmed), lambda line: F.when(line != "", F.xxhash64(line)))
    return stored(base.select("id", "mark", names.alias("names")), "line-names")


def _lines(base: DataFrame) -> DataFrame:
    """``line``, the 64-bit name, and ``content`` of each line."""
    cut = base.select(F.explode(F.split("text", "\n")).alias("content"))
    cut = cut.select(_trimmed(F.col("content")).alias("content")).where("content != ''")
    return cut.select(F.xxhash64("content").alias("line"), "content")


def _kept(base: DataFrame, named: DataFrame) -> DataFrame:
    """``id, mark, kept`` of documents of which a line stays: the first places of the components."""
    rooted = _rooted(_lines(base))
    lines = named.select("id", "mark", F.posexplode("names").alias("i", "line")).where("line is not null")
    places = lines.groupBy("line").agg(F.min(F.struct("id", "i", "mark")).alias("place"))
    named = places.join(rooted.withColumnRenamed("node", "line"), "line", "left").withColumn("root", F.coalesce("root", "line"))
    firsts = named.groupBy("root").agg(F.min("place").alias("place")).select("place.*")
    return firsts.groupBy("id", "mark").agg(F.sort_array(F.collect_list("i")).alias("kept"))


def _again(content: Column) -> Column:
    """Whether a line may have far fewer shingles than places: the shingle amid it and one of two others occur twice."""
    def twice(tenths: int) -> Column:
        at = F.floor(F.char_length(content) * tenths / 10).cast("int") - SHINGLE + 1
        one = F.substring(content, at, F.lit(SHINGLE))
        return (F.instr(content, one) < at) | (F.position(one, content, at + 1) > 0)

    return twice(5) & (twice(2) | twice(8))


def _signed_lines(lines: DataFrame) -> DataFrame:
    """``line`` and ``bands`` of lines of SHINGLE characters or more, a row for each kind of hashes that a line has."""
    places = F.char_length("content") - (SHINGLE - 1)
    cut = lines.select("line", "content", places.alias("places")).withColumn("again", (places >= FEW) & _again(F.col("content")))
    most = F.when(F.col("again"), float(RANGE)).otherwise(F.least(F.lit(1.0), F.lit(float(POINTS * PART)) / F.col("places")) * float(RANGE))
    few, many = (F.col("places") < FEW) | F.col("again"), F.col("places") * 100 >= FEW * PERCENT
    kinds = F.when(few & many, F.array(F.lit(True), F.lit(False))).otherwise(F.array(few))
    cut = cut.select("line", "places", F.encode("content", "utf-32").alias("codes"), most.cast("long").alias("most"), F.explode(kinds).alias("few"))
    each = cut.select("line", "few", "codes", "most", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("at"))
    each = each.select("line", "few", "most", _hash("codes", "at").alias("h")).select(
        "line", "few", "most", "h", F.shiftrightunsigned("h", POINTS.bit_length() - 1).alias("past"))
    each = each.where(F.col("few") | (F.col("past") <= F.col("most")))
    part = F.col("h").bitwiseAND(F.lit(POINTS - 1))
    firsts = each.groupBy("line", "few").agg(*[
        F.min(F.when(F.col("few"), F.xxhash64("h", F.lit(k))).when(part == k, F.col("past"))).alias(f"p{k}") for k in range(POINTS)])
    filled = [F.coalesce(*[F.col(f"p{(k + i) % POINTS}") for i in range(POINTS)]).alias(f"p{k}") for k in range(POINTS)]
    bands = [F.xxhash64("few", F.lit(b), *[f"p{k}" for k in band]) for b, band in enumerate(BANDS)]
    return firsts.select("line", "few", *filled).select("line", F.array(*bands).alias("bands"))


def _hash(codes: str, at: str) -> Column:
    """The hash of the shingle at a place, from 0, of a line in UTF-32."""
    return F.expr(f"xxhash64(substring({codes}, 4 * {at} + 1, {4 * SHINGLE}))")


def _set(content: str) -> Column:
    """The hashes of all shingles of a line. The line is encoded once, as the value of a variable;
    an expression would be put in its place and encode it for each shingle."""
    each = f"transform(sequence(0, shiftright(octet_length(codes), 2) - {SHINGLE}), at -> xxhash64(substring(codes, 4 * at + 1, {4 * SHINGLE})))"
    return F.expr(f"element_at(transform(array(encode({content}, 'utf-32')), codes -> {each}), 1)")


def _counted(contents: DataFrame) -> DataFrame:
    """``line, n`` and how many shingles each line has, and their parities."""
    # Outer, as a filter against empty sets would make each set again; there are none.
    each = contents.select("line", F.array_distinct(_set("content")).alias("set")).select("line", F.explode_outer("set").alias("h"))
    each = each.withColumn("word", F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(PARITIES - 1)))
    words = each.groupBy("line", "word").agg(F.count("*").alias("n"), F.bit_xor(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("odd"))
    return words.groupBy("line").agg(F.sum("n").alias("n"), *[
        F.coalesce(F.max(F.when(F.col("word") == w, F.col("odd"))), F.lit(0)).alias(name) for w, name in enumerate(WORDS)])


def _rooted(lines: DataFrame) -> DataFrame:
    """``node`` and ``root`` of lines that are like another one of a bucket, by components."""
    signed = stored(_signed_lines(lines.where(F.char_length("content") >= SHINGLE)), "line-signatures")
    buckets = signed.select("line", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("line").alias("leader"), F.max("line").alias("high")).where("leader < high")
    led = stored(buckets.join(shared.select("bucket", "leader"), "bucket").where("line != leader"), "line-members")
    wanted = led.select("line").union(led.select("leader")).distinct()
    contents = lines.join(small_if_few(wanted), "line", "left_semi").groupBy("line").agg(F.first("content").alias("content"))
    contents = stored(contents, "line-texts")
    sketches = stored(_counted(contents), "line-sizes")
    pairs = led.select("leader", "line").distinct()
    pairs = pairs.join(_named(sketches, "x_", line="leader"), "leader").join(_named(sketches, "y_", line="line"), "line")
    rooted = components(_alike(pairs.where(_near()), contents), "leader", "line")

    # The leader has met all lines of its bucket. The others are cut by size: lines as alike as
    # asked for share one of two classes.
    members = _across(led.select("bucket", "line"), rooted).select("bucket", "line")
    size = F.floor(F.log("n") / float(log(100 / PERCENT)))
    members = members.join(sketches.withColumn("class", F.explode(F.array(size, size + 1))), "line")
    members = members.withColumn("bucket", F.xxhash64("bucket", "class")).drop("class")
    before, most = 0, LEADERS
    while not (members := stored(_across(members, rooted), "line-members")).isEmpty():
        held = members.withColumn("full", F.col("pairs") * 2 <= F.col("lines") * most)
        place = F.pmod(F.xxhash64("bucket", "line"), F.lit(1_000_000)) * F.col("lines")
        # Whoever led before has met all lines of the bucket. More leaders contain the fewer.
        held = held.where(place >= before * 1_000_000).withColumn("leads", F.col("full") | (place < most * 1_000_000))
        held = held.select("bucket", "line", "root", "n", "leads", *WORDS)
        pairs = _named(held.where("leads"), "x_", bucket="bucket", line="leader").join(
            _named(held, "y_", bucket="bucket", line="line"), "bucket")
        pairs = pairs.where("x_root != y_root and (not y_leads or leader < line)")
        links = _alike(pairs.where(_near()), contents).toDF("node", "root")
        rooted = components(rooted.union(links), "node", "root")
        members = members.where(F.col("pairs") * 2 > F.col("lines") * most)
        before, most = most, most * GROWTH
    return rooted


def _across(members: DataFrame, rooted: DataFrame) -> DataFrame:
    """The members of buckets that span several components, with their ``root``, and of the
    bucket the ``lines`` and the ``pairs`` across components."""
    held = members.drop("root", "lines", "pairs").join(rooted.withColumnRenamed("node", "line"), "line", "left")
    held = held.withColumn("root", F.coalesce("root", "line"))
    counts = held.groupBy("bucket", "root").agg(F.count("*").alias("k")).groupBy("bucket").agg(
        F.sum("k").alias("lines"), F.sum(F.col("k") * F.col("k")).alias("same"))
    pairs = (F.col("lines") * F.col("lines") - F.col("same")) / 2
    return held.join(counts.select("bucket", "lines", pairs.cast("long").alias("pairs")).where("pairs > 0"), "bucket")


def _named(df: DataFrame, prefix: str, **names: str) -> DataFrame:
    """Columns under the names given, all others with a prefix."""
    return df.select(*[F.col(c).alias(names.get(c, prefix + c)) for c in df.columns])


#: The words of a line's parities.
WORDS = [f"s{w}" for w in range(PARITIES)]


def _near() -> Column:
    """Whether sizes and parities leave the two lines of a pair the similarity."""
    least, most = F.least("x_n", "y_n"), F.greatest("x_n", "y_n")
    apart = reduce(add, [F.bit_count(F.col("x_" + w).bitwiseXOR(F.col("y_" + w))) for w in WORDS])
    return (least * 100 >= most * PERCENT) & (apart * (100 + PERCENT) <= (least + most) * (100 - PERCENT))


def _alike(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """The pairs, ``leader`` and ``line``, whose Jaccard similarity over shingles reaches the threshold;
    ``x_n`` and ``y_n`` are the sizes of their sets.

    Texts go to the pairs, as sets would be eight times as large.
    """
    spark = pairs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = contents.select("line", "content")
    both = pairs.select("leader", "line", (F.col("x_n") + F.col("y_n")).alias("size")).distinct()
    both = both.join(texts.toDF("leader", "one"), "leader")
    # Few bytes and much work: as many tasks as there may be, not as few as hold the bytes.
    both = both.repartition(tasks, "line").join(texts.toDF("line", "other"), "line")
    shared = F.size(F.array_intersect(_set("one"), _set("other")))
    return stored(both.where(shared * (100 + PERCENT) >= F.col("size") * PERCENT).select("leader", "line"), "line-pairs")


# --- the sets of lines in numpy, for tests to hold those of SQL against

NONE = np.uint64(2**64 - 1)


def _shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles of texts of SHINGLE characters or more, and the text of each."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = lengths - (SHINGLE - 1)
    # The shingles that reach into the next text are left out.
    at = np.arange(counts.sum()) + np.repeat(np.arange(len(texts)) * (SHINGLE - 1), counts)
    return mixed(gram_hashes(mixed(codes + np.uint64(1)), SHINGLE)[at]), np.repeat(np.arange(len(texts)), counts)


def _once(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Where each distinct shingle of each text is."""
    return np.unique(mixed(h + mixed(owner.astype(np.uint64))), return_index=True)[1]


def _sizes(h: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """How many distinct shingles each text has."""
    return np.bincount(owner[_once(h, owner)], minlength=texts)


def _parities(h: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """A row per text, of shingles that are distinct in it: for each bit, whether an odd number fall there."""
    odd = np.zeros(texts * PARITIES, np.uint64)
    at = (h >> np.uint64(6)) % np.uint64(PARITIES)
    np.bitwise_xor.at(odd, owner * PARITIES + at.astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
    return odd.reshape(texts, PARITIES)


def _firsts(h: np.ndarray, owner: np.ndarray, texts: int, points: int) -> np.ndarray:
    """A row per text: the first hash from each point on; points cut the range evenly."""
    least = np.full(texts * points, NONE)
    np.minimum.at(least, owner * points + (h >> np.uint64(65 - points.bit_length())).astype(np.int64), h)
    least = least.reshape(texts, points)
    for k in [*range(points - 1, -1, -1)] * 2:
        least[:, k] = np.where(least[:, k] == NONE, least[:, (k + 1) % points], least[:, k])
    return least
