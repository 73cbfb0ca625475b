"""What every order of five filters removes, by decision diagrams.

A document's failure mask has a bit per filter. The table comes down to the number of documents
per part and mask, 32 at most for a part, in a few grouped aggregates. From these a part's
decision diagram is built: one level per filter, an edge for passing and one for failing,
weighted with the documents that take it; diagrams of no document are left out and equal ones
are shared. Swapping two adjacent levels turns the diagram of one order into that of another, and
a walk over all orders by adjacent swaps visits each once. The path that passes every filter
reads off each step: the weight at its nodes is what is left, the failing edges are what goes.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepkit.llm.text import words

#: The filters in the order of their bits, and how each fails a text.
FILTERS = "ABCDE"
FEW_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 50, 65, 5, r"[#$%&*|]"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
#: Documents, those of good quality and toxic ones.
MEASURES = ("docs", "good", "toxic")
#: Rows without an id are dealt over so many keys.
SALTS = 4096


def filter_audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 part: str = "source") -> DataFrame:
    """``part``, ``filter_order``, ``step`` and the counts of ``COUNTS`` for every part, order of
    the five filters and step.

    A NULL text is an empty one: it has too few words and fails no other rule on its own. A NULL
    part is the part of the empty string. A document is a copy if its text is also that of a
    smaller id anywhere in the table; rows of the smallest id are none of each other, and a NULL
    id is neither smaller nor larger. A label given more than once holds if any says so; a NULL
    id has none. Repeated rows count each. Other columns are not read. An empty table gives an
    empty one.
    """
    return walked(mask_counts(docs, labels, doc_id, text, part))


def mask_counts(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, part: str) -> DataFrame:
    """``part``, ``mask`` and the three measures. Texts do not move: a digest stands for each."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    no_id = F.col(doc_id).isNull()
    rows = docs.select(
        F.col(doc_id).alias("id"),
        # An outer join sends all NULL keys to one task, but for this second key.
        F.when(no_id, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0).cast("int").alias("salt"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(whole, 256)).alias("digest"), text_mask(whole).alias("mask"))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")).withColumn("salt", F.lit(0))
    labelled = rows.join(said, ["id", "salt"], "left").fillna(False, ["good", "toxic"])
    # Rows of one id first, in the join's own partitions, then by text: what one text has of a
    # part and of labels is one row, however many copies there are.
    ids = labelled.groupBy("id", "salt", "digest", "part", "mask", "good", "toxic").agg(F.count("*").alias("docs"))
    texts = ids.groupBy("digest", "part", "mask", "good", "toxic", F.col("id").isNull().alias("no_id")).agg(
        F.sum("docs").alias("docs"), F.min("id").alias("least"), F.min_by("docs", "id").alias("at_least"))
    first = texts.groupBy("digest").agg(F.min("least").alias("first"))
    held = texts.join(first, "digest")
    originals = F.when(F.col("no_id"), F.col("docs")).when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    copy = F.col("mask").bitwiseOR(1 << FILTERS.index("E"))
    split = held.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask"), originals.alias("docs")),
        F.struct(copy.alias("mask"), (F.col("docs") - originals).alias("docs")))).alias("x")).select("part", "good", "toxic", "x.*")
    return split.where("docs > 0").groupBy("part", "mask").agg(
        F.sum("docs").alias("docs"), *[F.sum(F.when(F.col(m), F.col("docs")).otherwise(0)).alias(m) for m in MEASURES[1:]])


def text_mask(text: Column) -> Column:
    """The bits of the filters that look at one text."""
    n, distinct = (F.size(x).cast("long") for x in (words(text), F.array_distinct(words(text))))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    fails = (n < FEW_WORDS, 100 * distinct < DISTINCT_PERCENT * n,
             100 * capitals > CAPITAL_PERCENT * F.length(text), text.rlike(SYMBOLS))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def walked(masks: DataFrame) -> DataFrame:
    """All orders and steps of each part, from its counts by mask: one row in, 600 out."""
    cells = [F.coalesce(F.max(F.when(F.col("mask") == m, F.col(x))), F.lit(0)) for m in range(1 << len(FILTERS)) for x in MEASURES]
    rows = masks.groupBy("part").agg(F.array(*cells).alias("cells"))
    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()),
                           T.StructField("step", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(COUNTS)]
        for batch in batches:
            for part, weights in zip(*(batch.column(c).to_pylist() for c in ("part", "cells"))):
                columns = zip(*part_rows(part, [tuple(weights[i:i + 3]) for i in range(0, len(weights), 3)]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

    return rows.mapInArrow(task, schema)


def part_rows(part: str, weights: list[tuple]) -> list[tuple]:
    """The rows of a part, in the order of the walk."""
    n = len(FILTERS)
    fails = [sum(w[0] for m, w in enumerate(weights) if m >> f & 1) for f in range(n)]
    steps = []
    diagram = Diagram(n)
    root = diagram.built(weights, tuple(range(n)))
    for order, root in diagram.orders(root):
        node, left = root, diagram.weight(root)[0]
        for step, f in enumerate(order, 1):
            passing, failing = node[1:] if node else (None, None)
            gone = diagram.weight(failing)
            node, left = passing, left - gone[0]
            steps.append(("".join(FILTERS[x] for x in order), step, f, left, *gone))
    shapley = [sum(s[4] for s in steps if s[2] == f) for f in range(n)]
    return [(part, order, step, left, gone, fails[f] - gone, weights[1 << f][0], good, toxic, shapley[f])
            for order, step, f, left, gone, good, toxic in steps]


class Diagram:
    """Weighted decision diagrams over ``n`` levels. None is that of no document; others are
    tuples (weight, passing, failing), at the end (weight,), each kept once."""

    def __init__(self, n: int):
        self.n, self.nodes = n, {}

    @staticmethod
    def weight(node: tuple | None) -> tuple:
        return node[0] if node else (0,) * len(MEASURES)

    def node(self, passing: tuple | None, failing: tuple | None) -> tuple | None:
        if passing is None and failing is None:
            return None
        made = tuple(map(sum, zip(self.weight(passing), self.weight(failing)))), passing, failing
        # Children are kept once, so their identity stands for them.
        return self.nodes.setdefault((id(passing), id(failing)), made)

    def built(self, weights: list[tuple], order: tuple[int, ...], mask: int = 0) -> tuple | None:
        if not order:
            return self.nodes.setdefault(weights[mask], (weights[mask],)) if weights[mask][0] else None
        return self.node(self.built(weights, order[1:], mask), self.built(weights, order[1:], mask | 1 << order[0]))

    def swapped(self, node: tuple | None, level: int) -> tuple | None:
        """Levels ``level`` and ``level`` + 1 below this node exchanged."""
        if node is None:
            return None
        _, passing, failing = node
        if level:
            return self.node(self.swapped(passing, level - 1), self.swapped(failing, level - 1))
        (_, pp, pf), (_, fp, ff) = (x or (None, None, None) for x in (passing, failing))
        return self.node(self.node(pp, fp), self.node(pf, ff))

    def orders(self, root: tuple | None) -> Iterator[tuple[tuple[int, ...], tuple | None]]:
        """All orders with their diagrams, each one adjacent swap from the one before: the
        largest filter that can still move in its direction moves."""
        order, left = list(range(self.n)), [True] * self.n
        for _ in range(factorial(self.n) - 1):
            yield tuple(order), root
            for f in reversed(range(self.n)):
                at = order.index(f)
                to = at - 1 if left[f] else at + 1
                if 0 <= to < self.n and order[to] < f:
                    break
            order[at], order[to] = order[to], order[at]
            root = self.swapped(root, min(at, to))
            left[f + 1:] = [not x for x in left[f + 1:]]
        yield tuple(order), root
