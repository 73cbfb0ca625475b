"""A Merkle tree over a table: leaves per row, a subtree per source, a root over the sources.

Digests are lowercase hex SHA-256. A level of a tree is made from the one below by a slot pivot:
the nodes of a parent are spread by conditional aggregates into one column per slot;
concatenating the columns and hashing gives the parent, and leaving out a node's own column
gives its siblings. Levels are built bottom up, each a sixteenth of the one below and written;
then proofs are handed down, a parent's to all its children at once, so no leaf is joined
with its upper levels one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepkit.functions.columns import union_all
from prepkit.llm.scratch import stored
from prepkit.llm.text import lower_ascii
from prepkit.operators.broadcasts import broadcast_if_small

FANOUT = 16
#: Letters of a digest.
DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows numbered in one task: from so many on a table is cut, and so many are the most.
RUN_LEAST, RUN_MOST = 10_000, 2_000_000


def manifest(docs: DataFrame, altered: Column | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Per row its id (the first field), ``leaf``, ``subroot``, ``root`` and ``proof_sha256``, and
    ``folded_root``, computed from the leaf of the row with ``altered`` as its last field and the
    siblings of the proof, and whether that is the root, ``verified``. Where ``altered`` is NULL
    the row is as it was and its own leaf is folded.

    ``fields`` are the id, the group and others, the last one the text; all enter the leaf, a
    NULL as ``-``. Within a group leaves ascend by id, a NULL id first, rows of one id by leaf;
    equal rows have places and proofs of their own. A NULL group comes before the empty one. A
    group of one row has its leaf as subroot, a table of one group the subroot as root. Other
    columns do not count. An empty table gives an empty one.
    """
    doc_id, source, text = fields[0], fields[1], fields[-1]
    changed = F.lit(None).cast("string") if altered is None else altered
    others = [F.col(f) for f in fields[:-1]]
    rows = docs.select(
        F.col(doc_id).alias("id"), group_key(F.col(source)).alias("group"), leaf_digest(*others, F.col(text)).alias("digest"),
        F.when(changed.isNotNull(), leaf_digest(*others, changed)).alias("changed"))
    leaves = as_nodes(placed(rows, ["group"], ["id", "digest"]), "id", "changed")
    levels, subroots = climbed(leaves)
    sources = as_nodes(placed(subroots.withColumn("all", F.lit("")), ["all"], ["group"]).select(
        F.col("all").alias("group"), F.col("group").alias("member"), "level", "digest", "place", "size"), "member", "level")
    upper, root = climbed(sources)
    root = root.select("group", "level", F.col("digest").alias("root"), no_path().alias("path"))
    above = descended(sources, upper, root, "root").select(
        F.col("node.member").alias("group"), F.col("node.level").alias("level"), F.col("node.digest").alias("subroot"),
        "root", "path")
    held = descended(leaves, levels, stored(above, "sources"), "root", "subroot")
    # Every row is folded, altered or not: that the root comes out again is a result, not given.
    folded = F.aggregate("path", F.coalesce("node.changed", "node.digest"), lambda digest, step: F.sha2(F.concat(
        step["left"], digest, step["right"]), 256))
    siblings = F.array_join(F.transform("path", lambda step: F.concat(step["left"], step["right"])), "")
    return held.select(
        F.col("node.id").alias(doc_id), F.col("node.digest").alias("leaf"), "subroot", "root",
        F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 over fields, each with its length in bytes before it, or a mark for NULL."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def group_key(group: Column) -> Column:
    """Never NULL, and in the order of the groups' bytes with NULL first."""
    return F.coalesce(F.concat(F.lit("+"), group.cast("string")), F.lit(""))


def no_path() -> Column:
    return F.expr("CAST(array() AS array<struct<left: string, right: string>>)")


def as_nodes(rows: DataFrame, *carried: str) -> DataFrame:
    return rows.select("group", "place", "size", F.struct("digest", *carried).alias("node"))


def placed(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """All rows with ``place``, counted from 0 within their group in that order, and the group's ``size``.

    The table is cut into ranges of the whole order, written, and numbered within each range; a row
    per range and group says how many come before. A group of a third of all rows is many ranges,
    and so are equal rows, which a last key tells apart.
    """
    total = rows.count()
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(-(-total // RUN_LEAST), most), -(-total // RUN_MOST))
    keys = [*group, *order, "tie"]
    runs = stored(rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *keys)
                  .sortWithinPartitions(*keys).drop("tie").withColumn("row", F.monotonically_increasing_id()), "runs")
    # The upper bits of such an id are the range, the lower 33 the row's place in it.
    runs = runs.withColumn("range", F.shiftright("row", 33))
    whole = Window.partitionBy(*group)
    before = F.sum("rows").over(whole.orderBy("range")) - F.col("rows")
    parts = runs.groupBy("range", *group).agg(F.min("row").alias("first"), F.count("*").alias("rows")).select(
        "range", *group, (before - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("size"))
    return runs.join(broadcast_if_small(parts), ["range", *group]).withColumn(
        "place", F.col("row") + F.col("shift")).drop("range", "row", "shift")


def climbed(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The levels of parents above the nodes, with their slots, and the top of each group:
    ``group``, ``digest`` and ``level`` (0 where the node is alone)."""
    levels, tops = [], []
    while True:
        tops.append(nodes.where("size = 1").select("group", "node.digest", F.lit(len(levels)).alias("level")))
        parents = stored(pivoted(nodes.where("size > 1")), "parents")
        if parents.isEmpty():
            return levels, union_all(tops)
        levels.append(parents)
        nodes = parents.select("group", F.col("parent").alias("place"), F.ceil(F.col("size") / FANOUT).alias("size"),
                               F.struct(F.sha2(joined(), 256).alias("digest")).alias("node"))


SLOTS = [f"slot{i}" for i in range(FANOUT)]


def pivoted(nodes: DataFrame) -> DataFrame:
    """A row per parent with a column for each of its slots."""
    slot = F.col("place") % FANOUT
    return nodes.groupBy("group", "size", F.floor(F.col("place") / FANOUT).alias("parent")).agg(
        *[F.max(F.when(slot == i, F.col("node"))).alias(s) for i, s in enumerate(SLOTS)])


def joined() -> Column:
    """The digests of all slots one after the other."""
    return F.concat(*[F.coalesce(f"{s}.digest", F.lit("")) for s in SLOTS])


def descended(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame, *carried: str) -> DataFrame:
    """The lowest nodes with ``path``: from each up to the top the siblings to the ``left`` and to
    the ``right``, and then the top's own path. What the tops carry is handed down."""
    def of_level(level: int) -> DataFrame:
        return tops.where(F.col("level") == level).select("group", F.lit(0).cast("long").alias("place"), "path", *carried)

    handed = of_level(len(levels))
    for level in reversed(range(len(levels))):
        held = levels[level].withColumn("place", F.col("parent")).join(handed, ["group", "place"])
        filled = F.filter(F.array(*SLOTS), lambda node: node.isNotNull())
        children = held.select("group", "parent", joined().alias("digests"), "path", *carried, F.posexplode(filled).alias("slot", "node"))
        left = F.substring("digests", F.lit(1), F.col("slot") * DIGEST)
        right = F.substring("digests", (F.col("slot") + 1) * DIGEST + 1, F.lit(FANOUT * DIGEST))
        path = F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("path"))
        below = children.select("group", (F.col("parent") * FANOUT + F.col("slot")).alias("place"), "node", path.alias("path"), *carried)
        if level:
            handed = below.drop("node").unionByName(of_level(level))
    alone = nodes.where("size = 1").select("group", "node").join(of_level(0), "group")
    return alone.unionByName(below) if levels else alone


def altered_text(doc_id: Column, text: Column) -> Column:
    """A tampering for trials: every fifth id, by its checksum, has A to Z in lower case."""
    return F.when(F.crc32(doc_id.cast("string")) % 5 == 0, lower_ascii(text))
