"""The filter audit against applying every order to every document."""

from collections import Counter, defaultdict
from itertools import permutations

from prepkit.llm import filter_audit as fa
from tests.llm import cases


def failures(rows):
    least = {}
    for doc, text, *_ in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    for doc, text, *_ in rows:
        w, text = cases.words(text), text or ""
        yield {x for x, fails in zip("ABCDE", (
            len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            any(c in "#$%&*|" for c in text), doc is not None and least[text] < doc)) if fails}


def brute(rows, good, toxic):
    parts = defaultdict(list)
    for row, fails in zip(rows, failures(rows)):
        parts[row[3] or ""].append((row[0], fails))
    out = []
    for part, docs in parts.items():
        removed = Counter()
        held = []
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                removed[f] += len(gone)
                held.append(("".join(order), step, f, len(left), len(gone), sum(f in d[1] for d in docs) - len(gone),
                             sum(d[1] == {f} for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)))
        out += [(part, *x[:2], *x[3:], removed[x[2]]) for x in held]
    return out


LABELS = [(-10, 1, 0), (2, 1, 0), (14, 1, 0), (14, 0, 0), (17, 1, 1), (20, 0, 1), (23, None, 1), (None, 1, 1), (47, 1, 0), (50, 1, 1), (9999, 1, 1)]
GOOD, TOXIC = ({d for d, *x in LABELS if x[i] == 1 and d is not None} for i in (0, 1))


def test_audit_equals_brute_force(spark):
    rows = cases.awkward_rows()
    rows += [(100 + i, "Many Capital Words $ " * 30, None, "web", None, None, None, None, None, None) for i in range(5)]
    docs = spark.createDataFrame(rows, cases.SCHEMA).repartition(4)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in fa.filter_audit(docs, labels).collect()]
    assert sorted(got) == sorted(brute(rows, GOOD, TOXIC))
    assert fa.filter_audit(docs.where("false"), labels).count() == 0
    unlabelled = fa.filter_audit(docs, labels.where("false")).agg({"good_lost": "sum", "toxic_lost": "max"}).first()
    assert tuple(unlabelled) == (0, 0)


def test_rows_that_share_the_smallest_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, None, "a"), (1, text, None, "b"), (1, text, None, "a"), (2, text, None, "b"), (None, text, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    counts = fa.mask_counts(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), "doc_id", "text", "source")
    assert {(r.part, r["mask"], r.docs) for r in counts.collect()} == {("a", 0, 2), ("b", 0, 2), ("b", 16, 1)}


def test_the_walk_meets_every_order_once_by_adjacent_swaps():
    diagram = fa.Diagram(5)
    weights = [(m % 7, m % 3, m % 2) if m % 7 else (0, 0, 0) for m in range(32)]
    orders = []
    for order, root in diagram.orders(diagram.built(weights, tuple(range(5)))):
        orders.append(order)
        # The swapped diagram is the one that the order builds on its own.
        assert root is diagram.built(weights, order)
    assert len(set(orders)) == 120
    for a, b in zip(orders, orders[1:]):
        assert [i for i in range(5) if a[i] != b[i]] in [[i, i + 1] for i in range(4)]
