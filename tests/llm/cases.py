"""A small table with every awkward case, and brute-force versions of the operators."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, n int, shard int, score string, mark string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, letters="abcdefghij"):
    return [rng.choice(letters) + rng.choice(letters) + rng.choice("xyz.,") for _ in range(n)]


def awkward_rows(seed=3):
    """Null ids, texts and sources, empty and blank texts, equal rows, shared ids, near copies,
    shared passages, a very long text, odd blanks, letters beyond ASCII."""
    rng = random.Random(seed)
    passage, base = prose(rng, 60), prose(rng, 200)
    texts = [None, "", " \n\t ", "one", "ONE", "a b c", "a b c d", "A b C d"]
    texts += [" ".join(base), " ".join(base), " ".join(base[:100] + ["new"] + base[101:]), " ".join(base[5:])]
    texts += [" ".join(prose(rng, 30) + passage + prose(rng, 20)) for _ in range(4)]
    texts += [" ".join(prose(rng, 10) + passage[:55] + prose(rng, 90)), "\x0b".join(passage) + "\x0c\r\n" + " ".join(base[:60])]
    texts += [" ".join(["same"] * 300), " ".join(["same"] * 120), "é ü ß ĳ " * 30, "Öl ## $$ %% | < >\n" * 20]
    texts += [" ".join(prose(rng, 40)) for _ in range(12)]
    texts += [" ".join(prose(rng, 30_000, "abcdefghijklmnop"))]
    rows = []
    for i, text in enumerate(texts):
        source = (None, "web", "books", "web", "ßx", "")[i % 6]
        rows.append((i * 3 - 10, text, None if i % 5 == 0 else "en", source, None, 1, None, 7, None, "x"))
    rows += [(None, " ".join(base), None, None, None, None, None, None, None, None)] * 2
    rows += [(None, None, None, None, None, None, None, None, None, None)]
    rows += [rows[9]] * 3
    return rows


def repeats(rows, length=50):
    """(id, text) to (words, removed, kept) by looking at every window."""
    first = {}
    far = 2**63
    for doc, text, *_ in rows:
        w = words(text)
        for i in range(len(w) - length + 1):
            key = tuple(w[i:i + length])
            first[key] = min(first.get(key, far), far if doc is None else doc)
    out = {}
    for doc, text, *_ in rows:
        w, gone = words(text), set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i:i + length])] < (far if doc is None else doc):
                gone.update(range(i, i + length))
        out[doc, text] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, n=4):
    w = words(lowered(text))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def jaccard(rows, percent=85):
    """Per row (shingles, component) by all pairs."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    far = 2**63
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), far), far if r[0] is None else r[0])
    return [(len(sets[i]), None if least[find(i)] == far else least[find(i)]) for i in range(len(rows))]


def rule_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen, covered = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i:i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            for i in places:
                covered.update(range(i, i + 8))
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def edit_distance_within(pattern, text):
    """The fewest edits with which the pattern occurs somewhere in the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)
