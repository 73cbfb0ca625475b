"""Token counts by finite-state transducers compiled from a tokenizer file.

Two deterministic transducers stand in for the tokenizer:

* The *segmenter* reads character kinds and marks where words begin. Its transition monoid, the
  few dozen state maps that any stretch of characters can have, is enumerated once with its
  composition table. A text is cut into chunks; all chunks read one character a step, each
  folding its characters into one state map, and the maps are composed by a parallel prefix
  scan, which gives the state every chunk begins in.
* The *merger* reads the bytes of a word, the last one marked, and annotates each transition
  with the tokens it emits (less those it takes back). It does what rank-ordered pair merging
  does: the last token of each prefix of a word is the one token ending there that merging
  leaves alone beside the last token of the prefix before it. A state holds that for every
  place from which some token could still be spelt. States and transitions are compiled when
  first met and forgotten together when there are too many, so memory is bounded.

A word starts in one state whatever was before it, so its map is a constant, which is kept for
words that come again. Character kinds and lower case come from the tokenizer file's own
normaliser and splitter, probed a page of 256 characters at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

#: Tokens that fit a model's context.
LIMIT = 2048
#: Characters taken into numpy at a time, and characters a chunk reads.
PIECE_CHARS, CHUNK = 2_000_000, 512
#: Compiled transitions and known words of a worker, at most, before it starts afresh.
MOST_TRANSITIONS, MOST_WORDS = 400_000, 400_000

# Fixed values of this kind of tokenizer file.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END_OF_WORD = "</w>"
#: Letters that make a word of their own with an apostrophe before them.
SHORT_ENDINGS, LONG_ENDINGS = ("s", "t", "m", "d"), ("re", "ve", "ll")
#: Below this code point a text is in canonical composed form.
FIRST_COMBINING = "\u0300"
#: The one letter that is longer in lower case.
LONGER_IN_LOWER_CASE = "\u0130", "i\u0307"


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """Per row its id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more tokens than
    ``limit``), for the tokenizer whose file's content is ``vocabulary``.

    Counts are those of the whole text without tokens for its beginning and end; a special
    token's string inside a text is one token. NULL and empty texts have none. Every row has
    one, also with a NULL or repeated id; other columns are not read. An empty table gives an
    empty one. A text is read in pieces of bounded size, cut at blanks; one without any blank is
    held whole in one task.
    """
    check_supported(json.loads(vocabulary))
    rows = docs.select(F.col(doc_id), F.col(text).cast("string").alias(TEXT))
    schema = T.StructType([rows.schema.fields[0], *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_tokens"))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(vocabulary)
        for batch in batches:
            texts = batch.column(TEXT)
            n_bytes = pc.binary_length(texts).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(counter.counts(texts))], names=schema.names)

    return rows.mapInArrow(task, schema).withColumn("over_limit", F.col("n_tokens") > limit)


TEXT = "__text"


def check_supported(spec: dict) -> None:
    """Refuse a tokenizer file of another kind than these transducers are compiled for."""
    model, splitter = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
    plain = dict(type="BPE", dropout=None, end_of_word_suffix=END_OF_WORD, ignore_merges=False)
    if ([n["type"] for n in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]
            or splitter[0]["pattern"] != {"Regex": WORD_PATTERN} or splitter[1]["type"] != "ByteLevel"
            or splitter[1]["use_regex"] or splitter[1]["add_prefix_space"] or any(model[k] != v for k, v in plain.items())
            or any(t[k] for t in spec["added_tokens"] for k in ("normalized", "single_word", "lstrip", "rstrip"))):
        raise ValueError("the tokenizer file is not word BPE over bytes with lower case")


class Counter:
    """Token counts of texts, by the two transducers."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)) if special else "(?!)")
        self.composed = normalizers.NFC().normalize_str
        self.characters = Characters(Tokenizer.from_str(vocabulary))
        self.merger = Merger(spec["model"]["merges"])
        self.known: dict[bytes, int] = {}

    @staticmethod
    @lru_cache(2)
    def of(vocabulary: str) -> Counter:
        return Counter(vocabulary)

    def counts(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        held, owners, size = [], [], 0
        for i, scalar in enumerate(texts):
            parts = self.special.split(scalar.as_py() or "")
            out[i] += len(parts) - 1
            for piece in (p for part in parts for p in pieces(part)):
                if not piece.isascii() and max(piece) >= FIRST_COMBINING:
                    piece = self.composed(piece)
                held.append(piece.replace(*LONGER_IN_LOWER_CASE))
                owners.append(i)
                size += len(piece)
                if size >= PIECE_CHARS:
                    np.add.at(out, owners, self.tokens(held))
                    held, owners, size = [], [], 0
        if held:
            np.add.at(out, owners, self.tokens(held))
        return out

    def tokens(self, texts: list[str]) -> np.ndarray:
        points, kinds = self.characters.read(" ".join([*texts, ""]))
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        starts = SEGMENTER.starts(with_endings(points, kinds))
        first, inside = np.flatnonzero(starts), kinds != BLANK
        points, starts = points[inside], starts[inside]
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        offsets = np.concatenate([[0], np.cumsum(width)])[np.append(np.flatnonzero(starts), len(points))]
        spelt = points.astype("<u4").tobytes().decode("utf-32-le").encode()
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(spelt)])
        words = words.dictionary_encode()
        each = np.fromiter(map(self.of_word, words.dictionary.to_pylist()), np.int64, len(words.dictionary))
        total = np.concatenate([[0], np.cumsum(each[words.indices.to_numpy()])])
        return np.diff(total[np.searchsorted(first, ends)], prepend=0)

    def of_word(self, word: bytes) -> int:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= MOST_WORDS:
                self.known.clear()
            found = self.merger.tokens(word)
            if len(word) <= CHUNK:
                self.known[word] = found
        return found


def pieces(text: str) -> Iterator[str]:
    """A text cut at blanks into pieces of bounded size; without a blank it is one piece. A
    blank is in no word and joins with no character, so the pieces' tokens add up."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        blank = text.rfind(" ", at + 1, at + PIECE_CHARS)
        if blank < 0 and (blank := text.find(" ", at + PIECE_CHARS)) < 0:
            break
        yield text[at:blank]
        at = blank
    yield text[at:] if at else text


# --- the segmenter

BLANK, LETTER, NUMBER, OTHER, SHORT, LONG, UNKNOWN = range(7)
BETWEEN, LETTERS, OTHERS, ONE_LEFT, TWO_LEFT = range(5)


class Characters:
    """Lower case and kind of characters, by pages filled when first met."""

    def __init__(self, tokenizer: Tokenizer):
        self.normalised = tokenizer.normalizer.normalize_str
        self.split = pre_tokenizers.Split(Regex(WORD_PATTERN), "removed", invert=True).pre_tokenize_str
        self.lower = np.arange(0x110000, dtype=np.uint32)
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        kinds = self.kind[points]
        if (kinds == UNKNOWN).any():
            for page in np.unique(points[kinds == UNKNOWN] >> 8):
                self.fill(int(page) << 8)
            kinds = self.kind[points]
        return self.lower[points], kinds

    def fill(self, first: int) -> None:
        for point in range(first, first + 256):
            if 0xD800 <= point < 0xE000 or len(lower := self.normalised(chr(point))) != 1:
                continue  # Not met in composed texts.
            self.lower[point] = ord(lower)
            # Two of a kind between letters: one word, none, one of their own, or two.
            self.kind[point] = KIND_BY_PARTS[len(self.split("a" + lower * 2 + "a"))]


KIND_BY_PARTS = {1: LETTER, 2: BLANK, 3: OTHER, 4: NUMBER}


def with_endings(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Kinds in which an apostrophe tells how long the ending is that it may begin."""
    at = np.flatnonzero(points == ord("'"))
    after = np.concatenate([points, np.zeros(2, points.dtype)])
    one, two = after[at + 1], after[at + 2]
    long = np.zeros(len(at), bool)
    for a, b in LONG_ENDINGS:
        long |= (one == ord(a)) & (two == ord(b))
    kinds = kinds.copy()
    kinds[at[np.isin(one, list(map(ord, SHORT_ENDINGS)))]] = SHORT
    kinds[at[long]] = LONG
    return kinds


class Segmenter:
    """A deterministic transducer over kinds that marks the first character of every word, with
    its transition monoid: ``maps[m]`` is a state map, ``joined[a, b]`` is first a, then b."""

    def __init__(self, step: list[list[int]], start: list[list[int]]):
        self.step, self.start = np.array(step, np.uint8), np.array(start, bool)
        letters = [tuple(column) for column in zip(*step)]
        maps = {tuple(range(len(step))): 0}
        for m in (todo := list(maps)):
            for letter in letters:
                if (new := tuple(letter[s] for s in m)) not in maps:
                    maps[new] = len(maps)
                    todo.append(new)
        self.maps = np.array(list(maps), np.uint8)
        self.joined = np.array([[maps[tuple(b[s] for s in a)] for b in maps] for a in maps], np.uint8)
        self.letters = np.array([maps[x] for x in letters], np.uint8)

    def starts(self, kinds: np.ndarray) -> np.ndarray:
        chunks = -(-len(kinds) // CHUNK)
        padded = np.full(chunks * CHUNK, BLANK, np.uint8)
        padded[:len(kinds)] = kinds
        steps = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
        chunk_map = np.zeros(chunks, np.uint8)
        for kind in steps:
            chunk_map = self.joined[chunk_map, self.letters[kind]]
        state = self.maps[np.concatenate([[0], self.scanned(chunk_map)[:-1]]), BETWEEN]
        marks = np.empty((CHUNK, chunks), bool)
        for i, kind in enumerate(steps):
            marks[i] = self.start[state, kind]
            state = self.step[state, kind]
        return marks.T.reshape(-1)[:len(kinds)]

    def scanned(self, maps: np.ndarray) -> np.ndarray:
        """All prefix compositions: in each round every map takes on the one twice as far back."""
        back = 1
        while back < len(maps):
            maps = np.concatenate([maps[:back], self.joined[maps[:-back], maps[back:]]])
            back *= 2
        return maps


# By state (between words, in letters, in others, one or two letters of an ending to come), the
# next state and whether a word begins, for the kinds in their order.
SEGMENTER = Segmenter(
    [[BETWEEN, LETTERS, BETWEEN, OTHERS, ONE_LEFT, TWO_LEFT],
     [BETWEEN, LETTERS, BETWEEN, OTHERS, ONE_LEFT, TWO_LEFT],
     [BETWEEN, LETTERS, BETWEEN, OTHERS, OTHERS, OTHERS],
     [BETWEEN] * 6,
     [ONE_LEFT] * 6],
    [[0, 1, 1, 1, 1, 1], [0, 0, 1, 1, 1, 1], [0, 1, 1, 0, 0, 0], [0] * 6, [0] * 6])


# --- the merger

LAST = 256


class Merger:
    """The transducer of a word's bytes. Symbols 0 to 255 are bytes, ``LAST`` + byte the last one."""

    def __init__(self, merges: list):
        spelt = {byte_letter(b) + end: chr(b + (LAST if end else 0)) for b in range(256) for end in ("", END_OF_WORD)}
        self.rank, self.tokens_of = {}, set(spelt.values())
        for rank, (a, b) in enumerate(merges):
            self.rank.setdefault((spelt[a], spelt[b]), rank)
            spelt[a + b] = spelt[a] + spelt[b]
            self.tokens_of.add(spelt[a + b])
        self.begun = {t[:i] for t in self.tokens_of for i in range(1, len(t))}
        self.forget()

    def forget(self) -> None:
        self.alone: dict[tuple[str, str], bool] = {}
        self.states: dict[tuple, int] = {}
        self.items: list[tuple] = []
        self.moves: dict[int, tuple[int, int]] = {}
        # A place from which tokens may be spelt: letters since then, last token there, tokens
        # up to there less tokens up to now.
        self.state((("", "", 0),))

    def state(self, items: tuple) -> int:
        if items not in self.states:
            self.states[items] = len(self.items)
            self.items.append(items)
        return self.states[items]

    def tokens(self, word: bytes) -> int:
        state, count = 0, 0
        moves = self.moves
        for symbol in (*word[:-1], word[-1] + LAST):
            move = moves.get(state << 9 | symbol)
            if move is None:
                if len(moves) >= MOST_TRANSITIONS:
                    state, moves = self.restarted(state)
                move = self.compiled(state, symbol)
            state = move[0]
            count += move[1]
        return count

    def restarted(self, state: int) -> tuple[int, dict]:
        items = self.items[state]
        self.forget()
        return self.state(items), self.moves

    def compiled(self, state: int, symbol: int) -> tuple[int, int]:
        letter = chr(symbol)
        grown = [(spelt + letter, token, less) for spelt, token, less in self.items[state]]
        last, emitted = next((spelt, less + 1) for spelt, token, less in grown
                             if spelt in self.tokens_of and self.left_alone(token, spelt))
        items = [(spelt, token, less - emitted) for spelt, token, less in grown if spelt in self.begun]
        move = self.state((*items, ("", last, 0))) if symbol < LAST else 0, emitted
        self.moves[state << 9 | symbol] = move
        return move

    def left_alone(self, before: str, token: str) -> bool:
        """Whether merging the letters of both gives just these two tokens again."""
        if (known := self.alone.get((before, token))) is None:
            known = self.alone[before, token] = self.merged(before + token) == [t for t in (before, token) if t]
        return known

    def merged(self, letters: str) -> list[str]:
        parts, far = list(letters), len(self.rank)
        while len(parts) > 1:
            ranks = [self.rank.get(pair, far) for pair in zip(parts, parts[1:])]
            if (least := min(ranks)) == far:
                break
            i = ranks.index(least)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts


def byte_letter(b: int) -> str:
    """The printable letter that stands for a byte: itself, or the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return chr(b) if b in plain else chr(256 + b - sum(p < b for p in plain))
