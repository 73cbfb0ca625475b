"""Quality rules as a short-circuit cascade.

Each rule is a Spark condition that rejects a document. On a sample the share that each rule
rejects is counted and the time it takes is measured; rules then run in order of rejections per
second, and a document that one rule rejects is not put to the next. The order decides the
work, not the verdict: a document is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepkit.llm.scratch import stored
from prepkit.llm.text import words

SYMBOLS = "#*$%&|<>"
BLANK_CHARS = " \t\n\x0b\x0c\r"
WINDOW = 8
#: The sample on which rules are measured: so many rows at most.
SAMPLE_ROWS, SAMPLE_SHARE = 1_000, 0.01


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns, and ``n_words``, ``word_chars`` (code points in words), ``n_symbols``,
    ``n_dup_lines`` (lines with a word that equal an earlier line), ``n_repeat_words`` (words in
    windows of eight that the text holds at least twice) and ``base_failed`` (under 20 words, or
    over 30 % repeated ones).

    NULL, empty and blank texts count as no words. Columns of the input with these names are
    replaced. Windows of a text are told apart by 64-bit hashes.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.translate(x, BLANK_CHARS, "") != "")
    # Each step is a column of its own, so that what it uses twice is computed once.
    wide = docs.withColumn(HASHES, F.transform(words(whole), lambda w: F.xxhash64(w)))
    wide = wide.withColumn("n_words", F.size(HASHES).cast("long"))
    for width in (1, 2, 4):  # neighbours of one, two and four words make windows of eight
        n = F.greatest(F.size(HASHES) - width, F.lit(0))
        wide = wide.withColumn(HASHES, F.zip_with(
            F.slice(HASHES, 1, n), F.slice(HASHES, width + 1, n), lambda a, b: F.xxhash64(a, b)))
    wide = wide.withColumn(AGAIN, F.size(F.array_distinct(HASHES)) < F.size(HASHES))
    # Repeated windows stand together when sorted by hash. Their places, sorted, cover eight
    # words each or the way to the next one.
    wide = wide.withColumn(PLACED, F.when(F.col(AGAIN), F.sort_array(F.transform(
        HASHES, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    twins = F.filter(F.zip_with(PLACED, F.slice(PLACED, 2, F.size(PLACED)), lambda a, b: F.struct(
        a["i"].alias("i"), b["i"].alias("j"), (a["h"] == b["h"]).alias("same"))), lambda p: p["same"])
    wide = wide.withColumn(PLACED, F.sort_array(F.array_distinct(F.flatten(
        F.transform(twins, lambda p: F.array(p["i"], p["j"]))))))
    steps = F.zip_with(PLACED, F.slice(PLACED, 2, F.size(PLACED)), lambda a, b: F.least(
        F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    repeated = F.when(F.col(AGAIN), F.aggregate(steps, F.lit(0), lambda total, x: total + x)).otherwise(0)
    out = wide.withColumns({
        "word_chars": F.char_length(F.translate(whole, BLANK_CHARS, "")).cast("long"),
        "n_symbols": F.regexp_count(whole, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated.cast("long"),
    }).drop(HASHES, AGAIN, PLACED)
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30))


HASHES, AGAIN, PLACED = "__windows", "__again", "__placed"


def rules(text: Column) -> dict[str, Column]:
    """Conditions that reject, over the measured columns and the text. NULL does not reject."""
    n = F.col("n_words")
    return {
        # more than one symbol in five words
        "symbols": F.col("n_symbols") * 100 > n * 20,
        # more than a third of the words have a double exclamation mark
        "shouting": F.regexp_count(text, F.lit("!!")) * 100 > n * 33,
        # words of under 2 or over 25 characters on average
        "word_length": (F.col("word_chars") < n * 2) | (F.col("word_chars") > n * 25),
        # more than half of the lines were there before
        "repeated_lines": F.col("n_dup_lines") * 100 > F.size(F.split(text, "\n")) * 50,
        # fewer letters than six in ten characters of words
        "letters": F.regexp_count(text, F.lit(r"\p{L}")) * 100 < F.col("word_chars") * 60,
        # more capitals than small letters
        "capitals": F.regexp_count(text, F.lit(r"\p{Lu}")) > F.regexp_count(text, F.lit(r"\p{Ll}")),
    }


def ordered(sample: DataFrame, rules: Mapping[str, Column]) -> list[str]:
    """The rules by rejections per second of work on the sample, the best first."""
    def seconds(frame: DataFrame) -> float:
        begun = time.perf_counter()
        frame.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begun

    rejected = sample.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()]).first()
    seconds(sample)  # the first reading is not a rule's cost
    idle = seconds(sample)
    cost = {name: max(seconds(sample.where(rule)) - idle, 1e-3) for name, rule in rules.items()}
    return sorted(rules, key=lambda name: -rejected[name] / cost[name])


def judged(docs: DataFrame, text: str = "text", rules: Callable[[Column], Mapping[str, Column]] = rules,
           order: Sequence[str] | None = None) -> DataFrame:
    """All columns, the measured ones, ``failed_rule`` (the first rule of the cascade that
    rejects, NULL if none) and ``kept``: neither the base conditions nor a rule reject.

    Without ``order`` it is fitted on a sample of at most SAMPLE_ROWS documents. A NULL text fails
    the base conditions. An empty table has any order.
    """
    plain = docs.drop("failed_rule", "kept")
    conditions = rules(F.col(text))
    if order is None:
        sample = measured(plain.select(text).sample(SAMPLE_SHARE, seed=7).limit(SAMPLE_ROWS), text)
        order = ordered(stored(sample, "rule-sample"), conditions)
    first = F
    for name in order:  # CASE stops at the first branch that holds
        first = first.when(conditions[name], F.lit(name))
    failed = F.lit(None).cast("string") if first is F else first
    out = measured(plain, text).withColumn("failed_rule", F.when(~F.col("base_failed"), failed))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull())
