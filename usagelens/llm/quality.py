"""Quality rules as a short-circuit cascade, in built-in functions only.

Each rule is a boolean expression that is true for a text to reject. On a sample, each rule's cost
(seconds to evaluate it over the sample) and selectivity (share that it rejects) are measured; the
cascade tests the rules in the order of rejections per cost, and the first that rejects ends it.
The order changes the work, never the verdict: a text is kept if no rule rejects it. What only a rule
needs (distinct words, letters, capitals, line counts) is computed inside its condition, so that a text
rejected earlier doesn't pay for it; the base columns are results and computed for every text.

The sample is those ``SAMPLE_ROWS`` rows whose hash is smallest, wherever they lie, of texts of at most
``SAMPLE_BYTES`` bytes; it stays on the executors. Only the rules' order depends on it.

Words are the runs outside ``[\\x20\\x09-\\x0D]``. A line counts if it has a word. A null text is
empty: no words, so ``base_failed`` (and not kept). Repeated rows, null ids: each row for itself.
Empty table: empty result, rules in their written order. Very long texts are arrays within a row.
Other columns are kept, result columns replace ones of the same name.
"""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, stored

SYMBOLS = "#*$%&|<>"
#: Rows on which cost and selectivity are estimated.
SAMPLE_ROWS = 1_000
SAMPLE_BYTES = 65_536
#: Times that the sample is read in one timed job, so that a rule's own cost shows beside the job's.
TIMES = 20


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _without(text: Column, characters: str) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), characters, text)


def _bytes_of(text: Column, characters: str) -> Column:
    """How many of these (ASCII) characters the text holds."""
    return (F.octet_length(text) - F.octet_length(_without(text, characters))).cast("long")


def words(text: Column) -> Column:
    """The array of words, in order."""
    plain = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), "\t\n\x0b\x0c\r", text)
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _repeated(windows: Column) -> Column:
    """Words covered by windows of three that occur twice or more; ``windows`` has a hash for each position."""

    def covered(ranked: Column) -> Column:
        def again(x: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(ranked, i - 1)["h"] == x["h"]).otherwise(False)
            after = F.when(i + 1 < F.size(ranked), F.get(ranked, i + 1)["h"] == x["h"]).otherwise(False)
            return before | after

        places = F.filter(ranked, again)
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2)))))

    ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    # most texts repeat no window, and need no sorting to show it
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(ranked, covered))


def _windows(w: Column) -> Column:
    n = F.size(w)
    whole = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(n >= 3, whole).otherwise(F.array().cast("array<bigint>"))


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _lines(text: Column) -> Column:
    """The array of lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.octet_length(_without(x, " \t\n\x0b\x0c\r")) > 0)


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with the base columns, each text's words split once."""
    by_word, kept = free_name("by_word", docs.columns), [c for c in docs.columns if c not in (*BASE, "kept")]
    of_words = let(
        words(_text()), lambda w: F.struct(F.size(w).cast("long").alias("n"), let(_windows(w), _repeated).cast("long").alias("again"))
    )
    out = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        of_words.alias(by_word),
        F.length(_without(_text(), " \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
        _bytes_of(_text(), SYMBOLS).alias("n_symbols"),
        let(_lines(_text()), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )
    out = out.withColumn("n_words", F.col(by_word)["n"]).withColumn("n_repeat_words", F.col(by_word)["again"])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).select(*[F.col(f"`{c}`") for c in kept], *BASE)


def _letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))


def default_rules() -> dict[str, Column]:
    """Name to the condition that rejects; over the text and the columns of ``measures``."""
    text, n = _text(), F.greatest(F.col("n_words"), F.lit(1))

    def mostly_repeated(lines: Column) -> Column:
        return (F.size(lines) >= 4) & (2 * F.col("n_dup_lines") > F.size(lines))

    return {
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        # most texts repeat no line, and need no counting of their lines
        "repeated_lines": F.when(F.col("n_dup_lines") > 0, let(_lines(text), mostly_repeated)).otherwise(False),
        "few_distinct_words": 100 * F.size(F.array_distinct(words(text))) < 15 * F.least(n, F.lit(500)),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
        "shouting": 10 * _bytes_of(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ") > 3 * F.col("word_chars"),
        "exclamations": 10 * _bytes_of(text, "!") > F.col("n_words"),
        "letters": 2 * _letters(text) < F.col("word_chars"),
    }


def _sample(docs: DataFrame, rows: int) -> DataFrame:
    """Base columns and text of the rows whose hash is among the ``rows`` smallest: hashes go to the driver, texts don't."""
    texts = docs.select(F.xxhash64(*[c for c, kind in docs.dtypes if not kind.startswith("map")]).alias("hash"), F.col("text").cast("string").alias("text"))
    texts = texts.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)
    least = texts.select("hash").orderBy("hash").limit(rows).agg(F.max("hash")).first()[0]
    chosen = texts.where(F.lit(False) if least is None else F.col("hash") <= least).limit(rows)  # equal rows have one hash
    return stored(measures(chosen.select("text")), "quality-sample")


def order_rules(docs: DataFrame, rules: dict[str, Column], sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, share rejected, seconds) on a sample, by rejections per second; ties in the written order."""
    sample = _sample(docs, sample_rows)
    n, *rejected = sample.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(rule.cast("int")), F.lit(0)) for rule in rules.values()]).first()
    often = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(TIMES))))

    def seconds(rule: Column) -> float:
        start = time.perf_counter()
        often.agg(F.sum(rule.cast("int") + F.col("again"))).first()
        return time.perf_counter() - start

    empty = min(seconds(F.length("text") < 0) for _ in range(2))
    found = [(name, r / max(n, 1), max(seconds(rule) - empty, 1e-3)) for (name, rule), r in zip(rules.items(), rejected, strict=True)]
    return sorted(found, key=lambda x: -x[1] / x[2])


def quality_cascade(docs: DataFrame, rules: dict[str, Column] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept."""
    rules = default_rules() if rules is None else rules
    verdict = F.when(F.col("base_failed"), F.lit(False))
    for name, _, _ in order_rules(docs, rules, sample_rows):
        verdict = verdict.when(rules[name], F.lit(False))
    return measures(docs).withColumn("kept", verdict.otherwise(F.lit(True)))
