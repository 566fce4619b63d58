"""Quality rules as a short-circuit cascade, all in DataFrame expressions.

The features of the contract (words, symbols, repeated lines, repeated word
trigrams) are computed for every row, which must have them; rules on them alone cost
nothing more. The verdict runs through all rules in one CASE: a rule is evaluated
only for rows that passed all rules before it. Their order comes from a sample: each rule's seconds and share of rejected rows
are measured, and rules run by rejection per cost, highest first. The order
changes the cost, never the verdict.

Null and empty texts have no words and fail the base rules. Repeated rows are
judged one by one. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space between words and the symbols counted.
SPACES = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """Thresholds of the verdict; min_words and max_repeat_percent are the base rules."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbols_percent: int = 10
    max_dup_lines_percent: int = 60
    min_mean_word: int = 2
    max_mean_word: int = 20
    max_ellipsis_percent: int = 30
    min_letter_percent: int = 70
    max_bullet_percent: int = 90


def word_list(text: Column) -> Column:
    """Maximal runs of characters other than the six ASCII white-space characters."""
    return F.filter(F.split(text, SPLIT), lambda w: w != "")


def has_word(line: Column) -> Column:
    return F.translate(line, SPACES, "") != ""


def let(value: Column, body) -> Column:
    """body(value) with value computed once; a column named in a lambda may be inlined and recomputed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trigram_hashes(words: Column) -> Column:
    return let(words, lambda ws: F.when(F.size(ws) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))))


def covered_words(hashes: Column) -> Column:
    """Words in trigrams found twice or more, from the trigram hashes in text order.

    Equal hashes are brought together by sorting (hash, position) pairs.
    """
    def count(s: Column) -> Column:
        twice = F.filter(s, lambda e, j: F.coalesce(F.get(s, j - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda e: F.sequence(e["i"], e["i"] + 2)))))

    def checked(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, count))

    return let(hashes, checked)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, text, words, lines and the counts of the contract for every row."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", "text", word_list(F.col("text")).alias("words"), F.filter(F.split("text", "\n"), has_word).alias("lines"))
    return d.select(
        "doc_id", "text", "words", "lines", F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered_words(trigram_hashes(F.col("words"))).cast("long").alias("n_repeat_words"),
    )


def base_failed(limits: Limits) -> Column:
    return (F.col("n_words") < limits.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * limits.max_repeat_percent)


def rules(limits: Limits) -> dict[str, Column]:
    """True where a row fails; each rule reads the columns of features() only."""
    share = lambda part, whole, percent: part * 100 > whole * percent
    n_lines = F.size("lines")
    return {
        "symbols": share(F.col("n_symbols"), F.col("n_words"), limits.max_symbols_percent),
        "dup_lines": share(F.col("n_dup_lines"), n_lines, limits.max_dup_lines_percent),
        "word_length": (F.col("word_chars") < F.col("n_words") * limits.min_mean_word) | (F.col("word_chars") > F.col("n_words") * limits.max_mean_word),
        "ellipsis": share(F.size(F.filter("lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))), n_lines, limits.max_ellipsis_percent),
        "bullets": share(F.size(F.filter("lines", lambda x: F.ltrim(x).rlike("^[-*•]"))), n_lines, limits.max_bullet_percent),
        "letters": F.size(F.filter("words", lambda w: w.rlike(r"\p{L}"))) * 100 < F.col("n_words") * limits.min_letter_percent,
    }


def rule_order(docs: DataFrame, limits: Limits, sample_rows: int = 2000, seed: int = 7) -> list[str]:
    """Rules by rejection per cost on about sample_rows rows, highest first; ties by name."""
    total = docs.count()
    if total == 0:
        return sorted(rules(limits))
    kept = sample = features(docs.sample(fraction=min(1.0, sample_rows / total), seed=seed)).persist()
    try:
        n, sample = sample.count(), sample.filter(~base_failed(limits))

        def measured(c: Column) -> tuple[float, int]:
            began = time.monotonic()
            hit = sample.agg(F.sum(c.cast("int"))).first()[0] or 0
            return time.monotonic() - began, hit

        idle = min(measured(F.lit(False))[0] for _ in range(2))
        gain = {}
        for name, rule in rules(limits).items():
            seconds, hit = measured(rule)
            gain[name] = (hit / max(n, 1)) / max(seconds - idle, 1e-3)
    finally:
        kept.unpersist()
    return sorted(gain, key=lambda k: (-gain[k], k))


def quality_cascade(docs: DataFrame, limits: Limits = Limits(), sample_rows: int = 2000) -> DataFrame:
    """The contract's columns; kept is false where the base rules or a rule of the cascade reject the row."""
    order, all_rules = rule_order(docs, limits, sample_rows), rules(limits)
    first = F.when(base_failed(limits), F.lit("base"))
    for name in order:
        first = first.when(all_rules[name], F.lit(name))
    out = features(docs).withColumn("base_failed", base_failed(limits)).withColumn("failed_rule", first)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("failed_rule").isNull().alias("kept"))
