"""Quality rules as a short-circuit cascade of native expressions.

Every rule is a rejecting condition over the text. On a random sample its
selectivity (share rejected) and its cost (seconds to evaluate, without those of
a job that evaluates nothing) are measured, and the rules are chained by
rejection per cost in one CASE expression, which stops at the first rule that
rejects. The order changes the work, never the verdict.

Defined cases: null and empty texts have no words and fail the base rule;
repeated rows are judged each for itself; an empty table gives no rows; texts
are judged whole; other columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .shared import materialize, release

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
SAMPLE_ROWS = 400
SAMPLE_BYTES = 1 << 15
TIMED_ROWS = 3000
LEAST_COST = 1e-3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(F.filter(F.split(text, "\n"), lambda x: without(x, SPACES) != ""), lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))


def window_hashes(listed: Column) -> Column:
    """Hashes of all runs of 8 words, by doubling: pairs, pairs of pairs, and those again."""

    def doubled(hashes: Column, step: int) -> Column:
        n = F.size(hashes) - step
        return F.when(n > 0, F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, step + 1, n), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(listed, lambda w: F.xxhash64(w)), lambda h1: let(doubled(h1, 1), lambda h2: let(doubled(h2, 2), lambda h4: doubled(h4, 4))))


def repeated_words(hashes: Column) -> Column:
    """Words in windows that occur twice or more, from the hashes of all windows."""

    def covered(places: Column) -> Column:
        n = F.size(places) - 1
        gaps = F.zip_with(F.slice(places, 1, n), F.slice(places, 2, n), lambda a, b: F.least(b - a, F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(WINDOW), lambda total, gap: total + gap)

    def places(ordered: Column) -> Column:
        n = F.size(ordered)

        def repeated(x: Column, i: Column) -> Column:
            return F.coalesce(F.get(ordered, i - 1).h == x.h, F.lit(False)) | F.coalesce(F.get(ordered, i + 1).h == x.h, F.lit(False))

        marked = F.transform(ordered, lambda x, i: F.when(repeated(x, i), x.i))
        return F.when(n > 0, F.array_sort(F.filter(marked, lambda p: p.isNotNull())))

    exact = let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), lambda ordered: let(places(ordered), covered))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(exact)


def base_columns(docs: DataFrame) -> DataFrame:
    """doc_id, text, the base counts and base_failed."""
    text = F.coalesce("text", F.lit(""))
    listed = docs.select("doc_id", text.alias("text"), words(text).alias("words"))
    counted = listed.select(
        "doc_id",
        "text",
        F.size("words").cast("long").alias("n_words"),
        F.length(without(F.col("text"), SPACES)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        n_dup_lines(F.col("text")).cast("long").alias("n_dup_lines"),
        let(window_hashes(F.col("words")), repeated_words).cast("long").alias("n_repeat_words"),
    )
    return counted.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


@dataclass(frozen=True)
class Rule:
    """A name and the condition, over base_columns, under which a text is rejected."""

    name: str
    rejects: Column


def default_rules() -> list[Rule]:
    n = F.col("n_words")
    text = F.col("text")
    no_letters = F.length(text) - F.length(F.regexp_replace(text, "[^\\p{L}\\s]", ""))
    listed = F.filter(F.split(text, "\n"), lambda x: without(x, SPACES) != "")
    lines = F.size(listed)

    def share(pattern: str, tenths: int, *marks: str) -> Column:
        """More than so many tenths of the lines match; lines are only made where the text holds one of the marks."""
        held = text.contains(marks[0])
        for mark in marks[1:]:
            held |= text.contains(mark)
        return held & let(listed, lambda x: 10 * F.size(F.filter(x, lambda line: line.rlike(pattern))) > tenths * F.size(x))

    return [
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 14 * n)),
        Rule("duplicate_lines", 2 * F.col("n_dup_lines") > lines),
        Rule("letters", 10 * no_letters > 4 * F.col("word_chars")),
        Rule("bullets", share("^[\\x20\\x09]*[-*•]", 9, "-", "*", "•")),
        Rule("ellipses", share("(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$", 3, "...", "…")),
    ]


def rule_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 11) -> DataFrame:
    """Base columns of about ``rows`` random rows of the table (at most twice as many), of texts of up to SAMPLE_BYTES; written once, in one part."""
    share = min(1.0, rows / max(1, docs.count()))
    chosen = docs.select("doc_id", "text").where(F.octet_length("text") <= SAMPLE_BYTES).sample(False, share, seed).limit(2 * rows)
    return materialize(base_columns(chosen).where("NOT base_failed"), "rule-sample")


def net_costs(sample: DataFrame, rules: list[Rule], n: int) -> list[float]:
    """Seconds that each rule takes on about TIMED_ROWS rows, repeated from the sample, beyond a rule that is constant; the least of three runs."""
    repeats = F.explode(F.sequence(F.lit(1), F.lit(max(1, TIMED_ROWS // n))))
    rows = sample.withColumn("__repeat", repeats).drop("__repeat")

    def seconds(condition: Column) -> float:
        taken = []
        for _ in range(3):
            began = time.perf_counter()
            rows.agg(F.count(F.when(condition, 1)), F.max(F.length("text"))).first()
            taken.append(time.perf_counter() - began)
        return min(taken)

    bare = seconds(F.col("n_words") < 0)
    return [max(LEAST_COST, seconds(r.rejects) - bare) for r in rules]


def ordered_rules(sample: DataFrame, rules: list[Rule]) -> list[Rule]:
    """The rules by rejection per cost, both measured on the sample; a rule that rejects nothing there counts as half a row."""
    found = sample.agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(r.rejects, 1)).alias(f"r{i}") for i, r in enumerate(rules))).first()
    if not rules or not found["n"]:
        return rules
    costs = net_costs(sample, rules, found["n"])
    gain = {r.name: max(found[f"r{i}"], 0.5) / costs[i] for i, r in enumerate(rules)}
    return sorted(rules, key=lambda r: (-gain[r.name], r.name))


def judge(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the base columns, kept and failed_rule (null where kept or where the base failed)."""
    rules = default_rules() if rules is None else rules
    base = base_columns(docs)
    sample = rule_sample(docs, sample_rows)
    rules = ordered_rules(sample, rules)
    release(docs.sparkSession, sample)
    first = F.lit(None).cast("string")
    if rules:
        chain = F.when(F.col("base_failed"), F.lit(None).cast("string"))
        for r in rules:
            chain = chain.when(r.rejects, F.lit(r.name))
        first = chain
    judged = base.withColumn("failed_rule", first)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return judged.select("doc_id", *counts, (~F.col("base_failed") & F.col("failed_rule").isNull()).alias("kept"), "failed_rule")
