"""Quality rules as a short-circuit cascade: on a sample each rule's cost and rejection rate are estimated, and the rules
run in the order of rejections per cost. The order only saves work; a document is kept if no rule rejects it.

Every rule has its own expression over the text and its words, so that what it counts is counted only for documents that
the rules before it let through; and an expression of its work, the characters and list elements that it goes through.
Work is a cost that two runs give alike, unlike times, in which a rule's share drowns in those of reading and scheduling.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.textstats import fixed, let, lines_with_words, n_repeat_words, n_symbols, put_back, set_aside, with_stats, with_words, word_chars

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``rejects`` gives a boolean expression of the text and its words; ``known`` the same where the statistics of STATS
    are columns; ``work`` what ``rejects`` goes through: characters matched or list elements handled."""

    name: str
    rejects: Callable[[Column, Column], Column]
    work: Callable[[Column, Column], Column]
    known: Callable[[], Column] | None = None


def _shouted(text: Column, w: Column) -> Column:
    return 100 * F.size(F.filter(w, lambda x: (F.upper(x) == x) & (F.lower(x) != x))) > 60 * F.size(w)


def _repeated_lines(text: Column, w: Column) -> Column:
    return let(lines_with_words(text), lambda lines: 100 * (F.size(lines) - F.size(F.array_distinct(lines))) > 70 * F.size(lines))


RULES = (
    Rule("symbols", lambda t, w: 100 * n_symbols(t) > 20 * F.size(w), lambda t, w: F.length(t), lambda: 100 * F.col("n_symbols") > 20 * F.col("n_words")),
    Rule(
        "word_length", lambda t, w: let(word_chars(w), lambda n: (n < 2 * F.size(w)) | (n > 20 * F.size(w))), lambda t, w: F.size(w) * 2,
        lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")),
    ),
    Rule("repeated_lines", _repeated_lines, lambda t, w: F.length(t), lambda: 100 * F.col("n_dup_lines") > 70 * F.col("n_lines")),
    Rule("shouted", _shouted, lambda t, w: 2 * F.length(t) + 4 * F.size(w)),
)


def base_failed(n_words: Column, n_repeats: Column) -> Column:
    return (n_words < 50) | (100 * n_repeats > 50 * n_words)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000, text: str = "text") -> list[Rule]:
    """Rules by rejections per work, over the first ``sample_rows`` texts of at least 50 words (a bound of this estimate, not of the result).

    Spark reads partitions until it has so many rows, and only one flag and one number for each rule come to the driver.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    seen = with_words(docs.select(content.alias("_t")), "_t").where(F.size("_w") >= 50)
    of = lambda f, c: f(F.col("_t"), F.col("_w")).cast("double").alias(c)
    sample = seen.select(*[of(r.rejects, f"hit_{k}") for k, r in enumerate(rules)], *[of(r.work, f"work_{k}") for k, r in enumerate(rules)]).take(sample_rows)
    rate = lambda k: sum(r[f"hit_{k}"] for r in sample) / max(1.0, sum(r[f"work_{k}"] for r in sample))
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: (-rate(k), k))]


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000, text: str = "text", statistics: bool = True) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept to every row; without ``statistics`` only kept.

    Null and empty texts have no words and fail the base rules. Repeated rows are judged each; columns of ``docs`` with
    these names, in any case, are replaced, all others stay whatever their names. An empty table gives no rows. Without ``statistics`` nothing is counted for a document that
    an earlier rule has rejected.
    """
    added = (*STATS, "base_failed", "kept") if statistics else ("kept",)
    docs, names, (text,) = set_aside(docs, added, ("_w", "_h", "_s", "_l", "n_lines"), text)
    ordered = order_rules(docs, rules, sample_rows, text)
    own = docs.columns
    if not statistics:
        content, w = F.coalesce(F.col(text), F.lit("")), F.col("_w")
        kept = F.when(F.size(w) < 50, False)
        for rule in ordered:
            kept = kept.when(rule.rejects(content, w), False)
        kept = kept.when(base_failed(F.size(w).cast("long"), n_repeat_words(w)), False)  # the dearest last
        return put_back(fixed(with_words(docs.select(*own), text), ["_w"], kept.otherwise(True).alias("kept")), names)
    stats = with_stats(docs.select(*own), text).withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    kept = F.when(F.col("base_failed"), False)
    for rule in ordered:
        kept = kept.when(rule.known() if rule.known else rule.rejects(F.coalesce(F.col(text), F.lit("")), F.col("_w")), False)
    return put_back(stats.withColumn("kept", kept.otherwise(True)).select(*own, *STATS, "base_failed", "kept"), names)
