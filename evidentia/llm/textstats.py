"""Text statistics as Spark column expressions. ``with_words`` and ``with_stats`` keep each shared array as a column of its own, so it is computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Java and RE2 class of the white space that separates words.
BLANK = r"[ \t\n\x0B\f\r]+"
NOT_BLANK = r"[^ \t\n\x0B\f\r]"
SYMBOLS = "[#*$%&|<>]"


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(NOT_BLANK))


def fixed(rows: DataFrame, without: list[str], *added: Column) -> DataFrame:
    """Adds columns that a filter above can't be pushed through: it would repeat their expressions inside one another."""
    kept = [c for c in rows.columns if c not in without]
    return rows.select(*kept, F.inline(F.array(F.struct(*added))))


def set_aside(docs: DataFrame, added: tuple[str, ...], inner: tuple[str, ...], *used: str) -> tuple[DataFrame, dict[str, str], list[str]]:
    """``docs`` without the columns of ``added`` names, and with other names for columns that are called, in any case, like an operator's own ones.

    Also gives the new names with the old ones, for :func:`put_back`, and the names that the ``used`` columns have now.
    """
    kept = [c for c in docs.columns if c.lower() not in {a.lower() for a in added}]
    taken, names = {c.lower() for c in (*kept, *added, *inner)}, {}
    for column in kept:
        if column.lower() in {i.lower() for i in inner}:
            new = f"_{column}"
            while new.lower() in taken:
                new = f"_{new}"
            taken.add(new.lower())
            names[new] = column
    now = {old: new for new, old in names.items()}
    return docs.select(*[F.col(f"`{c}`").alias(now.get(c, c)) for c in kept]), names, [now.get(u, u) for u in used]


def put_back(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in rows.columns]) if names else rows


def with_words(docs: DataFrame, text: str = "text", into: str = "_w") -> DataFrame:
    """Adds the words of a text (null: none) as an array."""
    return docs.withColumn(into, words(F.coalesce(F.col(text), F.lit(""))))


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOLS)).cast("long")


def word_chars(w: Column) -> Column:
    return F.length(F.array_join(w, "")).cast("long")


def window_hashes(w: Column) -> Column:
    at = lambda i: F.get(w, i)
    return F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))).otherwise(F.array().cast("array<long>"))


def covered_words(s: Column) -> Column:
    """Words in windows whose hash is there twice or more, from sorted (h, i): the windows' hashes and places."""
    same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
    twice = F.filter(s, lambda e, j: ((j > 0) & same(e, j - 1)) | same(e, j + 1))
    places = F.array_sort(F.transform(twice, lambda e: e["i"]))
    zero = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last"))
    return F.aggregate(places, zero, step, lambda acc: acc["n"])


def sorted_windows(h: Column) -> Column:
    """(h, i) in order where a window is there twice, else null."""
    return F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))


def n_repeat_words(w: Column) -> Column:
    return let(window_hashes(w), lambda h: let(sorted_windows(h), lambda s: F.coalesce(covered_words(s), F.lit(0)))).cast("long")


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words; ``_w`` stays for further rules."""
    content = F.coalesce(F.col(text), F.lit(""))
    docs = with_words(docs, text).withColumn("_h", window_hashes(F.col("_w"))).withColumn("_l", lines_with_words(content))
    docs = docs.withColumn("_s", sorted_windows(F.col("_h")))
    return fixed(
        docs, ["_h", "_s", "_l"], F.size("_w").cast("long").alias("n_words"), word_chars(F.col("_w")).alias("word_chars"),
        n_symbols(content).alias("n_symbols"), F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), F.coalesce(covered_words(F.col("_s")), F.lit(0)).cast("long").alias("n_repeat_words"),
    )
