"""A sparse rule ensemble for document quality.

Shallow trees are grown on statistics of labelled documents; every path from a root is a conjunctive rule. A logistic model
with an L1 penalty weights the rules, most weights become zero, and the rest are compiled into one Spark column
expression: scoring is column expressions over whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.textstats import NOT_BLANK, SYMBOLS, fixed, put_back, set_aside, with_words

#: Inputs of a score; ids, languages, sources and labels are none.
FEATURES = ("log_words", "word_length", "symbols", "exclamations", "bars", "digits", "shouted", "distinct", "stutter", "dup_lines")


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds FEATURES (doubles, 0 for a text without words; null text: empty)."""
    content = F.coalesce(F.col(text), F.lit(""))
    docs = with_words(docs, text)
    n = F.greatest(F.size("_w"), F.lit(1))
    share = lambda c: (c / n).cast("double")
    count = lambda pattern: F.regexp_count(content, F.lit(pattern))
    docs = docs.withColumn("_l", F.filter(F.split(content, "\n"), lambda line: line.rlike(NOT_BLANK)))
    return fixed(
        docs, ["_w", "_l"], F.log1p(F.size("_w").cast("double")).alias("log_words"), share(F.length(F.array_join("_w", ""))).alias("word_length"),
        share(count(SYMBOLS)).alias("symbols"), share(count("!")).alias("exclamations"), share(count("[|]")).alias("bars"), share(count("[0-9]")).alias("digits"),
        share(F.size(F.filter("_w", lambda w: (F.upper(w) == w) & (F.lower(w) != w)))).alias("shouted"),
        share(F.size(F.array_distinct("_w"))).alias("distinct"), share(F.size(F.filter("_w", lambda w, i: (i > 0) & (w == F.get("_w", i - 1))))).alias("stutter"),
        ((F.size("_l") - F.size(F.array_distinct("_l"))) / F.greatest(F.size("_l"), F.lit(1))).cast("double").alias("dup_lines"),
    )


@dataclass(frozen=True)
class Model:
    """``rules``: (conditions, weight); a condition is (feature, threshold, whether above)."""

    intercept: float
    rules: tuple[tuple[tuple[tuple[str, float, bool], ...], float], ...]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            holds = reduce(Column.__and__, [F.col(f) > t if above else F.col(f) <= t for f, t, above in conditions])
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def tree_rules(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = 3, trees: int = 20, least: int = 10) -> list[tuple]:
    """Every path of bootstrapped Gini trees over random halves of the features, as tuples of (feature, threshold, above)."""
    found: dict[tuple, None] = {}

    def grow(rows: np.ndarray, features: np.ndarray, path: tuple) -> None:
        if len(path) == depth or len(rows) < 2 * least or y[rows].min() == y[rows].max():
            return
        best, n, total = (1e-9, None, None), len(rows), y[rows].sum()
        parent = total * (n - total) / n
        for f in features:
            values = x[rows, f]
            order = np.argsort(values, kind="stable")
            v, ones = values[order], np.cumsum(y[rows][order])
            at = np.flatnonzero(v[1:] > v[:-1])
            at = at[(at + 1 >= least) & (n - at - 1 >= least)]
            if not len(at):
                continue
            left, hits = at + 1, ones[at]
            impurity = hits * (left - hits) / left + (total - hits) * (n - left - total + hits) / (n - left)
            i = int(impurity.argmin())
            if parent - impurity[i] > best[0]:
                best = (parent - impurity[i], f, float((v[at[i]] + v[at[i] + 1]) / 2))
        if best[1] is None:
            return
        above = x[rows, best[1]] > best[2]
        for side in (False, True):
            rule = (*path, (int(best[1]), best[2], side))
            found[rule] = None
            grow(rows[above == side], features, rule)

    for _ in range(trees):
        rows = rng.integers(0, len(y), min(len(y), 5_000))
        grow(rows, rng.permutation(x.shape[1])[: (x.shape[1] + 1) // 2], ())
    return list(found)


def lasso_logistic(hits: np.ndarray, y: np.ndarray, penalty: float = 2e-3, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of least mean log loss + penalty * |weights|, by accelerated proximal gradient steps."""
    n, m = hits.shape
    rate = 4.0 / (np.linalg.norm(np.c_[np.ones(n), hits], 2) ** 2 / n)
    w, z, b, zb, t = np.zeros(m), np.zeros(m), 0.0, 0.0, 1.0
    for _ in range(steps):
        off = 1 / (1 + np.exp(-np.clip(hits @ z + zb, -30, 30))) - y
        new_w = z - rate * (hits.T @ off) / n
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - rate * penalty, 0)
        new_b = zb - rate * off.mean()
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z, zb = new_w + (old - 1) / t * (new_w - w), new_b + (old - 1) / t * (new_b - b)
        w, b = new_w, new_b
    return float(b), w


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """A model from feature rows and 0/1 labels; without rows or with one class the score is constant."""
    if len(y) == 0 or y.min() == y.max():
        return Model(0.0 if len(y) == 0 else (4.0 if y[0] else -4.0), ())
    paths = tree_rules(x, y, np.random.default_rng(seed))
    if not paths:
        share = y.mean()
        return Model(float(np.log(share / (1 - share))), ())
    holds = lambda path: np.logical_and.reduce([x[:, f] > t if above else x[:, f] <= t for f, t, above in path])
    intercept, weights = lasso_logistic(np.stack([holds(p) for p in paths], 1).astype(np.float64), y)
    named = lambda path: tuple((FEATURES[f], t, above) for f, t, above in path)
    return Model(intercept, tuple((named(p), float(w)) for p, w in zip(paths, weights, strict=True) if w))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 10_000, text: str = "text") -> Model:
    """A model from at most ``sample_rows`` labelled documents outside the held-out fold, those of the smallest id hashes.

    The bound limits only what the model is fitted on. Rows with a null id or label are not used.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    sample = usable.select("doc_id", F.col("quality").cast("double").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # The sample's size is bounded by the parameter, so it may be broadcast.
    found = docs.select("doc_id", text).join(F.broadcast(sample), "doc_id")
    # A doc_id may have many rows: the sample is bounded again, by rows.
    order = F.xxhash64("doc_id", text, "quality").alias("_order")
    rows = with_features(found.select("*", order), text).select("doc_id", "quality", "_order", *FEATURES).orderBy("_order").limit(sample_rows).toPandas().sort_values(["doc_id", "quality", "_order"])
    return fit(rows[list(FEATURES)].to_numpy(np.float64), rows["quality"].to_numpy(np.float64))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_rows: int = 10_000, text: str = "text") -> DataFrame:
    """Adds held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold, else 0) to every row.

    Null and empty texts are scored as texts without words; a null doc_id is not held out. Columns of ``docs`` with the
    names that are added, in any case, are replaced, all others stay whatever their names.
    """
    docs, names, (text,) = set_aside(docs, ("held_out", "score", "predicted"), (*FEATURES, "_w", "_l"), text)
    model = train(docs, labels, sample_rows, text)
    own = docs.columns
    scored = fixed(with_features(docs.select(*own), text), list(FEATURES), model.score().alias("score"))
    out = scored.select(*own, F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
    return put_back(out, names)
