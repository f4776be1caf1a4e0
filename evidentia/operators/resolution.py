"""Resolving references against known targets, with an explicit status for every outcome."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edge_changes(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one of two edge sets has, with ``change`` added or removed: one aggregation of the union, combined before its shuffle."""
    sides = before.select(*keys, F.lit(True).alias("_b"), F.lit(False).alias("_a")).unionByName(after.select(*keys, F.lit(False).alias("_b"), F.lit(True).alias("_a")))
    seen = sides.groupBy(*keys).agg(F.bool_or("_b").alias("_b"), F.bool_or("_a").alias("_a")).where("_a <> _b")
    return seen.select(*keys, F.when(F.col("_a"), "added").otherwise("removed").alias("change"))


def candidate_status(rows: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """Per key: how many distinct targets it has, ``resolved`` with that target if one, else ``ambiguous`` or ``unresolved`` without."""
    found = rows.groupBy(*keys).agg(F.count_distinct(target).alias("candidate_count"), F.min(target).alias("_target"))
    status = F.when(F.col("candidate_count") == 1, "resolved").when(F.col("candidate_count") > 1, "ambiguous").otherwise("unresolved")
    return found.select(*keys, "candidate_count", status.alias("status"), F.when(F.col("candidate_count") == 1, F.col("_target")).alias("target"))


def exact_lineage(removed: DataFrame, added: DataFrame, fingerprint: str, item: str) -> DataFrame:
    """Per removed item: how many added items have its fingerprint, and the one successor if it is unique.

    The added side is counted per fingerprint first, so a fingerprint that many rows share is never expanded into pairs.
    """
    found = added.groupBy(fingerprint).agg(F.count("*").alias("candidate_count"), F.min(item).alias("_first"))
    lineage = F.when(F.col("candidate_count") == 1, "unique").otherwise("ambiguous")
    return removed.join(found, fingerprint).select(item, "candidate_count", lineage.alias("lineage"), F.when(F.col("candidate_count") == 1, F.col("_first")).alias("successor"))


def first_match(references: DataFrame, targets: DataFrame, reference: str, candidates: Column, target_key: str, target: str) -> DataFrame:
    """Left join of references to the target of their best-ranked candidate; ``candidates`` is an array of (rank, path)."""
    tried = references.select(reference).distinct().select(reference, F.inline(candidates))
    best = tried.join(targets.select(F.col(target_key).alias("path"), F.col(target).alias("_t")), "path").groupBy(reference).agg(F.min(F.struct("rank", "_t")).alias("_m"))
    return references.join(best, reference, "left").select(*references.columns, F.col("_m.rank").alias("match_rank"), F.col("_m._t").alias("target"), F.when(F.col("_m").isNull(), "unresolved").otherwise("resolved").alias("status"))


def longest_prefix(rows: DataFrame, text: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Adds the target of the longest rule prefix that a text starts with, the smaller pattern at a tie; rules are a fixed list, so no join is needed."""
    out = F.lit(None).cast("string")
    for pattern, to in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        out = F.when(F.col(text).startswith(pattern), F.lit(to)).otherwise(out)
    return rows.withColumn("mapped", out)


def freshness(references: DataFrame, current: DataFrame, key: str, basis: Sequence[str], fingerprint: str) -> DataFrame:
    """One status per reference by an ordered ladder: target missing, a basis column that differs, fingerprint differs, current."""
    now = current.select(F.col(key), F.lit(True).alias("_there"), *[F.col(c).alias(f"_now_{c}") for c in (*basis, fingerprint)])
    reason = F.when(F.col("_there").isNull(), "target-missing")
    for c in basis:
        reason = reason.when(~F.col(c).eqNullSafe(F.col(f"_now_{c}")), f"{c}-changed")
    reason = reason.when(~F.col(fingerprint).eqNullSafe(F.col(f"_now_{fingerprint}")), "fingerprint-mismatch").otherwise("fingerprint-match")
    status = F.when(F.col("reason") == "target-missing", "unresolved").when(F.col("reason") == "fingerprint-match", "current").otherwise("stale")
    return references.join(now, key, "left").select(key, reason.alias("reason")).withColumn("status", status)
