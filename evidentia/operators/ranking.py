"""Additive candidate scores, retention and coalesced occurrences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score(rows: DataFrame, weights: Mapping[str, tuple[Column, int]], base: int) -> DataFrame:
    """Adds ``reasons`` (names of the conditions that hold, in order) and ``score`` (base plus their weights); rows without a reason are dropped."""
    reasons = F.filter(F.array(*[F.when(c, F.lit(name)) for name, (c, _) in weights.items()]), lambda r: r.isNotNull())
    total = F.lit(base)
    for condition, weight in weights.values():
        total = total + F.when(condition, weight).otherwise(0)
    return rows.withColumn("reasons", reasons).withColumn("score", total).where("size(reasons) > 0")


def top(rows: DataFrame, k: int, tie: str) -> DataFrame:
    return rows.orderBy(F.desc("score"), tie).limit(k)


def retention(rows: DataFrame, key: str, before: Column, after: Column, changed: Column) -> DataFrame:
    """removed, added, changed or retained for every key, from which rows of it each snapshot has."""
    flags = rows.groupBy(key).agg(F.bool_or(before).alias("b"), F.bool_or(after).alias("a"), F.bool_or(changed).alias("c"))
    status = F.when(F.col("b") & ~F.col("a"), "removed").when(~F.col("b") & F.col("a"), "added").when(F.col("c"), "changed").otherwise("retained")
    return flags.where("a or b").select(key, status.alias("retention"))


def coalesce_occurrences(rows: DataFrame, keys: Sequence[str], count: Column | None = None) -> DataFrame:
    """Identical records once, with the sum of their occurrence counts."""
    return rows.groupBy(*keys).agg(F.sum(F.lit(1) if count is None else count).cast("long").alias("occurrence_count"))
