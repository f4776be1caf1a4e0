"""Snapshot comparison: one row per key with its change kind, counters over all changes, bounded lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_delta(before: DataFrame, after: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows added, removed or changed between two snapshots, matched on ``keys`` (null-safe) by one full outer join.

    Each input has one row per key. Columns: the keys, ``change`` (added, removed, changed), and for each value
    ``before_<v>`` and ``after_<v>``. Unchanged keys are not returned; two nulls are equal.
    """
    b = before.select(*[F.col(k).alias(f"_b_{k}") for k in keys], *[F.col(v).alias(f"before_{v}") for v in values], F.lit(True).alias("_in_b"))
    a = after.select(*[F.col(k).alias(f"_a_{k}") for k in keys], *[F.col(v).alias(f"after_{v}") for v in values], F.lit(True).alias("_in_a"))
    on = reduce(Column.__and__, [F.col(f"_b_{k}").eqNullSafe(F.col(f"_a_{k}")) for k in keys])
    differs = reduce(Column.__or__, [~F.col(f"before_{v}").eqNullSafe(F.col(f"after_{v}")) for v in values], F.lit(False))
    change = F.when(F.col("_in_b").isNull(), "added").when(F.col("_in_a").isNull(), "removed").when(differs, "changed")
    return (
        b.join(a, on, "full_outer")
        .select(*[F.coalesce(f"_b_{k}", f"_a_{k}").alias(k) for k in keys], change.alias("change"), *[F.col(f"{side}_{v}") for v in values for side in ("before", "after")])
        .where("change is not null")
    )


def delta_counts(delta: DataFrame) -> DataFrame:
    """One row: how many keys were added, changed and removed, before any bound on the lists."""
    kinds = ("added", "changed", "removed")
    return delta.agg(*[F.count_if(F.col("change") == k).alias(f"{k}_count") for k in kinds])


def bounded(rows: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows by a total order; the bound is this operator's meaning, counts are taken before it."""
    return rows.orderBy(*order).limit(limit)
