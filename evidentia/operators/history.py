"""Ranking the commits after a revision that is known to be good by what they change; a rank is no claim of a cause."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base of a score, what one hit adds once, and what every changed file adds.
BASE = 10
ONCE = {"focus": 100, "cone": 60, "entry": 60, "test": 25}
EACH = {"focus": 35, "cone": 20}
REASONS = {"focus": "changes-focus-path", "cone": "changes-dependency-cone", "entry": "changes-entry", "test": "changes-related-test"}
AFTER = "introduced-after-last-known-good"


def rank_commits(changes: DataFrame, paths: DataFrame, after_position: int, limit: int = 64) -> DataFrame:
    """sha, score, reasons, changed_paths (how many of interest), total (candidates before the bound), best first, ties by sha.

    ``changes``: sha, position (0 is the newest), path; only commits newer than ``after_position`` count. ``paths``: path,
    role (focus, cone, entry, test); a focus path is in the cone as well. A commit without a reason is no candidate.
    """
    focus = paths.where("role = 'focus'").select("path", F.lit("cone").alias("role"))
    roles = paths.select("path", "role").unionByName(focus).distinct()
    hits = changes.where(F.col("position") < after_position).select("sha", "path").distinct().join(roles, "path")
    per_role = hits.groupBy("sha").agg(*[F.count_if(F.col("role") == r).alias(r) for r in ONCE], F.count_distinct("path").alias("changed_paths"))
    score = F.lit(BASE)
    for role, weight in ONCE.items():
        score = score + F.when(F.col(role) > 0, weight).otherwise(0)
    for role, weight in EACH.items():
        score = score + F.col(role) * weight
    reasons = F.filter(F.array(*[F.when(F.col(r) > 0, F.lit(text)) for r, text in REASONS.items()]), lambda r: r.isNotNull())
    scored = per_role.select("sha", score.cast("long").alias("score"), F.concat(reasons, F.array(F.lit(AFTER))).alias("reasons"), "changed_paths")
    total = scored.agg(F.count("*").alias("total"))
    # One row with the count beside at most ``limit`` rows.
    return scored.orderBy(F.desc("score"), "sha").limit(limit).join(F.broadcast(total))


def first_parent_range(commits: DataFrame, head: str, base: str, limit: int = 100_000) -> DataFrame:
    """One row: status (in-lineage, out-of-lineage, truncated) of ``base`` among the first-parent ancestors of ``head``, and how many commits lie between.

    ``commits``: sha, position along the first-parent line that ends at the newest commit.
    """
    at = commits.agg(F.min(F.when(F.col("sha") == head, F.col("position"))).alias("h"), F.min(F.when(F.col("sha") == base, F.col("position"))).alias("b"))
    status = F.when(F.col("h").isNull() | F.col("b").isNull() | (F.col("b") < F.col("h")), "out-of-lineage").when(F.col("b") - F.col("h") > limit, "truncated").otherwise("in-lineage")
    return at.select(status.alias("status"), F.when(F.col("b") >= F.col("h"), F.col("b") - F.col("h")).alias("distance"))
