"""Whether recorded good states still apply, by an ordered ladder; and rows that a store lacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_rows(rows: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows that an insert which ignores known keys appends: one for each key that is not stored, the least where several share a key; a null key is a key."""
    others = [c for c in rows.columns if c not in keys]
    flat = F.struct(*others) if others else F.lit(1)
    once = rows.groupBy(*keys).agg(F.min(flat).alias("_m")).select(*keys, *[F.col(f"_m.{c}").alias(c) for c in others]).select(*rows.columns)
    known = stored.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return once.join(known, on, "left_anti")


def applicability(candidates: DataFrame, contexts: DataFrame, observations: DataFrame, versions: DataFrame, lineage: DataFrame) -> DataFrame:
    """candidate, status, reason of recorded good states, the first rung of the ladder that fails, else applicable.

    ``candidates``: candidate, context, repository, project, definition, basis, expected, integrity, observation, graph_version,
    graph_id, revision, contract. ``contexts``: context with the repository, project, definition, basis, expected and contract of
    now. ``observations``: observation, project, graph_version, revision, dirty. ``versions``: graph_version, graph_id, contract.
    ``lineage``: revision, the commits from the current one back along first parents.
    """
    now = contexts.select("context", *[F.col(c).alias(f"_now_{c}") for c in ("repository", "project", "definition", "basis", "expected", "contract")])
    seen = observations.select("observation", F.col("project").alias("_o_project"), F.col("graph_version").alias("_o_version"), F.col("revision").alias("_o_revision"), F.col("dirty").alias("_o_dirty"))
    graphs = versions.select("graph_version", F.col("graph_id").alias("_g_id"), F.col("contract").alias("_g_contract"))
    commits = lineage.select("revision", F.lit(True).alias("_on_line")).distinct()
    rows = candidates.join(now, "context", "left").join(seen, "observation", "left").join(graphs, "graph_version", "left").join(commits, "revision", "left")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    observed = same("_o_project", "project") & same("_o_version", "graph_version") & same("_o_revision", "revision") & F.coalesce(~F.col("_o_dirty"), F.lit(False))
    ladder = [
        (~(same("repository", "_now_repository") & same("project", "_now_project")), "repository-mismatch", "repository-identity-mismatch"),
        (~(same("definition", "_now_definition") & same("basis", "_now_basis") & same("expected", "_now_expected")), "context-basis-mismatch", "context-definition-or-expected-behavior-changed"),
        (F.coalesce(F.col("integrity") != "complete", F.lit(True)), "basis-unavailable", "integrity-incomplete"),
        (F.col("observation").isNull() | F.col("graph_version").isNull(), "basis-unavailable", "graph-basis-unavailable"),
        (~observed, "basis-unavailable", "observation-unavailable-or-mismatched"),
        (F.col("_g_id").isNull(), "basis-unavailable", "graph-contract-unavailable"),
        (F.col("contract").isNull(), "basis-unavailable", "evidence-contract-unavailable"),
        (~(same("graph_id", "_g_id") & same("contract", "_g_contract") & same("contract", "_now_contract")), "contract-incompatible", "evidence-contract-incompatible"),
        (F.col("_on_line").isNull(), "out-of-lineage", "revision-not-on-first-parent-lineage"),
    ]
    step = F.when(F.lit(False), F.struct(F.lit("").alias("status"), F.lit("").alias("reason")))
    for condition, status, reason in ladder:
        step = step.when(condition, F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason")))
    return rows.select("candidate", step.otherwise(F.struct(F.lit("applicable").alias("status"), F.lit("").alias("reason"))).alias("s")).select("candidate", "s.*")
