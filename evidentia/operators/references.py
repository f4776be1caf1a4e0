"""Freshness of stored references to nodes and flows against the current observation, and candidates for stale ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Contracts:
    """Names of fingerprint scopes and contracts: of nodes as they are made now, and of whole files as they were once."""

    node_scope: str
    node_contract: str
    file_scope: str
    file_contract: str


@dataclass(frozen=True)
class Store:
    """``state``: project_id, observation_id. ``observations``: observation_id, project_id, graph_version, revision, dirty.
    ``nodes``: graph_version, node_id, kind, path, fingerprint. ``sources``: graph_version, path, hash. ``flows``: graph_version, flow_id, fingerprint.
    """

    state: DataFrame
    observations: DataFrame
    nodes: DataFrame
    sources: DataFrame | None = None
    flows: DataFrame | None = None


def revision(revision: str = "revision", dirty: str = "dirty") -> Column:
    return F.concat(revision, F.when(F.col(dirty), "+dirty").otherwise(""))


def current_basis(store: Store) -> DataFrame:
    """project_id, current_observation, current_version, current_revision: what each project's pointer leads to."""
    return store.state.join(store.observations.drop("project_id"), "observation_id").select(
        "project_id", F.col("observation_id").alias("current_observation"), F.col("graph_version").alias("current_version"), revision().alias("current_revision"))


def node_evidence(store: Store) -> DataFrame:
    """Nodes with the hash of their file, null without one."""
    return store.nodes.join(store.sources, ["graph_version", "path"], "left").select("graph_version", "node_id", "kind", "path", "fingerprint", "hash")


def _origins(references: DataFrame, store: Store) -> DataFrame:
    """Adds ``there`` (the origin's observation exists) and ``agrees`` (and is what the reference says), and the current basis."""
    seen = store.observations.select(F.col("observation_id").alias("origin_observation"), F.col("project_id").alias("_p"), F.col("graph_version").alias("_v"), revision().alias("_r"))
    agrees = (F.col("_p") == F.col("project_id")) & (F.col("_v") == F.col("graph_version")) & (F.col("_r") == F.col("origin_revision"))
    rows = references.join(seen, "origin_observation", "left").withColumn("there", F.col("_v").isNotNull()).withColumn("agrees", F.coalesce(agrees, F.lit(False)))
    return rows.drop("_p", "_v", "_r").join(current_basis(store), "project_id", "left")


def context_freshness(references: DataFrame, store: Store, contracts: Contracts, most: int = 32) -> DataFrame:
    """uri, status, reason, candidates, truncated for references to nodes, by an ordered ladder.

    ``references``: uri, project_id, graph_version, node_id, origin_observation, origin_revision, origin_fingerprint, scope, contract.
    A stale reference whose fingerprint other current nodes of its kind have is told by what they are: several, one with a
    compatible reference of its own, or one without. ``candidates`` are the references of such nodes, at most ``most`` in order.
    Candidates are counted and cut per fingerprint before the join, so a fingerprint of many nodes is never expanded.
    """
    evidence = node_evidence(store)
    origin = evidence.select("graph_version", "node_id", F.col("kind").alias("origin_kind"), F.col("fingerprint").alias("_of"), F.col("hash").alias("_oh"))
    now = evidence.select(F.col("graph_version").alias("current_version"), "node_id", F.col("fingerprint").alias("_nf"), F.lit(True).alias("_now"))
    rows = _origins(references, store).join(origin, ["graph_version", "node_id"], "left").join(now, ["current_version", "node_id"], "left")

    is_node, is_file = F.col("scope") == contracts.node_scope, F.col("scope") == contracts.file_scope
    named = (is_node & (F.col("contract") == contracts.node_contract)) | (is_file & (F.col("contract") == contracts.file_contract))
    valid = F.coalesce(named & (F.when(is_file, F.col("_oh")).otherwise(F.col("_of")) == F.col("origin_fingerprint")), F.lit(False))
    empty = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    ladder = [
        (F.col("current_version").isNull(), "unavailable", "current-observation-unavailable"),
        (empty("origin_observation") | empty("origin_fingerprint"), "unresolved", "insufficient-origin-evidence"),
        (~F.col("agrees"), "unavailable", "origin-observation-unavailable"),
        (~valid, "unavailable", "origin-evidence-inconsistent"),
        (F.col("_now").isNull(), "stale", "node-identity-missing"),
        (F.col("contract") != contracts.node_contract, "unresolved", "incompatible-fingerprint-contract"),
        ((F.col("_nf") == F.col("origin_fingerprint")) & (F.col("current_observation") == F.col("origin_observation")), "current", "origin-observation-current"),
        (F.col("_nf") == F.col("origin_fingerprint"), "current", "node-fingerprint-match"),
    ]
    step = F.when(F.lit(False), F.struct(F.lit("").alias("status"), F.lit("").alias("reason")))
    for condition, status, reason in ladder:
        step = step.when(condition, F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason")))
    rows = rows.withColumn("_s", step.otherwise(F.struct(F.lit("stale").alias("status"), F.lit("node-fingerprint-changed").alias("reason"))))

    # Current nodes, each with the references made to it, per kind and fingerprint: how many, the first one, the first references.
    made = references.select(F.col("project_id").alias("project_id"), F.col("graph_version").alias("current_version"), "node_id", F.col("uri").alias("to"), F.col("scope").alias("_ts"), F.col("contract").alias("_tc"), F.col("origin_fingerprint").alias("_tf"))
    nodes = current_basis(store).select("project_id", "current_version").join(evidence.withColumnRenamed("graph_version", "current_version"), "current_version")
    nodes = nodes.select("project_id", "current_version", "node_id", F.col("kind").alias("origin_kind"), F.col("fingerprint").alias("origin_fingerprint")).join(made, ["project_id", "current_version", "node_id"], "left")
    key = ["project_id", "origin_kind", "origin_fingerprint"]
    fits = F.coalesce((F.col("_ts") == contracts.node_scope) & (F.col("_tc") == contracts.node_contract) & (F.col("_tf") == F.col("origin_fingerprint")), F.lit(False))
    found = nodes.groupBy(*key).agg(F.count("*").alias("n_found"), F.min(fits).alias("fits"))
    listed = nodes.where("to is not null").select(*key, "to").distinct().withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("to"))).where(F.col("n") <= most + 1)
    listed = listed.groupBy(*key).agg(F.array_sort(F.collect_list("to")).alias("to"))
    rows = rows.join(found, key, "left").join(listed, key, "left")

    searched = F.coalesce(is_node & (F.col("contract") == contracts.node_contract) & ~empty("origin_fingerprint") & F.col("origin_kind").isNotNull() & F.col("current_version").isNotNull(), F.lit(False))
    stale = searched & F.col("agrees") & (F.col("_s.status") == "stale") & F.col("n_found").isNotNull()
    reason = F.when(stale & (F.col("n_found") > 1), "exact-successor-ambiguous").when(stale & F.col("fits"), "unique-exact-candidate").when(stale, "successor-reference-unavailable").otherwise(F.col("_s.reason"))
    every = F.when(searched, F.coalesce("to", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    return rows.select("uri", F.col("_s.status").alias("status"), reason.alias("reason"), F.slice(every, 1, most).alias("candidates"), (F.size(every) > most).alias("truncated"))


def flow_freshness(references: DataFrame, store: Store) -> DataFrame:
    """uri, status, reason for references to flows: uri, project_id, graph_version, flow_id, origin_observation, origin_revision, origin_fingerprint."""
    now = store.flows.select(F.col("graph_version").alias("current_version"), "flow_id", F.col("fingerprint").alias("_f"))
    rows = _origins(references, store).join(now, ["current_version", "flow_id"], "left")
    same = F.col("_f") == F.col("origin_fingerprint")
    reason = (
        F.when(F.coalesce(F.col("origin_fingerprint") == "", F.lit(True)), "origin-flow-evidence-unavailable").when(~F.col("there"), "origin-observation-unavailable").when(~F.col("agrees"), "origin-flow-basis-inconsistent")
        .when(F.col("current_version").isNull(), "origin-graph-unavailable").when(F.col("_f").isNull(), "flow-identity-missing").when(same & (F.col("current_observation") == F.col("origin_observation")), "origin-observation-current")
        .when(same, "flow-fingerprint-match").otherwise("flow-fingerprint-changed")
    )
    status = F.when(F.col("reason").isin("flow-identity-missing", "flow-fingerprint-changed"), "stale").when(F.col("reason").isin("origin-observation-current", "flow-fingerprint-match"), "current").otherwise("unavailable")
    return rows.select("uri", reason.alias("reason")).select("uri", status.alias("status"), "reason")
