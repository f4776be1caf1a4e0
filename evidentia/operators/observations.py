"""Observations compared: relations of their bases, changes of several categories with bounds, order-free fingerprints of graphs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.fingerprints import fingerprint


def basis_relation(before: Column, after: Column) -> Column:
    """same, changed, or unavailable where either fingerprint is empty or null."""
    missing = F.coalesce((before == "") | (after == ""), F.lit(True))
    return F.when(missing, "unavailable").when(before == after, "same").otherwise("changed")


def contract_available(legacy: str, *parts: Column) -> Column:
    """Whether every part of an evidence contract is there and none is the legacy mark."""
    return reduce(Column.__and__, [F.coalesce((p != "") & (p != legacy), F.lit(False)) for p in parts])


def delta_envelope(changes: DataFrame, limits: Mapping[str, int], graph_relation: Column) -> DataFrame:
    """One row: added, changed and removed counts of each category before any bound, status, reason, truncated, omissions.

    ``changes`` has category and change; ``graph_relation`` is same-structural-graph, structural-graph-changed or unavailable.
    Without a relation, only categories that need none (``source``) are counted.
    """
    names = list(limits)
    counted = F.when(graph_relation == "unavailable", F.col("category") == "source").otherwise(F.lit(True))
    kinds = ("added", "changed", "removed")
    one = changes.where(counted).agg(*[F.count_if((F.col("category") == c) & (F.col("change") == k)).alias(f"{c}_{k}") for c in names for k in kinds])
    total = lambda c: F.col(f"{c}_added") + F.col(f"{c}_changed") + F.col(f"{c}_removed")
    left_out = F.filter(F.array(*[F.when(total(c) > n, F.lit(f"{c} changes omitted after max bound {n}")) for c, n in limits.items()]), lambda o: o.isNotNull())
    unavailable = F.when(graph_relation == "unavailable", F.array(F.lit("structural changes omitted because evidence contracts are incompatible"))).otherwise(F.array().cast("array<string>"))
    truncated = F.size(left_out) > 0
    status = F.when(graph_relation == "unavailable", "unavailable").when(truncated, "truncated").otherwise("complete")
    reason = (
        F.when(graph_relation == "unavailable", "incompatible-evidence-contract").when(graph_relation == "same-structural-graph", "same-structural-graph")
        .when(truncated, "change-bounds-reached").otherwise("adjacent-structural-graph-change")
    )
    return one.select("*", status.alias("status"), reason.alias("reason"), truncated.alias("truncated"), F.array_sort(F.concat(left_out, unavailable)).alias("omissions"))


def bounded_changes(changes: DataFrame, limits: Mapping[str, int], order: Sequence[str]) -> DataFrame:
    """The first changes of each category by a total order; each bound is its own top-k, so no category is sorted whole."""
    return reduce(DataFrame.unionByName, [changes.where(F.col("category") == c).orderBy(*order).limit(n) for c, n in limits.items()])


def same_rows(name: str, stored: DataFrame, expected: DataFrame) -> DataFrame:
    """(category, only_stored, only_expected, compatible): whether two tables hold the same rows as often, column by name; one aggregation, combined before its shuffle."""
    columns = sorted(stored.columns)
    sides = stored.select(*columns, F.lit(1).alias("_n")).unionByName(expected.select(*columns, F.lit(-1).alias("_n")))
    left = sides.groupBy(*columns).agg(F.sum("_n").alias("_n"))
    more = lambda c: F.coalesce(F.sum(F.when(c, F.abs("_n"))), F.lit(0)).cast("long")
    sums = left.agg(more(F.col("_n") > 0).alias("only_stored"), more(F.col("_n") < 0).alias("only_expected"))
    return sums.select(F.lit(name).alias("category"), "only_stored", "only_expected", ((F.col("only_stored") == 0) & (F.col("only_expected") == 0)).alias("compatible"))


def multiset_sum(digest: Column) -> list[Column]:
    """Aggregates that identify a multiset of SHA-256 digests (hex): sums of their four 64-bit parts.

    Sums combine before a shuffle, so a group of any size is never gathered or sorted, unlike a list of its members.
    """
    part = lambda i: F.conv(F.substring(digest, 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")
    return [F.coalesce(F.sum(part(i)).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias(f"sum_{i}") for i in range(4)]


def node_fingerprints(nodes: DataFrame, edges: DataFrame, partitions: int | None = None) -> DataFrame:
    """(id, fingerprint) of nodes (id, intrinsic): what they are, and all edges (src, dst, kind, evidence) in and out but ``declares``.

    The order of edges is no part of it. An edge from a node to itself counts as outgoing, as it does once. The sums of nodes are
    shuffled over ``partitions`` tasks if given; that number should grow with the edges, as a task holds the sums of its nodes.
    """
    links = edges.where("kind <> 'declares'")
    out = links.select(F.col("src").alias("id"), F.lit(True).alias("_out"), "kind", "evidence", F.col("dst").alias("_other"))
    sides = out.unionByName(links.where("src <> dst").select(F.col("dst").alias("id"), F.lit(False).alias("_out"), "kind", "evidence", F.col("src").alias("_other")))
    # Digests are longer than what they are made of, so they are made behind the shuffle where there is one for rows.
    sides = sides.repartition(partitions, "id") if partitions else sides
    digest = F.when(F.col("_out"), fingerprint("out", "kind", "evidence", "_other")).otherwise(fingerprint("in", "kind", "evidence", "_other"))
    sums = sides.select("id", digest.alias("_d")).groupBy("id").agg(*multiset_sum(F.col("_d")))
    parts = [F.coalesce(f"sum_{i}", F.lit(0)).cast("decimal(38,0)").cast("string") for i in range(4)]
    return nodes.join(sums, "id", "left").select("id", fingerprint("node", "intrinsic", *parts).alias("fingerprint"))


def graph_id(tables: Mapping[str, DataFrame], *identity: str) -> DataFrame:
    """One row (graph_id): fixed identity fields and all rows of the given tables, as multisets; columns count by name."""
    sums = []
    for name, rows in tables.items():
        digest = fingerprint(name, *sorted(rows.columns))
        sums.append(rows.select(digest.alias("_d")).agg(*multiset_sum(F.col("_d"))).select(F.lit(name).alias("name"), F.concat_ws(":", *[F.col(f"sum_{i}").cast("string") for i in range(4)]).alias("sums")))
    # One row a table: a list of a fixed, small size.
    listed = reduce(DataFrame.unionByName, sums).agg(F.array_sort(F.collect_list(F.concat_ws("=", "name", "sums"))).alias("parts"))
    return listed.select(fingerprint("graph", *[F.lit(x) for x in identity], F.array_join("parts", "|")).alias("graph_id"))
