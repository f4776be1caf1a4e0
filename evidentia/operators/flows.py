"""Ordered, bounded flows from entry targets over calls and constructions, for all entries at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.fingerprints import fingerprint
from evidentia.functions.lineage import cut


@dataclass(frozen=True)
class Caps:
    steps: int = 256
    edges: int = 512
    depth: int = 64


def walk_flows(entries: DataFrame, nodes: DataFrame, edges: DataFrame, caps: Caps = Caps()) -> DataFrame:
    """What :func:`project_flows` returns as one row a flow: entry, steps (node, role, depth; in order), n_steps, n_edges, status, omissions.

    A flow has no more steps than its cap and follows no more edges than its cap, so its list and what a level adds to it are one short
    row. A level is two shuffles: of the frontiers by node to join the edges, and of the edges by entry to join their flow. Edges
    carry what their end's place depends on, and flows that are at their end are set aside.
    """
    followed = edges.where("kind in ('calls', 'constructs')").select("src", "dst", "kind", "evidence")
    w = Window.partitionBy("src").orderBy("kind", "dst", "evidence")
    out = followed.withColumn("n", F.row_number().over(w)).where(F.col("n") <= caps.edges + 1).select("src", "n", "dst")
    start = cut(entries.groupBy("entry").agg(F.min("target").alias("target")))
    counted = nodes.select(F.col("id").alias("dst"), F.lit(0).cast("long").alias("one"), F.lit(True).alias("known")).unionAll(followed.select("src", F.lit(1).cast("long"), F.lit(False)))
    known = counted.groupBy("dst").agg(F.least(F.sum("one"), F.lit(caps.edges + 1).cast("long")).alias("degree"), F.max("known").alias("known")).where("known").drop("known")
    # Targets go with the edges, as edges from nowhere, so that degrees are looked up once.
    targets = start.where("target is not null and target <> entry").select(F.lit(None).cast(edges.schema["src"].dataType).alias("src"), F.lit(None).cast("int").alias("n"), F.col("target").alias("dst")).distinct()
    graph = cut(out.where("src is not null").unionByName(targets).join(known, "dst"))
    links = graph.where("src is not null")

    zero = F.lit(0).cast("long")
    place = lambda depth, degree, before: F.struct(F.lit(depth).alias("depth"), degree.alias("degree"), before.alias("before"))
    # ``nodes`` has each step's node, ``places`` its depth, number of edges and the edges before it; ``at`` is where the last level begins.
    first = start.join(graph.where("src is null").select(F.col("dst").alias("target"), "degree"), "target", "left")
    there = F.col("degree").isNotNull() & (F.col("target") != F.col("entry"))
    root = lambda a, b: F.concat(a, F.when(there, b).otherwise(F.slice(a, 1, 0)))
    degree = F.col("degree") if caps.depth else zero
    state = first.select("entry", root(F.array("entry"), F.array("target")).alias("nodes"), root(F.array(place(0, zero, zero)), F.array(place(0, F.coalesce(degree, zero), zero))).alias("places"), F.lit(1).alias("at"))
    done = []
    for depth in range(1, caps.depth + 1):
        state = cut(state)
        goes_on = F.size("nodes") > F.col("at")
        done.append(state.where(~goes_on))
        state = state.where(goes_on)
        if state.isEmpty():
            break
        tail = F.slice(F.arrays_zip("nodes", "places"), F.col("at") + 1, F.size("nodes") - F.col("at"))
        front = state.select("entry", "at", F.posexplode(tail).alias("i", "s")).select("entry", (F.col("at") + F.col("i")).alias("position"), F.col("s.nodes").alias("src"), F.col("s.places.degree").alias("has"), F.col("s.places.before").alias("before"))
        # An edge beyond the cap is not followed.
        follow = front.where((F.col("position") < caps.steps) & (F.col("has") > 0)).join(links, "src").where(F.col("before") + F.col("n") <= caps.edges)
        seen_at = F.col("position").cast("long") * (caps.edges + 2) + F.col("n")
        ends = follow.select("entry", "dst", "degree", seen_at.alias("seen_at")).repartition("entry").groupBy("entry", "dst").agg(F.min("seen_at").alias("seen_at"), F.max("degree").alias("degree"))
        found = ends.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("seen_at", "dst", "degree"))).alias("found"))

        def add(acc: Column, end: Column) -> Column:
            # A full list of edges ends a flow; one step beyond the cap is kept to tell that there was one. No edge is followed at the last depth.
            degree = end["degree"] if depth < caps.depth else zero
            grown = F.struct(F.concat(acc["nodes"], F.array(end["dst"])).alias("nodes"), F.concat(acc["places"], F.array(place(depth, degree, acc["sum"]))).alias("places"), (acc["sum"] + degree).alias("sum"))
            return F.when((acc["sum"] < caps.edges) & (F.size(acc["nodes"]) <= caps.steps), grown).otherwise(acc)

        last = F.element_at("places", -1)
        fresh = F.filter("found", lambda e: ~F.array_contains(F.col("nodes"), e["dst"]))
        grown = F.aggregate(fresh, F.struct("nodes", "places", (last["before"] + last["degree"]).alias("sum")), add)
        joined = state.join(found, "entry", "left").select("entry", "nodes", "places", F.size("nodes").alias("at"), grown.alias("grown"))
        state = joined.select("entry", F.coalesce("grown.nodes", "nodes").alias("nodes"), F.coalesce("grown.places", "places").alias("places"), "at")
    else:
        done.append(cut(state))
    flows = reduce(DataFrame.unionByName, done)

    steps = F.slice(F.transform(F.arrays_zip("nodes", "places"), lambda s, i: F.struct(s["nodes"].alias("node"), F.when(i == 0, "entry").when(i == 1, "target").otherwise("callee").alias("role"), s["places"]["depth"].alias("depth"))), 1, caps.steps)
    inside = F.slice("places", 1, caps.steps)
    more_depth = F.exists(F.slice("places", 2, max(caps.steps - 1, 0)), lambda p: p["depth"] >= caps.depth)
    more_edges = F.exists(inside, lambda p: p["before"] + p["degree"] > caps.edges)
    caps_met = [("depth", more_depth, caps.depth), ("edges", more_edges, caps.edges), ("steps", F.size("nodes") > caps.steps, caps.steps)]
    omissions = F.filter(F.array(*[F.when(c, F.lit(f"flow {name} capped at {n}")) for name, c, n in caps_met]), lambda o: o.isNotNull())
    taken = F.aggregate(inside, zero, lambda acc, p: acc + F.least(p["degree"], F.lit(caps.edges) - p["before"]))
    rows = flows.select("entry", steps.alias("steps"), F.least(F.size("nodes"), F.lit(caps.steps)).cast("long").alias("n_steps"), taken.alias("n_edges"), omissions.alias("omissions"))
    return rows.select("entry", "steps", "n_steps", "n_edges", F.when(F.size("omissions") > 0, "truncated").otherwise("complete").alias("status"), "omissions")


def project_flows(entries: DataFrame, nodes: DataFrame, edges: DataFrame, caps: Caps = Caps()) -> tuple[DataFrame, DataFrame]:
    """Flows of ``entries`` (entry, target; one row an entry) over ``edges`` (src, dst, kind, evidence) between ``nodes`` (id).

    Returns steps (entry, position, node, role, depth) and flows (entry, n_steps, n_edges, status, omissions). Position 0 is the
    entry itself. Nodes follow in breadth-first order, the neighbours of a node by kind, dst and evidence; a node is a step once,
    so cycles end. A flow stops at the first cap it meets, and each cap that left something out is an omission; the caps are the
    meaning of the operator. An unknown or null target gives a flow of its entry alone.

    Only the first ``caps.edges + 1`` edges of a node can count, so no more are kept of any node.
    """
    flows = walk_flows(entries, nodes, edges, caps)
    return flows.select("entry", F.posexplode("steps").alias("position", "s")).select("entry", "position", "s.*"), flows.drop("steps")


def flow_fingerprints(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(entry, n_inner, fingerprint) of the flows with ``steps``: the followed kinds of edges between two of their steps, and a hash of steps and edges."""
    order = F.transform(F.array_sort(F.collect_list(F.struct("position", "node"))), lambda s: s["node"])
    targets = F.collect_list(F.when(F.col("position") > 0, F.col("node")))
    return listed_fingerprints(steps.groupBy("entry").agg(order.alias("nodes"), targets.alias("inner")), edges)


def listed_fingerprints(flows: DataFrame, edges: DataFrame) -> DataFrame:
    """:func:`flow_fingerprints` of flows (entry, nodes in order, inner: those but the entry itself; one row a flow).

    A flow has no more steps than its cap, so its lists are short and tell whether an edge ends inside. Edges are summed as whole
    numbers of 64 bits of their digests (wrapping never happens in 38 digits).
    """
    links = edges.where("kind in ('calls', 'constructs')").select("src", "dst", "kind", "evidence").distinct()
    leaving = flows.select("entry", F.explode("inner").alias("src")).join(links, "src")
    inside = leaving.join(flows.select("entry", "inner"), "entry").where(F.array_contains("inner", F.col("dst")))
    digest = F.conv(F.substring(fingerprint("flow-edge", "src", "kind", "dst", "evidence"), 1, 15), 16, 10).cast("decimal(38,0)")
    sums = inside.groupBy("entry").agg(F.count("*").alias("n_inner"), F.sum(digest).alias("sum"))
    rows = flows.join(sums, "entry", "left")
    return rows.select("entry", F.coalesce("n_inner", F.lit(0)).alias("n_inner"), fingerprint("flow", F.array_join("nodes", "\0"), F.coalesce("sum", F.lit(0))).alias("fingerprint"))
