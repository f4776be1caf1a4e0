"""Bounded traversals as level-synchronous joins; each level's frontier is checkpointed, so plans stay short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.lineage import cut


def reach(edges: DataFrame, roots: DataFrame, max_depth: int, directed: bool = True) -> DataFrame:
    """(node, depth): every node within ``max_depth`` steps of a root and its least depth; cycles end where a node was seen.

    ``edges`` has src and dst, ``roots`` has node. A node that many edges share is joined by key only, so skew joins split it.
    """
    steps = edges.select("src", "dst")
    if not directed:
        steps = steps.unionByName(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen = cut(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in range(1, max_depth + 1):
        new = frontier.join(steps, frontier["node"] == steps["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = cut(new.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)  # of written levels: none is written again
    return seen


def export_closure(exports: DataFrame, max_hops: int = 32) -> DataFrame:
    """Resolves re-exports: (module, name, target_module, target_name, hops, status).

    ``exports`` rows: module, name, source_module, source_name; a local export has no source module, and as source_name its local name where that is another; ``*`` as name and source_name
    forwards every name but ``default``. An explicit binding of a module beats ``*``. Outcomes: resolved, ambiguous
    (several targets), unresolved; a name still forwarded after ``max_hops`` is ``cycle-or-depth``.
    """
    named = exports.where("name <> '*'")
    stars = exports.where("name = '*'").select("module", "source_module")
    local = cut(named.where("source_module is null").select("module", "name", F.col("module").alias("target_module"), F.coalesce("source_name", "name").alias("target_name"), F.lit(0).alias("hops")))
    forwards = named.where("source_module is not null").select("module", F.col("name").alias("own"), "source_module", "source_name")
    explicit = named.select("module", "name").distinct()
    known, fresh = local, local
    for hop in range(1, max_hops + 1):
        found = fresh.select(F.col("module").alias("source_module"), F.col("name").alias("source_name"), "target_module", "target_name")
        by_name = forwards.join(found, ["source_module", "source_name"]).select("module", F.col("own").alias("name"), "target_module", "target_name")
        by_star = stars.join(found.where("source_name <> 'default'"), "source_module").select("module", F.col("source_name").alias("name"), "target_module", "target_name").join(explicit, ["module", "name"], "left_anti")
        new = by_name.unionByName(by_star).distinct().join(known, ["module", "name", "target_module", "target_name"], "left_anti")
        fresh = cut(new.withColumn("hops", F.lit(hop)))
        if fresh.isEmpty():
            break
        known = cut(known.unionByName(fresh))
    targets = known.groupBy("module", "name").agg(F.count("*").alias("n"), F.min(F.struct("target_module", "target_name")).alias("t"), F.min("hops").alias("hops"))
    everything = explicit.unionByName(targets.select("module", "name")).distinct().join(targets, ["module", "name"], "left")
    forwarded = named.where("source_module is not null").select("module", "name", F.col("source_module").alias("_s")).groupBy("module", "name").agg(F.first("_s").alias("_s"))
    modules = exports.select(F.col("module").alias("_s"), F.lit(True).alias("_known")).distinct()
    status = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").when(F.col("_known"), "cycle-or-depth").otherwise("unresolved")
    return (
        everything.join(forwarded, ["module", "name"], "left").join(modules, "_s", "left")
        .select("module", "name", F.when(F.col("n") == 1, F.col("t.target_module")).alias("target_module"), F.when(F.col("n") == 1, F.col("t.target_name")).alias("target_name"), "hops", status.alias("status"))
    )


def unresolved_exports(exports: DataFrame, closure: DataFrame, max_hops: int = 32) -> DataFrame:
    """(module, name, reason) for the names of a closure that aren't resolved or ambiguous, and for exported names that forward nowhere.

    Reasons, the first that holds for any way the name is forwarded: external-reexport (leaves the known modules),
    re-export-depth-capped (goes on after ``max_hops``), re-export-cycle (comes back to where it has been), missing-export
    (ends at a module that doesn't export the name). ``exports`` are the rows of :func:`export_closure`; an explicit binding beats ``*``.
    Only the ways of names that have failed are walked, a join a hop for all of them.
    """
    named = exports.where("name <> '*'").select("module", "name", "source_module", "source_name")
    stars = exports.where("name = '*'").select("module", F.col("source_module").alias("star"))
    known = exports.select(F.col("module").alias("at")).distinct().withColumn("known", F.lit(True))
    failed = closure.where("status not in ('resolved', 'ambiguous')").select("module", "name")
    start = cut(failed.select("module", "name", F.col("module").alias("at"), F.col("name").alias("wanted")))
    forwards = named.select(F.col("module").alias("at"), F.col("name").alias("wanted"), "source_module", F.coalesce("source_name", "name").alias("source_name")).distinct()
    through = stars.select(F.col("module").alias("at"), "star").distinct()
    seen, frontier, ends = start, start, None
    for hop in range(1, max_hops + 1):
        here = frontier.join(forwards, ["at", "wanted"], "left")
        explicit = here.where("source_module is not null").select("module", "name", F.col("source_module").alias("to"), F.col("source_name").alias("next"))
        starred = here.where("source_module is null and wanted <> 'default'").join(through, "at").select("module", "name", F.col("star").alias("to"), F.col("wanted").alias("next"))
        stuck = here.where("source_module is null").join(through.select("at").distinct().withColumn("_star", F.lit(True)), "at", "left")
        missing = stuck.where("_star is null or wanted = 'default'").select("module", "name", F.lit("missing-export").alias("reason"))
        steps = explicit.unionByName(starred).distinct().join(known.withColumnRenamed("at", "to"), "to", "left")
        outside = steps.where("known is null").select("module", "name", F.lit("external-reexport").alias("reason"))
        inside = steps.where("known").select("module", "name", F.col("to").alias("at"), F.col("next").alias("wanted"))
        been = inside.join(seen, ["module", "name", "at", "wanted"], "left_semi").select("module", "name", F.lit("re-export-cycle").alias("reason"))
        fresh = cut(inside.join(seen, ["module", "name", "at", "wanted"], "left_anti"))
        found = cut(missing.unionByName(outside).unionByName(been).distinct())
        ends = found if ends is None else ends.unionByName(found)
        frontier = fresh
        if fresh.isEmpty():
            break
        seen = cut(seen.unionByName(fresh))
    late = frontier.select("module", "name", F.lit("re-export-depth-capped").alias("reason"))
    rank = F.array_position(F.array(*[F.lit(r) for r in ("external-reexport", "re-export-depth-capped", "re-export-cycle", "missing-export")]), F.col("reason"))
    return (late if ends is None else ends.unionByName(late)).groupBy("module", "name").agg(F.min_by("reason", rank).alias("reason"))
