"""Which commits after a good state touch what a question is about: ranked over versions that are encoded as intervals.

Files, edges and flows hold from one version of a line of commits to another (``valid_from`` up to, not including,
``valid_to``; null: still valid). What a commit changes is what starts or ends at its version, so no snapshot of a version is
ever rebuilt, and one pass answers any number of questions. A rank is a signal of relevance, not a claim of a cause.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.lineage import cut
from evidentia.functions.paths import is_typescript
from evidentia.tables import tasks

# What a candidate starts with, what a hit adds once, what each hit adds, and the reasons they give.
BASE = 10
ONCE = {"focus_path": 100, "cone_path": 60, "focus_edge": 45, "cone_edge": 25}
EACH = {"flow": 75, "entry": 60, "tests": 25, "focus_file": 35, "cone_file": 20}
REASONS = {
    "focus_path": "changed-path-in-focus-context", "cone_path": "changed-path-in-dependency-cone", "flow": "focused-flow-changed", "entry": "focused-entry-changed",
    "tests": "related-test-structure-changed", "focus_file": "focused-node-changed", "cone_file": "dependency-cone-node-changed", "focus_edge": "focused-edge-changed",
    "cone_edge": "dependency-cone-edge-changed",
}
AFTER = "introduced-after-last-known-good"
EDGE_KINDS = ("calls", "constructs", "imports")
MANIFEST = "package.json"


def merge_intervals(rows: DataFrame, keys: Sequence[str], meet: Sequence[str] = (), parts: int = 1) -> DataFrame:
    """Keys, valid_from, valid_to: intervals of one key that overlap or touch become one, so each end is a change of membership.

    ``meet``: some of the keys, whose rows meet in one of ``parts`` tasks, so that this and what groups by them later takes one shuffle.
    """
    rows = rows.repartition(parts, *meet) if meet else rows
    last = F.coalesce(F.col("valid_to"), F.lit(2**62))
    ordered = Window.partitionBy(*keys).orderBy("valid_from", "_end")
    before = F.max("_end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.select(*keys, F.col("valid_from").cast("long").alias("valid_from"), last.cast("long").alias("_end")).distinct().withColumn("_new", F.when(before.isNull() | (F.col("valid_from") > before), 1).otherwise(0))
    islands = marked.withColumn("_island", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy(*keys, "_island").agg(F.min("valid_from").alias("valid_from"), F.max("_end").alias("_end"))
    return merged.select(*keys, "valid_from", F.when(F.col("_end") < 2**62, F.col("_end")).alias("valid_to"))


def changes(intervals: DataFrame, keys: Sequence[str], *values: str) -> DataFrame:
    """version, keys, and a struct ``before`` and ``after`` of the values, null where the key doesn't exist: a row for each version that changes a key.

    Intervals of one key must not overlap; one that ends where the next starts with equal values is no change. What holds
    at version 0 was there from the start: it is no change either.
    """
    content = F.struct(*values, F.lit(True).alias("there"))
    starts = intervals.select(F.col("valid_from").alias("version"), *keys, content.alias("after"), F.lit(None).cast(intervals.select(content.alias("c")).schema["c"].dataType).alias("before"))
    ends = intervals.where("valid_to is not null").select(F.col("valid_to").alias("version"), *keys, F.lit(None).cast(starts.schema["after"].dataType).alias("after"), content.alias("before"))
    both = starts.unionByName(ends).where("version > 0").groupBy("version", *keys).agg(F.max("before").alias("before"), F.max("after").alias("after"))
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def _places(moved: DataFrame) -> DataFrame:
    """version, paths (sorted, distinct): where the ends of every changed edge (src, dst) are."""
    # The places of two nodes at one version: two, unless files share a node.
    places = F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.array("src_path", "dst_path")))))
    return moved.groupBy("version", "src", "dst").agg(places.alias("paths")).select("version", "paths")


def _path_sets(moved: DataFrame) -> DataFrame:
    """version, paths (sorted, distinct), n: how many changed edges (src, dst) have their ends at just these paths."""
    return _counted(_places(moved))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


def _among(rows: DataFrame, column: str, values: DataFrame, most: int = 100_000) -> DataFrame:
    """``rows`` without those whose column is none of the ``values`` (paths), where these are few enough to be sent to all tasks; a join decides later."""
    values = values.select(F.col("path").alias(column)).distinct()
    return rows.join(F.broadcast(values), column, "left_semi") if values.limit(most + 1).count() <= most else rows


def _hits(at_paths: DataFrame, roles: DataFrame, max_commits: int, each: int = 200_000) -> DataFrame:
    """The roles with each version in their ranges that something happened to their paths at, what happened, and a block: a context's rows of one block are in one task.

    Contexts are dealt into blocks of about ``each`` roles, larger contexts into several. A block gets what happened to a path once, however many
    of its contexts ask for it, and sums it up where it is: pairs of a context's path and a version are never shuffled.
    """
    measures = [c for c in at_paths.columns if c not in ("version", "path")]
    slice_of = lambda version: F.floor(version / max(max_commits, 1))
    profiles = at_paths.groupBy("path", slice_of(F.col("version")).alias("slice")).agg(F.collect_list(F.struct("version", *measures)).alias("profile"))
    # A context's range is no longer than a slice of versions, so it meets two of them at most.
    blocks = tasks(roles, each=each)
    large = roles.groupBy("context").count().where(F.col("count") > each).select("context", F.ceil(F.col("count") / each).alias("shares"))
    share = F.when(F.col("shares").isNull(), 0).otherwise(F.pmod(F.hash("path"), F.col("shares")))
    dealt = roles.join(F.broadcast(large), "context", "left").withColumn("block", F.pmod(F.hash("context", share), F.lit(blocks)).cast("int"))
    dealt = dealt.withColumn("slice", F.explode(F.array_distinct(F.array(slice_of(F.col("after_version") + 1), slice_of(F.col("head_version"))))))
    wanted = dealt.select("block", "path", "slice").distinct().join(profiles, ["path", "slice"])
    asks = dealt.select("block", "path", "slice", "context", "in_focus", "by_flow", "after_version", "head_version", F.lit(None).cast(profiles.schema["profile"].dataType).alias("profile"))
    gives = wanted.select("block", "path", "slice", *[F.lit(None).cast(asks.schema[c].dataType).alias(c) for c in ("context", "in_focus", "by_flow", "after_version", "head_version")], "profile")
    met = Window.partitionBy("block", "path", "slice").orderBy(F.col("profile").isNull())
    both = asks.unionByName(gives).repartitionById(blocks, F.col("block")).withColumn("profile", F.first("profile").over(met.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return both.where("context is not null").select("block", "path", "context", "in_focus", "by_flow", "after_version", "head_version", F.inline("profile")).where((F.col("version") > F.col("after_version")) & (F.col("version") <= F.col("head_version")))


def _sums(rows: DataFrame, kept: Sequence[str] = (), **flags: Column) -> DataFrame:
    """context, version, what is kept, and a count for every kind of hit, zero where it isn't given."""
    return rows.select("context", "version", *kept, *[flags.get(n, F.lit(0)).cast("long").alias(n) for n in REASONS])


def rank_history(
    contexts: DataFrame, commits: DataFrame, changed_paths: DataFrame, files: DataFrame, edges: DataFrame, flows: DataFrame, focus: DataFrame, focus_flows: DataFrame,
    max_commits: int = 128, max_candidates: int = 64, max_paths: int = 256,
) -> tuple[DataFrame, DataFrame]:
    """Candidates and one summary for every context.

    Inputs: ``contexts`` (context, state: usable or why not, good_version, graph_version, head_version, dirty), ``commits``
    (version, commit), ``changed_paths`` (version, path; all a commit touches), ``files`` (path, hash, intervals), ``edges``
    (src, dst, kind, src_path, dst_path, intervals merged by :func:`merge_intervals`), ``flows`` (flow, fingerprint, entry,
    entry_record, tests, intervals), ``focus`` (context, path, in_focus: in the focus, or else only in its cone),
    ``focus_flows`` (context, flow).

    Candidates: context, rank, commit, version, score, reasons, n_paths (of interest), paths (the first ``max_paths``), retention
    (retained, changed or removed, against the newest files). Summary: context, status, commits_inspected, total (candidates
    before the bound), truncated, omissions. Contexts that can't be diagnosed have a status and no candidates.
    """
    by_flow = focus_flows.groupBy("context").agg(F.lit(True).alias("by_flow"))
    gate = (
        F.when(F.col("state") != "usable", F.col("state")).when(F.col("dirty") | (F.col("graph_version") != F.col("head_version")), "source-state-mismatch")
        .when(F.col("good_version") == F.col("head_version"), "empty-range").otherwise("confirmed")
    )
    length = F.greatest(F.col("head_version") - F.col("good_version"), F.lit(0))
    gated = contexts.join(by_flow, "context", "left").select(
        "context", gate.alias("status"), "head_version", F.coalesce("by_flow", F.lit(False)).alias("by_flow"),
        F.greatest(F.col("good_version"), F.col("head_version") - max_commits).alias("after_version"), F.when(gate == "confirmed", length).otherwise(0).alias("length"),
    )
    open_ = gated.where("status = 'confirmed'").select("context", "after_version", "head_version", "by_flow")
    roles = cut(focus.groupBy("context", "path").agg(F.max("in_focus").alias("in_focus")).join(open_, "context"), free=True)
    in_range = (F.col("version") > F.col("after_version")) & (F.col("version") <= F.col("head_version"))
    # What happened to paths at versions in no question's range is left out before it is shuffled.
    span = roles.agg(F.min("after_version").alias("first"), F.max("head_version").alias("last")).first()
    asked = F.lit(False) if span["first"] is None or span["last"] is None else (F.col("version") > span["first"]) & (F.col("version") <= span["last"])
    near, far = F.col("in_focus").cast("int"), (~F.col("in_focus")).cast("int")

    # Paths that count: sources, and the manifest for questions about flows.
    touched = changed_paths.select("version", "path").distinct()
    source = is_typescript(F.col("path"))
    # Merged intervals of an edge don't touch: each start and each end is a change. Rows that merge_intervals let meet are not shuffled again.
    bounds = F.explode(F.array("valid_from", "valid_to")).alias("version")
    moved = edges.where(F.col("kind").isin(*EDGE_KINDS)).select(bounds, "src", "dst", "src_path", "dst_path").where("version > 0")
    edges_at = cut(_places(moved.where(asked)), free=True)
    # What happens to a path at a version is summed up before any context asks for it.
    none = F.lit(0).cast("long")
    parts = [
        touched.where(source | (F.col("path") == MANIFEST)).select("version", "path", F.lit(1).cast("long").alias("touched"), none.alias("file"), none.alias("edges")),
        changes(files, ["path"], "hash").select("version", "path", none.alias("touched"), F.lit(1).cast("long").alias("file"), none.alias("edges")),
        edges_at.select("version", F.explode("paths").alias("path"), none.alias("touched"), none.alias("file"), F.lit(1).cast("long").alias("edges")),
    ]
    at_paths = reduce(DataFrame.unionByName, parts).where(asked).groupBy("version", "path").agg(*[F.sum(c).alias(c) for c in ("touched", "file", "edges")])
    hit = _hits(at_paths, roles, max_commits)
    counts = F.col("touched") * (is_typescript(F.col("path")) | F.col("by_flow")).cast("int")
    paths = _sums(hit, ["block"], focus_path=near * counts, cone_path=counts, focus_file=near * F.col("file"), cone_file=far * F.col("file"), focus_edge=near * F.col("edges"), cone_edge=far * F.col("edges"))
    paths = cut(paths.groupBy("block", "context", "version").agg(*[F.sum(n).alias(n) for n in REASONS]).drop("block"), free=True)
    # An edge with an end in the focus is none of the cone's: it is taken off at each of its ends there. What is left is above zero
    # exactly where an edge has ends in the cone and none in the focus, so edges are never paired with the contexts of their cones.
    cone = roles.where("not in_focus").select("context", "path")
    ends = edges_at.where(F.size("paths") == 2).select("version", F.inline(F.array(*[F.struct(F.col("paths")[i].alias("path"), F.col("paths")[1 - i].alias("other")) for i in (0, 1)])))
    ends = _counted(_among(_among(ends, "other", cone), "path", roles.where("in_focus")))
    own = ends.join(roles.where("in_focus"), "path").where(in_range).select("context", "version", "n", F.col("other").alias("path"))
    if not (wide := edges_at.where(F.size("paths") > 2)).isEmpty():
        several = _counted(wide).select("version", "paths", "n", F.explode("paths").alias("path")).join(roles.where("in_focus"), "path").where(in_range).select("context", "version", "paths", "n").distinct()
        own = own.unionByName(several.select("context", "version", "n", F.explode("paths").alias("path")))
    links = cut(own.join(cone, ["context", "path"]).groupBy("context", "version").agg(F.sum("n").alias("n")), free=True)
    links = _sums(links, cone_edge=-F.col("n"))

    shifted = changes(flows, ["flow"], "fingerprint", "entry", "entry_record", "tests")
    differs = lambda f: ~F.col(f"before.{f}").eqNullSafe(F.col(f"after.{f}"))
    tests = F.coalesce("before.tests", F.lit("")) != F.coalesce("after.tests", F.lit(""))
    flow_hits = shifted.select("version", "flow", differs("fingerprint").alias("f"), differs("entry").alias("e"), differs("entry_record").alias("r"), tests.alias("t"))
    flow_hits = flow_hits.join(focus_flows.distinct(), "flow").join(open_, "context").where(in_range)
    moves = _sums(flow_hits, flow=F.col("f").cast("int"), entry=F.col("e").cast("int"), tests=F.col("t").cast("int")).withColumn("record", F.lit(0))
    # An entry's record may change while the flow keeps its entry; that counts once a commit, and only then.
    records = flow_hits.select("context", "version", *[F.lit(0).cast("long").alias(n) for n in REASONS], F.col("r").cast("int").alias("record"))

    all_hits = reduce(DataFrame.unionByName, [paths.withColumn("record", F.lit(0)), links.withColumn("record", F.lit(0)), moves, records])
    sums = all_hits.groupBy("context", "version").agg(*[F.sum(n).alias(n) for n in REASONS], F.max("record").alias("record"))
    sums = sums.withColumn("entry", F.when((F.col("entry") == 0) & (F.col("record") > 0), 1).otherwise(F.col("entry")))
    score = F.lit(BASE)
    for name, weight in ONCE.items():
        score = score + F.when(F.col(name) > 0, weight).otherwise(0)
    for name, weight in EACH.items():
        score = score + weight * F.col(name)
    reasons = F.filter(F.array(*[F.when(F.col(n) > 0, F.lit(r)) for n, r in REASONS.items()]), lambda r: r.isNotNull())
    scored = sums.select("context", "version", score.cast("long").alias("score"), reasons.alias("reasons")).where(F.size("reasons") > 0)

    # Commits that touch no path of interest are no candidates; the rest show what became of the paths they touched.
    newest = files.where("valid_to is null").select("path", F.col("hash").alias("now"))
    then = files.select("path", F.col("valid_from").alias("version"), F.col("hash").alias("then"))
    counted = touched.where(source | (F.col("path") == MANIFEST)).withColumn("manifest", F.col("path") == MANIFEST)
    sizes = touched.groupBy("version").agg(F.count("*").alias("n_all"), F.count_if(source).alias("n_sources"), F.count_if(F.col("path") == MANIFEST).alias("n_manifests"))
    sizes = sizes.withColumn("by_flow", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("n_paths", F.col("n_sources") + F.when(F.col("by_flow"), F.col("n_manifests")).otherwise(0))
    # The first paths of each commit only, found before the shuffle, so a commit may touch any number of paths.
    place = F.row_number().over(Window.partitionBy("version", "by_flow").orderBy("path"))
    each = counted.withColumn("by_flow", F.explode(F.when(F.col("manifest"), F.array(F.lit(True))).otherwise(F.array(F.lit(False), F.lit(True)))))
    first = each.withColumn("place", place).where(F.col("place") <= max_paths).join(newest, "path", "left").join(then, ["path", "version"], "left")
    listed = first.groupBy("version", "by_flow").agg(F.array_sort(F.collect_list(F.struct("path", "now", "then"))).alias("listed"))
    gone = F.exists("listed", lambda p: p["now"].isNull())
    stays = F.exists("listed", lambda p: p["now"].isNotNull())
    differs_now = F.exists("listed", lambda p: p["now"].isNotNull() & ~p["now"].eqNullSafe(p["then"]))
    retention = F.when(~stays, "removed").when(differs_now | gone, "changed").otherwise("retained")
    fates = listed.select("version", "by_flow", F.transform("listed", lambda p: p["path"]).alias("paths"), retention.alias("retention"))
    found = scored.join(open_.select("context", "by_flow"), "context").join(sizes.where("n_paths > 0"), ["version", "by_flow"]).join(commits, "version")

    # Lists of paths are joined to what the bound keeps only.
    rank = F.row_number().over(Window.partitionBy("context").orderBy(F.desc("score"), "commit"))
    given = F.concat("reasons", F.array(F.lit(AFTER))).alias("reasons")
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= max_candidates).join(fates, ["version", "by_flow"])
    ranked = ranked.select("context", "rank", "commit", "version", "score", given, "n_paths", "paths", "retention")
    note = F.when(F.col("n_paths") > max_paths, f" paths capped at {max_paths}").when(F.col("n_all") > F.col("n_paths"), " contained non-TypeScript paths omitted from candidate evidence")
    # At most ``max_commits`` notes a context.
    totals = found.groupBy("context").agg(F.count("*").alias("total"), F.array_sort(F.collect_list(F.concat(F.lit("commit "), "commit", note))).alias("cut"))
    capped = F.filter(
        F.array(F.when(F.col("length") > max_commits, F.lit(f"history commits capped at {max_commits}")), F.when(F.col("total") > max_candidates, F.lit(f"historical candidates capped at {max_candidates}"))), lambda o: o.isNotNull(),
    )
    summary = gated.join(totals, "context", "left").withColumn("total", F.coalesce("total", F.lit(0))).select(
        "context", "status", F.least("length", F.lit(max_commits)).alias("commits_inspected"), "total",
        ((F.col("length") > max_commits) | (F.col("total") > max_candidates)).alias("truncated"), F.concat(F.coalesce("cut", F.array().cast("array<string>")), capped).alias("omissions"),
    )
    return ranked, summary
