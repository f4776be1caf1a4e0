"""Continuity of contexts between a commit and its first parent: gates in order, then what changed around one node."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.lineage import cut
from evidentia.operators.ancestry import union_all

# Why a question has no answer, in the order in which that is found out.
WRONG_PROJECT, DIRTY = "context-ref-project-does-not-match-current-repository", "historical-continuity-unavailable-for-dirty-source"
NO_PREDECESSOR, NOT_ADJACENT = "predecessor-revision-unavailable", "non-adjacent-first-parent-range"
NO_SNAPSHOT, OTHER_PROJECT = "historical-snapshot-unavailable", "historical-snapshot-project-mismatch"
NO_IDENTITY, LEGACY_IDENTITY, OTHER_IDENTITY = "historical-repository-identity-unavailable", "legacy-repository-identity-unavailable", "historical-repository-identity-mismatch"
LEGACY_CONTRACT, OTHER_CONTRACT = "legacy-evidence-contract-unavailable", "incompatible-evidence-contract"
COMPARED, STALE = "adjacent-first-parent-snapshot-compared", "origin-context-ref-is-stale"
SNAPSHOT_CUT = "historical-snapshot-truncated"


@dataclass(frozen=True)
class Limits:
    paths: int = 256
    nodes: int = 256
    edges: int = 256
    flows: int = 64


def judge(questions: DataFrame, commits: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``questions`` with from_revision and to_revision filled in, reason (the first gate that holds, null for none) and truncated.

    ``questions``: question (unique), project, origin_project, repository, dirty, from_revision (null: the first parent),
    to_revision (null: head_revision), head_revision, node, current. ``commits``: commit, parent, unique. ``snapshots``: revision
    (unique), project, repository, contract, truncated. A revision without a snapshot is a gate of its own.
    """
    asked = questions.withColumn("to", F.coalesce("to_revision", "head_revision"))
    parents = commits.select(F.col("commit").alias("to"), F.col("parent").alias("direct"))
    rows = asked.join(parents, "to", "left").withColumn("from", F.coalesce("from_revision", "direct"))
    side = lambda name: snapshots.select(F.col("revision").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("project", "repository", "contract", "truncated")], F.lit(True).alias(f"{name}_there"))
    rows = rows.join(side("from"), "from", "left").join(side("to"), "to", "left")
    other = lambda c: ~(F.col(f"from_{c}").eqNullSafe(F.col(c)) & F.col(f"to_{c}").eqNullSafe(F.col(c)))
    none = lambda c: F.col(f"from_{c}").isNull() | F.col(f"to_{c}").isNull()
    reason = (
        F.when(~F.col("origin_project").eqNullSafe(F.col("project")), WRONG_PROJECT).when(F.col("dirty"), DIRTY).when(F.col("from").isNull(), NO_PREDECESSOR)
        .when(~F.col("from").eqNullSafe(F.col("direct")), NOT_ADJACENT).when(none("there"), NO_SNAPSHOT).when(other("project"), OTHER_PROJECT)
        .when(F.col("repository").isNull(), NO_IDENTITY).when(none("repository"), LEGACY_IDENTITY).when(other("repository"), OTHER_IDENTITY)
        .when(none("contract"), LEGACY_CONTRACT).when(F.col("from_contract") != F.col("to_contract"), OTHER_CONTRACT)
    )
    cut_off = F.coalesce(F.col("from_truncated"), F.lit(False)) | F.coalesce(F.col("to_truncated"), F.lit(False))
    return rows.select("question", "node", "current", F.col("from").alias("from_revision"), F.col("to").alias("to_revision"), reason.alias("reason"), (reason.isNull() & cut_off).alias("truncated"))


def near(rows: DataFrame, wanted: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``rows`` without most of those whose ``keys`` are not among ``wanted``; never without others.

    2^24 bits tell the hashes that are wanted, 2 MB however many rows there are, so they are broadcast and the rest isn't shuffled.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << 24))
    bucket, bit = F.shiftright(place, 15), place.bitwiseAND((1 << 15) - 1)
    bits = wanted.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.pmod(F.floor(byte / F.pow(F.lit(2), bit.bitwiseAND(7))), F.lit(2)) == 1
    return rows.join(F.broadcast(bits), (bucket == F.col("_bucket")) & is_set, "left_semi")


def changes(asks: DataFrame, rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """from_revision, to_revision, ``by``, key, status (added, removed, changed) of ``rows`` (revision, ``by``, key, value) for distinct ``asks``.

    Sums combine before their shuffle, so one node may hold a third of all rows. Repeated keys count with their least value; a null
    value is a value.
    """
    pair = ("from_revision", "to_revision", *by)
    sides = asks.select(*pair, F.explode(F.array(F.struct(F.lit(True).alias("before"), F.col("from_revision").alias("revision")), F.struct(F.lit(False).alias("before"), F.col("to_revision").alias("revision")))).alias("s")).select(*pair, "s.*")
    held = F.struct(F.coalesce(F.col("value"), F.lit("")).alias("value"), F.col("value").isNull().alias("none"))
    if by:
        rows = near(rows, sides, ("revision", *by))
    both = sides.join(rows, ["revision", *by]).groupBy(*pair, "key").agg(F.min(F.when(F.col("before"), held)).alias("b"), F.min(F.when(~F.col("before"), held)).alias("a"))
    status = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select(*pair, "key", status.alias("status"), F.when(F.col("b").isNull() | F.col("a").isNull(), F.coalesce("b.value", "a.value")).alias("value")).where("status is not null")


def _first(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], limit: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("position", place).where(F.col("position") <= limit)


def continuity(questions: DataFrame, commits: DataFrame, snapshots: DataFrame, files: DataFrame, nodes: DataFrame, edges: DataFrame, flows: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """What became of every question, and the changes that its bounds admit; for the columns of the first three tables see :func:`judge`.

    ``files`` (revision, path, hash), ``nodes`` (revision, node, kind, fingerprint; unique), ``edges`` (revision, src, dst, kind),
    ``flows`` (revision, flow, node, fingerprint: a row for each node of a flow). Summaries: question, status (available, stale,
    wrong-project, unavailable), reason, from_revision, to_revision, node_status, fingerprint_relation, the numbers of path changes,
    path lineages (pairs of a removed and an added path of one hash), node, edge and flow changes and of lineage candidates (nodes
    after it of a removed node's kind and fingerprint), truncated, omissions (sorted, joined by commas). Changes: question, category
    (path, edge, flow, candidate), position, key, status; the first ones by key (edges: removed ones first). Bounds cut lists and
    never counts. Changes are found once for a pair of revisions, or for a pair and a node, however many questions ask for them.
    """
    judged = cut(judge(questions, commits, snapshots))
    passed = judged.where("reason is null")
    pairs = cut(passed.select("from_revision", "to_revision").distinct())
    asks = cut(passed.where("node is not null").select("from_revision", "to_revision", "node").distinct())
    two, three = ("from_revision", "to_revision"), ("from_revision", "to_revision", "node")

    paths = cut(changes(pairs, files.select("revision", F.col("path").alias("key"), F.col("hash").alias("value"))))
    hashes = paths.where("status in ('added', 'removed') and value <> ''").groupBy(*two, "value").agg(F.count_if(F.col("status") == "added").alias("n"), F.count_if(F.col("status") == "removed").alias("m"))
    path_sums = paths.groupBy(*two).agg(F.count("*").alias("path_changes")).join(hashes.groupBy(*two).agg(F.sum(F.col("n") * F.col("m")).alias("path_lineages")), list(two), "left")

    name = F.concat_ws("\0", "src", "kind", "dst").alias("key")
    touching = edges.select("revision", F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"), name, F.lit("").alias("value"))
    at_edges = cut(changes(asks, touching, ("node",)))
    at_flows = cut(changes(asks, flows.select("revision", "node", F.col("flow").alias("key"), F.col("fingerprint").alias("value")), ("node",)))

    side = lambda end: nodes.select(F.col("revision").alias(f"{end}_revision"), "node", F.col("kind").alias(f"{end}_kind"), F.col("fingerprint").alias(f"{end}_fp"), F.lit(True).alias(f"{end}_there"))
    seen = cut(asks.join(side("from"), ["from_revision", "node"], "left").join(side("to"), ["to_revision", "node"], "left"))
    b, a = F.coalesce("from_there", F.lit(False)), F.coalesce("to_there", F.lit(False))
    same = F.col("from_fp").eqNullSafe(F.col("to_fp"))
    state = F.when(b & a & same, "retained").when(b & a, "changed").when(b, "removed").when(a, "added").otherwise("unavailable")
    relation = F.when(b & a & same, "identical").when(b & a, "changed").otherwise("unavailable")
    # Candidates are counted, and the first of them taken, once for a revision, kind and fingerprint.
    lost = seen.where(b & ~a & (F.coalesce("from_fp", F.lit("")) != "")).select(*three, F.col("from_kind").alias("kind"), F.col("from_fp").alias("fingerprint"))
    like = lost.select(F.col("to_revision").alias("revision"), "kind", "fingerprint").distinct().join(nodes, ["revision", "kind", "fingerprint"]).select("revision", "kind", "fingerprint", "node").distinct()
    like = cut(like)
    n_like = like.groupBy("revision", "kind", "fingerprint").agg(F.count("*").alias("lineage_candidates"))
    of = lambda t: t.withColumnRenamed("revision", "to_revision")
    n_lost = lost.join(of(n_like), ["to_revision", "kind", "fingerprint"]).select(*three, "lineage_candidates")
    first_like = _first(like, ("revision", "kind", "fingerprint"), ("node",), limits.nodes).withColumnRenamed("node", "key")

    count = lambda t, c: t.groupBy(*three).agg(F.count("*").alias(c))
    node_sums = seen.select(*three, state.alias("node_status"), relation.alias("fingerprint_relation"), F.when(state == "retained", 0).otherwise(1).cast("long").alias("node_changes"))
    node_sums = node_sums.join(count(at_edges, "edge_changes"), list(three), "left").join(count(at_flows, "flow_changes"), list(three), "left").join(n_lost, list(three), "left")
    out = judged.join(path_sums, list(two), "left").join(node_sums, list(three), "left")

    sums = ("path_changes", "path_lineages", "node_changes", "edge_changes", "flow_changes", "lineage_candidates")
    ok = F.col("reason").isNull()
    number = lambda c: F.coalesce(F.col(c), F.lit(int(c == "node_changes")))
    whole = [F.when(ok, number(c)).otherwise(0).cast("long").alias(c) for c in sums]
    out = out.select("question", "current", "reason", *two, "truncated", F.when(ok, F.coalesce("node_status", F.lit("unavailable"))).otherwise("unavailable").alias("node_status"), F.when(ok, F.coalesce("fingerprint_relation", F.lit("unavailable"))).otherwise("unavailable").alias("fingerprint_relation"), *whole)
    bounds = [("path_changes", limits.paths, "historical path changes"), ("path_lineages", limits.paths, "path lineage candidates"), ("node_changes", limits.nodes, "historical node changes"), ("edge_changes", limits.edges, "historical edge changes"), ("flow_changes", limits.flows, "historical flow changes"), ("lineage_candidates", limits.nodes, "lineage candidates")]
    notes: list[Column] = [F.when(F.col("truncated"), SNAPSHOT_CUT)] + [F.when(F.col(c) > n, f"{what} capped at {n}") for c, n, what in bounds]
    omitted = F.array_sort(F.array_compact(F.array(*notes)))
    status = F.when(F.col("reason") == WRONG_PROJECT, "wrong-project").when(F.col("reason").isNotNull(), "unavailable").when(F.col("current"), "available").otherwise("stale")
    shown = F.col("reason").isNull() | (F.col("reason") == NOT_ADJACENT)
    summary = out.select(
        "question", status.alias("status"), F.coalesce("reason", F.when(F.col("current"), COMPARED).otherwise(STALE)).alias("reason"), F.when(shown, F.col("from_revision")).alias("from_revision"), F.when(shown, F.col("to_revision")).alias("to_revision"),
        "node_status", "fingerprint_relation", *sums, (F.size(omitted) > 0).alias("truncated"), F.array_join(omitted, ",").alias("omissions"),
    )

    listed = lambda t, category: t.select("question", F.lit(category).alias("category"), "position", "key", "status")
    lists = [
        listed(passed.join(_first(paths, two, ("key",), limits.paths), list(two)), "path"),
        listed(passed.join(_first(at_edges.withColumn("_r", F.when(F.col("status") == "removed", 0).otherwise(1)), three, ("_r", "key"), limits.edges), list(three)), "edge"),
        listed(passed.join(_first(at_flows, three, ("key",), limits.flows), list(three)), "flow"),
        listed(passed.join(lost, list(three)).join(of(first_like), ["to_revision", "kind", "fingerprint"]).withColumn("status", F.lit("candidate")), "candidate"),
    ]
    return summary, union_all(lists)
