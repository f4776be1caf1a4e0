"""Lifecycles of known-good states, reduced from append-only events that name their candidates and their predecessors.

The order of a context's events is their chain of predecessors, not time. Up to the first event that breaks a rule, what is
pending is what the last PROPOSE, CONFIRM or REJECT before it left, and what is active is what the last CONFIRM or REVOKE
left. So the state before an event needs no walk: it is the last setter before it, inside stretches of positions first, then
carried from stretch to stretch. A context with a third of all events is many stretches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.lineage import cut
from evidentia.operators.chains import chain_positions

# The reasons why a lifecycle is corrupt, in the order in which they are looked for.
CANDIDATE_CORRUPT = "lkg-candidate-context-or-identity-corrupt"
CANDIDATE_INVALID = "lkg-candidate-contract-invalid"
CANDIDATE_INCONSISTENT = "lkg-candidate-provenance-inconsistent"
EVENT_CORRUPT = "lkg-event-context-or-identity-corrupt"
EVENT_MISMATCH = "lkg-event-candidate-provenance-mismatch"
EVENT_UNSUPPORTED = "lkg-event-type-unsupported"
EVENT_REPLACES = "lkg-event-replacement-on-non-confirm-invalid"
CHAIN = {
    "root-invalid": "lkg-event-chain-root-invalid",
    "predecessor-invalid": "lkg-event-chain-predecessor-invalid",
    "disconnected": "lkg-event-chain-disconnected",
}
PROPOSED_TWICE = "lkg-candidate-proposed-more-than-once"
SEVERAL_PENDING = "lkg-multiple-pending-candidates"
CONFIRM_NOT_PENDING = "lkg-confirm-target-not-pending"
CONFIRM_TARGET = "lkg-confirm-replacement-target-invalid"
CONFIRM_WITHOUT_ACTIVE = "lkg-confirm-replacement-without-active"
REJECT_NOT_PENDING = "lkg-reject-target-not-pending"
REVOKE_NOT_ACTIVE = "lkg-revoke-target-not-active"
TYPES = ("PROPOSE", "CONFIRM", "REJECT", "REVOKE")


def _empty(*names: str) -> Column:
    missing = F.lit(False)
    for name in names:
        missing = missing | (F.coalesce(F.col(name), F.lit("")) == "")
    return missing


def _first(rows: DataFrame, reason: Column, *order: str) -> DataFrame:
    """(context, reason): the reason of each context's first row that has one."""
    found = rows.withColumn("reason", reason).where("reason is not null")
    return found.groupBy("context").agg(F.min_by("reason", F.struct(*order)).alias("reason"))


def candidate_errors(candidates: DataFrame, schema: str) -> DataFrame:
    """(context, reason) of contexts whose candidates repeat an id, miss a field or disagree on where they come from."""
    copy = F.row_number().over(Window.partitionBy("context", "candidate").orderBy("position"))
    origin = candidates.groupBy("context").agg(F.min_by(F.struct("repository", "project"), "position").alias("origin"))
    rows = candidates.withColumn("copy", copy).join(origin, "context")
    other = (F.col("repository") != F.col("origin.repository")) | (F.col("project") != F.col("origin.project"))
    invalid = ~F.col("schema").eqNullSafe(F.lit(schema)) | _empty("repository", "project", "revision")
    return _first(rows, F.when(F.col("copy") > 1, CANDIDATE_CORRUPT).when(invalid, CANDIDATE_INVALID).when(other, CANDIDATE_INCONSISTENT), "position", "candidate")


def event_errors(candidates: DataFrame, events: DataFrame, schema: str) -> DataFrame:
    """(context, reason) of contexts with an event that is no valid one by itself, or doesn't agree with its candidate."""
    known = candidates.groupBy("context", "candidate").agg(F.min_by(F.struct("repository", "project"), "position").alias("of"))
    copy = F.row_number().over(Window.partitionBy("context", "event").orderBy("position"))
    rows = events.withColumn("copy", copy).join(known, ["context", "candidate"], "left")
    corrupt = ~F.col("schema").eqNullSafe(F.lit(schema)) | _empty("event", "repository", "project") | (F.col("copy") > 1) | F.col("of").isNull()
    other = (F.col("repository") != F.col("of.repository")) | (F.col("project") != F.col("of.project"))
    replaces = (F.col("type") != "CONFIRM") & F.col("replaces").isNotNull()
    unsupported = ~F.coalesce(F.col("type").isin(*TYPES), F.lit(False))
    reason = F.when(corrupt, EVENT_CORRUPT).when(other, EVENT_MISMATCH).when(unsupported, EVENT_UNSUPPORTED).when(replaces, EVENT_REPLACES)
    return _first(rows, reason, "position", "event")


def _setters() -> dict[str, Column]:
    none = F.struct(F.lit(None).cast("string").alias("candidate"))
    return {
        "pending": F.when(F.col("type") == "PROPOSE", F.struct("candidate")).when(F.col("type").isin("CONFIRM", "REJECT"), none),
        "active": F.when(F.col("type") == "CONFIRM", F.struct("candidate")).when(F.col("type") == "REVOKE", none),
    }


def states_inside(events: DataFrame) -> DataFrame:
    """The columns of :func:`states_before`, for contexts of few events each."""
    rows = events.withColumns({f"_{n}": s for n, s in _setters().items()})
    before = Window.partitionBy("context").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    copy = F.row_number().over(Window.partitionBy("context", "candidate").orderBy("position"))
    rows = rows.select(*events.columns, *[F.last(f"_{n}", ignorenulls=True).over(before)["candidate"].alias(n) for n in _setters()])
    return rows.withColumn("mentioned", copy > 1)


def states_before(events: DataFrame, stretch: int = 65_536) -> DataFrame:
    """Adds pending, active (candidates, null for none) and mentioned (whether an earlier event names the candidate).

    ``events``: context, event, position (gapless from 0), type, candidate. ``stretch`` positions of a context are one group.
    """
    setters = _setters()
    rows = events.withColumn("_stretch", F.floor(F.col("position") / stretch)).withColumns({f"_{n}": s for n, s in setters.items()})
    inside = Window.partitionBy("context", "_stretch").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("context", "_stretch").agg(*[F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), F.col("position"))).alias(f"_{n}") for n in setters])
    # A row for each stretch.
    across = Window.partitionBy("context").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("context", "_stretch", *[F.last(f"_{n}", ignorenulls=True).over(across).alias(f"_{n}_carried") for n in setters])
    rows = rows.withColumns({n: F.last(f"_{n}", ignorenulls=True).over(inside) for n in setters}).join(carried, ["context", "_stretch"])
    first = events.groupBy("context", "candidate").agg(F.min("position").alias("_first"))
    rows = rows.join(first, ["context", "candidate"])
    before = {n: F.coalesce(n, f"_{n}_carried")["candidate"].alias(n) for n in setters}
    return rows.select(*events.columns, *before.values(), (F.col("position") > F.col("_first")).alias("mentioned"))


def violation(rows: DataFrame) -> Column:
    """The rule that an event breaks in the state before it, else null."""
    is_ = lambda t: F.col("type") == t
    pending, active = F.col("candidate").eqNullSafe(F.col("pending")), F.col("candidate").eqNullSafe(F.col("active"))
    return (
        F.when(is_("PROPOSE") & F.col("mentioned"), PROPOSED_TWICE)
        .when(is_("PROPOSE") & F.col("pending").isNotNull(), SEVERAL_PENDING)
        .when(is_("CONFIRM") & ~pending, CONFIRM_NOT_PENDING)
        .when(is_("CONFIRM") & F.col("active").isNotNull() & ~F.col("replaces").eqNullSafe(F.col("active")), CONFIRM_TARGET)
        .when(is_("CONFIRM") & F.col("active").isNull() & F.col("replaces").isNotNull(), CONFIRM_WITHOUT_ACTIVE)
        .when(is_("REJECT") & ~pending, REJECT_NOT_PENDING)
        .when(is_("REVOKE") & ~active, REVOKE_NOT_ACTIVE)
    )


def reduce_lifecycles(
    contexts: DataFrame, candidates: DataFrame, events: DataFrame, candidate_schema: str = "candidate-1", event_schema: str = "event-1", stretch: int = 65_536
) -> DataFrame:
    """context, status (none, pending, active, inactive, corrupt), tip_event, active, pending, n_events, reason (of corrupt ones).

    ``contexts``: context. ``candidates``: context, candidate, position (as stored), schema, repository, project, revision.
    ``events``: context, event, position (as stored), predecessor, type, candidate, replaces, schema, repository, project.
    Any broken rule makes the context corrupt, with the first reason and without a state; candidates and events of contexts
    that aren't listed are ignored.
    """
    contexts = contexts.select("context").distinct()
    wrong = candidate_errors(candidates, candidate_schema)
    wrong = cut(wrong.unionByName(event_errors(candidates, events, event_schema).join(wrong, "context", "left_anti")))
    sound = events.join(wrong, "context", "left_anti")
    kept = ("type", "candidate", "replaces")
    status, positions = chain_positions(sound.select(F.col("context").alias("key"), "event", "predecessor", *kept), *kept)
    status = cut(status)
    reason = F.element_at(F.create_map(*[F.lit(x) for pair in CHAIN.items() for x in pair]), F.col("status"))
    broken = status.where("status <> 'linear'").select(F.col("key").alias("context"), reason.alias("reason"))

    # What is before an event of a context of one stretch takes no join.
    ordered = positions.withColumnRenamed("key", "context")
    large = status.where(F.col("n_events") > stretch).select(F.col("key").alias("context"))
    if large.isEmpty():
        ordered = states_inside(ordered)
    else:
        ordered = states_inside(ordered.join(large, "context", "left_anti")).unionByName(states_before(ordered.join(large, "context", "left_semi"), stretch))
    ordered = cut(ordered)
    faults = _first(ordered, violation(ordered), "position")
    # After the last event: what its own type sets, else what was before it.
    last = ordered.groupBy("context").agg(F.max_by(F.struct("event", "type", "candidate", "pending", "active"), "position").alias("l"), F.count("*").alias("n_events"))
    pending = F.when(F.col("l.type") == "PROPOSE", F.col("l.candidate")).when(F.col("l.type") == "REVOKE", F.col("l.pending"))
    active = F.when(F.col("l.type") == "CONFIRM", F.col("l.candidate")).when(F.col("l.type") != "REVOKE", F.col("l.active"))
    ends = last.select("context", F.col("l.event").alias("tip_event"), active.alias("active"), pending.alias("pending"), "n_events")
    out = contexts.join(wrong.unionByName(broken).unionByName(faults), "context", "left").join(ends, "context", "left")
    sound_ = F.col("reason").isNull()
    state = F.when(~sound_, "corrupt").when(F.col("tip_event").isNull(), "none").when(F.col("active").isNotNull(), "active").when(F.col("pending").isNotNull(), "pending").otherwise("inactive")
    kept = [F.when(sound_, F.col(c)).alias(c) for c in ("tip_event", "active", "pending", "n_events")]
    return out.select("context", state.alias("status"), *kept, "reason")
