"""Whether linked events form one chain per key: one root, known predecessors, no branch, no cycle."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.lineage import cut

#: Chains of no more events are one row each; others are linked by joins.
SHORT = 256


def _linked(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, n_events, early) and, for keys without an early failure, (key, event, to, hops): where a pointer ends, null at the root, and how far that is."""
    ids = events.select(F.col("key").alias("key"), F.col("event").alias("predecessor"), F.lit(True).alias("_known"))
    linked = events.join(ids, ["key", "predecessor"], "left")
    followers = events.where("predecessor is not null").groupBy("key", "predecessor").agg(F.count("*").alias("_n")).groupBy("key").agg(F.max("_n").alias("most"))
    unknown = F.col("predecessor").isNotNull() & (F.col("_known").isNull() | (F.col("predecessor") == F.col("event")))
    sums = linked.groupBy("key").agg(F.count("*").alias("n_events"), F.count_if(F.col("predecessor").isNull()).alias("roots"), F.count_if(unknown).alias("unknown")).join(followers, "key", "left")
    early = F.when(F.col("roots") != 1, "root-invalid").when((F.col("unknown") > 0) | (F.col("most") > 1), "predecessor-invalid")
    sums = cut(sums.select("key", "n_events", early.alias("early")))

    open_keys = sums.where("early is null")
    longest = open_keys.agg(F.max("n_events")).first()[0] or 0
    hops = F.when(F.col("predecessor").isNotNull(), 1).otherwise(0).cast("long").alias("hops")
    links = cut(events.join(open_keys.select("key"), "key").select("key", "event", F.col("predecessor").alias("to"), hops))
    for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        # An event whose pointer is null has reached the root, and stays there.
        beyond = links.select("key", F.col("event").alias("to"), F.col("to").alias("next"), F.col("hops").alias("more"))
        links = cut(links.join(beyond, ["key", "to"], "left").select("key", "event", F.col("next").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")))
    return sums, links


def _short(events: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """key, n_events, status, hops and rows (event, predecessor, ``kept``) of keys of at most ``SHORT`` events: the same doubling, inside an array."""
    rows = events.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("event", "predecessor", *kept))).alias("rows"))
    # Where the predecessor stands, from 1; null at a root, 0 for an unknown one.
    ids = F.transform("rows", lambda r: r["event"])
    placed = rows.withColumn("ids", ids).select("key", "rows", F.transform("rows", lambda r: F.array_position("ids", r["predecessor"])).alias("to"))
    known = F.filter("to", lambda t: t > 0)
    unknown = F.exists(F.transform("to", lambda t, i: F.coalesce((t == 0) | (t == i + 1), F.lit(False))), lambda x: x)
    early = F.when(F.size(F.filter("to", lambda t: t.isNull())) != 1, "root-invalid").when(unknown | (F.size(F.array_distinct(known)) < F.size(known)), "predecessor-invalid")
    at = lambda array, place: F.get(array, (place - 1).cast("int"))
    start = F.struct(F.col("to").alias("to"), F.transform("to", lambda t: F.when(t.isNull(), 0).otherwise(1).cast("long")).alias("hops"))
    double = lambda s, _: F.struct(
        F.transform(s["to"], lambda t: at(s["to"], t)).alias("to"), F.transform(s["hops"], lambda h, i: h + F.coalesce(at(s["hops"], F.get(s["to"], i)), F.lit(0))).alias("hops"),
    )
    rounds = F.filter(F.array(*[F.lit(1 << k) for k in range(math.ceil(math.log2(SHORT)))]), lambda n: n < F.size("to"))
    linked = placed.withColumn("early", early).withColumn("ends", F.when(F.col("early").isNull(), F.aggregate(rounds, start, double)))
    status = F.coalesce("early", F.when(F.exists("ends.to", lambda t: t.isNotNull()), "disconnected").otherwise("linear"))
    return linked.select("key", F.size("rows").cast("long").alias("n_events"), status.alias("status"), F.col("ends.hops").alias("hops"), "rows")


def _split(events: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Events of short chains, and those of long ones, if there are any."""
    long_ = cut(events.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SHORT).select("key"))
    if long_.isEmpty():
        return events, None
    return events.join(long_, "key", "left_anti"), events.join(long_, "key", "left_semi")


def _status(sums: DataFrame, links: DataFrame) -> DataFrame:
    lost = links.where("to is not null").groupBy("key").agg(F.count("*").alias("lost"))
    status = F.coalesce(F.col("early"), F.when(F.col("lost") > 0, "disconnected").otherwise("linear"))
    return sums.join(lost, "key", "left").select("key", "n_events", status.alias("status"))


def chain_status(events: DataFrame) -> DataFrame:
    """(key, n_events, status) of ``events`` (key, event, predecessor; event ids are unique and a root has none before it).

    root-invalid: not exactly one root; predecessor-invalid: an event that follows itself or an unknown one, or two that follow the
    same; disconnected: not all events lead back to the root; else linear. Keys that pass the first two tests hold one path and
    perhaps cycles, so pointers are doubled as often as the longest chain needs: no chain is walked in one task, and short ones,
    which are one row each, are not joined at all.
    """
    short, long_ = _split(events.select("key", "event", "predecessor"))
    status = _short(short).select("key", "n_events", "status")
    return status if long_ is None else status.unionByName(_status(*_linked(long_)))


def chain_positions(events: DataFrame, *kept: str) -> tuple[DataFrame, DataFrame]:
    """The statuses of :func:`chain_status`, and (key, event, position, ``kept``) of the events of linear keys; the root is at 0."""
    short, long_ = _split(events.select("key", "event", "predecessor", *kept))
    chains = _short(short, kept)
    status = chains.select("key", "n_events", "status")
    each = chains.where("status = 'linear'").select("key", F.explode(F.arrays_zip("rows", "hops")).alias("x"))
    positions = each.select("key", "x.rows.event", F.col("x.hops").alias("position"), *[F.col(f"x.rows.{c}").alias(c) for c in kept])
    if long_ is None:
        return status, positions
    sums, links = _linked(long_.select("key", "event", "predecessor"))
    far = cut(_status(sums, links))
    linear = far.where("status = 'linear'").select("key")
    placed = links.join(linear, "key", "left_semi").select("key", "event", F.col("hops").alias("position"))
    return status.unionByName(far), positions.unionByName(placed.join(long_.select("key", "event", *kept), ["key", "event"]) if kept else placed)
