"""Packets of ranked sections, trimmed to a number of bytes: items go from the tails, section by section, until a packet fits.

How much is gone before an item's turn is a prefix sum. It is summed up over stretches of positions first and inside a stretch
then, so a packet with any number of items needs no list, no loop and no task of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Sections in the order in which they give way.
SECTIONS = ("candidates", "assertions", "focus_nodes", "focus_flows", "related_tests", "reconciliation", "flow_refs", "context_refs")


def trim(envelopes: DataFrame, items: DataFrame, max_bytes: int, sections: Sequence[str] = SECTIONS, stretch: int = 65_536, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The items that stay, and one row for each packet: packet, bytes, n_kept, n_omitted, truncated, omissions, status.

    ``envelopes``: packet, size (bytes without any item). ``items``: packet, section, position (from 0, unique in a section, best first),
    size (bytes, with the comma). An item goes if what would be left with it and without all that gives way before it is more
    than ``max_bytes``. A packet whose envelope alone is larger has the status envelope-too-large and keeps no item; others are
    complete or trimmed. ``omissions`` counts what each section has lost. Items of sections that aren't listed are an error.
    Items are shuffled and sorted once, over ``partitions`` tasks if given; that number should grow with them.
    """
    if max_bytes <= 0:
        raise ValueError("max_bytes must be greater than zero")
    turn = F.element_at(F.create_map(*[x for i, s in enumerate(sections) for x in (F.lit(s), F.lit(i))]), F.col("section"))
    known = F.when(turn.isNull(), F.raise_error(F.concat(F.lit("unknown section: "), "section")).cast("int")).otherwise(turn)
    keys = ["packet", "_turn", "_stretch"]
    rows = items.withColumn("_turn", known).withColumn("_stretch", F.floor(F.col("position") / stretch))
    rows = rows.repartition(partitions, *keys) if partitions else rows.repartition(*keys)
    sums = rows.groupBy(*keys).agg(F.sum("size").alias("_sum"))
    # A row for each stretch of a section.
    earlier = Window.partitionBy("packet").orderBy("_turn", F.desc("_stretch")).rowsBetween(Window.unboundedPreceding, -1)
    totals = sums.groupBy("packet").agg(F.sum("_sum").alias("_items"))
    sized = envelopes.join(totals, "packet", "left").select("packet", "size", (F.col("size") + F.coalesce("_items", F.lit(0))).alias("_total"))
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).join(sized.select("packet", "_total"), "packet").select(*keys, (F.col("_total") - F.col("_offset")).alias("_left"))
    inside = Window.partitionBy(*keys).orderBy(F.desc("position")).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_gone", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    judged = placed.join(offsets, keys).withColumn("_stays", F.col("_left") - F.col("_gone") <= max_bytes)
    counts = judged.groupBy("packet").agg(
        F.count_if(F.col("_stays")).alias("n_kept"), F.count_if(~F.col("_stays")).alias("n_omitted"), F.sum(F.when(~F.col("_stays"), F.col("size")).otherwise(0)).alias("_less"),
        *[F.count_if(~F.col("_stays") & (F.col("_turn") == i)).alias(f"_lost_{i}") for i in range(len(sections))],
    )
    lost = F.filter(F.array(*[F.when(F.col(f"_lost_{i}") > 0, F.concat(F.col(f"_lost_{i}").cast("string"), F.lit(f" {s} omitted by packet bound"))) for i, s in enumerate(sections)]), lambda o: o.isNotNull())
    summary = sized.join(counts, "packet", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_kept", "n_omitted", "_less")})
    status = F.when(F.col("size") > max_bytes, "envelope-too-large").when(F.col("n_omitted") > 0, "trimmed").otherwise("complete")
    summary = summary.select("packet", (F.col("_total") - F.col("_less")).alias("bytes"), "n_kept", "n_omitted", (status != "complete").alias("truncated"), F.when(F.col("n_omitted") > 0, lost).otherwise(F.array().cast("array<string>")).alias("omissions"), status.alias("status"))
    return judged.where("_stays").select(*items.columns), summary
