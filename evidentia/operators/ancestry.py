"""First parents of many commits at once: tables of 2^k-th parents, and how pairs of commits stand to one another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.lineage import cut


def ancestor_index(commits: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(commit, root, depth) and, for k = 0, 1, .., the 2^k-th parents (commit, ancestor), of ``commits`` (commit, parent; unique, not null).

    A parent that is not a commit is none: histories may be cut off. Commits that lead into a cycle have no depth and no root.
    A history of n commits in a line takes log n joins, so none is walked, in no task.
    """
    known = commits.select(F.col("commit").alias("parent"), F.lit(True).alias("_known"))
    first = commits.join(known, "parent", "left").select("commit", F.when(F.col("_known"), F.col("parent")).alias("parent"))
    # ``to`` is null beyond the root; ``hops`` counts the commits passed, ``root`` the last one.
    links = cut(first.select("commit", F.col("parent").alias("to"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("hops"), F.when(F.col("parent").isNull(), F.col("commit")).alias("root")))
    levels, most = [], links.count()
    while True:
        level = links.where("to is not null").select("commit", F.col("to").alias("ancestor"))
        # More hops than commits: what is left open are cycles.
        if 1 << len(levels) > most or level.isEmpty():
            break
        levels.append(level)
        beyond = links.select(F.col("commit").alias("to"), F.col("to").alias("next"), F.col("hops").alias("more"), F.col("root").alias("end"))
        joined = links.join(beyond, "to", "left")
        links = cut(joined.select("commit", F.col("next").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.coalesce("root", "end").alias("root")))
    return links.select("commit", "root", F.when(F.col("root").isNotNull(), F.col("hops")).alias("depth")), levels


def _jump(rows: DataFrame, column: str, level: DataFrame, when) -> DataFrame:
    """``rows`` with ``column`` replaced by its ancestor in ``level`` where ``when`` holds."""
    step = level.select(F.col("commit").alias(column), F.col("ancestor").alias("_next"))
    moved = rows.withColumn("_when", when).join(step, column, "left")
    return moved.withColumn(column, F.when(F.col("_when"), F.col("_next")).otherwise(F.col(column))).drop("_next", "_when")


def relate(pairs: DataFrame, commits: DataFrame) -> DataFrame:
    """a, b, relation, common, ahead, behind of distinct ``pairs`` (a, b) by the first parents of ``commits`` (commit, parent).

    relation: same; adjacent (a is b's first parent); ancestor (a comes before b); descendant; diverged (a common commit, which is
    neither); unrelated; cyclic (one of them leads into a cycle); unknown (one of them is null or no commit). ``common`` is the
    latest common commit, ``ahead`` and ``behind`` are b's and a's distances from it; the three are null without one.
    """
    depths, levels = ancestor_index(commits)
    end = lambda side: depths.select(F.col("commit").alias(side), F.lit(True).alias(f"{side}_known"), F.col("root").alias(f"{side}_root"), F.col("depth").alias(f"{side}_depth"))
    rows = cut(pairs.select("a", "b").distinct().join(end("a"), "a", "left").join(end("b"), "b", "left"))
    kin = F.col("a_root") == F.col("b_root")
    # The deeper one goes up by the bits of the difference, then both go up by halving steps while they differ. Pairs of one depth
    # skip the first part, and pairs that have met skip the second.
    gap = F.col("a_depth") - F.col("b_depth")
    deeper = rows.where(kin).select("a", "b", F.when(gap < 0, F.col("b")).otherwise(F.col("a")).alias("x"), F.when(gap < 0, F.col("a")).otherwise(F.col("b")).alias("y"), F.abs(gap).alias("gap"))
    climbing = deeper.where("gap > 0")
    for k, level in enumerate(levels):
        climbing = _jump(climbing, "x", level, F.col("gap").bitwiseAND(1 << k) != 0)
        # One checkpoint for several joins: each level reads the one before it once.
        if k % 4 == 3:
            climbing = cut(climbing)
    level_pairs = cut(climbing.unionByName(deeper.where("gap = 0")).drop("gap"))
    met, open_pairs = level_pairs.where("x = y"), level_pairs.where("x <> y")
    for k, level in enumerate(reversed(levels)):
        up = lambda side: level.select(F.col("commit").alias(side), F.col("ancestor").alias(f"{side}_up"))  # noqa: B023, E731
        apart = open_pairs.join(up("x"), "x", "left").join(up("y"), "y", "left").withColumn("_go", F.coalesce(F.col("x_up") != F.col("y_up"), F.lit(False)))
        move = lambda side: F.when(F.col("_go"), F.col(f"{side}_up")).otherwise(F.col(side)).alias(side)
        open_pairs = apart.select("a", "b", move("x"), move("y"))
        if k % 4 == 3:
            open_pairs = cut(open_pairs)
    open_pairs = met.unionByName(open_pairs)
    if levels:
        parent = levels[0].select(F.col("commit").alias("x"), F.col("ancestor").alias("_p"))
        open_pairs = open_pairs.join(parent, "x", "left").withColumn("common", F.when(F.col("x") == F.col("y"), F.col("x")).otherwise(F.col("_p")))
    else:
        open_pairs = open_pairs.withColumn("common", F.col("x"))
    at = depths.select(F.col("commit").alias("common"), F.col("depth").alias("_d"))
    found = open_pairs.join(at, "common").select(F.col("a").alias("_a"), F.col("b").alias("_b"), "common", "_d")
    out = rows.join(found, rows["a"].eqNullSafe(found["_a"]) & rows["b"].eqNullSafe(found["_b"]), "left").withColumns({"ahead": F.col("b_depth") - F.col("_d"), "behind": F.col("a_depth") - F.col("_d")})
    relation = (
        F.when(F.col("a_known").isNull() | F.col("b_known").isNull(), "unknown").when(F.col("a_root").isNull() | F.col("b_root").isNull(), "cyclic").when(F.col("common").isNull(), "unrelated")
        .when(F.col("a") == F.col("b"), "same").when((F.col("behind") == 0) & (F.col("ahead") == 1), "adjacent").when(F.col("behind") == 0, "ancestor").when(F.col("ahead") == 0, "descendant").otherwise("diverged")
    )
    return out.select("a", "b", relation.alias("relation"), "common", "ahead", "behind")


def graph_relation(events: DataFrame) -> DataFrame:
    """key, n_events, relation of chains of ``events`` (key, graph_id): whether all events of a chain saw the same graph; null ids don't count."""
    changed = F.min("graph_id") != F.max("graph_id")
    return events.groupBy("key").agg(F.count("*").alias("n_events"), F.when(F.coalesce(changed, F.lit(False)), "structural-graph-changed").otherwise("same-structural-graph").alias("relation"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
