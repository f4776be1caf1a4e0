"""Ordered logs: predecessor chains, latest and tail rows, and finite-state folds that no hot key can overload."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collapse_chain(rows: DataFrame, key: str, order: Sequence[str], value: str, event: str) -> DataFrame:
    """Keeps a row whose value differs from the one just before it in its key, with ``predecessor``, the kept event before it; A-B-A keeps three."""
    w = Window.partitionBy(key).orderBy(*order)
    kept = rows.withColumn("_before", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) | ~F.col("_before").eqNullSafe(F.col(value)))
    return kept.select(*rows.columns, F.lag(event).over(w).alias("predecessor")).drop("_before", "_n")


def latest(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of every key; partial maxima are combined before the shuffle."""
    others = [c for c in rows.columns if c not in (*order, key)]
    best = rows.groupBy(key).agg(F.max(F.struct(*order, *others)).alias("m"))
    return best.select(key, *[F.col(f"m.{c}").alias(c) for c in (*order, *others)]).select(*rows.columns)


def tail(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n rows of every key, with how many the key has (the count is taken before the bound)."""
    w = Window.partitionBy(key)
    return rows.withColumn("_r", F.row_number().over(w.orderBy(F.desc(order)))).withColumn("total", F.count("*").over(w)).where(F.col("_r") <= n).drop("_r")


def walk_back(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Per row: how many unbroken predecessors it has (positions that go down by one), and whether that reaches position 0."""
    w = Window.partitionBy(key).orderBy(position)
    island = rows.select(key, position).distinct().withColumn("_i", F.col(position) - F.row_number().over(w))
    depth = F.row_number().over(Window.partitionBy(key, "_i").orderBy(position)) - 1
    return island.withColumn("depth", depth.cast("long")).withColumn("complete", F.col("depth") == F.col(position)).drop("_i")


class Machine:
    """A finite-state machine: ``moves[(state, event)] = next``. Other events are ignored, or with ``strict`` lead to a final error state."""

    def __init__(self, start: str, moves: dict[tuple[str, str], str], strict: bool = False):
        self.start, self.moves, self.strict = start, moves, strict

    def step(self, state: str, event: str) -> str:
        if state.startswith("corrupt:"):
            return state
        return self.moves.get((state, event), f"corrupt:{event}-in-{state}" if self.strict else state)

    @property
    def states(self) -> list[str]:
        return sorted({self.start, *self.moves.values(), *(s for s, _ in self.moves)})


def fold(rows: DataFrame, key: str, order: Sequence[str], event: str, machine: Machine) -> DataFrame:
    """(key, state) after all events of each key, in order.

    Rows are range-partitioned by key and order, so a key with a third of all rows is spread over many tasks. A stretch of
    events is a map from every start state to an end state; a task emits one such map for each key in it, and a key's
    few maps are then composed in order.
    """
    states = machine.states
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, part int, ends array<string>"

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, known, open_key, ends = TaskContext.get().partitionId(), {}, None, None
        for batch in batches:
            done = []
            for k, e in zip(batch[key], batch[event], strict=True):
                if ends is None or k != open_key:
                    if ends is not None:
                        done.append((open_key, part, list(ends)))
                    open_key, ends = k, tuple(states)
                if (ends, e) not in known:
                    known[ends, e] = tuple(machine.step(s, e) for s in ends)
                ends = known[ends, e]
            yield pd.DataFrame(done, columns=[key, "part", "ends"])
        if ends is not None:
            yield pd.DataFrame([(open_key, part, list(ends))], columns=[key, "part", "ends"])

    maps = rows.select(key, *order, event).repartitionByRange(key, *order).sortWithinPartitions(key, *order).mapInPandas(stretches, schema)
    parts = F.array_sort(F.collect_list(F.struct("part", "ends")))
    names = F.array(*[F.lit(s) for s in states])
    go = lambda state, p: F.when(state.startswith("corrupt:"), state).otherwise(F.get(p["ends"], (F.array_position(names, state) - 1).cast("int")))
    return maps.groupBy(key).agg(parts.alias("_p")).select(key, F.aggregate("_p", F.lit(machine.start), go).alias("state"))


def violation(state: Column) -> Column:
    """The first violation's reason of a strict machine's end state, else null."""
    return F.when(state.startswith("corrupt:"), F.substring_index(state, ":", -1))
