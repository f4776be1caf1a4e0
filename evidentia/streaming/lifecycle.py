"""Lifecycle states of an unbounded event log: a keyed finite-state machine in Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evidentia.operators.sequences import Machine


def follow(events: DataFrame, key: str, order: str, event: str, machine: Machine) -> DataFrame:
    """(key, state) of every key in each micro-batch that has events for it; events of one batch are applied by ``order``, batches as they come."""
    kind = events.schema[key].dataType.simpleString()

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else machine.start
        for e in pd.concat(list(batches)).sort_values(order)[event]:
            now = machine.step(now, e)
        state.update((now,))
        yield pd.DataFrame({key: [group[0]], "state": [now]})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, state string", "state string", "update", GroupStateTimeout.NoTimeout)
