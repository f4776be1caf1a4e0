"""All queries over the driver's tables, by name, with the DuckDB text that must give the same rows."""

from __future__ import annotations

from evidentia.plans import commands, continuities, delta, diagnoses, evidence, lifecycles, packets, relational, scripts, settings

QUERIES: dict = {}
ORACLES: dict = {}

for module in (delta, relational, evidence, lifecycles, diagnoses, packets, scripts, settings, continuities, commands):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
