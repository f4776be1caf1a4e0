"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(rows: DataFrame, free: bool = False) -> DataFrame:
    """``rows``, checkpointed to the shared folder in spark.checkpoint.dir; only a local session gets a folder of its own.

    ``free``: the files of the shuffles that led to them are removed at once, not when the driver happens to collect garbage.
    """
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    if not free:
        return rows.checkpoint()
    conf = rows.sparkSession.conf
    before = conf.get(FREE, "false")
    conf.set(FREE, "true")
    try:
        # The setting holds for plans that are made after it.
        return rows.select("*").checkpoint()
    finally:
        conf.set(FREE, before)
