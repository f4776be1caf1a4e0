"""Answers to a stream of commands, by the batch operator and a table of receipts that every micro-batch adds to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from evidentia.operators import receipts


def answer_stream(commands: DataFrame, folder: str) -> DataStreamWriter:
    """A writer that answers ``commands`` (see :func:`evidentia.operators.receipts.answer`) into ``folder``/answers and ``folder``/receipts.

    A micro-batch writes its own partitions, over what a failed attempt at it left, and reads the receipts of earlier ones only; so
    it comes to the same when it is run again. Nothing of a key is held in memory, whatever its number of commands.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        columns = f"{receipts.RECEIPT}, batch bigint"
        empty = spark.createDataFrame([], columns)
        # The first batch has nothing to read; a folder may still hold its own failed attempt.
        known = spark.read.schema(columns).parquet(f"{folder}/receipts") if number else empty
        known = known.where(F.col("batch") < number).drop("batch")
        events = known.select("context", "idempotency_key", "event", "kind")
        batch = batch.persist()
        try:
            answers, added = receipts.answer(batch, known, events)
            added.write.mode("overwrite").parquet(f"{folder}/receipts/batch={number}")
            answers.write.mode("overwrite").parquet(f"{folder}/answers/batch={number}")
        finally:
            batch.unpersist()

    return commands.writeStream.foreachBatch(step)
