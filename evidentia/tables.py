"""Reading the driver's parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(*rows: DataFrame, each: int = 1_000_000) -> int:
    """How many tasks to shuffle so many rows over, so that a task's share does not grow with the tables; tables of files are counted from their footers."""
    least = int(rows[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-sum(r.count() for r in rows) // each))
