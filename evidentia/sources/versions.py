"""Tables kept as Parquet in partitions that Spark writes itself: versions appended, partitions replaced, newest rows merged in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_version(rows: DataFrame, path: str, version: int) -> None:
    """Adds the rows as a partition of their own; other versions' files stay as they are."""
    rows.withColumn("version", F.lit(version).cast("long")).write.mode("append").partitionBy("version").parquet(path)


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, or of the newest one, without that column."""
    stored = spark.read.parquet(path)
    wanted = F.lit(version) if version is not None else F.lit(stored.agg(F.max("version")).first()[0])
    return stored.where(F.col("version") == wanted).drop("version")


def replace_partitions(rows: DataFrame, path: str, by: Sequence[str]) -> None:
    """Puts the rows in place of the partitions that they fall into; files of all other partitions aren't touched, and a rerun changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key: the one of the highest order, of the incoming rows where both have it. Partial maxima combine before the shuffle."""
    others = [c for c in stored.columns if c not in keys]
    rows = stored.withColumn("_new", F.lit(0)).unionByName(incoming.select(*stored.columns).withColumn("_new", F.lit(1)))
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, "_new", *[c for c in others if c not in order])).alias("_m"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_m.{c}").alias(c) for c in stored.columns])
