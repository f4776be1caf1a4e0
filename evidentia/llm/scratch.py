"""Written tables that cut lineage, in the folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session without that setting gets a temporary folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextmanager
def rows_a_batch(spark: SparkSession, n: int) -> Iterator[None]:
    """Inside, what runs sends at most ``n`` rows at once to Python, for rows that are large; then the session's own limit holds again."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """A folder of one job's tables. ``keep`` writes a table and reads it again, ``drop`` deletes one that is used up."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{job}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, rows: DataFrame, name: str, **options: str) -> DataFrame:
        rows.write.mode("overwrite").option("compression", "zstd").options(**options).parquet(self.path(name))
        return self.spark.read.schema(rows.schema).parquet(self.path(name))

    def last(self, rows: DataFrame, name: str) -> DataFrame:
        """Keeps a job's result and deletes all its other tables."""
        kept = self.keep(rows, name)
        path_of = self.spark._jvm.org.apache.hadoop.fs.Path
        root = path_of(self.root)
        for status in root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(root):
            if status.getPath().getName() != name:
                self.drop(status.getPath().getName())
        return kept

    def drop(self, *names: str) -> None:
        path_of = self.spark._jvm.org.apache.hadoop.fs.Path
        for name in names:
            path = path_of(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
