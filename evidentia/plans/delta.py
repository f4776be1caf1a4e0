"""Snapshot delta queries over ``orders`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators.delta import bounded, delta_counts, snapshot_delta
from evidentia.tables import table


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    before = orders.where("o_orderkey % 10 <> 0")
    edited = F.when(F.col("o_orderkey") % 7 == 0, F.lit("X")).otherwise(F.col("o_orderstatus"))
    after = orders.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", edited)
    return before, after


def query_snapshot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_delta(*_snapshots(spark, sf_dir), ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


def query_delta_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_counts(query_snapshot_delta(spark, sf_dir))


def query_delta_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded(query_snapshot_delta(spark, sf_dir).select("o_orderkey", "change"), [F.col("change"), F.col("o_orderkey")], 256)


_DELTA = """
with b as (select o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderkey % 10 <> 0),
a as (select o_orderkey, case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end as o_orderstatus, o_orderpriority
      from orders where o_orderkey % 11 <> 0),
d as (select coalesce(b.o_orderkey, a.o_orderkey) as o_orderkey,
  case when b.o_orderkey is null then 'added' when a.o_orderkey is null then 'removed'
       when b.o_orderstatus is distinct from a.o_orderstatus or b.o_orderpriority is distinct from a.o_orderpriority then 'changed' end as change,
  b.o_orderstatus as before_o_orderstatus, a.o_orderstatus as after_o_orderstatus,
  b.o_orderpriority as before_o_orderpriority, a.o_orderpriority as after_o_orderpriority
  from b full outer join a on b.o_orderkey = a.o_orderkey)
"""

QUERIES = {"snapshot_delta": query_snapshot_delta, "delta_counts": query_delta_counts, "delta_bounded": query_delta_bounded}
ORACLES = {
    "snapshot_delta": _DELTA + "select * from d where change is not null",
    "delta_counts": _DELTA + """select count(*) filter (where change = 'added') as added_count,
      count(*) filter (where change = 'changed') as changed_count, count(*) filter (where change = 'removed') as removed_count from d""",
    "delta_bounded": _DELTA + "select o_orderkey, change from d where change is not null order by change, o_orderkey limit 256",
}
