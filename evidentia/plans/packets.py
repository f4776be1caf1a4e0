"""Packets of customers (their orders and lines in three sections), manifests of orders, and rows merged by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import manifests, packets
from evidentia.sources.versions import upsert
from evidentia.tables import table, tasks

# What follows reads alike in Spark and in DuckDB.
_ITEMS = """select o_custkey as packet, 'candidates' as section, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) - 1 as position, 20 + length(o_orderpriority) + o_orderkey % 30 as size from orders
  union all select o_custkey, 'related_tests', row_number() over (partition by o_custkey order by l_orderkey, l_linenumber, l_partkey) - 1, 5 + l_partkey % 20 from lineitem join orders on o_orderkey = l_orderkey
  union all select o_custkey, 'context_refs', row_number() over (partition by o_custkey order by o_orderkey) - 1, 8 + o_orderkey % 9 from orders where o_orderkey % 3 = 0"""
_ENVELOPES = "select c_custkey as packet, case when c_custkey % 41 = 0 then 900 else 100 + length(c_name) end as size from customer"
_FILE = """concat('{"path":"', case when o_custkey % 9 = 1 and o_orderkey % 4 = 0 then '/' when o_custkey % 9 = 2 and o_orderkey % 4 = 1 then 'a/../' when o_custkey % 9 = 3 then 'x//' else 'src/' end,
  cast(case when o_custkey % 9 = 4 then o_orderkey % 12 else o_orderkey end as string), '.ts","language":"', case when o_custkey % 9 = 5 then 'js' else 'typescript' end, '","bytes":', cast(o_orderkey % 100 as string),
  case when o_custkey % 9 = 6 and o_orderkey % 4 = 0 then '' else concat(',"hash":"', cast(o_orderkey % 7 as string), '"') end, '}')"""
_BOUNDS = {"max_bytes": 1200, "max_files": 14}


def _trimmed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Items as ``_ITEMS`` has them, numbered over tasks whose number grows with the lines."""
    orders, lines = (table(spark, sf_dir, name) for name in ("orders", "lineitem"))
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    n = tasks(orders, lines)
    lines.select("l_orderkey", "l_linenumber", "l_partkey").repartition(n, "l_orderkey").createOrReplaceTempView("lineitem")
    orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority").repartition(n, "o_orderkey").createOrReplaceTempView("orders")
    joined = spark.sql("select o_custkey, l_orderkey, l_linenumber, l_partkey from lineitem join orders on o_orderkey = l_orderkey").repartition(n, "o_custkey")
    joined.createOrReplaceTempView("packet_lines")
    spark.table("orders").repartition(n, "o_custkey").createOrReplaceTempView("packet_orders")
    items = spark.sql(_ITEMS.replace("from lineitem join orders on o_orderkey = l_orderkey", "from packet_lines").replace("from orders", "from packet_orders"))
    return packets.trim(spark.sql(_ENVELOPES), items, 800, partitions=n)


def packet_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trimmed(spark, sf_dir)[0]


def packet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trimmed(spark, sf_dir)[1].withColumn("omissions", F.array_join("omissions", ","))


def source_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of each customer's orders, some of them wrong in one way or another: the files in them, or why they are refused."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    files = spark.sql(f"select o_custkey as key, {_FILE} as f from orders").groupBy("key").agg(F.array_sort(F.collect_list("f")).alias("f"))
    raw = F.concat(F.lit("["), F.array_join("f", ","), F.when(F.col("key") % 9 == 7, "").otherwise("]"))
    decoded = manifests.decode_manifests(files.select("key", raw.alias("raw")), **_BOUNDS)
    return decoded.select("key", "n_files", "reason", F.array_join(F.transform("files", lambda f: F.concat_ws(":", f["path"], f["bytes"].cast("string"), f["hash"])), ",").alias("files"))


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' prices, and those that lines bring: of each part the row of the newest ship date, of the lines where both have it."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.lit("1996-01-01").cast("timestamp").alias("at"), F.col("p_retailprice").alias("price"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.date_trunc("year", "l_shipdate").alias("at"), F.col("l_extendedprice").alias("price"))
    return upsert(parts, lines, ["part"], ["at"]).select("part", F.date_format("at", "yyyy-MM-dd").alias("day"), "price")


_DUCK = lambda text: text.replace("as string)", "as varchar)")
_TRIM = f"""with i as ({_ITEMS}), e as ({_ENVELOPES}), o as (select *, case section when 'candidates' then 0 when 'related_tests' then 4 else 7 end as turn from i),
  t as (select e.packet, e.size, e.size + coalesce(sum(i.size), 0) as total from e left join i on i.packet = e.packet group by e.packet, e.size),
  j as (select o.*, t.total - coalesce(sum(o.size) over (partition by o.packet order by turn, position desc rows between unbounded preceding and 1 preceding), 0) <= 800 as stays from o join t on t.packet = o.packet)"""
QUERIES = {"packet_items": packet_items, "packet_summary": packet_summary, "source_manifests": source_manifests, "upsert_latest": upsert_latest}
ORACLES = {
    "packet_items": _TRIM + " select packet, section, position, size from j where stays",
    "packet_summary": _TRIM
    + """, c as (select packet, count(*) filter (where stays) as n_kept, count(*) filter (where not stays) as n_omitted, coalesce(sum(size) filter (where not stays), 0) as less from j group by packet),
      l as (select packet, string_agg(n || ' ' || section || ' omitted by packet bound', ',' order by turn) as omissions from (select packet, section, turn, count(*) as n from j where not stays group by all) group by packet)
    select t.packet, cast(total - coalesce(less, 0) as bigint) as bytes, coalesce(n_kept, 0) as n_kept, coalesce(n_omitted, 0) as n_omitted, size > 800 or coalesce(n_omitted, 0) > 0 as truncated, coalesce(omissions, '') as omissions,
      case when size > 800 then 'envelope-too-large' when coalesce(n_omitted, 0) > 0 then 'trimmed' else 'complete' end as status from t left join c on c.packet = t.packet left join l on l.packet = t.packet""",
    "source_manifests": f"""with f as (select o_custkey as key, o_orderkey as k, {_DUCK(_FILE)} as f from orders), m as (select key, '[' || string_agg(f, ',' order by f) || case when key % 9 = 7 then '' else ']' end as raw, count(*) as n from f group by key),
      d as (select key, raw, n, case when json_valid(raw) then json_extract_string(raw, '$[*].path') end as paths, case when json_valid(raw) then json_extract_string(raw, '$[*].hash') end as hashes,
        case when json_valid(raw) then json_extract_string(raw, '$[*].language') end as languages, case when json_valid(raw) then json_extract_string(raw, '$[*].bytes') end as sizes from m),
      r as (select *, case when strlen(raw) > 1200 then 'manifest-too-large' when not json_valid(raw) or len(hashes) < n then 'manifest-malformed' when n > 14 then 'too-many-files'
        when list_contains(languages, 'js') or len(list_filter(paths, lambda p: starts_with(p, '/') or contains(p, '//') or contains(p, '/../'))) > 0 then 'path-not-normalized' when len(list_distinct(paths)) < n then 'duplicate-path' end as reason from d)
      select key, case when reason is null then cast(n as integer) end as n_files, reason, case when reason is null then list_aggregate(list_sort(list_transform(range(1, n + 1), lambda i: paths[i] || ':' || sizes[i] || ':' || hashes[i])), 'string_agg', ',') end as files from r""",
    "upsert_latest": """with a as (select p_partkey as part, timestamp '1996-01-01' as t, 0 as new, p_retailprice as price from part union all select l_partkey, date_trunc('year', l_shipdate), 1, l_extendedprice from lineitem)
      select part, strftime(t, '%Y-%m-%d') as day, price from a qualify row_number() over (partition by part order by t desc, new desc, price desc) = 1""",
}
