"""History diagnosis over 24 versions: orders change their customers' files, lines are edges between files, suppliers are flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.lineage import cut
from evidentia.operators import diagnosis
from evidentia.tables import table, tasks

# What follows reads alike in Spark and in DuckDB.
_PATH = "case when {0} % 11 = 0 then concat('docs/c', cast({0} as string), '.md') else concat('src/c', cast({0} as string), '.ts') end"
_COMMON = f"""oc as (select o_custkey as cust, o_orderkey % 24 as v, max(o_orderkey) as k from orders group by o_custkey, o_orderkey % 24),
  of as (select cust, {_PATH.format("cust")} as path, concat('h', cast(k % 5 as string)) as hash, v as valid_from, lead(v) over (partition by cust order by v) as next_v from oc),
  files as (select cust, path, hash, valid_from, case when next_v is null and cust % 7 = 0 and valid_from < 20 then valid_from + 2 else next_v end as valid_to, next_v from of),
  touched as (select valid_from as version, path from files union all select valid_to, path from files where next_v is null and valid_to is not null
    union all select distinct o_orderkey % 24, 'package.json' from orders where o_orderkey % 24 in (3, 9)),
  raw as (select o_custkey as cust, concat('n', cast(o_custkey as string)) as src, concat('n', cast(l_partkey % 400 as string)) as dst,
    case l_linenumber % 4 when 0 then 'calls' when 1 then 'constructs' when 2 then 'imports' else 'declares' end as kind, {_PATH.format("o_custkey")} as src_path, {_PATH.format("(l_partkey % 400)")} as dst_path,
    l_orderkey % 24 as valid_from, case when l_orderkey % 24 + 1 + cast(l_quantity as int) % 10 < 24 then l_orderkey % 24 + 1 + cast(l_quantity as int) % 10 end as valid_to from lineitem join orders on o_orderkey = l_orderkey),
  lf as (select distinct l_suppkey as s, l_orderkey % 24 as v from lineitem where l_linenumber = 2 and l_orderkey % 5 = l_suppkey % 5),
  flows as (select concat('flow', cast(s as string)) as flow, concat('f', cast((v * 7 + s) % 3 as string)) as fingerprint, case when v < 9 then 'e0' when v < 18 then 'e1' else 'e2' end as entry,
    case when v < 5 then 'r0' when v < 14 then 'r1' else 'r2' end as entry_record, concat('t', cast(v % 2 as string)) as tests, v as valid_from, lead(v) over (partition by s order by v) as valid_to from lf),
  contexts as (select c_custkey as context, case when c_custkey % 5 = 1 then 'corrupt' when c_custkey % 13 = 1 then 'confirmed-inapplicable' else 'usable' end as state,
    case when c_custkey % 23 = 0 then 23 else c_custkey % 12 end as good_version, case when c_custkey % 19 = 0 then 22 else 23 end as graph_version, 23 as head_version, c_custkey % 17 = 0 as dirty from customer where c_custkey % 3 = 0),
  starts as (select context, context + i as cust from contexts cross join (select 0 as i union all select 1 union all select 2) as x),
  focus as (select context, {_PATH.format("cust")} as path, true as in_focus from starts union all
    select distinct context, dst_path, false from starts join raw on raw.cust = starts.cust where valid_to is null),
  focus_flows as (select context, concat('flow', cast(context % 100 + 1 as string)) as flow from contexts where context % 2 = 0),
  commits as (select distinct o_orderkey % 24 as version, concat('commit', cast(o_orderkey % 24 * 7 % 24 as string)) as commit from orders)"""


def _diagnosis(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    for name in ("orders", "lineitem", "customer"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    read = lambda what: spark.sql(f"with {_COMMON} select {what}")
    keys = ["src", "dst", "kind", "src_path", "dst_path"]
    raw = read(f"{', '.join(keys)}, valid_from, valid_to from raw where kind <> 'declares'")
    edges = diagnosis.merge_intervals(raw, keys, meet=["src", "dst"], parts=tasks(table(spark, sf_dir, "lineitem"), each=500_000))
    every = cut(read("path, hash, valid_from, valid_to, next_v from files"), free=True)
    files = every.where("path like 'src/%'").drop("next_v")
    # As "touched" in the text above, from files that are made once.
    closed = every.where("next_v is null and valid_to is not null").select(F.col("valid_to").alias("version"), "path")
    manifest = spark.sql("select distinct o_orderkey % 24 as version, 'package.json' as path from orders where o_orderkey % 24 in (3, 9)")
    touched = every.select(F.col("valid_from").alias("version"), "path").unionByName(closed).unionByName(manifest)
    return diagnosis.rank_history(read("* from contexts"), read("* from commits"), touched, files, edges, read("* from flows"), read("* from focus"), read("* from focus_flows"), max_commits=20, max_candidates=12, max_paths=300)


def history_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked commits of every question."""
    candidates, _ = _diagnosis(spark, sf_dir)
    return candidates.withColumn("reasons", F.array_join("reasons", ",")).withColumn("paths", F.array_join("paths", ","))


def history_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every question: a status, and what bounds left out."""
    return _diagnosis(spark, sf_dir)[1].withColumn("omissions", F.array_join("omissions", ","))


_SQL = f"""with {_COMMON.replace("as string)", "as varchar)")},
  vs as (select unnest(range(0, 24)) as v),
  fa as (select v, path, hash from files, vs where path like 'src/%' and v >= valid_from and (valid_to is null or v < valid_to)),
  file_changes as (select coalesce(a.v, b.v) as v, coalesce(a.path, b.path) as path from fa a full join (select v + 1 as v, path, hash from fa) b on a.v = b.v and a.path = b.path where a.hash is distinct from b.hash and coalesce(a.v, b.v) between 1 and 23),
  ea as (select distinct v, src, dst, kind, src_path, dst_path from raw, vs where kind <> 'declares' and v >= valid_from and (valid_to is null or v < valid_to)),
  edge_changes as (select distinct coalesce(a.v, b.v) as v, coalesce(a.src, b.src) as src, coalesce(a.dst, b.dst) as dst, coalesce(a.src_path, b.src_path) as sp, coalesce(a.dst_path, b.dst_path) as dp
    from ea a full join (select * replace (v + 1 as v) from ea) b on a.v = b.v and a.src = b.src and a.dst = b.dst and a.kind = b.kind where (a.src is null or b.src is null) and coalesce(a.v, b.v) between 1 and 23),
  wa as (select v, flow, fingerprint, entry, entry_record, tests from flows, vs where v >= valid_from and (valid_to is null or v < valid_to)),
  flow_changes as (select coalesce(a.v, b.v) as v, coalesce(a.flow, b.flow) as flow, a.fingerprint is distinct from b.fingerprint as f, a.entry is distinct from b.entry as e, a.entry_record is distinct from b.entry_record as r, coalesce(a.tests, '') <> coalesce(b.tests, '') as t
    from wa a full join (select * replace (v + 1 as v) from wa) b on a.v = b.v and a.flow = b.flow where coalesce(a.v, b.v) between 1 and 23),
  gated as (select *, case when state <> 'usable' then state when dirty or graph_version <> head_version then 'source-state-mismatch' when good_version = head_version then 'empty-range' else 'confirmed' end as status,
    context in (select context from focus_flows) as by_flow from contexts),
  ranges as (select context, by_flow, v from gated, vs where status = 'confirmed' and v > good_version and v > head_version - 20 and v <= head_version),
  roles as (select context, path, bool_or(in_focus) as near from focus group by all),
  p as (select distinct version as v, path from touched),
  hp as (select r.context, r.v, bool_or(near) as focus_path, true as cone_path from ranges r join p on p.v = r.v join roles o on o.context = r.context and o.path = p.path where p.path like '%.ts' or (r.by_flow and p.path = 'package.json') group by r.context, r.v),
  hf as (select r.context, r.v, count(*) filter (where near) as focus_file, count(*) filter (where not near) as cone_file from ranges r join file_changes c on c.v = r.v join roles o on o.context = r.context and o.path = c.path group by r.context, r.v),
  he1 as (select r.context, r.v, src, dst, bool_or(near) as near from ranges r join edge_changes c on c.v = r.v join roles o on o.context = r.context and (o.path = c.sp or o.path = c.dp) group by all),
  he as (select context, v, bool_or(near) as focus_edge, bool_or(not near) as cone_edge from he1 group by context, v),
  hw as (select r.context, r.v, count(*) filter (where f) as flow, count(*) filter (where e) as entry, count(*) filter (where t) as tests, bool_or(r.by_flow and c.r) as record from ranges r join focus_flows w on w.context = r.context join flow_changes c on c.v = r.v and c.flow = w.flow group by r.context, r.v),
  s as (select r.context, r.v, r.by_flow, coalesce(focus_path, false) as focus_path, coalesce(cone_path, false) as cone_path, coalesce(focus_file, 0) as focus_file, coalesce(cone_file, 0) as cone_file, coalesce(focus_edge, false) as focus_edge, coalesce(cone_edge, false) as cone_edge,
      coalesce(flow, 0) as flow, case when coalesce(entry, 0) = 0 and coalesce(record, false) then 1 else coalesce(entry, 0) end as entry, coalesce(tests, 0) as tests
    from ranges r left join hp on hp.context = r.context and hp.v = r.v left join hf on hf.context = r.context and hf.v = r.v left join he on he.context = r.context and he.v = r.v left join hw on hw.context = r.context and hw.v = r.v),
  scored as (select *, 10 + 100 * focus_path::int + 60 * cone_path::int + 75 * flow + 60 * entry + 25 * tests + 35 * focus_file + 20 * cone_file + 45 * focus_edge::int + 25 * cone_edge::int as score,
    list_filter([case when focus_path then 'changed-path-in-focus-context' end, case when cone_path then 'changed-path-in-dependency-cone' end, case when flow > 0 then 'focused-flow-changed' end, case when entry > 0 then 'focused-entry-changed' end,
      case when tests > 0 then 'related-test-structure-changed' end, case when focus_file > 0 then 'focused-node-changed' end, case when cone_file > 0 then 'dependency-cone-node-changed' end, case when focus_edge then 'focused-edge-changed' end,
      case when cone_edge then 'dependency-cone-edge-changed' end], lambda x: x is not null) as why from s),
  kept as (select p.v, b.by_flow, p.path, n.hash as now, f.hash as then_ from p cross join (values (true), (false)) as b(by_flow) left join files n on n.path = p.path and n.valid_to is null left join fa f on f.path = p.path and f.v = p.v
    where p.path like '%.ts' or (b.by_flow and p.path = 'package.json') qualify row_number() over (partition by p.v, b.by_flow order by p.path) <= 300),
  fate as (select v, by_flow, string_agg(path, ',' order by path) as paths, case when count(now) = 0 then 'removed' when bool_or(now is null or now is distinct from then_) then 'changed' else 'retained' end as retention from kept group by v, by_flow),
  sizes as (select v, count(*) as n_all, count(*) filter (where path like '%.ts') as n_sources, count(*) filter (where path = 'package.json') as n_manifests from p group by v),
  found as (select scored.context, commit, scored.v, score, why, n_sources + case when scored.by_flow then n_manifests else 0 end as n_paths, n_all, paths, retention
    from scored join fate on fate.v = scored.v and fate.by_flow = scored.by_flow join sizes on sizes.v = scored.v join commits on version = scored.v where len(why) > 0)"""
QUERIES = {"history_candidates": history_candidates, "history_summary": history_summary}
ORACLES = {
    "history_candidates": _SQL
    + """ select context, cast(row_number() over (partition by context order by score desc, commit) as integer) as rank, commit, v as version, cast(score as bigint) as score,
      array_to_string(list_append(why, 'introduced-after-last-known-good'), ',') as reasons, n_paths, paths, retention from found qualify rank <= 12""",
    "history_summary": _SQL
    + """, totals as (select context, count(*) as total, list_sort(list(case when n_paths > 300 then 'commit ' || commit || ' paths capped at 300' when n_all > n_paths then 'commit ' || commit || ' contained non-TypeScript paths omitted from candidate evidence' end)
        filter (where n_paths > 300 or n_all > n_paths)) as notes from found group by context),
      lengths as (select *, case when status = 'confirmed' then greatest(head_version - good_version, 0) else 0 end as length from gated)
    select l.context, status, least(length, 20) as commits_inspected, coalesce(total, 0) as total, length > 20 or coalesce(total, 0) > 12 as truncated,
      array_to_string(list_concat(coalesce(notes, []), list_filter([case when length > 20 then 'history commits capped at 20' end, case when total > 12 then 'historical candidates capped at 12' end], lambda x: x is not null)), ',') as omissions
    from lengths l left join totals t on t.context = l.context""",
}
