"""Commits and what changes between them: every customer's orders are a tree of commits; lines and orders fill 40 snapshots.

The SQL walks to all ancestors of every commit, and compares whole snapshots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import ancestry, continuity
from evidentia.tables import table

LIMITS = continuity.Limits(paths=60, nodes=10, edges=12, flows=3)
# What follows reads alike in Spark and in DuckDB, but for the lateral views.
_TREE = """select commit, case when n % 4 = 0 then third else previous end as parent from (select o_orderkey as commit, row_number() over w as n, lag(o_orderkey, 1) over w as previous, lag(o_orderkey, 3) over w as third
  from orders window w as (partition by o_custkey order by o_orderkey)) as x"""
_PAIRS = """select o_orderkey as a, o_orderkey as b from orders union select o_orderkey, o_orderkey + 1 from orders
  union select o_orderkey, lead(o_orderkey, 1) over (partition by o_custkey order by o_orderkey) from orders union select lead(o_orderkey, 2) over (partition by o_custkey order by o_orderkey), o_orderkey from orders
  union select o_orderkey, lead(o_orderkey, 5) over (partition by o_custkey order by o_orderkey) from orders"""
_PARTS = {
    "commits": "select concat('r', cast(v as string)) as commit, case when v > 0 then concat('r', cast(v - case when v % 10 = 5 then 3 else 1 end as string)) end as parent from (select distinct o_orderkey % 40 as v from orders) as x",
    "snapshots": """select concat('r', cast(v as string)) as revision, case when v % 13 = 7 then 'q' else 'p' end as project, case when v = 9 then null when v = 17 then 'fork' else 'i' end as repository,
      case when v = 21 then null when v >= 31 then 'k2' else 'k1' end as contract, v % 6 = 2 as truncated from (select distinct o_orderkey % 40 as v from orders) as x where v <> 25""",
    "files": """select concat('r', cast((o_orderkey + s) % 40 as string)) as revision, concat('src/c', cast(o_custkey % 400 as string), '.ts') as path, concat('h', cast(max(o_orderkey) % 3 as string)) as hash
      from orders lateral view explode(array(0, 1, 2)) y as s group by (o_orderkey + s) % 40, o_custkey % 400""",
    "nodes": """select concat('r', cast((o_orderkey + s) % 40 as string)) as revision, concat('n', cast(o_custkey as string)) as node, concat('kind', cast(o_custkey % 3 as string)) as kind,
      case when max(o_orderkey) % 7 = 0 then '' else concat('f', cast(max(o_orderkey) % 4 as string)) end as fingerprint from orders lateral view explode(array(0, 1, 2)) y as s group by (o_orderkey + s) % 40, o_custkey""",
    "edges": """select concat('r', cast((l_orderkey + s) % 40 as string)) as revision, concat('n', cast(o_custkey as string)) as src, concat('n', cast(l_partkey % 1000 as string)) as dst, concat('e', cast(l_linenumber % 3 as string)) as kind
      from lineitem join orders on o_orderkey = l_orderkey lateral view explode(array(0, 1)) y as s""",
    "flows": """select distinct concat('r', cast(v as string)) as revision, concat('F', cast(l_suppkey as string)) as flow, concat('n', cast(o_custkey as string)) as node, concat('p', cast(max(l_orderkey) over (partition by v, l_suppkey) % 3 as string)) as fingerprint
      from (select (l_orderkey + s) % 40 as v, l_suppkey, l_orderkey, o_custkey from lineitem join orders on o_orderkey = l_orderkey lateral view explode(array(0, 1)) y as s) as x""",
    "questions": """select concat('q', cast(c_custkey as string)) as question, 'p' as project, case when c_custkey % 31 = 0 then 'q' else 'p' end as origin_project, case when c_custkey % 37 <> 0 then 'i' end as repository, c_custkey % 29 = 0 as dirty,
      case c_custkey % 5 when 0 then concat('r', cast((c_custkey + 35) % 40 as string)) when 1 then concat('r', cast((c_custkey + 39) % 40 as string)) end as from_revision,
      case when c_custkey % 17 <> 0 then concat('r', cast(c_custkey % 40 as string)) end as to_revision, 'r39' as head_revision, concat('n', cast(c_custkey as string)) as node, c_custkey % 4 <> 0 as current from customer""",
}


def revision_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How pairs of commits stand to one another, and their latest common commit."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return ancestry.relate(spark.sql(_PAIRS).where("a is not null and b is not null"), spark.sql(_TREE))


def _continuity(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    for name in ("orders", "lineitem", "customer"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    t = {name: spark.sql(text) for name, text in _PARTS.items()}
    return continuity.continuity(t["questions"], t["commits"], t["snapshots"], t["files"], t["nodes"], t["edges"], t["flows"], LIMITS)


def continuity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _continuity(spark, sf_dir)[0]


def continuity_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _continuity(spark, sf_dir)[1].withColumn("key", F.translate("key", "\0", " "))


_DUCK = lambda text: text.replace("as string)", "as varchar)").replace("lateral view explode(array(0, 1, 2)) y as s", "cross join (values (0), (1), (2)) as y(s)").replace("lateral view explode(array(0, 1)) y as s", "cross join (values (0), (1)) as y(s)")
_SIDES = lambda name, key, value, node: f"""{name}_b as (select p.f, p.t{node}, {key} as key, {value} as value from asks p join {name} x on x.revision = p.f{node and " and x.node = p.node"}),
  {name}_a as (select p.f, p.t{node}, {key} as key, {value} as value from asks p join {name} x on x.revision = p.t{node and " and x.node = p.node"}),
  {name}_c as (select coalesce(b.f, a.f) as f, coalesce(b.t, a.t) as t{node and ", coalesce(b.node, a.node) as node"}, coalesce(b.key, a.key) as key, coalesce(b.value, a.value) as value, case when b.key is null then 'added' when a.key is null then 'removed' else 'changed' end as status
    from {name}_b b full join {name}_a a on a.f = b.f and a.t = b.t and a.key = b.key{node and " and a.node = b.node"} where b.key is null or a.key is null or a.value <> b.value)"""  # noqa: E731
_SQL = f"""with {", ".join(f"{name} as ({_DUCK(text)})" for name, text in _PARTS.items())},
  r as (select q.*, coalesce(to_revision, head_revision) as t, c.parent as direct, coalesce(from_revision, c.parent) as f from questions q left join commits c on c.commit = coalesce(to_revision, head_revision)),
  j as (select question, r.node, current, f, t, case when origin_project <> 'p' then '{continuity.WRONG_PROJECT}' when dirty then '{continuity.DIRTY}' when f is null then '{continuity.NO_PREDECESSOR}' when f is distinct from direct then '{continuity.NOT_ADJACENT}'
      when b.revision is null or a.revision is null then '{continuity.NO_SNAPSHOT}' when b.project <> 'p' or a.project <> 'p' then '{continuity.OTHER_PROJECT}' when r.repository is null then '{continuity.NO_IDENTITY}'
      when b.repository is null or a.repository is null then '{continuity.LEGACY_IDENTITY}' when b.repository <> r.repository or a.repository <> r.repository then '{continuity.OTHER_IDENTITY}'
      when b.contract is null or a.contract is null then '{continuity.LEGACY_CONTRACT}' when b.contract <> a.contract then '{continuity.OTHER_CONTRACT}' end as reason, b.truncated or a.truncated as snapshot_cut from r left join snapshots b on b.revision = r.f left join snapshots a on a.revision = r.t),
  ok as (select * from j where reason is null),
  files_asks as (select distinct f, t from ok), node_asks as (select distinct f, t, node from ok),
  touching as (select distinct revision, src as node, src || ' ' || kind || ' ' || dst as k from edges union select revision, dst, src || ' ' || kind || ' ' || dst from edges),
  {_SIDES("files", "x.path", "x.hash", "").replace("from asks", "from files_asks")},
  {_SIDES("touching", "x.k", "''", ", p.node").replace("from asks", "from node_asks")},
  {_SIDES("flows", "x.flow", "x.fingerprint", ", p.node").replace("from asks", "from node_asks")},
  ps as (select f, t, count(*) as n from files_c group by all), pl as (select x.f, x.t, count(*) as n from files_c x join files_c y on x.f = y.f and x.t = y.t and x.value = y.value and x.status = 'removed' and y.status = 'added' group by all),
  es as (select f, t, node, count(*) as n from touching_c group by all), fs as (select f, t, node, count(*) as n from flows_c group by all),
  ns as (select p.f, p.t, p.node, b.kind, b.fingerprint as fp, case when b.node is null and a.node is null then 'unavailable' when b.node is null then 'added' when a.node is null then 'removed' when a.fingerprint = b.fingerprint then 'retained' else 'changed' end as node_status
    from node_asks p left join nodes b on b.revision = p.f and b.node = p.node left join nodes a on a.revision = p.t and a.node = p.node),
  ls as (select ns.f, ns.t, ns.node, x.node as other from ns join nodes x on x.revision = ns.t and x.kind = ns.kind and x.fingerprint = ns.fp where node_status = 'removed' and fp <> ''),
  lc as (select f, t, node, count(*) as n from ls group by all)"""
_CAPS = [("path_changes", LIMITS.paths, "historical path changes"), ("path_lineages", LIMITS.paths, "path lineage candidates"), ("edge_changes", LIMITS.edges, "historical edge changes"), ("flow_changes", LIMITS.flows, "historical flow changes"), ("lineage_candidates", LIMITS.nodes, "lineage candidates")]
_LIST = lambda name, category, per, order, limit: f"select question, '{category}' as category, n as position, key, status from ok join (select *, cast(row_number() over (partition by {per} order by {order}) as integer) as n from {name}) x on {' and '.join(f'ok.{c} = x.{c}' for c in per.split(', '))} where n <= {limit}"
QUERIES = {"revision_relations": revision_relations, "continuity_summary": continuity_summary, "continuity_changes": continuity_changes}
ORACLES = {
    "revision_relations": f"""with recursive c as ({_TREE}), p as (select * from ({_PAIRS}) where a is not null and b is not null),
      up(commit, ancestor, d) as (select commit, commit, 0 from c union all select up.commit, c.parent, d + 1 from up join c on c.commit = up.ancestor where c.parent is not null),
      m as (select p.a, p.b, min((y.d, y.ancestor, x.d)) as m from p join up x on x.commit = p.a join up y on y.commit = p.b and y.ancestor = x.ancestor group by p.a, p.b),
      o as (select p.a, p.b, m[2] as common, m[1] as ahead, m[3] as behind from p left join m on m.a = p.a and m.b = p.b)
      select a, b, case when a not in (select commit from c) or b not in (select commit from c) then 'unknown' when common is null then 'unrelated' when a = b then 'same' when behind = 0 and ahead = 1 then 'adjacent'
        when behind = 0 then 'ancestor' when ahead = 0 then 'descendant' else 'diverged' end as relation, common, cast(ahead as bigint) as ahead, cast(behind as bigint) as behind from o""",
    "continuity_summary": _SQL
    + f""", s as (select j.question, current, reason, j.f, j.t, coalesce(snapshot_cut and reason is null, false) as snapshot_cut, coalesce(node_status, 'unavailable') as node_status, coalesce(ps.n, 0) as path_changes, coalesce(pl.n, 0) as path_lineages,
        case when reason is null and node_status is distinct from 'retained' then 1 else 0 end as node_changes, coalesce(es.n, 0) as edge_changes, coalesce(fs.n, 0) as flow_changes, coalesce(lc.n, 0) as lineage_candidates
        from j left join ps on j.reason is null and ps.f = j.f and ps.t = j.t left join pl on j.reason is null and pl.f = j.f and pl.t = j.t left join ns on j.reason is null and ns.f = j.f and ns.t = j.t and ns.node = j.node
        left join es on j.reason is null and es.f = j.f and es.t = j.t and es.node = j.node left join fs on j.reason is null and fs.f = j.f and fs.t = j.t and fs.node = j.node left join lc on j.reason is null and lc.f = j.f and lc.t = j.t and lc.node = j.node),
      o as (select *, array_to_string(list_sort(list_filter([case when snapshot_cut then '{continuity.SNAPSHOT_CUT}' end, {", ".join(f"case when {c} > {n} then '{what} capped at {n}' end" for c, n, what in _CAPS)}], lambda x: x is not null)), ',') as omissions from s)
      select question, case when reason = '{continuity.WRONG_PROJECT}' then 'wrong-project' when reason is not null then 'unavailable' when current then 'available' else 'stale' end as status, coalesce(reason, case when current then '{continuity.COMPARED}' else '{continuity.STALE}' end) as reason,
        case when reason is null or reason = '{continuity.NOT_ADJACENT}' then f end as from_revision, case when reason is null or reason = '{continuity.NOT_ADJACENT}' then t end as to_revision, node_status,
        case node_status when 'retained' then 'identical' when 'changed' then 'changed' else 'unavailable' end as fingerprint_relation, path_changes, path_lineages, cast(node_changes as bigint) as node_changes, edge_changes, flow_changes, lineage_candidates, omissions <> '' as truncated, omissions from o""",
    "continuity_changes": _SQL
    + f""", lk as (select f, t, node, other as key, 'candidate' as status from ls)
      {_LIST("files_c", "path", "f, t", "key", LIMITS.paths)} union all {_LIST("touching_c", "edge", "f, t, node", "status desc, key", LIMITS.edges)}
      union all {_LIST("flows_c", "flow", "f, t, node", "key", LIMITS.flows)} union all {_LIST("lk", "candidate", "f, t, node", "key", LIMITS.nodes)}""",
}
