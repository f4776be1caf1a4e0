"""Queries of references, aliases, flows and observations over graphs that the driver's tables stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import validation
from evidentia.operators import aliases, applicability, chains, entries, flows, observations, references
from evidentia.tables import table, tasks

# Two graph versions: orders as nodes, customers as files, lines as edges from an order to a part.
_NODES = """select 1 as graph_version, cast(o_orderkey as string) as node_id, o_orderpriority as kind, concat('c', cast(o_custkey as string)) as path, concat(o_orderstatus, '-', cast(o_custkey % 500 as string)) as fingerprint
  from orders where o_orderkey % 10 <> 0
  union all select 2, cast(case when o_orderkey % 13 = 0 then -o_orderkey else o_orderkey end as string), o_orderpriority, concat('c', cast(o_custkey as string)),
    concat(case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end, '-', cast(o_custkey % 500 as string)) from orders where o_orderkey % 11 <> 0"""
_SOURCES = """select v as graph_version, concat('c', cast(c_custkey as string)) as path, concat(c_mktsegment, cast(v as string)) as hash from customer, (select 1 as v union all select 2) where c_custkey % 6 <> 0"""
_OBSERVATIONS = """select * from (values ('a', 'p', 1, 'r1', false), ('b', 'p', 2, 'r2', true), ('other', 'q', 1, 'r1', false)) as t(observation_id, project_id, graph_version, revision, dirty)"""
_REFERENCES = """select concat('context:1:', cast(o_orderkey as string)) as uri, 'p' as project_id, 1 as graph_version, cast(o_orderkey as string) as node_id,
    case when o_orderkey % 19 = 0 then '' when o_orderkey % 23 = 0 then 'gone' when o_orderkey % 29 = 0 then 'other' else 'a' end as origin_observation, 'r1' as origin_revision,
    case when o_orderkey % 17 = 0 then concat(c_mktsegment, '1') when o_orderkey % 31 = 0 then 'forged' else concat(o_orderstatus, '-', cast(o_custkey % 500 as string)) end as origin_fingerprint,
    case when o_orderkey % 17 = 0 then 'file' else 'node' end as scope, case when o_orderkey % 17 = 0 then 'file-1' else 'node-1' end as contract
  from orders join customer on c_custkey = o_custkey where o_orderkey % 10 <> 0
  union all select concat('context:2:', cast(o_orderkey as string)), 'p', 2, cast(case when o_orderkey % 13 = 0 then -o_orderkey else o_orderkey end as string), 'b', 'r2+dirty',
    concat(case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end, '-', cast(o_custkey % 500 as string)), 'node', 'node-1' from orders where o_orderkey % 11 <> 0 and o_orderkey % 3 <> 0"""
_FLOWS = """select 1 as graph_version, cast(p_partkey as string) as flow_id, p_brand as fingerprint from part
  union all select 2, cast(p_partkey as string), case when p_partkey % 5 = 0 then p_type else p_brand end from part where p_partkey % 7 <> 0"""
_FLOW_REFERENCES = """select concat('flow:', cast(p_partkey as string)) as uri, 'p' as project_id, 1 as graph_version, cast(p_partkey as string) as flow_id,
    case when p_partkey % 23 = 0 then 'gone' else 'a' end as origin_observation, case when p_partkey % 29 = 0 then 'r0' else 'r1' end as origin_revision, case when p_partkey % 11 = 0 then '' else p_brand end as origin_fingerprint from part
  union all select concat('now:', cast(p_partkey as string)), 'p', 2, cast(p_partkey as string), 'b', 'r2+dirty', case when p_partkey % 5 = 0 then p_type else p_brand end from part where p_partkey % 7 <> 0"""
_MAPPINGS = """select * from (values ('@/*', 0, 'src/*'), ('@/*', 1, 'lib/*'), ('@/ECONOMY', 0, 'lib/economy/main'), ('@/M*', 0, 'src/m*'), ('@/S*/9', 0, 'src/nine/*'), ('@/S*', 0, 'src/S*'),
  ('@/ST*', 0, 'none/*'), ('@/ST*', 1, 'lib/ST*'), ('#*', 0, 'src/index')) as t(pattern, target_order, target)"""
_SPECIFIERS = """select distinct concat(case when p_partkey % 9 = 0 then '#' when p_partkey % 8 = 0 then '~/' else '@/' end, p_type, case when p_size % 3 = 0 then '' else concat('/', cast(p_size as string)) end) as specifier from part"""
_KNOWN = """select distinct case p_size % 6 when 0 then concat('src/', p_type, '.ts') when 1 then concat('lib/', p_type, '/', cast(p_size as string), '/index.tsx') when 2 then concat('src/', p_type, '/', cast(p_size as string), '.tsx')
  when 3 then concat('lib/', p_type, '.d.ts') when 4 then concat('src/nine/', substring(p_type, 2), '/index.ts') else 'src/index.ts' end as path from part where p_partkey % 4 <> 0"""
_EVENTS = """select c.conv_id as key, concat(cast(c.conv_id as string), ':', cast(turn as string)) as event,
  case when turn = 0 then null when conv_id % 6 = 1 and turn = 1 then null when conv_id % 6 = 2 and turn = 1 then 'gone' when conv_id % 6 = 3 and turn = 1 then concat(cast(conv_id as string), ':', cast(last as string))
    when conv_id % 6 = 4 and turn = 2 then concat(cast(conv_id as string), ':0') else concat(cast(conv_id as string), ':', cast(turn - 1 as string)) end as predecessor
  from (select distinct conv_id, turn from conversations) c join (select conv_id as k, max(turn) as last from conversations group by conv_id) on k = conv_id"""
_EDGES = """select distinct concat('o', cast(l_orderkey as string)) as src, concat('p', cast(l_partkey as string)) as dst, case when l_linenumber % 4 = 0 then 'declares' when l_linenumber % 2 = 0 then 'constructs' else 'calls' end as kind, l_returnflag as evidence from lineitem"""
_TEXTS = """select doc_id, coalesce(text, '') as text, case doc_id % 10 when 0 then concat('node src/', cast(doc_id as string), '.ts') when 1 then concat('deno run ', lang) when 2 then concat('bun  ', lang, ' ') when 3 then concat('tsx -w ', lang)
  when 4 then concat('tsc; node ', lang) when 5 then '' when 6 then concat('npm run ', lang) when 7 then concat('ts-node "', lang, '"') when 8 then 'node' else 'bun run test.ts' end as command from documents"""

_ENTRIES = r"""select p_partkey, case p_partkey % 9 when 0 then concat('./src/', p_type) when 1 then concat('src/x/../', p_type, '/', cast(p_size as string), '/index.tsx') when 2 then concat('../', p_type) when 3 then concat('dist/', p_type, '.js')
  when 4 then concat('/', p_type) when 5 then concat('c:', p_type) when 6 then concat('lib/', p_type) when 7 then concat('src/', p_type, '/', cast(p_size as string)) else concat('src/', p_type, '.d.ts') end as target from part"""
_CANDIDATES = """select o_orderkey as candidate, o_custkey as context, case when o_orderkey % 17 = 0 then 'fork' else 'repo' end as repository, 'p' as project, case when o_orderkey % 13 = 0 then 2 else 1 end as definition, c_mktsegment as basis,
    case when o_orderkey % 19 = 0 then 'old' else 'works' end as expected, case when o_orderkey % 11 = 0 then 'partial' else 'complete' end as integrity, case when o_orderkey % 23 = 0 then null else concat('o', cast(o_orderkey % 50 as string)) end as observation,
    o_orderkey % 50 as graph_version, concat('g', cast(case when o_orderkey % 29 = 0 then 0 else o_orderkey % 50 end as string)) as graph_id, concat('r', cast(o_orderkey % 50 as string)) as revision, case when o_orderkey % 31 = 0 then null when o_orderkey % 37 = 0 then 'c0' else 'c1' end as contract
  from orders join customer on c_custkey = o_custkey"""
_CONTEXTS = """select c_custkey as context, 'repo' as repository, 'p' as project, 1 as definition, case when c_custkey % 41 = 0 then 'other' else c_mktsegment end as basis, 'works' as expected, 'c1' as contract from customer"""
_SEEN = """select distinct concat('o', cast(o_orderkey % 50 as string)) as observation, 'p' as project, o_orderkey % 50 as graph_version, concat('r', cast(o_orderkey % 50 as string)) as revision, o_orderkey % 50 = 7 as dirty from orders where o_orderkey % 50 <> 8"""
_VERSIONS = """select distinct o_orderkey % 50 as graph_version, concat('g', cast(o_orderkey % 50 as string)) as graph_id, 'c1' as contract from orders where o_orderkey % 50 <> 9"""
_LINEAGE = """select distinct concat('r', cast(o_orderkey % 50 as string)) as revision from orders where o_orderkey % 50 < 40"""


def _rows(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    """Rows of a query over the driver's tables of these names."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


def _store(spark: SparkSession, sf_dir: str) -> references.Store:
    state = spark.sql("select 'p' as project_id, 'b' as observation_id")
    return references.Store(state, spark.sql(_OBSERVATIONS), _rows(spark, sf_dir, _NODES, "orders"), _rows(spark, sf_dir, _SOURCES, "customer"), _rows(spark, sf_dir, _FLOWS, "part"))


FLOW_CAPS = flows.Caps(steps=48, edges=72, depth=4)
# Layers, so that no node is met on two levels: customer, order, part, supplier, nation, region.
_CALLS = """select distinct src, dst, kind, evidence from (
    select concat('c', cast(o_custkey as string)) as src, concat('o', cast(o_orderkey as string)) as dst, case when o_totalprice < 250000 then 'calls' else 'constructs' end as kind, o_orderpriority as evidence from orders
    union all select concat('o', cast(l_orderkey as string)), concat('p', cast(l_partkey as string)), case when l_linenumber < 3 then 'calls' else 'constructs' end, l_returnflag from lineitem where l_quantity > 35
    union all select concat('p', cast(l_partkey as string)), concat('s', cast(l_suppkey as string)), case when l_discount < 0.05 then 'calls' else 'imports' end, l_returnflag from lineitem where l_quantity < 8
    union all select concat('s', cast(s_suppkey as string)), concat('n', cast(s_nationkey as string)), 'constructs', '' from supplier where s_acctbal < 1000
    union all select concat('n', cast(n_nationkey as string)), concat('r', cast(n_regionkey as string)), 'calls', '' from nation) as x"""


def context_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    contracts = references.Contracts("node", "node-1", "file", "file-1")
    out = references.context_freshness(_rows(spark, sf_dir, _REFERENCES, "orders", "customer"), _store(spark, sf_dir), contracts)
    return out.withColumn("candidates", F.array_join("candidates", ","))


def flow_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.flow_freshness(_rows(spark, sf_dir, _FLOW_REFERENCES, "part"), _store(spark, sf_dir))


def alias_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aliases.resolve_aliases(_rows(spark, sf_dir, _SPECIFIERS, "part"), spark.sql(_MAPPINGS), _rows(spark, sf_dir, _KNOWN, "part"))


def chain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.chain_status(_rows(spark, sf_dir, _EVENTS, "conversations"))


def _flows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A row for each flow, and the edges."""
    edges = _rows(spark, sf_dir, _CALLS, "orders", "lineitem", "supplier", "nation")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    starts = _rows(spark, sf_dir, "select concat('entry:', cast(c_custkey as string)) as entry, concat('c', cast(c_custkey as string)) as target from customer", "customer")
    return flows.walk_flows(starts, nodes, edges, FLOW_CAPS), edges


def ordered_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows from every customer over orders, parts, suppliers, nations and regions: steps in order, and which caps ended them."""
    rows, _ = _flows(spark, sf_dir)
    rows = rows.select("entry", F.posexplode("steps").alias("position", "s"), "n_steps", "n_edges", "status", F.array_join("omissions", ",").alias("omissions"))
    return rows.select("entry", "position", "s.*", "n_steps", "n_edges", "status", "omissions")


def flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every flow the number of edges between its steps."""
    rows, edges = _flows(spark, sf_dir)
    nodes = F.transform("steps", lambda s: s["node"])
    return flows.listed_fingerprints(rows.select("entry", nodes.alias("nodes"), F.slice(nodes, 2, FLOW_CAPS.steps).alias("inner")), edges).select("entry", "n_inner")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of two categories between the two graph versions: files by hash, nodes by fingerprint."""
    both = _rows(spark, sf_dir, f"select 'node' as category, graph_version, node_id as key, fingerprint from ({_NODES}) union all select 'source', graph_version, path, hash from ({_SOURCES}) where graph_version = 1 or path not like '%4'", "orders", "customer")
    side = lambda v: F.max(F.when(F.col("graph_version") == v, F.col("fingerprint")))
    sides = both.groupBy("category", "key").agg(side(1).alias("b"), side(2).alias("a"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("b") != F.col("a"), "changed")
    return sides.select("category", "key", change.alias("change")).where("change is not null")


def observation_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations.delta_envelope(_changes(spark, sf_dir), {"source": 1000000, "node": 64}, F.lit("structural-graph-changed")).withColumn("omissions", F.array_join("omissions", ","))


def observation_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations.bounded_changes(_changes(spark, sf_dir), {"source": 128, "node": 64}, ["change", "key"])


def graph_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, sources = _rows(spark, sf_dir, _NODES, "orders"), _rows(spark, sf_dir, _SOURCES, "customer")
    version = lambda rows, v: rows.where(F.col("graph_version") == v).drop("graph_version")
    checks = [("nodes", version(nodes, 1), version(nodes, 2)), ("kinds", version(nodes, 1).select("kind").distinct(), version(nodes, 2).select("kind").distinct()), ("sources", version(sources, 1).select("path"), version(sources, 2).select("path"))]
    first, *rest = [observations.same_rows(*c) for c in checks]
    for check in rest:
        first = first.unionByName(check)
    return first


def node_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Lines are dealt to tasks before they are told apart; their number grows with the lines.
    n = tasks(table(spark, sf_dir, "lineitem"), each=500_000)
    edges = _rows(spark, sf_dir, _EDGES.replace("select distinct", "select", 1), "lineitem").repartition(n, "src", "dst").distinct()
    nodes = _rows(spark, sf_dir, "select concat('p', cast(p_partkey as string)) as id, p_type as intrinsic from part union all select concat('o', cast(o_orderkey as string)), o_orderstatus from orders", "part", "orders")
    return observations.node_fingerprints(nodes, edges, n)


def graph_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _rows(spark, sf_dir, _EDGES, "lineitem")
    return observations.graph_id({"edges": edges, "files": _rows(spark, sf_dir, "select c_custkey, c_mktsegment from customer", "customer")}, "p", "derivation-1")


def entry_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.resolve_targets(_rows(spark, sf_dir, _ENTRIES, "part"), _rows(spark, sf_dir, _KNOWN, "part"))


def good_state_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda text: _rows(spark, sf_dir, text, "orders", "customer")
    return applicability.applicability(*map(read, (_CANDIDATES, _CONTEXTS, _SEEN, _VERSIONS, _LINEAGE)))


def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an insert of all lines adds to a store of the odd orders' first lines, a row for each order and part."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    stored = table(spark, sf_dir, "lineitem").where("l_orderkey % 2 = 1 and l_linenumber = 1")
    return applicability.missing_rows(lines, stored, ["l_orderkey", "l_partkey"])


def value_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, _TEXTS, "documents").withColumn("s", validation.script(F.col("command")))
    head = F.substring_index("text", " ", 1)
    return rows.select(
        "doc_id", F.col("s.runner").alias("runner"), F.col("s.target").alias("target"), F.col("s.reason").alias("reason"), validation.is_id(head).alias("is_id"), validation.is_revision(head).alias("is_revision"),
        validation.is_text(F.col("text")).alias("is_text"), validation.is_reference(F.col("text")).alias("is_reference"), validation.holds_credentials(F.col("text")).alias("holds_credentials"),
    )


_DUCK = lambda text: text.replace("as string)", "as varchar)")
_BASIS = f"""with n as ({_DUCK(_NODES)}), s as ({_DUCK(_SOURCES)}), ob as ({_OBSERVATIONS}), refs as ({_DUCK(_REFERENCES)}),
  e as (select n.*, hash from n left join s using (graph_version, path)),
  r as (select refs.*, ob.observation_id is not null and ob.project_id = refs.project_id and ob.graph_version = refs.graph_version and ob.revision || case when dirty then '+dirty' else '' end = origin_revision as agrees,
    o.kind as origin_kind, o.fingerprint as o_fp, o.hash as o_hash, c.node_id as now_id, c.fingerprint as now_fp
    from refs left join ob on ob.observation_id = origin_observation left join e o on o.graph_version = refs.graph_version and o.node_id = refs.node_id left join e c on c.graph_version = 2 and c.node_id = refs.node_id),
  l as (select *, case when origin_observation = '' or origin_fingerprint = '' then 'insufficient-origin-evidence' when not coalesce(agrees, false) then 'origin-observation-unavailable'
      when case scope when 'file' then o_hash else o_fp end is distinct from origin_fingerprint then 'origin-evidence-inconsistent' when now_id is null then 'node-identity-missing' when contract <> 'node-1' then 'incompatible-fingerprint-contract'
      when now_fp = origin_fingerprint and origin_observation = 'b' then 'origin-observation-current' when now_fp = origin_fingerprint then 'node-fingerprint-match' else 'node-fingerprint-changed' end as first from r),
  made as (select kind, fingerprint, count(*) as n, count(uri) as with_uri, list_sort(list(distinct uri) filter (where uri is not null)) as uris
    from (select * from e where graph_version = 2) x left join (select uri, node_id from refs where graph_version = 2) y on x.node_id = y.node_id group by kind, fingerprint)
"""
_HEX = lambda i: f"coalesce(sum(('0x' || substring(d, {16 * i + 1}, 16))::ubigint::hugeint), 0)::varchar"
_SUMS = " || chr(0) || ".join(f"coalesce(s{i}, '0')" for i in range(4))
_COLON = " || ':' || ".join(_HEX(i) for i in range(4))
_CHANGES = f"""with v as (select 'node' as category, graph_version as v, node_id as key, fingerprint as f from ({_DUCK(_NODES)}) union all select 'source', graph_version, path, hash from ({_DUCK(_SOURCES)}) where graph_version = 1 or path not like '%4'),
  c as (select coalesce(b.category, a.category) as category, coalesce(b.key, a.key) as key, case when b.key is null then 'added' when a.key is null then 'removed' else 'changed' end as change
    from (from v where v = 1) b full join (from v where v = 2) a on a.category = b.category and a.key = b.key where a.f is distinct from b.f)
"""

NAMES = (
    "context_freshness flow_freshness alias_imports chain_check ordered_flows flow_edges observation_delta observation_changes graph_reuse node_fingerprints graph_identity value_validation entry_targets good_state_applicability insert_or_ignore"
).split()
_WALKS = f"""with recursive e as ({_DUCK(_CALLS)}), o as (select src, dst, row_number() over (partition by src order by kind, dst, evidence) as n from e where kind in ('calls', 'constructs')), g as (select src, count(*) as degree from o group by src),
  k as (select src as id from e union select dst from e),
  b(entry, node, depth, place) as (select 'entry:' || c_custkey, 'c' || c_custkey, 0, cast(1 as bigint) from customer where 'c' || c_custkey in (select id from k)
    union all select entry, node, depth + 1, row_number() over (partition by entry order by s) from (select b.entry, o.dst as node, b.depth, min((b.place, o.n)) as s from b join o on o.src = b.node where b.depth < {FLOW_CAPS.depth} group by all)),
  p as (select b.*, row_number() over (partition by entry order by depth, place) as position, case when depth < {FLOW_CAPS.depth} then coalesce(degree, 0) else 0 end as degree from b left join g on g.src = b.node),
  q as (select *, coalesce(sum(degree) over (partition by entry order by position rows between unbounded preceding and 1 preceding), 0) as before from p),
  i as (select * from q where before < {FLOW_CAPS.edges} and position < {FLOW_CAPS.steps}),
  m as (select distinct entry from q where before < {FLOW_CAPS.edges} and position = {FLOW_CAPS.steps}),
  t as (select i.entry, count(*) + 1 as n_steps, sum(least(degree, {FLOW_CAPS.edges} - before)) as n_edges, concat_ws(',', case when bool_or(depth >= {FLOW_CAPS.depth}) then 'flow depth capped at {FLOW_CAPS.depth}' end,
      case when bool_or(before + degree > {FLOW_CAPS.edges}) then 'flow edges capped at {FLOW_CAPS.edges}' end, case when bool_or(m.entry is not null) then 'flow steps capped at {FLOW_CAPS.steps}' end) as omissions from i left join m on m.entry = i.entry group by i.entry),
  z as (select 'entry:' || c_custkey as entry, 0 as position, 'entry:' || c_custkey as node, 'entry' as role, 0 as depth from customer union all select entry, position, node, case when position = 1 then 'target' else 'callee' end, depth from i)"""
QUERIES = {name: globals()[name] for name in NAMES}
ORACLES = {
    "ordered_flows": _WALKS + """ select z.entry, cast(position as integer) as position, node, role, depth, cast(coalesce(n_steps, 1) as bigint) as n_steps, cast(coalesce(n_edges, 0) as bigint) as n_edges,
      case when coalesce(omissions, '') = '' then 'complete' else 'truncated' end as status, coalesce(omissions, '') as omissions from z left join t on t.entry = z.entry""",
    "flow_edges": _WALKS + """, w as (select x.entry, count(*) as n from z x join e on e.src = x.node join z y on y.entry = x.entry and y.node = e.dst where kind in ('calls', 'constructs') and x.position > 0 and y.position > 0 group by x.entry)
      select distinct z.entry, coalesce(n, 0) as n_inner from z left join w on w.entry = z.entry""",
    "entry_targets": f"""with e as ({_DUCK(_ENTRIES)}), k as ({_DUCK(_KNOWN)}), t as (select *, p_partkey % 9 as c, case p_partkey % 9 when 0 then target[3:] when 1 then replace(target, 'x/../', '') else target end as n from e),
      m as (select p_partkey, min(x.i) as i, min_by(n || x.suffix, x.i) as path from t join (values (0, ''), (1, '.ts'), (2, '.tsx'), (3, '/index.ts'), (4, '/index.tsx'), (5, '.d.ts'), (6, '/index.d.ts')) as x(i, suffix) on i in (0, 5, 6) or c <> 1
        join k on k.path = n || x.suffix where c in (0, 1, 6, 7) group by p_partkey)
      select t.p_partkey, target, case when i < 5 then path end as path, case c when 2 then 'entry-target-escapes-repository' when 3 then 'entry-target-javascript-output-unsupported' when 4 then 'entry-target-absolute-or-invalid' when 5 then 'entry-target-absolute-or-invalid'
        when 8 then 'entry-target-declaration-file-unsupported' else case when i < 5 then 'entry-target-resolved' when i is not null then 'entry-target-declaration-file-unsupported' else 'entry-target-missing-or-not-typescript' end end as reason
      from t left join m on m.p_partkey = t.p_partkey""",
    "good_state_applicability": f"""with c as ({_DUCK(_CANDIDATES)}), r as (select candidate, case when repository = 'fork' then 'repository-identity-mismatch' when definition = 2 or expected = 'old' or context % 41 = 0 then 'context-definition-or-expected-behavior-changed'
        when integrity = 'partial' then 'integrity-incomplete' when observation is null then 'graph-basis-unavailable' when graph_version in (7, 8) then 'observation-unavailable-or-mismatched' when graph_version = 9 then 'graph-contract-unavailable'
        when contract is null then 'evidence-contract-unavailable' when contract = 'c0' or graph_id <> 'g' || graph_version then 'evidence-contract-incompatible' when graph_version >= 40 then 'revision-not-on-first-parent-lineage' else '' end as reason from c)
      select candidate, reason, case when reason = '' then 'applicable' when reason like 'repository%' then 'repository-mismatch' when reason like 'context%' then 'context-basis-mismatch' when reason = 'evidence-contract-incompatible' then 'contract-incompatible'
        when reason like 'revision%' then 'out-of-lineage' else 'basis-unavailable' end as status from r""",
    "insert_or_ignore": """select l_orderkey, l_partkey, min(l_quantity) as l_quantity from lineitem where (l_orderkey, l_partkey) not in (select (l_orderkey, l_partkey) from lineitem where l_orderkey % 2 = 1 and l_linenumber = 1) group by all""",
    "context_freshness": _BASIS + """select uri, case when first in ('node-identity-missing', 'node-fingerprint-changed') then 'stale' when first in ('origin-observation-current', 'node-fingerprint-match') then 'current'
        when first in ('insufficient-origin-evidence', 'incompatible-fingerprint-contract') then 'unresolved' else 'unavailable' end as status,
      case when first in ('node-identity-missing', 'node-fingerprint-changed') and scope = 'node' and n is not null then case when n > 1 then 'exact-successor-ambiguous' when with_uri = 1 then 'unique-exact-candidate' else 'successor-reference-unavailable' end else first end as reason,
      case when scope = 'node' and origin_fingerprint <> '' then coalesce(array_to_string(uris[1:32], ','), '') else '' end as candidates, coalesce(scope = 'node' and origin_fingerprint <> '' and len(uris) > 32, false) as truncated
      from l left join made on made.kind = origin_kind and made.fingerprint = origin_fingerprint""",
    "flow_freshness": f"""with r as ({_DUCK(_FLOW_REFERENCES)}), f as (from ({_DUCK(_FLOWS)}) where graph_version = 2),
      l as (select uri, case when origin_fingerprint = '' then 'origin-flow-evidence-unavailable' when origin_observation = 'gone' then 'origin-observation-unavailable' when origin_revision = 'r0' then 'origin-flow-basis-inconsistent'
        when fingerprint is null then 'flow-identity-missing' when fingerprint <> origin_fingerprint then 'flow-fingerprint-changed' when origin_observation = 'b' then 'origin-observation-current' else 'flow-fingerprint-match' end as reason
        from r left join f on f.flow_id = r.flow_id)
      select uri, case when reason in ('flow-identity-missing', 'flow-fingerprint-changed') then 'stale' when reason in ('origin-observation-current', 'flow-fingerprint-match') then 'current' else 'unavailable' end as status, reason from l""",
    "alias_imports": f"""with m as ({_MAPPINGS}), s as ({_DUCK(_SPECIFIERS)}), k as ({_DUCK(_KNOWN)}), p as (select distinct pattern, instr(pattern, '*') as i from m),
      best as (select specifier, pattern, case when i > 0 then specifier[i:length(specifier) - (length(pattern) - i)] end as wild from s, p
        where pattern = specifier or (i > 0 and starts_with(specifier, pattern[:i - 1]) and ends_with(specifier, pattern[i + 1:]) and length(specifier) >= length(pattern) - 1)
        qualify row_number() over (partition by specifier order by pattern <> specifier, i desc, pattern) = 1),
      t as (select specifier, target_order, x.n, case when wild is null then target else replace(target, '*', wild) end || x.suffix as path from best join m using (pattern),
        (values (0, ''), (1, '.ts'), (2, '.tsx'), (3, '.d.ts'), (4, '/index.ts'), (5, '/index.tsx'), (6, '/index.d.ts')) as x(n, suffix)),
      f as (select specifier, min_by(path, target_order * 7 + n) as target from t join k using (path) group by specifier)
      select s.specifier, pattern, target, case when target is not null then 'local' when pattern is not null then 'unresolved' else 'external' end as status from s left join best on best.specifier = s.specifier left join f on f.specifier = s.specifier""",
    "chain_check": f"""with recursive ev as ({_DUCK(_EVENTS)}),
      c as (select key, count(*) as n_events, count(*) filter (where predecessor is null) as roots, count(*) filter (where predecessor is not null and (predecessor = event or predecessor not in (select event from ev))) as bad,
        count(predecessor) - count(distinct predecessor) as branches from ev group by key),
      w as (select key, event from ev where predecessor is null and key in (select key from c where roots = 1) union select ev.key, ev.event from w join ev on ev.predecessor = w.event and ev.key = w.key),
      n as (select key, count(*) as reached from w group by key)
      select c.key, n_events, case when roots <> 1 then 'root-invalid' when bad > 0 or branches > 0 then 'predecessor-invalid' when reached < n_events then 'disconnected' else 'linear' end as status from c left join n on n.key = c.key""",
    "observation_delta": _CHANGES + "select " + ", ".join(f"count(*) filter (where category = '{c}' and change = '{k}') as {c}_{k}" for c in ("source", "node") for k in ("added", "changed", "removed"))
    + """, case when count(*) filter (where category = 'node') > 64 then 'truncated' else 'complete' end as status, case when count(*) filter (where category = 'node') > 64 then 'change-bounds-reached' else 'adjacent-structural-graph-change' end as reason,
      count(*) filter (where category = 'node') > 64 as truncated, case when count(*) filter (where category = 'node') > 64 then 'node changes omitted after max bound 64' else '' end as omissions from c""",
    "observation_changes": _CHANGES + "select category, key, change from c qualify row_number() over (partition by category order by change, key) <= case category when 'source' then 128 else 64 end",
    "graph_reuse": f"""with n as ({_DUCK(_NODES)}), s as ({_DUCK(_SOURCES)}), r as (select 'nodes' as category, graph_version as v, concat_ws('|', node_id, kind, path, fingerprint) as x from n
        union all (select distinct 'kinds', graph_version, kind from n) union all select 'sources', graph_version, path from s),
      g as (select category, x, count(*) filter (where v = 1) - count(*) filter (where v = 2) as d from r group by category, x)
      select category, coalesce(sum(d) filter (where d > 0), 0)::bigint as only_stored, coalesce(-sum(d) filter (where d < 0), 0)::bigint as only_expected, bool_and(d = 0) as compatible from g group by category""",
    "node_fingerprints": f"""with e as (from ({_DUCK(_EDGES)}) where kind <> 'declares'),
      h as (select src as id, sha256('out' || chr(0) || kind || chr(0) || evidence || chr(0) || dst) as d from e union all select dst, sha256('in' || chr(0) || kind || chr(0) || evidence || chr(0) || src) from e),
      s as (select id, {", ".join(f"{_HEX(i)} as s{i}" for i in range(4))} from h group by id), n as (select 'p' || p_partkey as id, p_type as intrinsic from part union all select 'o' || o_orderkey, o_orderstatus from orders)
      select n.id, sha256('node' || chr(0) || intrinsic || chr(0) || {_SUMS}) as fingerprint from n left join s on s.id = n.id""",
    "graph_identity": f"""with e as (select sha256('edges' || chr(0) || dst || chr(0) || evidence || chr(0) || kind || chr(0) || src) as d from ({_DUCK(_EDGES)})), f as (select sha256('files' || chr(0) || c_custkey || chr(0) || c_mktsegment) as d from customer)
      select sha256('graph' || chr(0) || 'p' || chr(0) || 'derivation-1' || chr(0) || (select 'edges=' || {_COLON} from e) || '|' || (select 'files=' || {_COLON} from f)) as graph_id""",
    "value_validation": f"""with d as (select *, split_part(text, ' ', 1) as head, list_filter(regexp_split_to_array(command, '\\s+'), lambda t: t <> '') as w from ({_DUCK(_TEXTS)})),
      s as (select *, case when command = '' or regexp_matches(command, '[&|;><`$\\n\\r]') then 'script-command-complex-or-shell-composed' when len(list_filter(w, lambda t: starts_with(t, '-') or contains(t, '"') or contains(t, ''''))) > 0 then 'script-command-flags-or-quoting-unsupported'
        when (len(w) = 2 and w[1] in ('tsx', 'ts-node', 'ts-node-esm', 'node', 'bun')) or (len(w) = 3 and w[1] in ('bun', 'deno') and w[2] = 'run') then '' else 'unsupported-script-runner-or-arity' end as reason,
        regexp_matches(lower(text), 'password=|token=|secret=|private_key|authorization:') as holds_credentials from d)
      select doc_id, case when reason = '' then array_to_string(w[:-2], ' ') end as runner, case when reason = '' then w[-1] end as target, reason, regexp_matches(head, '^[A-Za-z0-9._:-]+$') and strlen(head) <= 128 as is_id,
        strlen(head) between 1 and 128 and not regexp_matches(head, '[\\s;|&`]') as is_revision, strlen(text) between 1 and 8192 and regexp_matches(text, '\\S') as is_text,
        strlen(text) between 1 and 1024 and not regexp_matches(text, '[\\r\\n]') and not holds_credentials as is_reference, holds_credentials from s""",
}
