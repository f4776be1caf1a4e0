"""Resolution, sequence, graph and ranking queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.fingerprints import fingerprint
from evidentia.operators import graph, ranking, resolution, sequences
from evidentia.tables import table

EVENTS = {"signup": "PROPOSE", "purchase": "CONFIRM", "error": "REJECT", "view": "REVOKE"}
MOVES = {
    ("none", "PROPOSE"): "pending", ("pending", "CONFIRM"): "active", ("pending", "REJECT"): "none", ("active", "PROPOSE"): "replacing", ("active", "REVOKE"): "inactive",
    ("replacing", "CONFIRM"): "active", ("replacing", "REJECT"): "active", ("inactive", "PROPOSE"): "pending",
}
PREFIX_RULES = (("ECO", "economy/*"), ("ECONOMY", "economy/main"), ("ME", "m/*"), ("MEDIUM", "m/medium"), ("P", "p/*"), ("S", "s/*"), ("SMALL", "s/small"), ("STA", "s/standard"))


def edge_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey")
    return resolution.edge_changes(edges.where("l_orderkey % 10 <> 0"), edges.where("l_orderkey % 11 <> 0"), ["l_suppkey", "l_partkey"])


def event_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return sequences.collapse_chain(events, "user_id", ["ts", "event_id"], "event_type", "event_id").drop("ts")


def _lifecycle(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("kind")).where(F.col("kind").isin(*EVENTS))
    kind = F.lit(None)
    for name, action in EVENTS.items():
        kind = F.when(F.col("kind") == name, action).otherwise(kind)
    return sequences.fold(events.withColumn("kind", kind), "user_id", ["ts", "event_id"], "kind", sequences.Machine("none", MOVES, strict))


def lifecycle_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lifecycle(spark, sf_dir, False)


def lifecycle_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("state").startswith("corrupt:"), "corrupt").otherwise(F.col("state"))
    return _lifecycle(spark, sf_dir, True).select("user_id", state.alias("state"), sequences.violation(F.col("state")).alias("reason"))


def occurrence_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.coalesce_occurrences(table(spark, sf_dir, "events"), ["user_id", "event_type"])


def _node(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def _places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nation = table(spark, sf_dir, "nation").select(_node("r", "n_regionkey").alias("src"), _node("n", "n_nationkey").alias("dst"))
    supplier = table(spark, sf_dir, "supplier").select(_node("n", "s_nationkey").alias("src"), _node("s", "s_suppkey").alias("dst"))
    customer = table(spark, sf_dir, "customer").select(_node("n", "c_nationkey").alias("src"), _node("c", "c_custkey").alias("dst"))
    return nation, supplier, customer


def _roots(spark: SparkSession, *nodes: str) -> DataFrame:
    return spark.sql("select explode(array({})) as node".format(", ".join(f"'{n}'" for n in nodes)))


def bfs_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, supplier, _ = _places(spark, sf_dir)
    return graph.reach(nation.unionByName(supplier), _roots(spark, "r:2"), 8)


def bfs_cyclic_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(_node("s", "l_suppkey").alias("src"), F.concat(F.lit("p:"), (F.col("l_partkey") % 50).cast("string")).alias("dst")).distinct()
    back = pairs.where("substring(dst, 3) % 3 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.reach(pairs.unionByName(back), _roots(spark, "s:1"), 3)


def dependency_cone(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, supplier, customer = _places(spark, sf_dir)
    return graph.reach(nation.unionByName(supplier).unionByName(customer), _roots(spark, "s:1", "c:5"), 2, directed=False)


def chain_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.walk_back(table(spark, sf_dir, "conversations"), "conv_id", "turn")


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"))


def candidate_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.candidate_status(_hashed(spark, sf_dir), ["text_hash"], "doc_id")


def exact_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _hashed(spark, sf_dir)
    return resolution.exact_lineage(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "text_hash", "doc_id")


def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fingerprint("document", "doc_id", "lang", "source", "text").alias("fingerprint"))


def import_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(found).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("occurrences"))


def import_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets against known pages: the path as given, without a fragment, without a query, its first segment."""
    hrefs = import_extract(spark, sf_dir).select("page_id", "href")
    path = F.regexp_replace("url", r"^https?://[^/]*", "")
    # Many pages may share a path: one target each.
    pages = table(spark, sf_dir, "pages").groupBy(path.alias("path")).agg(F.min("page_id").alias("page"))
    tries = [F.col("href"), F.regexp_replace("href", "#.*$", ""), F.regexp_replace("href", "[?#].*$", ""), F.concat(F.lit("/en"), F.col("href"))]
    candidates = F.array(*[F.struct(F.lit(i).alias("rank"), c.alias("path")) for i, c in enumerate(tries)])
    return resolution.first_match(hrefs, pages, "href", candidates, "path", "page").select("page_id", "href", "match_rank", "target", "status")


def freshness_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    status = F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))
    priority = F.when(F.col("o_orderkey") % 13 == 0, "0-NEW").otherwise(F.col("o_orderpriority"))
    now = orders.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", status).withColumn("o_orderpriority", priority)
    return resolution.freshness(orders, now, "o_orderkey", ["o_orderpriority"], "o_orderstatus")


def candidate_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    weights = {
        "segment": (F.col("c_mktsegment") == "BUILDING", 100), "price": (F.col("o_totalprice") > 100000, 60), "urgent": (F.col("o_orderpriority") == "1-URGENT", 75),
        "open": (F.col("o_orderstatus") == "O", 25),
    }
    scored = ranking.score(orders.join(customers, "o_custkey"), weights, 10)
    return ranking.top(scored.select("o_orderkey", F.array_join("reasons", ",").alias("reasons"), "score"), 64, "o_orderkey")


def retention_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return ranking.retention(lines, "l_orderkey", F.col("l_linenumber") <= 3, F.col("l_linenumber") >= 2, F.col("l_returnflag") == "R")


def related_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their part and supplier: strong where a large part comes from a supplier in credit, weak for either alone."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal")
    large, credit = F.col("p_size") > 25, F.col("s_acctbal") > 0
    strength = F.when(large & credit, "strong").when(large | credit, "weak")
    return lines.join(parts, "l_partkey").join(suppliers, "l_suppkey").select("l_orderkey", "l_linenumber", strength.alias("strength")).where("strength is not null")


def latest_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).drop("ts")


def tail_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.tail(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 2)


def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of both kinds of account in the nations of two regions."""
    nations = table(spark, sf_dir, "nation").where("n_regionkey in (1, 3)").select(F.col("n_nationkey").alias("nation"))
    suppliers = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    customers = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    return suppliers.unionByName(customers).join(nations, "nation", "left_semi").select("kind", "id", "name", "nation")


def pattern_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.longest_prefix(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", PREFIX_RULES)


def graph_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the place graph by kind: how many, and the first and last id."""
    nation, supplier, customer = _places(spark, sf_dir)
    edges = nation.unionByName(supplier).unionByName(customer)
    nodes = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return nodes.groupBy(F.substring_index("id", ":", 1).alias("kind")).agg(F.count("*").alias("node_count"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


_FOLD_MOVES = " ".join(f"when s = '{a}' and e = '{b}' then '{to}'" for (a, b), to in MOVES.items())
_FOLD = """
with e as (select user_id, list(case event_type when 'signup' then 'PROPOSE' when 'purchase' then 'CONFIRM' when 'error' then 'REJECT' else 'REVOKE' end order by ts, event_id) as es
  from events where event_type in ('signup', 'purchase', 'error', 'view') group by user_id),
f as (select user_id, list_reduce(es, lambda s, e: case {moves} else {other} end, 'none') as state from e)
"""
_PLACES = """
with recursive places as (select 'r:' || n_regionkey as src, 'n:' || n_nationkey as dst from nation
  union all select 'n:' || s_nationkey, 's:' || s_suppkey from supplier {more}),
"""
_WALK = """
walk(node, depth) as ({roots} union select e.dst, w.depth + 1 from walk w join edges e on e.src = w.node where w.depth < {depth})
select node, min(depth) as depth from walk group by node
"""
_HREFS = """
with h as (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href from pages),
i as (select page_id, href, count(*) as occurrences from h group by page_id, href)
"""

NAMES = (
    "edge_delta event_chain lifecycle_reduce lifecycle_strict occurrence_coalesce bfs_tree bfs_cyclic_bounded dependency_cone chain_walk candidate_resolution exact_lineage "
    "content_fingerprint import_extract import_resolve freshness_ladder candidate_rank retention_status related_evidence latest_observation tail_history alias_lookup pattern_mapping graph_snapshot"
).split()
QUERIES = {name: globals()[name] for name in NAMES}
ORACLES = {
    "edge_delta": """with b as (select distinct l_suppkey, l_partkey from lineitem where l_orderkey % 10 <> 0), a as (select distinct l_suppkey, l_partkey from lineitem where l_orderkey % 11 <> 0)
      select *, 'removed' as change from (from b except from a) union all select *, 'added' from (from a except from b)""",
    "event_chain": """with n as (select *, lag(event_type) over w as before, row_number() over w as n from events window w as (partition by user_id order by ts, event_id)),
      k as (select * from n where n = 1 or before is distinct from event_type)
      select event_id, user_id, event_type, lag(event_id) over (partition by user_id order by ts, event_id) as predecessor from k""",
    "lifecycle_reduce": _FOLD.format(moves=_FOLD_MOVES, other="s") + "select user_id, state from f",
    "lifecycle_strict": _FOLD.format(moves="when starts_with(s, 'corrupt:') then s " + _FOLD_MOVES, other="'corrupt:' || e || '-in-' || s")
    + "select user_id, case when starts_with(state, 'corrupt:') then 'corrupt' else state end as state, case when starts_with(state, 'corrupt:') then state[9:] end as reason from f",
    "occurrence_coalesce": "select user_id, event_type, count(*) as occurrence_count from events group by all",
    "bfs_tree": _PLACES.format(more="") + "edges as (from places)," + _WALK.format(roots="select 'r:2', 0", depth=8),
    "bfs_cyclic_bounded": """with recursive pairs as (select distinct 's:' || l_suppkey as src, l_partkey % 50 as p from lineitem),
      edges as (select src, 'p:' || p as dst from pairs union all select 'p:' || p, src from pairs where p % 3 = 0),""" + _WALK.format(roots="select 's:1', 0", depth=3),
    "dependency_cone": _PLACES.format(more="union all select 'n:' || c_nationkey, 'c:' || c_custkey from customer")
    + "edges as (from places union all select dst, src from places)," + _WALK.format(roots="select 's:1', 0 union all select 'c:5', 0", depth=2),
    "chain_walk": """with recursive t as (select distinct conv_id, turn from conversations),
      w(conv_id, turn, root) as (select conv_id, turn, turn from t where not exists (select 1 from t p where p.conv_id = t.conv_id and p.turn = t.turn - 1)
        union all select t.conv_id, t.turn, w.root from w join t on t.conv_id = w.conv_id and t.turn = w.turn + 1)
      select conv_id, turn, turn - root as depth, root = 0 as complete from w""",
    "candidate_resolution": """select sha256(text) as text_hash, count(distinct doc_id) as candidate_count, case count(distinct doc_id) when 1 then 'resolved' else 'ambiguous' end as status,
      case count(distinct doc_id) when 1 then min(doc_id) end as target from documents group by text""",
    "exact_lineage": """with a as (select text, count(*) as n, min(doc_id) as first from documents where doc_id % 2 = 1 group by text)
      select doc_id, n as candidate_count, case n when 1 then 'unique' else 'ambiguous' end as lineage, case n when 1 then first end as successor
      from documents d join a on a.text = d.text where doc_id % 2 = 0""",
    "content_fingerprint": "select doc_id, sha256('document' || chr(0) || doc_id || chr(0) || coalesce(lang, '') || chr(0) || coalesce(source, '') || chr(0) || coalesce(text, '')) as fingerprint from documents",
    "import_extract": _HREFS + "from i",
    "import_resolve": _HREFS + """, p as (select regexp_replace(url, '^https?://[^/]*', '') as path, min(page_id) as page from pages group by 1),
      c as (select distinct href, unnest([0, 1, 2, 3]) as rank, unnest([href, regexp_replace(href, '#.*$', ''), regexp_replace(href, '[?#].*$', ''), '/en' || href]) as path from i),
      m as (select href, min(rank) as match_rank, min_by(page, rank) as target from c join p using (path) group by href)
      select page_id, i.href, match_rank, target, case when match_rank is null then 'unresolved' else 'resolved' end as status from i left join m on m.href = i.href""",
    "freshness_ladder": """with n as (select o_orderkey as k, case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end as s, case when o_orderkey % 13 = 0 then '0-NEW' else o_orderpriority end as p
        from orders where o_orderkey % 11 <> 0),
      r as (select o_orderkey, case when k is null then 'target-missing' when p is distinct from o_orderpriority then 'o_orderpriority-changed'
        when s is distinct from o_orderstatus then 'fingerprint-mismatch' else 'fingerprint-match' end as reason from orders left join n on k = o_orderkey)
      select o_orderkey, reason, case reason when 'target-missing' then 'unresolved' when 'fingerprint-match' then 'current' else 'stale' end as status from r""",
    "candidate_rank": """with s as (select o_orderkey, c_mktsegment = 'BUILDING' as a, o_totalprice > 100000 as b, o_orderpriority = '1-URGENT' as c, o_orderstatus = 'O' as d
        from orders join customer on c_custkey = o_custkey)
      select o_orderkey, concat_ws(',', case when a then 'segment' end, case when b then 'price' end, case when c then 'urgent' end, case when d then 'open' end) as reasons,
        10 + case when a then 100 else 0 end + case when b then 60 else 0 end + case when c then 75 else 0 end + case when d then 25 else 0 end as score
      from s where a or b or c or d order by score desc, o_orderkey limit 64""",
    "retention_status": """with f as (select l_orderkey, bool_or(l_linenumber <= 3) as b, bool_or(l_linenumber >= 2) as a, bool_or(l_returnflag = 'R') as c from lineitem group by l_orderkey)
      select l_orderkey, case when b and not a then 'removed' when not b and a then 'added' when c then 'changed' else 'retained' end as retention from f where a or b""",
    "related_evidence": """select l_orderkey, l_linenumber, case when p_size > 25 and s_acctbal > 0 then 'strong' else 'weak' end as strength
      from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey where p_size > 25 or s_acctbal > 0""",
    "latest_observation": "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "tail_history": """select conv_id, turn, role, count(*) over (partition by conv_id) as total from conversations
      qualify row_number() over (partition by conv_id order by turn desc) <= 2""",
    "alias_lookup": """with u as (select 'supplier' as kind, s_suppkey as id, s_name as name, s_nationkey as nation from supplier union all select 'customer', c_custkey, c_name, c_nationkey from customer)
      from u where nation in (select n_nationkey from nation where n_regionkey in (1, 3))""",
    "pattern_mapping": "select p_partkey, p_type, case " + " ".join(f"when starts_with(p_type, '{p}') then '{t}'" for p, t in sorted(PREFIX_RULES, key=lambda r: -len(r[0]))) + " end as mapped from part",
    "graph_snapshot": _PLACES.format(more="union all select 'n:' || c_nationkey, 'c:' || c_custkey from customer")
    + "ids as (select src as id from places union select dst from places) select split_part(id, ':', 1) as kind, count(*) as node_count, min(id) as first_id, max(id) as last_id from ids group by 1",
}
