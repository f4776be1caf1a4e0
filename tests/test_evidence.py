"""Flows against a plain walk, and operators of references, aliases, chains and observations on hand-made rows."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from evidentia.functions import validation
from evidentia.operators import aliases, chains, flows, observations, references


def walk(target, nodes, edges, caps):
    """Node order, number of edges and omissions of one flow, by a queue."""
    out, steps, taken, omissions, queue = {}, ["entry"], 0, set(), deque([(target, 0)])
    for e in sorted(edges, key=lambda e: (e[2], e[1], e[3])):
        if e[2] in ("calls", "constructs"):
            out.setdefault(e[0], []).append(e[1])
    while queue:
        node, depth = queue.popleft()
        if node in steps or node not in nodes:
            continue
        if len(steps) >= caps.steps:
            omissions.add(f"flow steps capped at {caps.steps}")
            break
        steps.append(node)
        if depth >= caps.depth:
            omissions.add(f"flow depth capped at {caps.depth}")
            continue
        for to in out.get(node, []):
            if taken >= caps.edges:
                omissions.add(f"flow edges capped at {caps.edges}")
                break
            taken += 1
            queue.append((to, depth + 1))
        if taken >= caps.edges:
            break
    return steps[1:], taken, sorted(omissions)


@pytest.mark.parametrize("caps", [flows.Caps(), flows.Caps(6, 512, 64), flows.Caps(256, 9, 64), flows.Caps(256, 512, 2), flows.Caps(5, 7, 3), flows.Caps(256, 1, 64)])
def test_flows_match_a_plain_walk(spark, caps):
    rng = random.Random(caps.steps * 1000 + caps.edges)
    names = [f"n{i:02}" for i in range(24)]
    known = names[:21]
    edges = sorted({(rng.choice(names), rng.choice(names), rng.choice(["calls", "constructs", "declares"]), rng.choice("xy")) for _ in range(60)})
    entries = [(f"e{n}", n) for n in names] + [("none", None), ("lost", "nowhere")]
    steps, totals = flows.project_flows(spark.createDataFrame(entries, "entry string, target string"), spark.createDataFrame([(n,) for n in known], "id string"), spark.createDataFrame(edges, "src string, dst string, kind string, evidence string"), caps)
    got = {}
    for r in steps.orderBy("entry", "position").collect():
        assert r.position == len(got.setdefault(r.entry, []))
        got[r.entry].append(r.node)
    sums = {r.entry: r for r in totals.collect()}
    for entry, target in entries:
        nodes, taken, omissions = walk(target, set(known), edges, caps)
        assert (got[entry][1:], sums[entry].n_edges, list(sums[entry].omissions)) == (nodes, taken, omissions), entry
        assert sums[entry].n_steps == len(nodes) + 1 and sums[entry].status == ("truncated" if omissions else "complete")


def test_edges_beyond_the_last_depth_count_nothing(spark):
    edges = [("a", "b", "calls", ""), ("a", "c", "calls", ""), *[("b", f"x{i}", "calls", "") for i in range(9)]]
    nodes = {x for e in edges for x in e[:2]}
    rows = spark.createDataFrame(edges, "src string, dst string, kind string, evidence string"), flows.Caps(256, 5, 1)
    steps, totals = flows.project_flows(spark.createDataFrame([("e", "a")], "entry string, target string"), spark.createDataFrame([(n,) for n in nodes], "id string"), *rows)
    assert ([r.node for r in steps.orderBy("position").collect()][1:], totals.first().n_edges, list(totals.first().omissions)) == walk("a", nodes, edges, rows[1])


def test_fingerprints_of_flows(spark):
    steps = spark.createDataFrame([(e, i, n) for e, line in {"a": "aST", "b": "bST", "c": "cTS", "d": "dSU", "e": "e"}.items() for i, n in enumerate(line)], "entry string, position int, node string")
    edges = [("S", "T", "calls", "x"), ("S", "T", "calls", "x"), ("S", "T", "calls", "y"), ("T", "T", "constructs", "x"), ("S", "T", "declares", "x"), ("T", "V", "calls", "x"), ("a", "S", "calls", "x")]
    make = lambda rows: {r.entry: (r.n_inner, r.fingerprint) for r in flows.flow_fingerprints(steps.where("position > 0 or entry = 'e'"), spark.createDataFrame(rows, "src string, dst string, kind string, evidence string")).collect()}
    got, less = make(edges), make(edges[1:2] + edges[3:])
    assert {k: n for k, (n, _) in got.items()} == {"a": 3, "b": 3, "c": 3, "d": 0, "e": 0}
    assert got["a"] == got["b"] != got["c"] and len({f for _, f in got.values()}) == 4
    assert less["a"][0] == 2 and less["a"][1] != got["a"][1] and less["d"] == got["d"]


def test_flows_of_empty_tables(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    steps, totals = flows.project_flows(empty("entry string, target string"), empty("id string"), empty("src string, dst string, kind string, evidence string"))
    assert steps.count() == 0 and totals.count() == 0


def test_node_fingerprints_over_more_tasks(spark):
    nodes = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "id string, intrinsic string")
    edges = spark.createDataFrame([("a", "b", "calls", "1"), ("b", "b", "calls", None), ("b", "a", "declares", "1"), ("b", "a", "constructs", "2")], "src string, dst string, kind string, evidence string")
    assert sorted(observations.node_fingerprints(nodes, edges, 7).collect()) == sorted(observations.node_fingerprints(nodes, edges).collect())


def test_aliases(spark):
    rules = [("@/*", 0, "src/*"), ("@/*", 1, "lib/*"), ("@/a/*", 0, "a/*/*"), ("*.svg", 0, "assets/*"), ("exact", 0, "src/exact.ts"), ("ex*", 0, "none/*"), ("@/x*y", 0, "mid/*"), (None, 0, "src/null"), ("@/b*", 0, None)]
    known = ["src/m.ts", "lib/m.ts", "lib/only/index.ts", "a/q/q.tsx", "assets/pic", "src/exact.ts", "mid/z.d.ts"]
    wanted = ["@/m", "@/only", "@/a/q", "pic.svg", "exact", "example", "@/xzy", "@/xy", "react", "", None, "@/m"]
    rows = aliases.resolve_aliases(spark.createDataFrame([(w,) for w in wanted], "specifier string"), spark.createDataFrame(rules, "pattern string, target_order int, target string"), spark.createDataFrame([(k,) for k in known], "path string"))
    got = {r.specifier: (r.pattern, r.target, r.status) for r in rows.collect()}
    assert got == {
        "@/m": ("@/*", "src/m.ts", "local"), "@/only": ("@/*", "lib/only/index.ts", "local"), "@/a/q": ("@/a/*", "a/q/q.tsx", "local"), "pic.svg": ("*.svg", "assets/pic", "local"), "exact": ("exact", "src/exact.ts", "local"),
        "example": ("ex*", None, "unresolved"), "@/xzy": ("@/x*y", "mid/z.d.ts", "local"), "@/xy": ("@/x*y", None, "unresolved"), "react": (None, None, "external"), "": (None, None, "external"),
    }


def test_chains(spark):
    cases = {
        "linear": [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "d")], "single": [("a", None)], "two roots": [("a", None), ("b", None)], "no root": [("a", "b"), ("b", "a")],
        "itself": [("a", None), ("b", "b")], "unknown": [("a", None), ("b", "z")], "branch": [("a", None), ("b", "a"), ("c", "a")], "cycle": [("a", None), ("b", "c"), ("c", "b"), ("d", "a")],
    }
    rows = spark.createDataFrame([(k, e, p) for k, v in cases.items() for e, p in v], "key string, event string, predecessor string")
    got = {r.key: r.status for r in chains.chain_status(rows).collect()}
    assert got == {
        "linear": "linear", "single": "linear", "two roots": "root-invalid", "no root": "root-invalid", "itself": "predecessor-invalid", "unknown": "predecessor-invalid", "branch": "predecessor-invalid", "cycle": "disconnected",
    }
    assert chains.chain_status(rows.limit(0)).count() == 0


def test_candidates_of_a_stale_reference_are_bounded(spark):
    state = spark.sql("select 'p' as project_id, 'now' as observation_id")
    seen = spark.sql("select * from values ('then', 'p', 1, 'r1', false), ('now', 'p', 2, 'r2', false) as t(observation_id, project_id, graph_version, revision, dirty)")
    nodes = spark.sql("select 1 as graph_version, 'old' as node_id, 'f' as kind, 'x' as path, 'fp' as fingerprint union all select 2, concat('new', lpad(id, 3, '0')), 'f', 'x', 'fp' from range(40)")
    refs = spark.sql(
        "select 'old' as uri, 'p' as project_id, 1 as graph_version, 'old' as node_id, 'then' as origin_observation, 'r1' as origin_revision, 'fp' as origin_fingerprint, 'n' as scope, 'n1' as contract union all "
        "select concat('u', lpad(id, 3, '0')), 'p', 2, concat('new', lpad(id, 3, '0')), 'now', 'r2', 'fp', 'n', 'n1' from range(40)"
    )
    sources = spark.createDataFrame([], "graph_version int, path string, hash string")
    row = references.context_freshness(refs, references.Store(state, seen, nodes, sources), references.Contracts("n", "n1", "file", "file1")).where("uri = 'old'").first()
    assert (row.status, row.reason, row.truncated) == ("stale", "exact-successor-ambiguous", True) and row.candidates == [f"u{i:03}" for i in range(32)]


def test_without_a_current_observation_nothing_is_fresh(spark):
    store = references.Store(
        spark.createDataFrame([], "project_id string, observation_id string"), spark.sql("select 'a' as observation_id, 'p' as project_id, 1 as graph_version, 'r' as revision, false as dirty"),
        spark.sql("select 1 as graph_version, 'n' as node_id, 'f' as kind, cast(null as string) as path, 'fp' as fingerprint"), spark.createDataFrame([], "graph_version int, path string, hash string"),
        spark.sql("select 1 as graph_version, 'n' as flow_id, 'fp' as fingerprint"),
    )
    refs = spark.sql("select 'u' as uri, 'p' as project_id, 1 as graph_version, 'n' as node_id, 'n' as flow_id, 'a' as origin_observation, 'r' as origin_revision, 'fp' as origin_fingerprint, 'n' as scope, 'n1' as contract")
    context = references.context_freshness(refs.drop("flow_id"), store, references.Contracts("n", "n1", "file", "file1")).first()
    assert tuple(context) == ("u", "unavailable", "current-observation-unavailable", [], False)
    assert tuple(references.flow_freshness(refs, store).first()) == ("u", "unavailable", "origin-graph-unavailable")


def test_fingerprints_ignore_order_and_see_changes(spark):
    nodes = spark.createDataFrame([("a", "1"), ("b", "2"), ("alone", None)], "id string, intrinsic string")
    edges = [("a", "b", "calls", "x"), ("b", "a", "imports", "y"), ("a", "a", "calls", "z"), ("a", "b", "declares", "q")]
    of = lambda rows: {r.id: r.fingerprint for r in observations.node_fingerprints(nodes, spark.createDataFrame(rows, "src string, dst string, kind string, evidence string")).collect()}
    first, turned, fewer, undeclared = of(edges), of(edges[::-1]), of(edges[1:]), of(edges[:3])
    assert first == turned == undeclared and all(len(v) == 64 for v in first.values())
    assert first["a"] != fewer["a"] and first["b"] != fewer["b"] and first["alone"] == fewer["alone"]


def test_envelope(spark):
    changes = spark.createDataFrame([("node", "added", str(i)) for i in range(5)] + [("source", "removed", "s")], "category string, change string, key string")
    rows = {r: observations.delta_envelope(changes, {"source": 9, "node": 3}, F.lit(r)).first() for r in ("same-structural-graph", "structural-graph-changed", "unavailable")}
    assert [(rows[r].status, rows[r].reason, rows[r].node_added, rows[r].source_removed) for r in rows] == [
        ("truncated", "same-structural-graph", 5, 1), ("truncated", "change-bounds-reached", 5, 1), ("unavailable", "incompatible-evidence-contract", 0, 1),
    ]
    assert rows["structural-graph-changed"].omissions == ["node changes omitted after max bound 3"]
    assert observations.bounded_changes(changes, {"source": 9, "node": 3}, ["key"]).count() == 4
    available = spark.sql("select * from values ('a', 'b'), ('', 'b'), ('legacy', 'b'), (null, 'b') as t(x, y)").select(observations.contract_available("legacy", F.col("x"), F.col("y")).alias("ok"))
    assert [r.ok for r in available.collect()] == [True, False, False, False]


def test_same_rows_counts_repeats(spark):
    a, b = spark.sql("select * from values (1, null), (1, null), (2, 'x') as t(i, s)"), spark.sql("select * from values ('x', 2), (null, 1) as t(s, i)")
    assert tuple(observations.same_rows("t", a, b).first()) == ("t", 1, 0, False)
    assert tuple(observations.same_rows("t", a.distinct(), b).first()) == ("t", 0, 0, True)
    assert tuple(observations.same_rows("t", a.limit(0), b.limit(0)).first()) == ("t", 0, 0, True)


def test_values(spark):
    values = ["a-1:b.c_d", "a b", "", None, "x" * 129, "é", "main~1", "a;b", "t ", " ", "a\0b", "see token=abc", "two\nlines"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    v = F.col("v")
    got = rows.select("i", validation.is_id(v).alias("id"), validation.is_text(v).alias("text"), validation.is_revision(v).alias("rev"), validation.is_reference(v).alias("ref")).orderBy("i").collect()
    which = lambda c: [values[r.i] for r in got if r[c]]
    assert which("id") == ["a-1:b.c_d"]
    assert which("text") == [x for x in values if x and x not in (" ", "a\0b")]
    assert which("rev") == ["a-1:b.c_d", "é", "main~1"]
    assert which("ref") == [x for x in values if x and x not in ("a\0b", "see token=abc", "two\nlines")]
    changed = spark.sql("select * from values ('a.ts', false), ('a.js', true), ('package.json', true), ('package.json', false), ('x/package.json', true) as t(p, f)")
    assert [r[0] for r in changed.select(validation.is_changed_source(F.col("p"), F.col("f"))).collect()] == [True, False, True, False, False]


def test_scripts(spark):
    commands = {
        "tsx src/a.ts": ("tsx", "src/a.ts", ""), " bun  run\tx.ts ": ("bun run", "x.ts", ""), "deno run y": ("deno run", "y", ""), "bun run": ("bun", "run", ""), "deno x": (None, None, "unsupported-script-runner-or-arity"), "": (None, None, "script-command-complex-or-shell-composed"),
        "tsc && node x": (None, None, "script-command-complex-or-shell-composed"), "node --watch x": (None, None, "script-command-flags-or-quoting-unsupported"), "  ": (None, None, "unsupported-script-runner-or-arity"), None: (None, None, None),
    }
    rows = spark.createDataFrame([(c,) for c in commands], "c string").select("c", validation.script(F.col("c")).alias("s")).collect()
    assert {r.c: tuple(r.s) for r in rows} == commands
