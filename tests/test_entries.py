"""Entry targets, recorded good states and inserts on odd rows."""

from evidentia.operators import applicability, entries


def test_entry_targets(spark):
    known = ["src/a.ts", "src/b/index.tsx", "src/d.d.ts", "lib/x.y", "lib/x.y.ts", "e.ts", "e.tsx"]
    want = {
        "src/a": ("src/a.ts", "entry-target-resolved"), "./src/a.ts": ("src/a.ts", "entry-target-resolved"), "src\\a": ("src/a.ts", "entry-target-resolved"), "src/b": ("src/b/index.tsx", "entry-target-resolved"), "e": ("e.ts", "entry-target-resolved"),
        "lib/x.y": ("lib/x.y", "entry-target-resolved"), "src/d": (None, "entry-target-declaration-file-unsupported"), "src/d.d.ts": (None, "entry-target-declaration-file-unsupported"), "src/a.mjs": (None, "entry-target-missing-or-not-typescript"),
        "src/a.js": (None, "entry-target-javascript-output-unsupported"), "../src/a": (None, "entry-target-escapes-repository"), "/src/a": (None, "entry-target-absolute-or-invalid"), "c:a": (None, "entry-target-absolute-or-invalid"),
        "": (None, "entry-target-absolute-or-invalid"), None: (None, "entry-target-absolute-or-invalid"),
    }
    rows = spark.createDataFrame([("script", str(i), t) for i, t in enumerate(want)] + [("bin", "again", "e")], "kind string, key string, target string")
    files = spark.createDataFrame([(k,) for k in known], "path string")
    got = entries.resolve_targets(rows, files)
    assert {r.target: (r.path, r.reason) for r in got.collect()} == want and got.count() == len(want) + 1
    nodes, edges = entries.entry_graph(rows, files)
    assert nodes.count() == len(want) + 1 and {(r.src, r.dst) for r in edges.collect()} >= {("entry:bin:again", "file:e.ts"), ("entry:script:0", "file:src/a.ts")}
    assert entries.resolve_targets(rows, files.limit(0)).where("path is not null").count() == 0


def test_missing_rows(spark):
    stored = spark.createDataFrame([(1, None), (2, "b")], "k int, s string")
    rows = spark.createDataFrame([(1, None, 5), (1, "a", 7), (1, "a", 6), (None, "b", 1), (2, "b", 0)], "k int, s string, v int")
    got = applicability.missing_rows(rows, stored, ["k", "s"])
    assert got.columns == ["k", "s", "v"] and {tuple(r) for r in got.collect()} == {(1, "a", 6), (None, "b", 1)}
    assert {tuple(r) for r in applicability.missing_rows(stored, stored.limit(0), ["k", "s"]).collect()} == {(1, None), (2, "b")}


def test_applicability_of_unknown_rows(spark):
    columns = "candidate string, context string, repository string, project string, definition int, basis string, expected string, integrity string, observation string, graph_version int, graph_id string, revision string, contract string"
    good = ("ok", "c", "r", "p", 1, "b", "e", "complete", "o", 1, "g", "abc", "k")
    rows = spark.createDataFrame([good, ("no context", "z", *good[2:]), ("null", *[None] * 12), ("dirty", *good[1:8], "d", *good[9:])], columns)
    contexts = spark.sql("select 'c' as context, 'r' as repository, 'p' as project, 1 as definition, 'b' as basis, 'e' as expected, 'k' as contract")
    seen = spark.sql("select * from values ('o', 'p', 1, 'abc', false), ('d', 'p', 1, 'abc', true) as t(observation, project, graph_version, revision, dirty)")
    versions, lineage = spark.sql("select 1 as graph_version, 'g' as graph_id, 'k' as contract"), spark.sql("select 'abc' as revision")
    got = {r.candidate: (r.status, r.reason) for r in applicability.applicability(rows, contexts, seen, versions, lineage).collect()}
    assert got == {
        "ok": ("applicable", ""), "no context": ("repository-mismatch", "repository-identity-mismatch"), "null": ("repository-mismatch", "repository-identity-mismatch"),
        "dirty": ("basis-unavailable", "observation-unavailable-or-mismatched"),
    }
