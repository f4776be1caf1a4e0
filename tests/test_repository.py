"""A small repository from its files to its graph, and the commits data source."""

import os
import subprocess

import pytest

from evidentia.operators import facts
from evidentia.plans import repository_graph
from evidentia.sources.repository import GitCommits, source_files

SOURCES = {
    "src/main.ts": """// import x from './nope'
import def, { helper as h, type T } from './util';
import * as ns from "./util/index";
import './side';
import { readFile } from 'fs';
import { missing } from './gone';
export class Main extends def implements T, U {
  x = ns.other();
}
export const main = () => { h(2); new Main(); local(); };
/* new Nothing(); */
function local() { if (x) { return readFile('SENTINEL'); } }
""",
    "src/util.ts": "export { helper } from './impl';\nexport * from './more';\nexport default class Base {}\n",
    "src/impl.ts": "export function helper(n: number) { return n; }\n", "src/more.ts": "export const extra = 1;\n", "src/util/index.ts": "export function other() {}\n",
    "src/side.tsx": "export type T = string;\n", "tests/main.test.ts": "import { main } from '../src/main';\nimport { extra } from '../src/util';\nmain();\n",
    "node_modules/x/a.ts": "export const no = 1;\n", "readme.md": "x",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("repo")
    for path, text in SOURCES.items():
        (folder / path).parent.mkdir(parents=True, exist_ok=True)
        (folder / path).write_text(text)
    os.symlink(folder / "src", folder / "linked")
    return str(folder)


def test_facts(spark, root):
    files = source_files(spark, root)
    assert sorted(r.path for r in files.collect()) == sorted(p for p in SOURCES if p.endswith(("ts", "tsx")) and "node_modules" not in p)
    found = {(r.specifier, r.kind, r.local_name, r.imported_name, r.type_only) for r in facts.imports(files).where("path = 'src/main.ts'").collect()}
    assert found == {
        ("./util", "default", "def", "default", False), ("./util", "named", "h", "helper", False), ("./util", "named", "T", "T", True), ("./util/index", "namespace", "ns", "*", False),
        ("./side", "side-effect", None, None, False), ("fs", "named", "readFile", "readFile", False), ("./gone", "named", "missing", "missing", False),
    }
    assert {(r.owner, r.relation, r.reference) for r in facts.heritage(files).collect()} == {("Main", "extends", "def"), ("Main", "implements", "T"), ("Main", "implements", "U")}


def test_renamed_local_exports_lead_to_their_declaration(spark):
    from evidentia.operators.graph import export_closure

    rows = [("a", "h", None, "helper"), ("a", "k", None, None), ("b", "again", "a", "h"), ("b", "k", "a", "k")]
    closed = export_closure(spark.createDataFrame(rows, "module string, name string, source_module string, source_name string")).collect()
    assert {(r.module, r.name): (r.target_module, r.target_name) for r in closed} == {("a", "h"): ("a", "helper"), ("a", "k"): ("a", "k"), ("b", "again"): ("a", "helper"), ("b", "k"): ("a", "k")}


def test_exports_and_calls_of_every_form(spark):
    text = """import { z } from 'pkg//x'; // import { no } from './no'
const helper = 1, url = "http://a/*b*/"; /* f('x') */
export { helper as h, type T, other };
export * as ns from './x';
export { q as r } from './y';
export default helper;
export const { a, b: c, d = f(1), ...rest } = make();
export const [e] = list();
const s = "g() and 'h()'", t = `k()`;
class K {
  m(n: () => void) {
    this.m(1); helper2(s);
  }
  static async go<T>(x: T): Promise<void> {
    if (x) { m(2); }
  }
}
"""
    files = spark.createDataFrame([("src/k.ts", text), ("src/l.ts", "export default class {}\nexport default async function run() { run(); }\nexport default 5\n"), ("src/m.ts", "'" + "x" * 300_000 + "'; f();")], "path string, text string")
    found = {(r.module, r.name, r.source_module, r.source_name) for r in facts.exports(files).collect()}
    local = {n for m, n, source, _ in found if m == "src/k.ts" and source is None}
    assert local == {"h", "T", "other", "default", "a", "c", "d", "rest", "e"}
    assert {(n, own) for m, n, source, own in found if m == "src/k.ts" and source is None and own} == {("h", "helper"), ("default", "helper")}
    assert {x[1:] for x in found if x[2]} == {("ns", "./x", "*"), ("r", "./y", "q")} and ("src/l.ts", "default", None, None) in found
    assert {(r.specifier, r.kind) for r in facts.imports(files).collect()} == {("pkg//x", "named"), ("./x", "namespace-export"), ("./y", "re-export")}
    called = {(r.path, r.receiver, r.callee): r.occurrence_count for r in facts.calls(files).collect()}
    assert called == {
        ("src/k.ts", None, "f"): 1, ("src/k.ts", None, "make"): 1, ("src/k.ts", None, "list"): 1, ("src/k.ts", "this", "m"): 1, ("src/k.ts", None, "helper2"): 1, ("src/k.ts", None, "m"): 1,
        ("src/l.ts", None, "run"): 1, ("src/m.ts", None, "f"): 1,
    }
    assert {(r.path, r.name, r.heads) for r in facts.methods(files).collect()} == {("src/k.ts", "m", 1), ("src/k.ts", "go", 1)}


def test_graph(spark, root):
    graph = repository_graph.build(spark, root)
    outcome = {(r.path, r.reference): (r.status, r.reason, r.target) for r in graph.resolutions.collect()}
    assert outcome["src/main.ts", "h"] == ("resolved", "import-binding", "symbol:src/impl.ts#helper")
    assert outcome["src/main.ts", "readFile"][0] == "external" and outcome["src/main.ts", "ns.other"][0] == "unresolved"
    edges = {tuple(r) for r in graph.edges.collect()}
    assert ("symbol:src/main.ts#Main", "symbol:src/util.ts#Base", "extends") in edges and ("file:src/main.ts", "unresolved-module:./gone", "imports-unresolved") in edges
    ids = {r.id for r in graph.nodes.collect()}
    assert {x for e in edges for x in e[:2]} <= ids
    for table in (graph.nodes, graph.edges, graph.resolutions):
        assert "SENTINEL" not in str(table.collect())
    entry = spark.createDataFrame([("src/main.ts",)], "path string")
    assert {r.node: r.depth for r in repository_graph.flow(graph, entry).collect()}["symbol:src/impl.ts#helper"] == 1
    assert {tuple(r) for r in repository_graph.related_tests(graph).collect()} == {("tests/main.test.ts", "file:src/main.ts", "strong"), ("tests/main.test.ts", "file:src/util.ts", "weak")}


def test_commits(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    for i in range(5):
        (tmp_path / f"f{i}").write_text(str(i))
        git("add", "-A")
        git("commit", "-qm", f"change {i}")
    spark.dataSource.register(GitCommits)
    rows = spark.read.format("git-commits").option("path", str(tmp_path)).option("partitions", 2).load().orderBy("position").collect()
    assert [(r.summary, r.status, r.path, len(r.parents)) for r in rows] == [(f"change {i}", "A", f"f{i}", int(i > 0)) for i in range(4, -1, -1)]


def test_commits_with_paths_beyond_ascii(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    for names in (["é.ts", "a b.ts"], ["日本\tx.ts"], []):
        for n in names:
            (tmp_path / n).write_text("x")
        git("add", "-A")
        git("commit", "--allow-empty", "-qm", f"with {len(names)}")
    (tmp_path / "é.ts").write_text("y")
    git("commit", "-aqm", "again")
    spark.dataSource.register(GitCommits)
    rows = spark.read.format("git-commits").option("path", str(tmp_path)).option("partitions", 1).load().collect()
    assert {(r.summary, r.status, r.path) for r in rows} == {("with 2", "A", "a b.ts"), ("with 2", "A", "é.ts"), ("with 1", "A", "日本\tx.ts"), ("with 0", None, None), ("again", "M", "é.ts")}


def test_paths(spark):
    from pyspark.sql import functions as F

    from evidentia.functions.paths import is_excluded, normalize, resolve_relative

    rows = [("src/a.ts", "./b", "src/b"), ("src/a.ts", "../b/./c", "b/c"), ("a.ts", "../b", None), ("src/a.ts", "./c:d", None), ("src/a.ts", ".\\b", None), ("src/a.ts", "./x\\y", None), ("src/a.ts", "b", None)]
    frame = spark.createDataFrame(rows, "importer string, specifier string, want string")
    assert all(r.got == r.want for r in frame.withColumn("got", resolve_relative(F.col("importer"), F.col("specifier"))).collect())
    one = spark.range(1).select(normalize(F.lit("a//b/../c")).alias("a"), normalize(F.lit("/a")).alias("b"), normalize(F.lit("a\\b")).alias("c"), *[is_excluded(F.lit(p)).alias(f"x{i}") for i, p in enumerate(["out/a.ts", "vendor/a.ts", ".turbo/a.ts", "a/dist/b.ts", "dist.ts"])]).first()
    assert tuple(one) == ("a/c", None, None, False, False, True, True, False)


def test_graph_of_callers_and_members(spark, tmp_path):
    texts = {
        "src/a.ts": "import { B } from './b';\nexport class A extends B {\n  private one() { return 1; }\n  run() { this.one(); return new B(); }\n}\nexport const go = () => B.make();\n",
        "src/b.ts": "export class B { static make() { return 'SENTINEL'; } over(a: string): void; over(a) {} }\nfunction broken( {\n",
    }
    for path, text in texts.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    graph = repository_graph.build(spark, str(tmp_path))
    assert {tuple(r) for r in graph.call_edges.select("src", "dst", "kind").collect()} == {
        ("symbol:src/a.ts#A.run", "symbol:src/a.ts#A.one", "calls"), ("symbol:src/a.ts#A.run", "symbol:src/b.ts#B", "constructs"), ("symbol:src/a.ts#go", "symbol:src/b.ts#B.make", "calls"),
        ("symbol:src/a.ts#A", "symbol:src/a.ts#A.one", "declares-member"), ("symbol:src/a.ts#A", "symbol:src/a.ts#A.run", "declares-member"),
        ("symbol:src/b.ts#B", "symbol:src/b.ts#B.make", "declares-member"), ("symbol:src/b.ts#B", "symbol:src/b.ts#B.over", "declares-member"),
    }
    assert {r.path: r.recovered for r in graph.sources.collect()} == {"src/a.ts": False, "src/b.ts": True}
    before = {r.id: r.fingerprint for r in graph.members.unionByName(graph.declared, allowMissingColumns=True).collect()}
    (tmp_path / "src/a.ts").write_text(texts["src/a.ts"].replace("return 1;", "return 2; /* other */").replace("B.make()", "B . make( /* same */ )"))
    again = repository_graph.build(spark, str(tmp_path))
    after = {r.id: r.fingerprint for r in again.members.unionByName(again.declared, allowMissingColumns=True).collect()}
    assert {i for i in before if before[i] != after[i]} == {"symbol:src/a.ts#A.one"}
    for rows in (graph.members, graph.declared, graph.calls, graph.call_edges, graph.sources):
        assert "SENTINEL" not in str(rows.collect())


def test_commits_made_while_a_history_is_read_move_nothing(spark, tmp_path):
    from evidentia.sources.repository import GitReader

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    for i in range(6):
        git("commit", "--allow-empty", "-qm", f"change {i}")
    reader = GitReader(str(tmp_path), "HEAD", 3)
    parts = reader.partitions()
    git("commit", "--allow-empty", "-qm", "later")
    assert [row[2] for p in parts for row in reader.read(p)] == [f"change {i}" for i in range(5, -1, -1)]


def test_unresolved_exports_are_told_apart(spark):
    from evidentia.operators.graph import export_closure, unresolved_exports

    rows = [
        ("out", "x", "pkg", "x"), ("back", "y", "forth", "y"), ("forth", "y", "back", "y"), ("gone", "z", "leaf", "z"), ("leaf", "other", None, None), ("all", "*", "leaf", "*"), ("via", "w", "all", "w"), ("via", "other", "all", "other"),
        ("default", "d", "all", "default"), ("both", "q", "pkg", "q"), ("both", "q", "forth", "y"), ("star-out", "*", "pkg", "*"), ("via-out", "v", "star-out", "v"), *[(f"m{i}", "n", f"m{i + 1}", "n") for i in range(40)], ("m40", "k", None, None),
    ]
    exports = spark.createDataFrame(rows, "module string, name string, source_module string, source_name string")
    got = {(r.module, r.name): r.reason for r in unresolved_exports(exports, export_closure(exports)).collect()}
    chain = {(f"m{i}", "n"): "re-export-depth-capped" if i < 9 else "missing-export" for i in range(40)}
    assert got == {
        ("out", "x"): "external-reexport", ("back", "y"): "re-export-cycle", ("forth", "y"): "re-export-cycle", ("gone", "z"): "missing-export", ("via", "w"): "missing-export", ("default", "d"): "missing-export",
        ("both", "q"): "external-reexport", ("via-out", "v"): "external-reexport", **chain,
    }
    assert unresolved_exports(exports.limit(0), export_closure(exports.limit(0))).count() == 0
