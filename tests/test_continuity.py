"""Ancestors of many commits against a plain walk, and continuity against sets."""

import random

from evidentia.operators import ancestry, continuity


def walk(commit, parents):
    line = []
    while commit is not None and commit in parents and commit not in line:
        line.append(commit)
        commit = parents[commit]
    return line, commit in line


def relation(a, b, parents):
    if a not in parents or b not in parents:
        return "unknown", None, None, None
    (up, ca), (down, cb) = walk(a, parents), walk(b, parents)
    if ca or cb:
        return "cyclic", None, None, None
    common = next((c for c in up if c in down), None)
    if common is None:
        return "unrelated", None, None, None
    ahead, behind = down.index(common), up.index(common)
    what = "same" if a == b else "adjacent" if (behind, ahead) == (0, 1) else "ancestor" if behind == 0 else "descendant" if ahead == 0 else "diverged"
    return what, common, ahead, behind


def test_relations_match_a_plain_walk(spark):
    rng = random.Random(5)
    parents = {f"c{i}": None if i % 60 == 0 else f"c{max(i - rng.choice([1, 1, 1, 1, 2, 5]), i // 60 * 60)}" for i in range(180)}
    parents |= {"x": "y", "y": "z", "z": "x", "w": "x", "s": "s", "cut": "elsewhere", "end": "cut"}
    names = [*parents, "nowhere", None]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(400)] + [("c1", "c1"), ("end", "cut"), ("cut", "end"), ("w", "x"), ("c5", "s")] * 2
    got = ancestry.relate(spark.createDataFrame(pairs, "a string, b string"), spark.createDataFrame([*parents.items()], "commit string, parent string")).collect()
    assert {(r.a, r.b): (r.relation, r.common, r.ahead, r.behind) for r in got} == {(a, b): relation(a, b, parents) for a, b in pairs} and len(got) == len(set(pairs))
    assert {r.relation for r in got} >= {"same", "adjacent", "ancestor", "descendant", "diverged", "unrelated", "cyclic", "unknown"}


def test_long_line_and_empty_tables(spark):
    line = spark.range(1000).selectExpr("cast(id as string) as commit", "case when id > 0 then cast(id - 1 as string) end as parent")
    depths, levels = ancestry.ancestor_index(line)
    assert len(levels) == 10 and depths.where("depth = cast(commit as long) and root = '0'").count() == 1000
    none = spark.createDataFrame([], "commit string, parent string")
    assert ancestry.relate(spark.createDataFrame([("a", "b")], "a string, b string"), none).first().relation == "unknown"
    assert ancestry.relate(none.selectExpr("commit as a", "parent as b"), line).count() == 0


def test_graph_relation(spark):
    rows = spark.createDataFrame([("a", "g"), ("a", "g"), ("b", "g"), ("b", "h"), ("c", None), ("d", None), ("d", "g")], "key string, graph_id string")
    assert {r.key: (r.n_events, r.relation[:4]) for r in ancestry.graph_relation(rows).collect()} == {"a": (2, "same"), "b": (2, "stru"), "c": (1, "same"), "d": (2, "same")}


COLUMNS = "question string, project string, origin_project string, repository string, dirty boolean, from_revision string, to_revision string, head_revision string, node string, current boolean"
COMMITS = [("r0", None), ("r1", "r0"), ("r2", "r1"), ("r3", "r1"), ("old", "r0"), ("fork", "r0"), ("bare", "r0"), ("next", "r0"), ("far", "r0"), ("unseen", "r0")]
SNAPSHOTS = [("r0", "p", "i", "k", False), ("r1", "p", "i", "k", False), ("r2", "p", "i", "k", True), ("r3", "p", "i", "k", False), ("old", "p", None, "k", False), ("fork", "p", "j", "k", False), ("bare", "p", "i", None, False), ("next", "p", "i", "k2", False), ("far", "q", "i", "k", False)]


def tables(spark, questions):
    make = spark.createDataFrame
    files = [("r0", "a", "1"), ("r0", "b", "2"), ("r0", "c", "3"), ("r1", "a", "1"), ("r1", "c", "4"), ("r1", "d", "2"), ("r1", "e", "2"), ("r2", "a", None)]
    nodes = [("r0", "n", "function", "f"), ("r0", "m", "function", "g"), ("r0", "o", "class", "f"), ("r1", "m", "function", "h"), ("r1", "o", "class", "f"), ("r1", "x", "function", "f"), ("r1", "y", "function", "f"), ("r1", "z", "class", "f"), ("r2", "m", "function", "h")]
    edges = [("r0", "n", "m", "calls"), ("r0", "n", "n", "calls"), ("r1", "m", "n", "calls"), ("r1", "m", "o", "calls"), ("r2", "m", "o", "calls"), ("r2", "m", "o", "calls")]
    flows = [("r0", "F", "n", "1"), ("r0", "F", "m", "1"), ("r1", "F", "m", "2"), ("r1", "G", "m", "1"), ("r2", "G", "m", "1")]
    return (
        make(questions, COLUMNS), make(COMMITS, "commit string, parent string"), make(SNAPSHOTS, "revision string, project string, repository string, contract string, truncated boolean"), make(files, "revision string, path string, hash string"),
        make(nodes, "revision string, node string, kind string, fingerprint string"), make(edges, "revision string, src string, dst string, kind string"), make(flows, "revision string, flow string, node string, fingerprint string"),
    )


def ask(name, since=None, until="r1", node="n", project="p", repository="i", dirty=False, current=True):
    return (name, "p", project, repository, dirty, since, until, "r2", node, current)


def test_gates_in_their_order(spark):
    questions = [
        ask("project", project="q", dirty=True), ask("dirty", dirty=True, until="r0"), ask("root", until="r0"), ask("unknown", until="zz"), ask("skip", "r0", "r2"), ask("side", "r2", "r3"), ask("far", until="far"), ask("unseen", until="unseen"),
        ask("nobody", until="old", repository=None), ask("old", until="old"), ask("fork", until="fork"), ask("bare", until="bare"), ask("next", until="next"), ask("stale", current=False), ask("good", "r0", "r1"), ask("head", until=None),
    ]
    got = {r.question: r for r in continuity.continuity(*tables(spark, questions))[0].collect()}
    assert {k: r.reason for k, r in got.items()} == {
        "project": continuity.WRONG_PROJECT, "dirty": continuity.DIRTY, "root": continuity.NO_PREDECESSOR, "unknown": continuity.NO_PREDECESSOR, "skip": continuity.NOT_ADJACENT, "side": continuity.NOT_ADJACENT, "far": continuity.OTHER_PROJECT, "unseen": continuity.NO_SNAPSHOT,
        "nobody": continuity.NO_IDENTITY, "old": continuity.LEGACY_IDENTITY, "fork": continuity.OTHER_IDENTITY, "bare": continuity.LEGACY_CONTRACT, "next": continuity.OTHER_CONTRACT, "stale": continuity.STALE, "good": continuity.COMPARED, "head": continuity.COMPARED,
    }
    assert got["project"].status == "wrong-project" and got["stale"].status == "stale" and got["good"].status == "available" and got["skip"].from_revision == "r0" and got["dirty"].to_revision is None
    assert (got["head"].from_revision, got["head"].to_revision, got["head"].truncated, got["head"].omissions) == ("r1", "r2", True, continuity.SNAPSHOT_CUT)


def test_changes_and_bounds(spark):
    questions = [ask("n"), ask("m", node="m"), ask("o", node="o"), ask("none", node=None), ask("x", node="x"), ask("again")]
    summary, listed = continuity.continuity(*tables(spark, questions), continuity.Limits(2, 1, 1, 1))
    got = {r.question: (r.node_status, r.fingerprint_relation, r.path_changes, r.path_lineages, r.node_changes, r.edge_changes, r.flow_changes, r.lineage_candidates) for r in summary.collect()}
    assert got == {
        "n": ("removed", "unavailable", 4, 2, 1, 3, 1, 2), "again": ("removed", "unavailable", 4, 2, 1, 3, 1, 2), "m": ("changed", "changed", 4, 2, 1, 3, 2, 0), "o": ("retained", "identical", 4, 2, 0, 1, 0, 0),
        "none": ("unavailable", "unavailable", 4, 2, 1, 0, 0, 0), "x": ("added", "unavailable", 4, 2, 1, 0, 0, 0),
    }
    assert {r.question: r.omissions for r in summary.collect()}["n"] == "historical edge changes capped at 1,historical path changes capped at 2,lineage candidates capped at 1"
    rows = {(r.question, r.category, r.position, r.key.replace("\0", " "), r.status) for r in listed.collect()}
    paths = [(1, "b", "removed"), (2, "c", "changed")]
    assert rows == {(q[0], "path", *p) for q in questions for p in paths} | {(q, "edge", 1, "n calls m", "removed") for q in "m"} | {(q, "edge", 1, "n calls m", "removed") for q in ("n", "again")} | {("o", "edge", 1, "m calls o", "added")} | {
        ("n", "flow", 1, "F", "removed"), ("again", "flow", 1, "F", "removed"), ("m", "flow", 1, "F", "changed"), ("n", "candidate", 1, "x", "candidate"), ("again", "candidate", 1, "x", "candidate"),
    }
    empty = [t.limit(0) for t in tables(spark, questions)]
    assert [t.count() for t in continuity.continuity(*empty)] == [0, 0]


def test_rows_that_no_question_asks_for_are_left_out_before_the_shuffle(spark):
    """none that is wanted is lost, and hardly any other stays."""
    rows = spark.range(20_000).selectExpr("concat('r', id % 40) as revision", "concat('n', id) as node")
    wanted = rows.where("crc32(node) % 50 = 0")
    kept = {tuple(r) for r in continuity.near(rows, wanted, ("revision", "node")).collect()}
    asked = {tuple(r) for r in wanted.collect()}
    assert asked <= kept and len(kept) < len(asked) + 20 and asked
    assert continuity.near(rows, wanted.limit(0), ("revision", "node")).isEmpty()


def test_pairs_are_not_written_at_every_level(spark, monkeypatch):
    """Four levels of joins a checkpoint, and only pairs that are still apart climb on (F6)."""
    written = []
    monkeypatch.setattr(ancestry, "cut", lambda rows: written.append(sorted(rows.columns)) or rows.localCheckpoint())
    parents = {f"c{i}": f"c{i - 1 - i % 2}" if i > 1 else None for i in range(40)}
    pairs = [("c1", "c39"), ("c39", "c38"), ("c7", "c7"), ("c30", "c5")]
    got = {(r.a, r.b): (r.relation, r.common, r.ahead, r.behind) for r in ancestry.relate(spark.createDataFrame(pairs, "a string, b string"), spark.createDataFrame([*parents.items()], "commit string, parent string")).collect()}
    assert got == {(a, b): relation(a, b, parents) for a, b in pairs}
    assert sum("x" in columns for columns in written) <= 3
