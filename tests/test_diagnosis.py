"""History diagnosis on a small line of versions, and the interval helpers against snapshots."""

import random
import time

from evidentia.operators import diagnosis as dg

INTERVALS = "valid_from long, valid_to long"


def test_merged_intervals_hold_at_the_same_versions(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(6), a, None if rng.random() < 0.1 else a + rng.randint(1, 5)) for a in (rng.randrange(30) for _ in range(80))]
    got = dg.merge_intervals(spark.createDataFrame([*rows, rows[0]], f"k int, {INTERVALS}"), ["k"]).collect()
    at = lambda found, k: {v for n, a, b in found if n == k for v in range(a, 60 if b is None else b)}
    for k in range(6):
        assert at(rows, k) == at([tuple(r) for r in got], k)
        own = sorted((r.valid_from, r.valid_to) for r in got if r.k == k)
        assert all(b is not None and b < c for (_, b), (c, _) in zip(own, own[1:]))


def test_changes_equal_neighbouring_snapshots(spark):
    rng, rows = random.Random(2), []
    for k in range(20):
        at = rng.randrange(3)
        while at < 12:
            end = at + rng.randint(1, 4)
            rows.append((k, rng.choice("ab"), at, end if end < 12 else None))
            at = end + rng.choice([0, 0, 2])
    got = {(r.version, r.k): (r.before and r.before.f, r.after and r.after.f) for r in dg.changes(spark.createDataFrame(rows, f"k int, f string, {INTERVALS}"), ["k"], "f").collect()}
    value = lambda k, v: next((f for n, f, a, b in rows if n == k and a <= v and (b is None or v < b)), None)
    want = {(v, k): (value(k, v - 1), value(k, v)) for v in range(1, 14) for k in range(20) if value(k, v - 1) != value(k, v)}
    assert got == want


def tables(spark, contexts, focus_flows=()):
    """Versions 0 (A, good) to 4 (E): payment.ts changes at 1 and 3 (with a call edge at 3), the readme at 2, checkout.ts and the manifest at 4."""
    make = spark.createDataFrame
    commits = make([(i, f"commit-{c}") for i, c in enumerate("ABCDE")], "version long, commit string")
    touched = make([(1, "src/payment.ts"), (2, "README.md"), (3, "src/payment.ts"), (3, "src/gone.ts"), (4, "src/checkout.ts"), (4, "package.json"), (4, "src/checkout.ts")], "version long, path string")
    files = make([("src/payment.ts", "p0", 0, 1), ("src/payment.ts", "p1", 1, 3), ("src/payment.ts", "p3", 3, None), ("src/checkout.ts", "c0", 0, 4), ("src/checkout.ts", "c4", 4, None), ("src/gone.ts", "g", 0, 3)], f"path string, hash string, {INTERVALS}")
    edges = make([("checkout", "payment", "calls", "src/checkout.ts", "src/payment.ts", 0, None), ("payment", "retry", "calls", "src/payment.ts", "src/retry.ts", 3, None), ("checkout", "x", "declares", "src/checkout.ts", "src/x.ts", 1, None)], f"src string, dst string, kind string, src_path string, dst_path string, {INTERVALS}")
    flows = make([("f", "1", "start", "r1", "t", 0, 2), ("f", "1", "start", "r2", "t", 2, 4), ("f", "2", "start", "r2", "t,u", 4, None)], f"flow string, fingerprint string, entry string, entry_record string, tests string, {INTERVALS}")
    focus = make([(c[0], p, near) for c in contexts for p, near in (("src/checkout.ts", True), ("src/payment.ts", False))], "context string, path string, in_focus boolean")
    return make(contexts, "context string, state string, good_version long, graph_version long, head_version long, dirty boolean"), commits, touched, files, edges, flows, focus, make(list(focus_flows), "context string, flow string")


def test_candidates_of_a_small_history(spark):
    candidates, summary = dg.rank_history(*tables(spark, [("q", "usable", 0, 4, 4, False)]))
    assert [(r.rank, r.commit, r.score, r.reasons, r.paths, r.retention) for r in candidates.orderBy("rank").collect()] == [
        (1, "commit-E", 10 + 100 + 60 + 35, ["changed-path-in-focus-context", "changed-path-in-dependency-cone", "focused-node-changed", dg.AFTER], ["src/checkout.ts"], "retained"),
        (2, "commit-D", 10 + 60 + 20 + 25, ["changed-path-in-dependency-cone", "dependency-cone-node-changed", "dependency-cone-edge-changed", dg.AFTER], ["src/gone.ts", "src/payment.ts"], "changed"),
        (3, "commit-B", 10 + 60 + 20, ["changed-path-in-dependency-cone", "dependency-cone-node-changed", dg.AFTER], ["src/payment.ts"], "changed"),
    ]
    assert [tuple(r) for r in summary.collect()] == [("q", "confirmed", 4, 3, False, ["commit commit-E contained non-TypeScript paths omitted from candidate evidence"])]


def test_flows_entries_and_tests_count(spark):
    candidates, _ = dg.rank_history(*tables(spark, [("q", "usable", 1, 4, 4, False)], [("q", "f"), ("q", "f")]))
    got = {r.commit: (r.score, r.reasons, r.paths) for r in candidates.collect()}
    # At 2 the entry's record changes, but no path of interest does, so the commit is no candidate.
    assert set(got) == {"commit-E", "commit-D"}
    assert got["commit-E"] == (10 + 100 + 60 + 75 + 25 + 35, ["changed-path-in-focus-context", "changed-path-in-dependency-cone", "focused-flow-changed", "related-test-structure-changed", "focused-node-changed", dg.AFTER], ["package.json", "src/checkout.ts"])


def test_gates_and_bounds(spark):
    contexts = [("bad", "corrupt", 0, 4, 4, False), ("dirty", "usable", 0, 4, 4, True), ("old", "usable", 0, 3, 4, False), ("same", "usable", 4, 4, 4, False), ("q", "usable", 0, 4, 4, False), ("two", "usable", 2, 4, 4, False)]
    candidates, summary = dg.rank_history(*tables(spark, contexts), max_commits=3, max_candidates=1, max_paths=1)
    got = {r.context: tuple(r)[1:] for r in summary.collect()}
    assert {c: got[c][:4] for c in ("bad", "dirty", "old", "same")} == {"bad": ("corrupt", 0, 0, False), "dirty": ("source-state-mismatch", 0, 0, False), "old": ("source-state-mismatch", 0, 0, False), "same": ("empty-range", 0, 0, False)}
    assert got["q"] == ("confirmed", 3, 2, True, ["commit commit-D paths capped at 1", "commit commit-E contained non-TypeScript paths omitted from candidate evidence", "history commits capped at 3", "historical candidates capped at 1"])
    assert got["two"][:4] == ("confirmed", 2, 2, True)
    assert {(r.context, r.commit, r.n_paths) for r in candidates.collect()} == {("q", "commit-E", 1), ("two", "commit-E", 1)}
    empty = [t.limit(0) for t in tables(spark, contexts)]
    assert [t.count() for t in dg.rank_history(*empty)] == [0, 0]


def test_edges_of_one_place_are_one_row(spark):
    """A cone that many contexts share must not pair them with its edges (F1, F2)."""
    edges = spark.range(3000).selectExpr("id % 2 + 1 as version", "concat('n', id) as src", "'hub' as dst", "'a.ts' as src_path", "'hub.ts' as dst_path")
    got = {(r.version, tuple(r.paths), r.n) for r in dg._path_sets(edges.union(edges)).collect()}
    assert got == {(1, ("a.ts", "hub.ts"), 1500), (2, ("a.ts", "hub.ts"), 1500)}


def test_edges_count_for_the_cone_unless_an_end_is_in_the_focus(spark):
    rng, paths = random.Random(3), [f"p{i}.ts" for i in range(6)]
    # A node may lie in several files, so one edge has up to four ends.
    edges = {(f"n{rng.randrange(5)}", f"n{rng.randrange(5)}", rng.choice(paths), rng.choice(paths), rng.randrange(1, 7)) for _ in range(24)}
    focus = {(f"q{q}", p, rng.random() < 0.4) for q in range(40) for p in rng.sample(paths, 3)}
    contexts = [(f"q{q}", "usable", 0, 8, 8, False) for q in range(40)]
    t = list(tables(spark, contexts))
    t[1] = spark.createDataFrame([(v, f"commit-{v}") for v in range(9)], "version long, commit string")
    t[2] = spark.createDataFrame([(v, "other.ts") for v in range(9)], "version long, path string")
    t[4] = spark.createDataFrame([(s, d, "calls", a, b, v, None) for s, d, a, b, v in edges], f"src string, dst string, kind string, src_path string, dst_path string, {INTERVALS}")
    t[4] = dg.merge_intervals(t[4], ["src", "dst", "kind", "src_path", "dst_path"])
    t[6] = spark.createDataFrame(list(focus), "context string, path string, in_focus boolean")
    got = {(r.context, r.version): r.reasons[:-1] for r in dg.rank_history(*t)[0].collect()}
    want, first = {}, {}
    for s, d, a, b, v in sorted(edges, key=lambda e: e[4]):
        first.setdefault((s, d, a, b), v)
    for q, *_ in contexts:
        near, far = ({p for c, p, n in focus if c == q and n is x} for x in (True, False))
        for v in range(1, 9):
            items = {}
            for (s, d, a, b), start in first.items():
                if start == v:
                    items.setdefault((s, d), set()).update((a, b))
            flags = [(any(i & near for i in items.values()), "focused-edge-changed"), (any(i & far and not i & near for i in items.values()), "dependency-cone-edge-changed")]
            if any(f for f, _ in flags):
                want[q, v] = [r for f, r in flags if f]
    assert got == want and any(len(r) == 2 for r in want.values())


def test_edges_meet_in_one_shuffle(spark):
    """Merging intervals, and the places of edges, took three shuffles of all edges (F1, F2)."""
    keys = ["src", "dst", "kind", "src_path", "dst_path"]
    rows = spark.range(300).selectExpr("concat('n', id % 7) as src", "concat('n', id % 3) as dst", "if(id % 2 = 0, 'calls', 'imports') as kind", "concat('p', id % 7) as src_path", "'hub' as dst_path", "id % 11 as valid_from", "id % 11 + 1 + id % 4 as valid_to")
    moved = lambda edges: dg._places(edges.select(dg.F.explode(dg.F.array("valid_from", "valid_to")).alias("version"), "src", "dst", "src_path", "dst_path"))
    met = moved(dg.merge_intervals(rows, keys, meet=["src", "dst"], parts=3))
    assert met._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert sorted(map(str, met.collect())) == sorted(map(str, moved(dg.merge_intervals(rows, keys)).collect()))


def test_blocks_of_contexts_see_what_a_join_sees(spark):
    """Pairs of a context's path and a version were shuffled, so the disk they took grew with the cones that share a path (F1, F2)."""
    rng = random.Random(4)
    at = spark.createDataFrame([(v, f"p{p}", rng.randrange(2), rng.randrange(3), v * p) for v in range(1, 30) for p in range(12) if rng.random() < 0.7], "version long, path string, touched long, file long, edges long")
    roles = [(f"q{q}", f"p{p}", rng.random() < 0.3, after, after + rng.randrange(6), q % 2 == 0) for q in range(25) for after in [rng.randrange(24)] for p in rng.sample(range(14), rng.choice([1, 4, 13]))]
    roles = spark.createDataFrame(roles, "context string, path string, in_focus boolean, after_version long, head_version long, by_flow boolean")
    columns = ["context", "path", "version", "in_focus", "by_flow", "touched", "file", "edges"]
    want = at.join(roles, "path").where("version > after_version and version <= head_version").select(*columns).collect()
    for each in (3, 200_000):
        hits = dg._hits(at, roles, 5, each)
        assert sorted(map(tuple, hits.select(*columns).collect())) == sorted(map(tuple, want)) and want
        # What is summed up by block, context and version is not shuffled again.
        found = hits.groupBy("block", "context", "version").agg(dg.F.sum("edges"))._jdf.queryExecution().executedPlan().toString()
        top = found[: found.index("shufflepartitionidpassthrough")]
        assert top.count("Exchange ") == 1
    blocks = dg._hits(at, roles, 5, 3).groupBy("context").agg(dg.F.countDistinct("block").alias("n")).collect()
    assert max(r.n for r in blocks) > 1


def test_shuffles_of_a_freed_cut_are_gone(spark):
    from evidentia.functions.lineage import FREE, cut

    files = lambda: sum("shuffle_" in spark._jvm.java.util.Objects.toString(f) for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    before, setting = files(), spark.conf.get(FREE)
    rows = cut(spark.range(1000).repartition(3, "id").groupBy((dg.F.col("id") % 7).alias("k")).count(), free=True)
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and spark.conf.get(FREE) == setting
    assert rows.count() == 7


def test_versions_that_no_question_asks_about_are_not_written(spark, monkeypatch):
    """Edges of all versions were written and joined, however few the questions look at (F2)."""
    seen = []
    monkeypatch.setattr(dg, "cut", lambda rows, free=False: seen.append(rows) or rows)
    t = tables(spark, [("q", "usable", 2, 4, 4, False), ("bad", "corrupt", 0, 4, 4, False)])
    edges = spark.createDataFrame([(f"n{v}", "payment", "calls", "src/checkout.ts", "src/payment.ts", v, None) for v in range(9)], t[4].schema)
    got = [r.commit for r in dg.rank_history(*t[:4], edges, *t[5:])[0].orderBy("rank").collect()]
    assert got == ["commit-E", "commit-D"]
    written = [sorted(r.version for r in rows.collect()) for rows in seen if rows.columns[:2] == ["version", "paths"]]
    assert written == [[3, 4]]
