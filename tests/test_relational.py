"""Queries against DuckDB on the small tables, and operators on hand-made rows."""

import glob
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidentia.functions import paths
from evidentia.operators import delta, graph, ranking, resolution, sequences
from evidentia.plans import registry

SF = "/root/testdata/sf0.001"


def plain(frame):
    def value(x):
        if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
            return None
        return int(x) if isinstance(x, float) and x == int(x) else x

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(value, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, duck, name):
    assert plain(registry.QUERIES[name](spark, SF).toPandas()) == plain(duck.sql(registry.ORACLES[name]).df())


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def test_delta_is_null_safe(spark):
    before = spark.createDataFrame([(1, None), (2, "a"), (None, "n")], "k int, v string")
    after = spark.createDataFrame([(1, None), (2, "b"), (3, "c"), (None, "n")], "k int, v string")
    found = delta.snapshot_delta(before, after, ["k"], ["v"])
    assert rows(found, "k", "change") == [(2, "changed"), (3, "added")]
    assert delta.delta_counts(found).first().asDict() == {"added_count": 1, "changed_count": 1, "removed_count": 0}


def test_chain_keeps_a_b_a(spark):
    log = spark.createDataFrame([(1, 7, 1, "A"), (2, 7, 2, "A"), (3, 7, 3, "B"), (4, 7, 4, "A")], "e int, k int, t int, v string")
    assert rows(sequences.collapse_chain(log, "k", ["t"], "v", "e"), "e", "predecessor") == [(1, None), (3, 1), (4, 3)]


def test_fold_is_the_same_however_the_log_is_cut(spark):
    machine = sequences.Machine("none", {("none", "P"): "pending", ("pending", "C"): "active", ("active", "R"): "none"}, strict=True)
    log = [(k, t, "PCR"[t % 3]) for k in (1, 2) for t in range(300)] + [(3, 0, "C"), (4, 0, "P"), (4, 1, "P")]
    frame = spark.createDataFrame(log, "k int, t int, v string")
    want = [(1, "none"), (2, "none"), (3, "corrupt:C-in-none"), (4, "corrupt:P-in-pending")]
    for partitions in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        assert rows(sequences.fold(frame, "k", ["t"], "v", machine), "k", "state") == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_reach_ends_in_cycles_and_at_the_depth(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "node string")
    assert rows(graph.reach(edges, roots, 3), "node", "depth") == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]


def test_export_closure(spark):
    exports = spark.createDataFrame(
        [
            ("m", "x", None, None), ("m", "default", None, None), ("n", "x", None, None), ("barrel", "*", "m", "*"), ("both", "*", "m", "*"), ("both", "*", "n", "*"),
            ("wins", "*", "m", "*"), ("wins", "x", "n", "x"), ("c1", "q", "c2", "q"), ("c2", "q", "c1", "q"), ("lost", "z", "nowhere", "z"),
        ], "module string, name string, source_module string, source_name string",
    )
    got = {(r.module, r.name): (r.status, r.target_module) for r in graph.export_closure(exports).collect()}
    assert got["barrel", "x"] == ("resolved", "m") and ("barrel", "default") not in got
    assert got["both", "x"] == ("ambiguous", None) and got["wins", "x"] == ("resolved", "n")
    assert got["c1", "q"][0] == "cycle-or-depth" and got["lost", "z"][0] == "unresolved"


def test_paths(spark):
    frame = spark.createDataFrame([("src/a/b.ts", "../x"), ("src/b.ts", "./y/../z"), ("b.ts", "../out"), ("b.ts", "pkg")], "f string, s string")
    assert [r[0] for r in frame.select(paths.resolve_relative(F.col("f"), F.col("s"))).collect()] == ["src/x", "src/z", None, None]
    frame = spark.createDataFrame([("src/dist/a.ts",), ("dist.ts",), ("a/x.test.tsx",), ("tests/a.TS",)], "p string")
    assert [tuple(r) for r in frame.select(paths.is_excluded(F.col("p")), paths.is_test(F.col("p")), paths.language(F.col("p"))).collect()] == [
        (True, False, "typescript"), (False, False, "typescript"), (False, True, "tsx"), (False, True, "typescript"),
    ]


def test_resolution_status_and_lineage(spark):
    found = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), ("c", None)], "k string, t int")
    assert rows(resolution.candidate_status(found, ["k"], "t"), "k", "status", "target") == [("a", "resolved", 1), ("b", "ambiguous", None), ("c", "unresolved", None)]
    removed, added = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "i int, h string"), spark.createDataFrame([(4, "x"), (5, "y"), (6, "y")], "i int, h string")
    assert rows(resolution.exact_lineage(removed, added, "h", "i"), "i", "lineage", "successor") == [(1, "unique", 4), (2, "ambiguous", None)]


def test_scores_drop_rows_without_a_reason(spark):
    frame = spark.createDataFrame([(1, 5), (2, 50), (3, 500)], "i int, v int")
    scored = ranking.score(frame, {"big": (F.col("v") > 10, 100), "huge": (F.col("v") > 100, 60)}, 10)
    assert rows(ranking.top(scored, 5, "i"), "i", "score", "reasons") == [(2, 110, ["big"]), (3, 170, ["big", "huge"])]
