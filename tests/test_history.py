from evidentia.operators.history import AFTER, first_parent_range, rank_commits


def test_rank(spark):
    changes = spark.createDataFrame(
        [("c0", 0, "a.ts"), ("c0", 0, "b.ts"), ("c1", 1, "b.ts"), ("c2", 2, "readme.md"), ("c3", 3, "a.test.ts"), ("c4", 4, "b.ts"), ("old", 5, "a.ts")], "sha string, position long, path string",
    )
    paths = spark.createDataFrame([("a.ts", "focus"), ("b.ts", "cone"), ("a.test.ts", "test")], "path string, role string")
    got = [(r.sha, r.score, r.reasons, r.total) for r in rank_commits(changes, paths, 5, limit=3).collect()]
    assert got == [
        ("c0", 10 + 100 + 60 + 35 + 2 * 20, ["changes-focus-path", "changes-dependency-cone", AFTER], 4), ("c1", 10 + 60 + 20, ["changes-dependency-cone", AFTER], 4),
        ("c4", 90, ["changes-dependency-cone", AFTER], 4),
    ]


def test_range(spark):
    commits = spark.createDataFrame([(f"c{i}", i) for i in range(5)], "sha string, position long")
    assert tuple(first_parent_range(commits, "c1", "c4").first()) == ("in-lineage", 3)
    assert first_parent_range(commits, "c4", "c1").first().status == "out-of-lineage"
    assert first_parent_range(commits, "c0", "zz").first().status == "out-of-lineage"
    assert first_parent_range(commits, "c0", "c4", limit=2).first().status == "truncated"
