import glob
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import manifests, packets
from evidentia.operators.sequences import Machine
from evidentia.sources import versions
from evidentia.streaming.lifecycle import follow
from evidentia.tables import tasks


def test_versions_and_replaced_partitions(spark, tmp_path):
    path = str(tmp_path / "nodes")
    versions.append_version(spark.range(3), path, 1)
    versions.append_version(spark.range(5), path, 2)
    assert versions.read_version(spark, path).count() == 5 and versions.read_version(spark, path, 1).count() == 3
    path = str(tmp_path / "candidates")
    rows = lambda *of: spark.createDataFrame(list(of), "context string, version int, commit string")
    versions.replace_partitions(rows(("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")), path, ["context", "version"])
    files = lambda: {f: os.path.getmtime(f) for f in glob.glob(f"{path}/*/*/*.parquet")}
    before = files()
    for _ in range(2):
        versions.replace_partitions(rows(("a", 2, "new"), ("a", 2, "newer")), path, ["context", "version"])
    kept = {f: t for f, t in before.items() if "context=a/version=2" not in f}
    assert len(kept) == 2 and kept.items() <= files().items()
    assert {(r.context, r.version, r.commit) for r in spark.read.parquet(path).collect()} == {("a", 1, "x"), ("a", 2, "new"), ("a", 2, "newer"), ("b", 1, "z")}


def test_upsert_keeps_the_newest(spark):
    stored = spark.createDataFrame([(1, 5, "old"), (2, 9, "stays"), (3, 4, "tie"), (None, 1, "null")], "k int, at int, v string")
    incoming = spark.createDataFrame([(1, 6, "new"), (2, 8, "late"), (3, 4, "incoming"), (4, 1, "added"), (4, 2, "twice"), (None, 2, "newer")], "k int, at int, v string")
    got = versions.upsert(stored, incoming, ["k"], ["at"])
    assert {tuple(r) for r in got.collect()} == {(1, 6, "new"), (2, 9, "stays"), (3, 4, "incoming"), (4, 2, "twice"), (None, 2, "newer")}
    assert {tuple(r) for r in versions.upsert(got, incoming, ["k"], ["at"]).collect()} == {tuple(r) for r in got.collect()}
    assert versions.upsert(stored.limit(0), incoming.limit(0), ["k"], ["at"]).count() == 0


@pytest.mark.parametrize("stretch", [65_536, 4])
def test_trimming_equals_popping_from_the_tails(spark, stretch):
    rng, items, envelopes, kept, sums = random.Random(7), [], [], set(), {}
    for packet in range(40):
        size = rng.choice([10, 60, 120])
        own = {s: [rng.randint(1, 12) for _ in range(rng.choice([0, 1, 5, 20]))] for s in packets.SECTIONS}
        envelopes.append((packet, size))
        items += [(packet, s, i, n) for s, sizes in own.items() for i, n in enumerate(sizes)]
        lost = {}
        while size + sum(map(sum, own.values())) > 100 and any(own.values()):
            section = next(s for s in packets.SECTIONS if own[s])
            own[section].pop()
            lost[section] = lost.get(section, 0) + 1
        kept |= {(packet, s, i, n) for s, sizes in own.items() for i, n in enumerate(sizes)}
        status = "envelope-too-large" if size > 100 else "trimmed" if lost else "complete"
        sums[packet] = (size + sum(map(sum, own.values())), sum(map(len, own.values())), sum(lost.values()), status != "complete", [f"{lost[s]} {s} omitted by packet bound" for s in packets.SECTIONS if s in lost], status)
    rows = spark.createDataFrame(items, "packet int, section string, position int, size int")
    got, summary = packets.trim(spark.createDataFrame(envelopes, "packet int, size int"), rows, 100, stretch=stretch)
    assert {tuple(r) for r in got.collect()} == kept and {r[0]: tuple(r)[1:] for r in summary.collect()} == sums
    spread = packets.trim(spark.createDataFrame(envelopes, "packet int, size int"), rows, 100, stretch=stretch, partitions=9)
    assert sorted(spread[0].collect()) == sorted(got.collect()) and sorted(spread[1].collect()) == sorted(summary.collect())
    assert [t.count() for t in packets.trim(spark.createDataFrame([], "packet int, size int"), rows.limit(0), 100)] == [0, 0]
    with pytest.raises(ValueError):
        packets.trim(summary, rows, 0)
    with pytest.raises(Exception, match="unknown section"):
        packets.trim(spark.createDataFrame(envelopes, "packet int, size int"), rows.withColumn("section", F.lit("other")), 100)[0].collect()


def test_manifests_are_refused_for_the_first_fault(spark):
    file = lambda path="src/a.ts", language="typescript", hash_="h", **more: {"path": path, "language": language, "bytes": 1, "hash": hash_, **more}
    given = {
        "good": json.dumps([file("b/c.tsx", "tsx"), file()]), "none": "[]", "large": json.dumps([file("x" * 300)]), "text": "not JSON", "object": json.dumps(file()), "cut": json.dumps([file()])[:-2],
        "missing": json.dumps([{"path": "a.ts"}]), "many": json.dumps([file(f"{i}") for i in range(4)]), "twice": json.dumps([file(), file()]), "hash": json.dumps([file(hash_="")]), "language": json.dumps([file(language="js")]), "null": None,
        **{f"path {p!r}": json.dumps([file(p)]) for p in ("/a.ts", "a//b.ts", "a/./b.ts", "../a.ts", "a/..", "a\\b.ts", "c:/a.ts", "", "a\0b")},
    }
    got = {r.key: (r.reason, r.n_files) for r in manifests.decode_manifests(spark.createDataFrame(list(given.items()), "key string, raw string"), max_bytes=280, max_files=3).collect()}
    want = {
        "good": (None, 2), "none": (None, 0), "large": (manifests.TOO_LARGE, None), "text": (manifests.MALFORMED, None), "cut": (manifests.MALFORMED, None), "object": (manifests.MALFORMED, None), "missing": (manifests.MALFORMED, None),
        "many": (manifests.TOO_MANY, None), "twice": (manifests.DUPLICATE, None), "hash": (manifests.NOT_NORMALIZED, None), "language": (manifests.NOT_NORMALIZED, None), "null": (manifests.MALFORMED, None),
    }
    assert {k: v for k, v in got.items() if k in want} == want and {v for k, v in got.items() if k.startswith("path")} == {(manifests.NOT_NORMALIZED, None)}
    files = manifests.decode_manifests(spark.createDataFrame([("k", given["good"])], "key string, raw string")).first().files
    assert [f.path for f in files] == ["b/c.tsx", "src/a.ts"]


def test_stream_states(spark, tmp_path):
    machine = Machine("none", {("none", "P"): "pending", ("pending", "C"): "active"})
    spark.createDataFrame([(1, 2, "C"), (1, 1, "P"), (2, 1, "C")], "k int, t int, e string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = follow(spark.readStream.schema("k int, t int, e string").parquet(str(tmp_path / "in")), "k", "t", "e", machine)
    query = stream.writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert {(r.k, r.state) for r in spark.table("states").collect()} == {(1, "active"), (2, "none")}


def test_tasks_grow_with_the_rows(spark):
    assert tasks(spark.range(40), spark.range(5), each=9) == 5 and tasks(spark.range(46), each=9) == 6 and tasks(spark.range(0)) == 4
