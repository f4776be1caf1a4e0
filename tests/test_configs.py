"""Chains of settings and package manifests of many repositories, on odd files."""

import json

import pytest

from evidentia.operators import configs, entries

FILES = "root string, path string, raw string"


def config(extends=None, base=None, paths=None):
    options = {k: v for k, v in (("baseUrl", base), ("paths", paths)) if v is not None}
    return json.dumps({k: v for k, v in (("extends", extends), ("compilerOptions", options)) if v is not None})


ROOTS = {
    "none": ({"readme.json": "{"}, "complete", None, 0),
    "plain": ({"tsconfig.json": '﻿{ // a\n "compilerOptions": { /* "x" */ "baseUrl": "./src", "paths": {"@a/*": ["a//b/*", "../c/*",], "u": ["http"] }, }, }'}, "complete", None, 1),
    "chain": ({"tsconfig.json": config("./base", paths={"@local/*": ["src/*"]}), "base.json": config("./deep/top.json", base="lib"), "deep/top.json": config(base="x", paths={"@old": ["y"]})}, "complete", None, 3),
    "kept": ({"tsconfig.json": config("./deep/top", base="lib"), "deep/top.json": config(paths={"@old": ["y"]})}, "complete", None, 2),
    "cycle": ({"tsconfig.json": config("./base"), "base.json": config("./tsconfig")}, "unavailable", "tsconfig-extends-cycle:tsconfig.json", 2),
    "escape": ({"tsconfig.json": config("../outside")}, "unavailable", "tsconfig-extends-escapes-repository", 1),
    "package": ({"tsconfig.json": config("shared")}, "unavailable", "tsconfig-package-extends-unsupported", 1),
    "gone": ({"tsconfig.json": config("./gone")}, "unavailable", "tsconfig-read-failed:gone.json", 1),
    "broken": ({"tsconfig.json": "{ not json"}, "unavailable", "tsconfig-invalid-jsonc:tsconfig.json", 1),
    "null": ({"tsconfig.json": None}, "unavailable", "tsconfig-invalid-jsonc:tsconfig.json", 1),
    "empty": ({"tsconfig.json": ""}, "unavailable", "tsconfig-invalid-jsonc:tsconfig.json", 1),
    "list": ({"tsconfig.json": "[]"}, "unavailable", "tsconfig-invalid-jsonc:tsconfig.json", 1),
    "number": ({"tsconfig.json": '{"compilerOptions": {"paths": {"a": ["b", 1]}}}'}, "unavailable", "tsconfig-invalid-jsonc:tsconfig.json", 1),
    "nulls": ({"tsconfig.json": '{"extends": null, "compilerOptions": {"baseUrl": null, "paths": null}}'}, "complete", None, 1),
    "stars": ({"tsconfig.json": config(paths={"a": ["b"], "b*/*": ["c"]})}, "unavailable", "tsconfig-path-pattern-unsupported:b*/*", 1),
    "hollow": ({"tsconfig.json": config(paths={"a": []})}, "unavailable", "tsconfig-path-targets-empty:a", 1),
    "root": ({"tsconfig.json": config(base="/usr")}, "unavailable", "tsconfig-path-absolute-or-machine-path", 1),
    "above": ({"tsconfig.json": config(paths={"a": ["../b"]})}, "unavailable", "tsconfig-path-escapes-repository", 1),
    "parent first": ({"tsconfig.json": config("./p", base="/usr"), "p.json": config(paths={"a": []})}, "unavailable", "tsconfig-path-targets-empty:a", 2),
    "sixteen": ({"tsconfig.json": config("./1"), **{f"{i}.json": config(f"./{i + 1}" if i < 15 else None) for i in range(1, 16)}}, "complete", None, 16),
    "seventeen": ({"tsconfig.json": config("./1"), **{f"{i}.json": config(f"./{i + 1}" if i < 16 else None) for i in range(1, 17)}}, "truncated", "tsconfig-files-capped-at-16", 16),
    "large": ({"tsconfig.json": config("./1"), "1.json": config() + " " * 1024 * 1024}, "truncated", "tsconfig-bytes-capped-at-1048576", 2),
    "many": ({"tsconfig.json": config(paths={f"p{i}": ["x"] for i in range(1001)})}, "truncated", "tsconfig-path-mappings-capped-at-1000", 1),
    "wide": ({"tsconfig.json": config(paths={"p": ["x"] * 10_001})}, "truncated", "tsconfig-path-targets-capped-at-10000", 1),
    "quote": ({"tsconfig.json": '{"compilerOptions": {"paths": {"a//\\"b": ["c/*,}"]}}}'}, "complete", None, 1),
}


@pytest.fixture(scope="module")
def effective(spark):
    rows = [(root, path, raw) for root, (files, *_) in ROOTS.items() for path, raw in files.items()]
    return configs.effective_settings(spark.createDataFrame([*rows, (None, "tsconfig.json", "{}"), ("none", None, "{}")], FILES))


def test_chains(effective):
    settings = {r.root: r for r in effective[0].collect()}
    assert {k: (r.status, r.reason, r.n_files) for k, r in settings.items()} == {k: v[1:] for k, v in ROOTS.items()}
    assert (settings["chain"].base_url, settings["chain"].base_origin, settings["chain"].files) == ("lib", "base.json", "base.json,deep/top.json,tsconfig.json")
    assert settings["cycle"].base_url is None and settings["plain"].base_url == "src" and settings["kept"].base_url == "lib"
    assert settings["nulls"].effective_fingerprint == settings["none"].effective_fingerprint != settings["plain"].effective_fingerprint
    assert settings["nulls"].exact_fingerprint != settings["none"].exact_fingerprint


@pytest.mark.parametrize("row_files", [0, 3])
def test_chains_in_rows_are_those_by_levels(spark, row_files):
    rows = [(root, path, raw) for root, (files, *_) in ROOTS.items() for path, raw in files.items()]
    settings = configs.read_settings(spark.createDataFrame(rows, FILES))
    one, other = configs.extends_chains(settings), configs.extends_chains(settings, row_files=row_files)
    assert [sorted(map(str, t.collect())) for t in one] == [sorted(map(str, t.collect())) for t in other]


def test_mappings(effective):
    got = {}
    for r in effective[1].orderBy("root", "pattern", "target_order").collect():
        got.setdefault(r.root, []).append((r.pattern, r.target, r.origin))
    assert got == {
        "plain": [("@a/*", "src/a/b/*", "tsconfig.json"), ("@a/*", "c/*", "tsconfig.json"), ("u", "src/http", "tsconfig.json")],
        "chain": [("@local/*", "lib/src/*", "tsconfig.json")],
        "kept": [("@old", "deep/y", "deep/top.json")],
        "quote": [('a//"b', "c/*,}", "tsconfig.json")],
    }


def test_chains_without_bounds(spark):
    """Chains of any length, files of any size and any number of patterns: nothing is capped, in rows and by doubling."""
    files = {"tsconfig.json": config("./1"), **{f"{i}.json": config(f"./{i + 1}" if i < 299 else None, paths={"@far": ["x"]} if i == 299 else None) for i in range(1, 300)}}
    roots = {root: files for root, (files, *_) in ROOTS.items()} | {"far": files, "turns": files | {"299.json": config("./7")}, "breaks": files | {"299.json": config("./300")}, "faulty": files | {"299.json": "{"}}
    frame = spark.createDataFrame([(root, path, raw) for root, files in roots.items() for path, raw in files.items()], FILES)
    settings = configs.read_settings(frame, None)
    one, *others = [configs.extends_chains(settings, None, None, row_files) for row_files in (1000, 256, 0)]
    for other in others:
        assert [sorted(map(str, t.collect())) for t in one] == [sorted(map(str, t.collect())) for t in other]
    settings, mappings = configs.effective_settings(frame, None, None, None, None)
    got = {r.root: (r.status, r.reason, r.n_files) for r in settings.collect()}
    want = {k: v[1:] for k, v in ROOTS.items()} | {"seventeen": ("complete", None, 17), "large": ("complete", None, 2), "many": ("complete", None, 1), "wide": ("complete", None, 1), "far": ("complete", None, 300)}
    want |= {"turns": ("unavailable", "tsconfig-extends-cycle:7.json", 300), "breaks": ("unavailable", "tsconfig-read-failed:300.json", 300), "faulty": ("unavailable", "tsconfig-invalid-jsonc:299.json", 300)}
    assert got == want
    counts = {r.root: r["count"] for r in mappings.groupBy("root").count().collect()}
    assert counts == {"plain": 3, "chain": 1, "kept": 1, "quote": 1, "many": 1001, "wide": 10_001, "far": 1}
    with pytest.raises(ValueError):
        configs.extends_chains(configs.read_settings(frame), None)


def test_mappings_of_long_chains_equal_the_sql(spark, tmp_path):
    """Repositories of 13, 40 and 300 files (and of more bytes than 1,500) have their mappings, in the query and in its SQL."""
    import duckdb

    from evidentia.plans import settings

    rows = [(c * 1000 + k, c) for c, n in ((54, 13), (55, 40), (52, 300), (53, 3), (24, 30), (28, 30)) for k in range(n)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = settings.settings_mappings(spark, str(tmp_path))
    with duckdb.connect() as db:
        db.sql(f"create view orders as from '{tmp_path}/orders.parquet/*.parquet'")
        want = db.sql(f"select {', '.join(got.columns)} from ({settings.ORACLES['settings_mappings']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and {52, 53, 54, 55} == {r[0] for r in want}
    assert "capped" not in settings.ORACLES["settings_mappings"]
    chains = settings.settings_chains(spark, str(tmp_path))  # this one reports its bounds
    assert {r.root for r in chains.where("status = 'truncated'").collect()} >= {52, 54, 55}


def test_specifiers_by_root(spark, effective):
    known = spark.createDataFrame([("plain", "src/a/b/x.ts"), ("plain", "c/y/index.ts"), ("plain", "src/q.ts"), ("chain", "lib/src/x.ts"), ("chain", "c/y.ts"), ("none", "q.ts")], "root string, path string")
    asked = [("plain", "@a/x"), ("plain", "@a/y"), ("plain", "@a/z"), ("plain", "q"), ("plain", "react"), ("chain", "@local/x"), ("chain", "@a/x"), ("none", "q"), ("cycle", "q"), ("many", "q"), ("unknown", "q"), ("plain", None), (None, "q"), ("plain", "q")]
    got = configs.resolve_specifiers(spark.createDataFrame(asked, "root string, specifier string"), effective[0], effective[1], known).collect()
    assert {(r.root, r.specifier): (r.target, r.status, r.reason) for r in got} == {
        ("plain", "@a/x"): ("src/a/b/x.ts", "local", None), ("plain", "@a/y"): ("c/y/index.ts", "local", None), ("plain", "@a/z"): (None, "unresolved", "missing-tsconfig-path-target"),
        ("plain", "q"): ("src/q.ts", "local", None), ("plain", "react"): (None, "external", None), ("chain", "@local/x"): ("lib/src/x.ts", "local", None), ("chain", "@a/x"): (None, "external", None),
        ("none", "q"): (None, "external", None), ("cycle", "q"): (None, "unresolved", "tsconfig-resolution-unavailable"), ("many", "q"): (None, "unresolved", "tsconfig-resolution-truncated"), ("unknown", "q"): (None, "external", None),
    } and len(got) == 11


def test_package_entries(spark):
    texts = {
        "a": json.dumps({"scripts": {"x": "tsx src/a", "y": "tsc && node z", "z": 1, "w": "bun run ./b.ts"}, "bin": "./c", "main": "dist/a.js", "module": 3}),
        "b": json.dumps({"bin": {"one": "src/a.ts", "two": None}, "scripts": []}), "c": "[]", "d": "{", "e": None, "f": '{"bin": 1}', "g": "{}" + " " * 300, "h": "{}",
    }
    judged, found = configs.package_entries(spark.createDataFrame([*texts.items(), (None, "{}")], "root string, raw string"), 200)
    assert {r.root: (r.status, r.reason) for r in judged.collect()} == {
        **dict.fromkeys("abfh", ("complete", None)), "c": ("unavailable", "package-json-not-object"), "d": ("unavailable", "package-json-invalid"), "e": ("unavailable", "package-json-invalid"), "g": ("truncated", "package.json exceeds 200 bytes"),
    }
    assert {(r.root, r.kind, r.key): (r.runner, r.target, r.reason) for r in found.collect()} == {
        ("a", "script", "x"): ("tsx", "src/a", None), ("a", "script", "y"): (None, None, "script-command-complex-or-shell-composed"), ("a", "script", "z"): (None, None, "script-command-not-literal"), ("a", "script", "w"): ("bun run", "./b.ts", None),
        ("a", "bin", "bin"): (None, "./c", None), ("a", "main", "main"): (None, "dist/a.js", None), ("a", "module", "module"): (None, None, "entry-target-not-string"),
        ("b", "bin", "one"): (None, "src/a.ts", None), ("b", "bin", "two"): (None, None, "bin-target-not-string"), ("f", "bin", "bin"): (None, None, "bin-not-string-or-object"),
    }
    assert "parse_json" not in found._jdf.queryExecution().optimizedPlan().toString()  # read several times, parsed once
    files = spark.createDataFrame([("a", "src/a.ts"), ("b", "c.ts"), ("a", "b.ts")], "root string, path string")
    placed = entries.resolve_targets(found.where("reason is null").drop("reason"), files, by=("root",))
    assert {(r.root, r.key, r.path) for r in placed.collect()} == {("a", "x", "src/a.ts"), ("a", "w", "b.ts"), ("a", "bin", None), ("a", "main", None), ("b", "one", None)}


def test_empty_tables(spark):
    settings, mappings = configs.effective_settings(spark.createDataFrame([], FILES))
    assert settings.count() == mappings.count() == 0
    assert [t.count() for t in configs.package_entries(spark.createDataFrame([], "root string, raw string"))] == [0, 0]
