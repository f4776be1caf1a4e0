"""Configuration files of many repositories as tables: chains of compiler settings and package manifests, read as VARIANT.

They feed :mod:`evidentia.operators.aliases` and :mod:`evidentia.operators.entries`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.fingerprints import fingerprint
from evidentia.functions.lineage import cut
from evidentia.functions.paths import candidates, normalize
from evidentia.functions.validation import script
from evidentia.operators.aliases import resolve_aliases

# Names of files, bounds, and why a file or a chain is refused.
SETTINGS, PACKAGE = "tsconfig.json", "package.json"
MAX_FILES, MAX_BYTES, MAX_PATTERNS, MAX_TARGETS = 16, 1024 * 1024, 1_000, 10_000
CYCLE, NOT_READ, INVALID = "tsconfig-extends-cycle:", "tsconfig-read-failed:", "tsconfig-invalid-jsonc:"
FILES_CAPPED, BYTES_CAPPED = "tsconfig-files-capped-at-", "tsconfig-bytes-capped-at-"
PATTERNS_CAPPED, TARGETS_CAPPED = "tsconfig-path-mappings-capped-at-", "tsconfig-path-targets-capped-at-"
TWO_STARS, NO_TARGETS = "tsconfig-path-pattern-unsupported:", "tsconfig-path-targets-empty:"
FROM_PACKAGE, EXTENDS_ESCAPES = "tsconfig-package-extends-unsupported", "tsconfig-extends-escapes-repository"
ABSOLUTE, ESCAPES = "tsconfig-path-absolute-or-machine-path", "tsconfig-path-escapes-repository"

_STRING = r'("(?:[^"\\]++|\\.)*+")'


def strip_comments(text: Column) -> Column:
    """JSON out of JSON with comments: what stands outside of strings loses line and block comments, and commas before a closing bracket."""
    plain = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), rf"(?s){_STRING}|//[^\n\r]*+|/\*.*?\*/", "$1 ")
    return F.regexp_replace(plain, rf"(?s){_STRING}|,(?=\s*+[\]}}])", "$1")


def _type(value: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(value, path, "variant")), F.lit("VOID"))


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _place(base: Column, value: Column) -> Column:
    """Struct (path, reason): ``value`` read from the folder ``base``; one of the two is null."""
    absolute = value.startswith("/") | value.contains("\\") | value.contains(":")
    inside = normalize(F.concat(F.when(base == "", "").otherwise(F.concat(base, F.lit("/"))), value))
    return F.struct(F.when(~absolute, inside).alias("path"), F.when(absolute, ABSOLUTE).when(inside.isNull(), ESCAPES).alias("reason"))


def read_settings(files: DataFrame, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """root, path, bytes, hash, valid, extends, base, paths (pattern to targets) of ``files`` (root, path, raw; one row a path).

    A file is valid if it is an object whose fields have their types; null stands for a field that is not there, but not for
    compilerOptions. Repeated keys, text that is not JSON and null are not valid. No file beyond ``max_bytes`` (None: no bound) is parsed.
    """
    small = F.col("raw") if max_bytes is None else F.when(F.octet_length("raw") <= max_bytes, F.col("raw"))
    rows = files.where("root is not null and path is not null").select("root", "path", F.coalesce(F.octet_length("raw"), F.lit(0)).cast("long").alias("bytes"), F.sha2(F.coalesce("raw", F.lit("")).cast("binary"), 256).alias("hash"), F.try_parse_json(strip_comments(small)).alias("v"))
    options = F.schema_of_variant(F.try_variant_get("v", "$.compilerOptions", "variant"))
    patterns = F.try_variant_get("v", "$.compilerOptions.paths", "map<string,variant>")
    targets = F.try_variant_get("v", "$.compilerOptions.paths", "map<string,array<string>>")
    texts = F.coalesce(F.forall(F.map_values(patterns), lambda t: F.schema_of_variant(t).isin("ARRAY<STRING>", "ARRAY<VOID>")) & F.forall(F.map_values(targets), lambda t: F.forall(t, lambda x: x.isNotNull())), F.lit(True))
    valid = (
        F.schema_of_variant("v").startswith("OBJECT") & F.coalesce(options.startswith("OBJECT"), F.lit(True)) & _type(F.col("v"), "$.extends").isin("STRING", "VOID")
        & _type(F.col("v"), "$.compilerOptions.baseUrl").isin("STRING", "VOID") & (_type(F.col("v"), "$.compilerOptions.paths").startswith("OBJECT") | (_type(F.col("v"), "$.compilerOptions.paths") == "VOID")) & texts
    )
    text = lambda p: F.try_variant_get("v", p, "string")
    return rows.select("root", "path", "bytes", "hash", F.coalesce(valid, F.lit(False)).alias("valid"), text("$.extends").alias("extends"), text("$.compilerOptions.baseUrl").alias("base"), targets.alias("paths"))


def _parents(settings: DataFrame) -> DataFrame:
    """Adds parent (null for none) and refused (why ``extends`` names no file) to ``settings``."""
    at = _place(_folder(F.col("path")), F.col("extends"))
    rows = settings.withColumn("_at", F.when(F.col("valid") & F.col("extends").isNotNull(), at))
    named = F.when(F.col("_at.path").rlike(r"[^/]\.[^./]*$"), F.col("_at.path")).otherwise(F.concat("_at.path", F.lit(".json")))
    refused = F.when(F.col("_at").isNull(), None).when(~F.col("extends").startswith("."), FROM_PACKAGE).when((F.col("_at.reason") == ESCAPES) | (F.col("_at.path") == ""), EXTENDS_ESCAPES).otherwise(F.col("_at.reason"))
    return rows.select("*", refused.alias("refused"), F.when(refused.isNull(), named).alias("parent")).drop("_at")


def _end_of_walk(at: Column, seen: Column, position: Column, file: Column, total: Column, max_files: int | None, max_bytes: int | None) -> Column:
    """Why a chain ends at ``file`` (null where there is none) at the path ``at``; null where it goes on or ends well."""
    end = F.when(F.array_contains(seen, at), F.concat(F.lit(CYCLE), at))
    end = end if max_files is None else end.when(position >= max_files, f"{FILES_CAPPED}{max_files}")
    end = end.when(file["valid"].isNull(), F.concat(F.lit(NOT_READ), at))
    end = end if max_bytes is None else end.when(total > max_bytes, f"{BYTES_CAPPED}{max_bytes}")
    return end.when(~file["valid"], F.concat(F.lit(INVALID), at)).otherwise(file["refused"])


def _walk_in_rows(files: DataFrame, max_files: int | None, max_bytes: int | None) -> DataFrame:
    """(root, visits: position, at, reason, held; in order) of roots with few files, each walked inside one row."""
    rows = files.groupBy("root").agg(F.collect_list(F.struct("at", "bytes", "valid", "refused", "parent")).alias("files")).where(F.exists("files", lambda f: f["at"] == SETTINGS))
    start = F.expr("struct(cast(array() as array<struct<position:int,at:string,reason:string,held:boolean>>) as visits, cast(array() as array<string>) as seen, cast(0 as bigint) as total, cast('" + SETTINGS + "' as string) as at)")

    def visit(acc: Column, _: Column) -> Column:
        def step(file: Column) -> Column:
            total, position = acc["total"] + F.coalesce(file["bytes"], F.lit(0)), F.size(acc["seen"])
            reason = _end_of_walk(acc["at"], acc["seen"], position, file, total, max_files, max_bytes)
            held = (F.lit(True) if max_files is None else position < max_files) & file["valid"].isNotNull() & ~F.array_contains(acc["seen"], acc["at"])
            return F.transform(F.array(reason), lambda r: F.struct(
                F.concat(acc["visits"], F.array(F.struct(position.alias("position"), acc["at"].alias("at"), r.alias("reason"), held.alias("held")))).alias("visits"),
                F.concat(acc["seen"], F.array(acc["at"])).alias("seen"), total.alias("total"), F.when(r.isNull(), file["parent"]).alias("at"),
            ))[0]

        # Lists of one element give a value a name, so that a file is looked up once a step.
        return F.when(acc["at"].isNull(), acc).otherwise(F.transform(F.array(F.get(F.filter("files", lambda f: f["at"] == acc["at"]), F.lit(0))), step)[0])

    steps = F.size("files") if max_files is None else F.lit(max_files)  # a chain holds each file once, and may end after them
    return rows.select("root", F.aggregate(F.sequence(F.lit(0), steps), start, visit)["visits"].alias("visits"))


def _walk_by_levels(files: DataFrame, max_files: int, max_bytes: int) -> DataFrame:
    """(root, position, at, reason, held) of all roots of ``files`` by a join of their ends a level."""
    level = files.where(F.col("at") == SETTINGS).select("root", F.lit(0).alias("position"), "at", F.array().cast("array<string>").alias("seen"), F.lit(0).cast("long").alias("total"))
    visits = None
    for _ in range(max_files + 1):
        total = F.col("total") + F.coalesce("bytes", F.lit(0))
        reason = _end_of_walk(F.col("at"), F.col("seen"), F.col("position"), F.struct("valid", "refused"), total, max_files, max_bytes)
        visit = level.join(files, ["root", "at"], "left").select("root", "position", "at", "seen", total.alias("total"), reason.alias("reason"), "parent", F.col("valid").isNotNull().alias("there"))
        visit = cut(visit)
        visits = visit if visits is None else visits.unionByName(visit)
        level = visit.where("reason is null and parent is not null").select("root", (F.col("position") + 1).alias("position"), F.col("parent").alias("at"), F.concat("seen", F.array("at")).alias("seen"), "total")
        if level.isEmpty():
            break
    held = (F.col("position") < max_files) & F.col("there") & ~F.array_contains("seen", F.col("at"))
    return visits.select("root", "position", "at", "reason", held.alias("held"))


def _walk_by_doubling(files: DataFrame) -> DataFrame:
    """(root, position, at, reason, held) of all roots of ``files`` without bounds; a chain of n visits takes log n joins.

    Until it ends, a walk is at another path at each step, so it is whole when twice as many steps find no new path.
    """
    start = files.where(F.col("at") == SETTINGS).select("root", F.lit(0).cast("long").alias("position"), "at")
    goes_on = files.where(F.col("valid") & F.col("refused").isNull() & F.col("parent").isNotNull())
    jumps, visits, steps = goes_on.select("root", "at", F.col("parent").alias("to")), start, 1
    while True:
        more = visits.join(jumps, ["root", "at"]).select("root", (F.col("position") + steps).alias("position"), F.col("to").alias("at"))
        more = cut(more.join(visits.select("root", "at"), ["root", "at"], "left_anti").groupBy("root", "at").agg(F.min("position").alias("position")))
        if more.isEmpty():
            break
        visits = cut(visits.unionByName(more))
        further = jumps.select("root", F.col("at").alias("from"), F.col("to").alias("at")).join(jumps, ["root", "at"])
        jumps, steps = cut(further.select("root", F.col("from").alias("at"), "to")), steps * 2
    rows = visits.join(files, ["root", "at"], "left")
    # The reason counts at the last visit alone: a parent that it has is held already.
    wrong = F.when(F.col("valid").isNull(), F.concat(F.lit(NOT_READ), F.col("at"))).when(~F.col("valid"), F.concat(F.lit(INVALID), F.col("at"))).otherwise(F.col("refused"))
    reason = F.coalesce(wrong, F.concat(F.lit(CYCLE), F.col("parent")))
    return rows.select("root", F.col("position").cast("int").alias("position"), "at", reason.alias("reason"), F.col("valid").isNotNull().alias("held"))


def extends_chains(settings: DataFrame, max_files: int | None = MAX_FILES, max_bytes: int | None = MAX_BYTES, row_files: int = 256) -> tuple[DataFrame, DataFrame]:
    """(root, position, path), the root's own file at 0 and its parents after it, and (root, reason), null where a chain ends well.

    A root of no more than ``row_files`` files is walked inside one row; all other chains advance together, a join of their ends a
    level. There are no more steps than ``max_files`` plus one. That bound is the meaning of the operator; a recursive query would
    also be bounded in rows. A chain ends at the first of: a file that it holds already, one file too many, a file that is not
    there, too many bytes, a file that is not valid, a parent outside. None for both bounds: chains are followed to their ends,
    those of roots of more files by doubling.
    """
    if (max_files is None) != (max_bytes is None):
        raise ValueError("either both bounds or none")
    files = cut(_parents(settings).select("root", F.col("path").alias("at"), "bytes", "valid", "refused", "parent"))
    large = cut(files.groupBy("root").count().where(F.col("count") > row_files).select("root"))
    walked = cut(_walk_in_rows(files.join(large, "root", "left_anti"), max_files, max_bytes))
    visits = walked.select("root", F.inline("visits"))
    ends = walked.select("root", F.element_at("visits", -1)["reason"].alias("reason"))
    if not large.isEmpty():
        own = files.join(large, "root", "left_semi")
        rest = _walk_by_doubling(cut(own)) if max_files is None else _walk_by_levels(own, max_files, max_bytes)
        visits = visits.unionByName(rest)
        ends = ends.unionByName(rest.groupBy("root").agg(F.max_by("reason", "position").alias("reason")))
    return visits.where("held").select("root", "position", F.col("at").alias("path")), ends


def effective_settings(files: DataFrame, max_files: int | None = MAX_FILES, max_bytes: int | None = MAX_BYTES, max_patterns: int | None = MAX_PATTERNS, max_targets: int | None = MAX_TARGETS) -> tuple[DataFrame, DataFrame]:
    """Settings and path mappings of every root of ``files`` (root, path, raw; one row a path).

    Settings: root, status (complete, truncated where a bound was met, else unavailable), reason, n_files, files (paths, joined by
    commas), base_url, base_origin, exact_fingerprint (the files' bytes), effective_fingerprint (what they come to). Mappings: root,
    pattern, target_order, target, origin, of complete roots only. A root without ``tsconfig.json`` is complete and empty. Parents
    come first: a base is replaced by a child's, and all patterns by those of a child that has any; targets are read from the base
    that holds at that file, else from the file's folder. The parent's faults are reported before the child's, and in a file those
    of the base, of the number of patterns, then of the patterns in byte order. None stands for no bound; files and bytes have both
    one or none. The files of a root's chain meet in one row group.
    """
    settings = cut(read_settings(files, max_bytes))
    chain, ends = extends_chains(settings, max_files, max_bytes)
    rows = chain.join(settings, ["root", "path"]).withColumn("_b", F.when(F.col("base").isNotNull(), _place(_folder(F.col("path")), F.col("base"))))
    nearest = Window.partitionBy("root").orderBy(F.desc("position")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.when(F.col("_b.path").isNotNull(), F.struct(F.col("_b.path").alias("path"), F.col("path").alias("origin")))
    rows = rows.withColumn("holds", F.last(own, ignorenulls=True).over(nearest)).withColumn("from", F.coalesce("holds.path", _folder(F.col("path"))))
    pairs = F.transform(F.array_sort(F.map_keys("paths")), lambda k: F.struct(k.alias("pattern"), F.transform(F.element_at(F.col("paths"), k), lambda t: _place(F.col("from"), t)).alias("targets")))
    rows = cut(rows.withColumn("pairs", pairs))

    def judge(acc: Column, pair: Column) -> Column:
        n = acc["n"] + F.size(pair["targets"])
        stars = F.length(pair["pattern"]) - F.length(F.replace(pair["pattern"], F.lit("*"), F.lit("")))
        wrong = F.when(stars > 1, F.concat(F.lit(TWO_STARS), pair["pattern"])).when(F.size(pair["targets"]) == 0, F.concat(F.lit(NO_TARGETS), pair["pattern"]))
        wrong = wrong if max_targets is None else wrong.when(n > max_targets, f"{TARGETS_CAPPED}{max_targets}")
        place = F.get(F.filter(pair["targets"], lambda t: t["reason"].isNotNull()), F.lit(0))["reason"]
        return F.struct(n.alias("n"), F.coalesce(acc["reason"], wrong, place).alias("reason"))

    folded = F.aggregate("pairs", F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("reason")), judge)["reason"]
    many = F.lit(None) if max_patterns is None else F.when(F.size("pairs") > max_patterns, f"{PATTERNS_CAPPED}{max_patterns}")
    fault = F.coalesce(F.col("_b.reason"), many, folded)
    merged = rows.withColumn("fault", fault).groupBy("root").agg(
        F.count("*").cast("int").alias("n_files"), F.array_sort(F.collect_list(F.struct("path", F.col("bytes").cast("string").alias("bytes"), "hash"))).alias("held"), F.min_by("holds", "position").alias("holds"),
        F.max_by("fault", F.when(F.col("fault").isNotNull(), F.col("position"))).alias("fault"), F.min_by(F.struct("pairs", F.col("path").alias("origin")), F.when(F.col("pairs").isNotNull(), F.col("position"))).alias("wins"),
    )
    every = files.where("root is not null").select("root").distinct().join(ends, "root", "left").join(merged, "root", "left")
    reason = F.coalesce("reason", "fault")
    sound = F.coalesce(reason.isNull(), F.lit(True))
    flat = F.flatten(F.transform("held", lambda f: F.array(f["path"], f["bytes"], f["hash"])))
    lines = F.flatten(F.transform("wins.pairs", lambda p: F.concat(F.array(p["pattern"]), F.transform(p["targets"], lambda t: t["path"]))))
    come_to = fingerprint("settings", "holds.path", "holds.origin", "wins.origin", F.array_join(lines, "\0"))
    out = every.select(
        "root", F.when(sound, "complete").when(reason.contains("capped"), "truncated").otherwise("unavailable").alias("status"), reason.alias("reason"), F.coalesce("n_files", F.lit(0)).alias("n_files"),
        F.coalesce(F.array_join(F.transform("held", lambda f: f["path"]), ","), F.lit("")).alias("files"), F.when(sound, F.col("holds.path")).alias("base_url"), F.when(sound, F.col("holds.origin")).alias("base_origin"),
        fingerprint("files", F.array_join(flat, "\0")).alias("exact_fingerprint"), F.when(sound, come_to).alias("effective_fingerprint"), F.when(sound, F.col("wins")).alias("wins"),
    )
    out = cut(out)
    mappings = out.select("root", F.col("wins.origin").alias("origin"), F.inline("wins.pairs")).select("root", "origin", "pattern", F.posexplode("targets").alias("target_order", "t"))
    return out.drop("wins"), mappings.select("root", "pattern", "target_order", F.col("t.path").alias("target"), "origin")


def resolve_specifiers(specifiers: DataFrame, settings: DataFrame, mappings: DataFrame, known: DataFrame) -> DataFrame:
    """root, specifier, target, status, reason of non-relative ``specifiers`` (root, specifier) by the effective settings of their roots.

    ``known`` has root, path. local: by the best pattern, or without one from the base; unresolved: a pattern's targets are not
    known, or the settings could not be read; else external. A root without settings counts as one that has none. Null roots and
    specifiers have no row.
    """
    inside = lambda name: F.concat("root", F.lit("\0"), name)
    wanted = specifiers.select("root", "specifier").where("root is not null and specifier is not null").distinct()
    rules = mappings.select(inside("pattern").alias("pattern"), "target_order", inside("target").alias("target"))
    found = resolve_aliases(wanted.select(inside("specifier").alias("specifier")), rules, known.select(inside("path").alias("path")))
    found = found.select(F.split("specifier", "\0")[0].alias("root"), F.split("specifier", "\0", 2)[1].alias("specifier"), "pattern", F.split("target", "\0", 2)[1].alias("mapped"))
    rows = wanted.withColumn("root", F.col("root").cast("string")).join(found, ["root", "specifier"]).join(settings.select(F.col("root").cast("string").alias("root"), F.col("status").alias("_s"), "base_url"), "root", "left")
    tried = rows.where("pattern is null and base_url is not null").select("root", "specifier", F.inline(candidates(_place(F.col("base_url"), F.col("specifier"))["path"])))
    based = tried.join(known.select(F.col("root").cast("string").alias("root"), "path").distinct(), ["root", "path"]).groupBy("root", "specifier").agg(F.min_by("path", "rank").alias("based"))
    refused = F.when(F.col("_s") == "truncated", "tsconfig-resolution-truncated").when(F.col("_s") == "unavailable", "tsconfig-resolution-unavailable")
    target = F.coalesce("mapped", "based")
    missing = F.when(F.col("pattern").isNotNull() & F.col("mapped").isNull(), "missing-tsconfig-path-target")
    rows = rows.join(based, ["root", "specifier"], "left").withColumn("reason", F.coalesce(refused, missing))
    status = F.when(F.col("reason").isNotNull(), "unresolved").when(target.isNotNull(), "local").otherwise("external")
    return rows.select("root", "specifier", F.when(F.col("reason").isNull(), target).alias("target"), status.alias("status"), "reason")


def package_entries(manifests: DataFrame, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """What ``manifests`` (root, raw: the text of ``package.json``; one row a root) name as entries.

    Manifests: root, status (complete; truncated beyond ``max_bytes``; else unavailable), reason, fingerprint. Entries: root, kind
    (script, bin, main, module), key, runner, target, reason (null where there is a target to resolve). Null text is not JSON.
    """
    small = F.octet_length("raw") <= max_bytes
    rows = manifests.where("root is not null").select("root", "raw", small.alias("small"), F.try_parse_json(F.when(small, F.col("raw"))).alias("v"))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    reason = F.when(~F.coalesce("small", F.lit(True)), f"package.json exceeds {max_bytes} bytes").when(F.col("v").isNull(), "package-json-invalid").when(~is_object, "package-json-not-object")
    judged = rows.select("root", F.when(reason.isNull(), "complete").when(F.col("small"), "unavailable").otherwise(F.when(F.col("raw").isNull(), "unavailable").otherwise("truncated")).alias("status"), reason.alias("reason"), F.sha2(F.coalesce("raw", F.lit("")).cast("binary"), 256).alias("fingerprint"))
    whole = rows.where(is_object)
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    record = lambda kind, key, command, target, why: F.struct(F.lit(kind).alias("kind"), key.alias("key"), command.alias("command"), target.alias("target"), why.alias("why"))
    nothing = F.lit(None).cast("string")

    def members(path: str, kind: str, why: str, command: bool) -> Column:
        each = lambda e: record(kind, e["key"], text(e["value"]) if command else nothing, nothing if command else text(e["value"]), F.when(text(e["value"]).isNull(), why))
        return F.coalesce(F.transform(F.map_entries(F.when(_type(F.col("v"), path).startswith("OBJECT"), F.try_variant_get("v", path, "map<string,variant>"))), each), F.array())

    def single(name: str, why: str) -> Column:
        value = F.try_variant_get("v", f"$.{name}", "variant")
        return F.when(value.isNotNull(), F.array(record(name, F.lit(name), nothing, text(value), F.when(text(value).isNull(), why))))

    whole_bin = F.when(~_type(F.col("v"), "$.bin").startswith("OBJECT"), single("bin", "bin-not-string-or-object"))
    parts = [members("$.scripts", "script", "script-command-not-literal", True), members("$.bin", "bin", "bin-target-not-string", False), whole_bin, single("main", "entry-target-not-string"), single("module", "entry-target-not-string")]
    found = whole.select("root", F.inline(F.flatten(F.array(*[F.coalesce(p, F.array()) for p in parts])))).withColumn("s", script(F.col("command")))
    why = F.coalesce("why", F.when(F.col("s.reason") != "", F.col("s.reason")))
    # Whoever looks for targets reads the entries several times; a manifest is parsed once.
    return judged, cut(found.select("root", "kind", "key", "s.runner", F.coalesce("s.target", "target").alias("target"), why.alias("reason")))
