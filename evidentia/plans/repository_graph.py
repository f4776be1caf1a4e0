"""The evidence graph of a repository: nodes, edges with an explicit outcome for every reference, flows and related tests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.fingerprints import fingerprint
from evidentia.functions.lineage import cut
from evidentia.functions.paths import candidates, is_test, resolve_relative
from evidentia.operators import calls, facts
from evidentia.operators.graph import export_closure, reach
from evidentia.operators.resolution import first_match
from evidentia.operators.tokens import bracket_balance, source_hashes, tokenize
from evidentia.sources.repository import source_files


@dataclass(frozen=True)
class Graph:
    """``nodes``: id, kind, path, name, fingerprint. ``edges``: src, dst, kind. ``resolutions``: path, reference, form, status, reason, target, occurrence_count.

    At the level of callers: ``members``: id, kind, path, owner, name, visibility, fingerprint (the canonical hash; repeated
    heads under one id are summed up); ``declared``: id, kind, path, name, fingerprint, likewise; ``calls``: caller, reference,
    form, status, reason, target, occurrence_count, for every call; ``call_edges``: src, dst, kind (calls, constructs,
    declares-member), from callers to what they resolve to. ``sources``: path, n_tokens, canonical_fingerprint, recovered.
    """

    files: DataFrame
    nodes: DataFrame
    edges: DataFrame
    resolutions: DataFrame
    members: DataFrame
    declared: DataFrame
    calls: DataFrame
    call_edges: DataFrame
    sources: DataFrame


def file_id(path: str) -> Column:
    return F.concat(F.lit("file:"), F.col(path))


def symbol_id(path: str, name: str) -> Column:
    return F.concat(F.lit("symbol:"), F.col(path), F.lit("#"), F.col(name))


def resolve_imports(files: DataFrame, imported: DataFrame) -> DataFrame:
    """Adds target (a file's path) and routing (local, unresolved, external) to imports: relative specifiers by ranked candidates, others are packages."""
    wanted = imported.select("path", "specifier").distinct().withColumn("base", resolve_relative(F.col("path"), F.col("specifier")))
    known = files.select(F.col("path").alias("file"))
    matched = first_match(wanted, known, "base", candidates(F.col("base")), "file", "file").select("path", "specifier", "base", "target")
    routing = F.when(F.col("target").isNotNull(), "local").when(F.col("base").isNotNull() | F.col("specifier").rlike(r"^(\.|/|@/|~/|#)"), "unresolved").otherwise("external")
    return imported.join(matched.select("path", "specifier", "target", routing.alias("routing")), ["path", "specifier"])


def resolved_exports(files: DataFrame, imported: DataFrame, declared: DataFrame) -> DataFrame:
    """The closure of all exports of files (path, text); ``imported`` has targets, and a default export goes by the name of its declaration."""
    sources = imported.select(F.col("path").alias("module"), F.col("specifier").alias("source_module"), F.col("target").alias("_t")).distinct()
    exported = facts.exports(files).join(sources, ["module", "source_module"], "left")
    closure = export_closure(exported.select("module", "name", F.when(F.col("source_module").isNotNull(), F.coalesce("_t", F.col("source_module"))).alias("source_module"), "source_name"))
    default = declared.where("is_default").select(F.col("path").alias("target_module"), F.lit("default").alias("target_name"), F.col("name").alias("default_name"))
    return closure.join(default, ["target_module", "target_name"], "left").withColumn("target_name", F.coalesce("default_name", "target_name")).drop("default_name")


def resolved_calls(files: DataFrame) -> DataFrame:
    """Every call of sources (path, text) with its caller and outcome, see ``operators.calls.resolve_calls``."""
    tokens = cut(tokenize(files))
    imported = cut(resolve_imports(files, facts.imports(tokens)))
    declared = cut(facts.declarations(tokens))
    return calls.resolve_calls(calls.owned_calls(tokens), imported, resolved_exports(tokens, imported, declared), declared, calls.members(tokens))


def build(spark: SparkSession, root: str) -> Graph:
    """Scans a repository and derives its graph. File bodies end here: no table of the graph holds them."""
    with_text = cut(source_files(spark, root))
    files = with_text.drop("text")
    tokens = cut(tokenize(with_text))
    imported = cut(resolve_imports(files, facts.imports(tokens)))
    declared = cut(facts.declarations(tokens))
    called = facts.calls(tokens)
    closure = cut(resolved_exports(tokens, imported, declared))

    # What a local name of a file stands for: an import's resolved export, else a declaration of the same file.
    bound = imported.where("kind in ('default', 'named') and not type_only").join(
        closure.select(F.col("module").alias("target"), F.col("name").alias("imported_name"), "target_module", "target_name", F.col("status").alias("export_status")), ["target", "imported_name"], "left",
    )
    reason = F.when(F.col("routing") != "local", F.concat(F.lit("import-"), F.col("routing"))).when(F.col("export_status").isNull(), "missing-export").when(F.col("export_status") == "resolved", "import-binding").otherwise(F.col("export_status"))
    status = F.when(F.col("routing") == "external", "external").when(F.col("export_status") == "ambiguous", "ambiguous").when(F.col("export_status") == "resolved", "resolved").otherwise("unresolved")
    names = bound.select("path", F.col("local_name").alias("callee"), F.struct(F.lit(0).alias("rank"), status.alias("status"), reason.alias("reason"), F.when(status == "resolved", symbol_id("target_module", "target_name")).alias("target")).alias("t"))
    local = declared.where("kind in ('function', 'class', 'variable', 'enum')").select("path", F.col("name").alias("callee"), F.struct(F.lit(1).alias("rank"), F.lit("resolved").alias("status"), F.lit("same-module").alias("reason"), symbol_id("path", "name").alias("target")).alias("t"))
    outcomes = names.unionByName(local).groupBy("path", "callee").agg(F.min("t").alias("t"), F.count_distinct(F.when(F.col("t.rank") == 0, F.col("t"))).alias("imports"))
    plain = called.where("receiver is null").join(outcomes, ["path", "callee"], "left")
    resolutions = cut(
        plain.select(
            "path", F.col("callee").alias("reference"), F.when(F.col("constructs"), "constructor").otherwise("identifier").alias("form"),
            F.when(F.col("imports") > 1, "ambiguous").otherwise(F.coalesce("t.status", F.lit("unresolved"))).alias("status"),
            F.when(F.col("imports") > 1, "several-imports").otherwise(F.coalesce("t.reason", F.lit("unknown-name"))).alias("reason"), F.when(F.coalesce("imports", F.lit(0)) <= 1, F.col("t.target")).alias("target"), "occurrence_count",
        ).unionByName(called.where("receiver is not null").select("path", F.concat_ws(".", "receiver", "callee").alias("reference"), F.lit("member").alias("form"), F.lit("unresolved").alias("status"), F.lit("dynamic-receiver").alias("reason"), F.lit(None).cast("string").alias("target"), "occurrence_count"))
    )

    declares = declared.select(file_id("path").alias("src"), symbol_id("path", "name").alias("dst"), F.lit("declares").alias("kind"))
    kinds = {"local": "imports", "unresolved": "imports-unresolved", "external": "imports-external"}
    to = F.when(F.col("routing") == "local", F.concat(F.lit("file:"), F.col("target"))).otherwise(F.concat("routing", F.lit("-module:"), "specifier"))
    edge_kind = F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("routing"))
    imports = imported.select(file_id("path").alias("src"), to.alias("dst"), edge_kind.alias("kind"))
    call_edges = resolutions.where("status = 'resolved'").select(file_id("path").alias("src"), F.col("target").alias("dst"), F.when(F.col("form") == "constructor", "constructs").otherwise("calls").alias("kind"))
    inherits = facts.heritage(tokens).join(outcomes.select("path", F.col("callee").alias("reference"), "t"), ["path", "reference"]).where("t.status = 'resolved'").select(symbol_id("path", "owner").alias("src"), F.col("t.target").alias("dst"), F.col("relation").alias("kind"))
    edges = cut(declares.unionByName(imports).unionByName(call_edges).unionByName(inherits).distinct())
    modules = imported.where("routing <> 'local'").select(to.alias("id"), F.concat("routing", F.lit("-module")).alias("kind"), F.lit(None).cast("string").alias("path"), F.col("specifier").alias("name"), fingerprint("module", "specifier").alias("fingerprint")).distinct()
    file_nodes = files.select(file_id("path").alias("id"), F.lit("file").alias("kind"), "path", F.lit(None).cast("string").alias("name"), F.col("hash").alias("fingerprint"))
    symbols = declared.select(symbol_id("path", "name").alias("id"), "kind", "path", "name", fingerprint("symbol", "path", "name", "kind").alias("fingerprint"))
    nodes = cut(file_nodes.unionByName(symbols).unionByName(modules).dropDuplicates(["id"]))

    heads = lambda rows, *by: rows.groupBy("id", "path", *by).agg(F.min("kind").alias("kind"), fingerprint("heads", F.array_join(F.array_sort(F.collect_list("fingerprint")), ",")).alias("fingerprint"))
    member_id = F.concat(symbol_id("path", "owner"), F.lit("."), F.col("name"))
    members = heads(facts.member_rows(tokens).withColumn("id", member_id), "owner", "name", "visibility")
    own = heads(facts.declaration_rows(tokens).withColumn("id", symbol_id("path", "name")), "name")
    outcomes_of_calls = cut(calls.resolve_calls(calls.owned_calls(tokens), imported, closure, declared, calls.members(tokens)))
    reached = outcomes_of_calls.where("status = 'resolved'").select(F.col("caller").alias("src"), F.col("target").alias("dst"), F.when(F.col("form") == "constructor", "constructs").otherwise("calls").alias("kind"))
    members = cut(members)
    held = members.select(symbol_id("path", "owner").alias("src"), F.col("id").alias("dst"), F.lit("declares-member").alias("kind"))
    balance = bracket_balance(tokens).select("path", "recovered")
    return Graph(files, nodes, edges, resolutions, members, cut(own), outcomes_of_calls, reached.unionByName(held).distinct(), cut(source_hashes(tokens).join(balance, "path")))



def flow(graph: Graph, entry: DataFrame, max_depth: int = 64) -> DataFrame:
    """(node, depth) that calls and constructions reach from entry files (path); a called symbol continues in its own file."""
    follows = graph.edges.where("kind in ('calls', 'constructs')").select("src", "dst")
    inside = graph.edges.where("kind = 'declares'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(follows.unionByName(inside), entry.select(file_id("path").alias("node")), max_depth)


def related_tests(graph: Graph) -> DataFrame:
    """test_path, target, strength: strong where a test file calls a symbol of the target file, weak where it only imports it."""
    tests = graph.files.where(is_test(F.col("path"))).select(file_id("path").alias("src"), F.col("path").alias("test_path"))
    weak = graph.edges.where("kind = 'imports'").join(tests, "src").select("test_path", F.col("dst").alias("target"), F.lit(1).alias("rank"))
    strong = graph.edges.where("kind in ('calls', 'constructs')").join(tests, "src").select("test_path", F.concat(F.lit("file:"), F.regexp_extract("dst", r"^symbol:(.*)#", 1)).alias("target"), F.lit(0).alias("rank"))
    best = weak.unionByName(strong).where("target <> concat('file:', test_path)").groupBy("test_path", "target").agg(F.min("rank").alias("rank"))
    return best.select("test_path", "target", F.when(F.col("rank") == 0, "strong").otherwise("weak").alias("strength"))
