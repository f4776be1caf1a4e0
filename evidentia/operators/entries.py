"""Entries of a package manifest: which source file a target names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.paths import normalize

# What a target without an extension may stand for, and declaration files that are no sources.
SOURCES = ("", ".ts", ".tsx", "/index.ts", "/index.tsx")
DECLARATIONS = (".d.ts", "/index.d.ts")


def resolve_targets(entries: DataFrame, files: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds path and reason to ``entries`` (target): the first known file of ``files`` (path) that a target names, else why there is none.

    ``by`` names columns of both, such as a repository, within which files are looked for.
    """
    wanted = entries.select(*by, "target").distinct().withColumn("_n", normalize(F.regexp_replace("target", r"\\", "/")))
    extension = F.regexp_extract("_n", r"[^/]\.([^./]*)$", 1)
    invalid = F.when(F.coalesce((F.col("target") == "") | F.col("target").rlike(r"\A[/\\]|:"), F.lit(True)), "entry-target-absolute-or-invalid").when(F.col("_n").isNull() | (F.col("_n") == ""), "entry-target-escapes-repository").when(
        extension.isin("js", "jsx"), "entry-target-javascript-output-unsupported").when(F.col("_n").endswith(".d.ts"), "entry-target-declaration-file-unsupported")
    wanted = wanted.withColumn("_invalid", invalid).withColumn("_bare", extension == "")
    tries = F.array(*[F.struct(F.lit(i).alias("rank"), F.concat("_n", F.lit(s)).alias("path"), F.lit(i > 0 and i < len(SOURCES)).alias("_only_bare")) for i, s in enumerate((*SOURCES, *DECLARATIONS))])
    tried = wanted.where("_invalid is null").select(*by, "target", "_bare", F.inline(tries)).where("_bare or not _only_bare")
    best = tried.join(files.select(*by, "path").distinct(), [*by, "path"]).groupBy(*by, "target").agg(F.min(F.struct("rank", "path")).alias("_m"))
    found = F.col("_m.rank") < len(SOURCES)
    reason = F.coalesce("_invalid", F.when(found, "entry-target-resolved").when(F.col("_m").isNotNull(), "entry-target-declaration-file-unsupported").otherwise("entry-target-missing-or-not-typescript"))
    outcome = wanted.join(best, [*by, "target"], "left").select(*[F.col(c).alias(f"_{i}") for i, c in enumerate((*by, "target"))], F.when(found, F.col("_m.path")).alias("path"), reason.alias("reason"))
    same = [entries[c].eqNullSafe(outcome[f"_{i}"]) for i, c in enumerate((*by, "target"))]
    return entries.join(outcome, same).drop(*[f"_{i}" for i in range(len(same))])


def entry_graph(entries: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, name, reason) and edges (src, dst, kind) of ``entries`` (kind, key, target): an entry leads to its file where it is resolved."""
    found = resolve_targets(entries, files).withColumn("id", F.concat(F.lit("entry:"), "kind", F.lit(":"), "key"))
    nodes = found.select("id", F.lit("entry").alias("kind"), F.concat_ws(":", "kind", "key").alias("name"), "reason").distinct()
    return nodes, found.where("path is not null").select(F.col("id").alias("src"), F.concat(F.lit("file:"), "path").alias("dst"), F.lit("enters").alias("kind")).distinct()
