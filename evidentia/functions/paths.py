"""Paths of source files as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories that hold no sources of one's own, and what a relative import may stand for.
EXCLUDED = (".git", "node_modules", "target", "dist", "build", "coverage", ".next", ".turbo")
SUFFIXES = ("", ".ts", ".tsx", ".d.ts", "/index.ts", "/index.tsx", "/index.d.ts")


def is_typescript(path: Column) -> Column:
    return F.lower(path).rlike(r"\.tsx?$")


def language(path: Column) -> Column:
    return F.when(F.lower(path).endswith(".tsx"), "tsx").when(F.lower(path).endswith(".ts"), "typescript")


def is_excluded(path: Column) -> Column:
    """Whether a directory of the path (not the file's own name) is one of EXCLUDED."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(x) for x in EXCLUDED]))


def is_test(path: Column) -> Column:
    low = F.lower(path)
    return low.rlike(r"\.(test|spec)\.tsx?$") | low.rlike(r"(^|/)(tests?|__tests__)/")


def normalize(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; null where it leaves its root, is absolute, or holds a backslash or a drive."""
    step = lambda acc, s: F.when(acc.isNull() | (s == "") | (s == "."), acc).when((s == "..") & (F.size(acc) == 0), F.lit(None)).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    folded = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(~path.rlike(r"^/|\\|^[A-Za-z]:"), F.array_join(folded, "/"))


def resolve_relative(importer: Column, specifier: Column) -> Column:
    """The normalized path that a ``./`` or ``../`` specifier names from the importing file's directory; null for one with a colon or a backslash."""
    folder = F.regexp_replace(importer, r"[^/]*$", "")
    return F.when(specifier.rlike(r"^\.\.?(/|$)") & ~specifier.rlike(r"[:\\]"), normalize(F.concat(folder, specifier)))


def candidates(path: Column) -> Column:
    """Structs (rank, path) of the files that an extension-less import path may stand for, in order."""
    return F.array(*[F.struct(F.lit(i).alias("rank"), F.concat(path, F.lit(s)).alias("path")) for i, s in enumerate(SUFFIXES)])
