"""Import specifiers over a table of path patterns (one ``*`` each at most), by equality joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.paths import SUFFIXES, candidates


def matching_pattern(specifiers: DataFrame, patterns: DataFrame) -> DataFrame:
    """(specifier, pattern, wild): the pattern equal to a specifier, else the one with the longest text before ``*``, the smaller at a tie.

    A specifier is joined by each of its beginnings, so patterns and specifiers may both be large. ``wild`` is what ``*`` stands for,
    null for a pattern without one. Specifiers without a pattern have no row.
    """
    star = F.instr("pattern", "*")
    rules = patterns.select("pattern").distinct().withColumn("begin", F.when(star > 0, F.substring("pattern", F.lit(1), star - 1))).withColumn("end", F.when(star > 0, F.expr("substring(pattern, instr(pattern, '*') + 1)")))
    wanted = specifiers.select("specifier").where("specifier is not null").distinct()
    found = F.struct(F.lit(1).alias("rank"), (-F.length("begin")).alias("shorter"), "pattern", "begin", "end")
    begins = wanted.select("specifier", F.explode(F.transform(F.sequence(F.lit(0), F.length("specifier")), lambda n: F.substring(F.col("specifier"), F.lit(1), n))).alias("begin"))
    fits = F.col("specifier").endswith(F.col("end")) & (F.length("specifier") >= F.length("begin") + F.length("end"))
    by_begin = begins.join(rules.where("begin is not null"), "begin").where(fits).select("specifier", found.alias("m"))
    equal = F.struct(F.lit(0).alias("rank"), F.lit(0).alias("shorter"), "pattern", "begin", "end")
    by_name = wanted.join(rules, wanted["specifier"] == rules["pattern"]).select("specifier", equal.alias("m"))
    best = by_begin.unionByName(by_name).groupBy("specifier").agg(F.min("m").alias("m"))
    wild = F.when(F.col("m.begin").isNotNull(), F.substring(F.col("specifier"), F.length("m.begin") + 1, F.length("specifier") - F.length("m.begin") - F.length("m.end")))
    return best.select("specifier", "m.pattern", wild.alias("wild"))


def resolve_aliases(specifiers: DataFrame, mappings: DataFrame, known: DataFrame) -> DataFrame:
    """(specifier, pattern, target, status): the first known path of the best pattern's targets, in their order and with each suffix.

    ``mappings`` has pattern, target_order, target; ``known`` has path. local: a path was found; unresolved: a pattern matches but
    no target is known; external: no pattern matches. Patterns and targets without text are no mappings.
    """
    matched = matching_pattern(specifiers, mappings.where("pattern is not null and target is not null"))
    place = F.when(F.col("wild").isNotNull(), F.replace("target", F.lit("*"), F.col("wild"))).otherwise(F.col("target"))
    tried = matched.join(mappings, "pattern").select("specifier", "target_order", F.inline(candidates(place)))
    order = F.col("target_order").cast("long") * len(SUFFIXES) + F.col("rank")
    best = tried.join(known.select("path").distinct(), "path").groupBy("specifier").agg(F.min_by("path", order).alias("target"))
    status = F.when(F.col("target").isNotNull(), "local").when(F.col("pattern").isNotNull(), "unresolved").otherwise("external")
    every = specifiers.select("specifier").where("specifier is not null").distinct()
    return every.join(matched.select("specifier", "pattern"), "specifier", "left").join(best, "specifier", "left").select("specifier", "pattern", "target", status.alias("status"))
