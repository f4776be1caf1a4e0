"""Calls with their callers, members of classes, and what each call stands for, with an outcome for every one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators.facts import call_sites, member_rows

#: Kinds of declarations that a plain call may stand for.
CALLABLE = ("function", "function-signature", "variable")


def members(files: DataFrame) -> DataFrame:
    """path, owner, name, kind (method, constructor, accessor), static, visibility, heads (how often a class has such a head); fields and computed names are none."""
    rows = member_rows(files).where("owner_kind = 'class'")
    kind = F.when(F.col("kind").isin("constructor", "accessor"), F.col("kind")).otherwise("method")
    return rows.groupBy("path", "owner", "name", kind.alias("kind"), "static", "visibility").agg(F.count("*").alias("heads"))


def owned_calls(files: DataFrame) -> DataFrame:
    """path, owner, owner_kind, member, receiver, callee, form (identifier, member, this-member, constructor), shadowed, occurrence_count.

    ``shadowed``: the first name of the call is bound by a variable or parameter of the same top-level declaration. Dynamic
    calls (longer chains than receiver.callee, computed names, optional calls) are left out.
    """
    calls = call_sites(files).where("callee is not null").drop("n", "line", "column")
    return calls.groupBy(*calls.columns).agg(F.count("*").alias("occurrence_count"))


def resolve_calls(called: DataFrame, imported: DataFrame, closure: DataFrame, declared: DataFrame, member_heads: DataFrame) -> DataFrame:
    """path, caller, reference, form, status, reason, target, occurrence_count for every call.

    ``imported`` has target and routing (resolve_imports), ``closure`` resolved exports (export_closure, defaults under the name of
    their declaration). A plain name is an import's export or a declaration of its file; ``this.x`` resolves only to a private
    method of the class, as others may be overridden; ``C.x`` to a static method of a local or imported class, ``ns.x`` to an export
    of a namespace; ``new C`` to the constructor or, without one, the class.
    """
    root = F.coalesce("receiver", "callee")
    facts = F.struct("kind", "routing", F.col("target").alias("module"), "imported_name", "type_only")
    bound = imported.where("kind in ('default', 'named', 'namespace')").groupBy("path", F.col("local_name").alias("root")).agg(F.count("*").alias("imports"), F.min(facts).alias("b"))
    local = declared.groupBy("path", F.col("name").alias("root")).agg(F.count_if(F.col("kind").isin(*CALLABLE)).alias("callables"), F.count_if(F.col("kind") == "class").alias("classes"))
    kinds = declared.groupBy(F.col("path").alias("target_module"), F.col("name").alias("target_name")).agg(F.min("kind").alias("export_kind"))
    exported = closure.select(F.col("module"), F.col("name").alias("wanted"), "target_module", "target_name", F.col("status").alias("export"), "hops").join(kinds, ["target_module", "target_name"], "left")

    rows = called.withColumn("root", root).join(bound, ["path", "root"], "left").join(local, ["path", "root"], "left").fillna(0, ["imports", "callables", "classes"])
    namespace = F.col("b.kind") == "namespace"
    rows = rows.withColumn("module", F.col("b.module")).withColumn("wanted", F.when(namespace, F.col("callee")).otherwise(F.col("b.imported_name"))).join(exported, ["module", "wanted"], "left")
    here, there = F.col("classes") > 0, (F.col("export_kind") == "class") & (F.col("export") == "resolved") & ~F.coalesce(namespace, F.lit(False))
    this = F.col("form") == "this-member"
    class_path = F.when(this & (F.col("owner_kind") == "class"), F.col("path")).when(this, None).when(here, F.col("path")).when(there, F.col("target_module"))
    class_name = F.when(this & (F.col("owner_kind") == "class"), F.col("owner")).when(this, None).when(here, F.col("root")).when(there, F.col("target_name"))
    plain = F.col("kind") != "constructor"
    heads = member_heads.groupBy(F.col("path").alias("class_path"), F.col("owner").alias("class_name"), F.col("name").alias("member_name")).agg(
        F.sum("heads").alias("any"), F.sum(F.when(F.col("static"), F.col("heads")).otherwise(0)).alias("statics"), F.sum(F.when(~F.col("static") & (F.col("visibility") == "private") & plain, F.col("heads")).otherwise(0)).alias("privates"))
    rows = rows.withColumn("class_path", class_path).withColumn("class_name", class_name).withColumn("member_name", F.when(F.col("form") == "constructor", "constructor").when(F.col("form") != "identifier", F.col("callee")))
    rows = rows.join(heads, ["class_path", "class_name", "member_name"], "left").fillna(0, ["any", "statics", "privates"])

    symbol = lambda *parts: F.concat(F.lit("symbol:"), *parts)
    export_id = symbol("target_module", F.lit("#"), "target_name")
    class_id = symbol("class_path", F.lit("#"), "class_name")
    member_id = F.concat(class_id, F.lit("."), "member_name")
    nothing = F.lit(None).cast("string")
    outcome = lambda status, reason, target=nothing: F.struct((F.lit(status) if isinstance(status, str) else status).alias("status"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), target.alias("target"))
    several, no_import = F.col("imports") > 1, F.col("imports") == 0
    unresolved = lambda reason: outcome("unresolved", reason)
    # What an import of a name comes to, before its kind is looked at.
    failed = F.when(F.col("b.routing") == "external", outcome("external", "external-module")).when(F.col("b.routing") != "local", unresolved("missing-relative-module")).when(F.col("export") == "ambiguous", outcome("ambiguous", "ambiguous-reexport")).when(F.col("export") == "cycle-or-depth", unresolved("re-export-cycle")).when(F.col("export").isNull() | (F.col("export") != "resolved"), unresolved("missing-export"))
    binding = F.when(F.col("hops") == 0, "local-export-binding").otherwise("re-export-binding")
    export = F.coalesce(failed, F.when(F.col("export_kind").isin(*CALLABLE), outcome("resolved", binding, export_id)).otherwise(unresolved("non-callable-export")))
    identifier = (
        F.when(several, outcome("ambiguous", "ambiguous-import-binding")).when(~no_import & F.col("shadowed"), unresolved("local-binding-shadowed-import")).when(F.col("b.type_only"), unresolved("type-only-binding"))
        .when(namespace, unresolved("namespace-called-as-function")).when(~no_import, export)
        .when(F.col("callables") == 1, outcome("resolved", "same-module-declaration", symbol("path", F.lit("#"), "root"))).when(F.col("callables") > 1, outcome("ambiguous", "same-module-declaration")).otherwise(unresolved("unknown-name"))
    )
    static = F.when(F.col("statics") == 1, outcome("resolved", "static-class-method", member_id)).when(F.col("statics") > 1, outcome("ambiguous", "ambiguous-static-method")).when(F.col("any") > 0, unresolved("static-member-not-found")).otherwise(unresolved("missing-class-member"))
    member = (
        F.when(here, static).when(several, outcome("ambiguous", "ambiguous-import-binding")).when(no_import, unresolved("unsupported-member-call")).when(F.col("shadowed"), unresolved("local-binding-shadowed-import"))
        .when(F.col("b.type_only"), unresolved("type-only-binding")).when(namespace, export).otherwise(F.coalesce(failed, F.when(there, static).otherwise(unresolved("static-member-on-non-class"))))
    )
    own = (
        F.when(F.col("shadowed"), unresolved("local-binding-shadowed-this")).when(F.col("class_name").isNull(), unresolved("this-member-outside-class")).when(F.col("privates") == 1, outcome("resolved", "same-class-private-method", member_id))
        .when(F.col("privates") > 1, outcome("ambiguous", "ambiguous-private-method")).when(F.col("any") > 0, unresolved("potentially-polymorphic-this-call")).otherwise(unresolved("missing-class-member"))
    )
    built = F.when(F.col("any") == 1, outcome("resolved", "explicit-constructor", member_id)).when(F.col("any") > 1, outcome("ambiguous", "ambiguous-constructor")).otherwise(outcome("resolved", "implicit-default-constructor", class_id))
    constructor = (
        F.when(F.col("receiver").isNotNull(), unresolved("dynamic-constructor")).when(F.col("shadowed"), unresolved("local-binding-shadowed-constructor")).when(F.col("classes") > 1, outcome("ambiguous", "ambiguous-class-binding")).when(here, built)
        .when(several, outcome("ambiguous", "ambiguous-import-binding")).when(no_import, unresolved("missing-class-binding")).when(F.col("b.type_only"), unresolved("type-only-constructor-binding"))
        .when(namespace, unresolved("constructor-target-not-class")).otherwise(F.coalesce(failed, F.when(there, built).otherwise(unresolved("constructor-target-not-class"))))
    )
    which = F.when(F.col("form") == "identifier", identifier).when(F.col("form") == "member", member).when(F.col("form") == "this-member", own).otherwise(constructor)
    caller = F.when(F.col("owner").isNull(), F.concat(F.lit("file:"), "path")).when(F.col("member").isNotNull(), symbol("path", F.lit("#"), "owner", F.lit("."), "member")).otherwise(symbol("path", F.lit("#"), "owner"))
    out = rows.select("path", caller.alias("caller"), F.concat_ws(".", "receiver", "callee").alias("reference"), "form", which.alias("o"), "occurrence_count")
    return out.groupBy("path", "caller", "reference", "form", "o").agg(F.sum("occurrence_count").alias("occurrence_count")).select("path", "caller", "reference", "form", "o.status", "o.reason", "o.target", "occurrence_count")
