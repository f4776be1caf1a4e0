"""A fixture: two modules are written for every supplier and nation, and read back as facts and resolved calls.

The SQL knows what was written, not how it is read, so it states the outcomes from the tables alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import calls, facts
from evidentia.plans.repository_graph import resolved_calls
from evidentia.tables import table

SUPPLIER = """import { helper as h, Box, type Shape } from './util{n}';
import * as ns from "./util{n}";
import ext from 'ext';
/* hidden() { */ // also hidden(1)
export class Local{k} extends Box {
  constructor(size: number) { super(size); }
  static make(x: number) { return h(x); }
  private inner() { return "skip()" + ns.helper(1); }
  run(): number {
    this.inner();
    this.run();
    return Local{k}.make(2);
  }
}
export function main(a: number) {
  const v = new Box();
  Box.create(a);
  Box.missing();
  ext.call();
  lost.go();
  return h(a) + h(2) + new Local{k}(a);
}
function shadow(h) {
  if (h) { Shape.of(); }
  return h(1) + ns.absent() + ns();
}
main({k});
new Missing();
"""
UTIL = """export { helper } from './base{n}';
export class Box {
  static create(y) { return new Box(); }
}
export interface Shape { of(): number }
"""
BASE = """export const helper = (x) => unknown(x);
"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text: a module a supplier, two modules a nation of regions other than 2."""
    def fill(text: str, **by: Column) -> Column:
        out = F.lit(text)
        for name, value in by.items():
            out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
        return out

    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("src/s"), k.cast("string"), F.lit(".ts")).alias("path"), fill(SUPPLIER, k=k, n=n).alias("text"))
    n = F.col("n_nationkey")
    nations = table(spark, sf_dir, "nation").where("n_regionkey <> 2")
    module = lambda name, text: nations.select(F.concat(F.lit(f"src/{name}"), n.cast("string"), F.lit(".ts")).alias("path"), fill(text, n=n).alias("text"))
    return suppliers.unionByName(module("util", UTIL)).unionByName(module("base", BASE))


def source_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved_calls(_files(spark, sf_dir))


def source_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.members(_files(spark, sf_dir))


def source_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.declarations(_files(spark, sf_dir)).select("path", "name", "kind", "exported")


_MODULES = """with s as (select s_suppkey::varchar as k, s_nationkey::varchar as n, n_regionkey <> 2 as there from supplier join nation on n_nationkey = s_nationkey), u as (select n_nationkey::varchar as n from nation where n_regionkey <> 2)"""
_SYMBOL = "'symbol:src/s' || k || '.ts#' || "
_BROKEN = "if(there, '{}', 'missing-relative-module')"
_CALLS = [
    # caller, reference, form, reason, target where it resolves, count
    ("'Local' || k || '.make'", "h", "identifier", _BROKEN.format("re-export-binding"), "if(there, 'symbol:src/base' || n || '.ts#helper', null)", 1),
    ("'Local' || k || '.inner'", "ns.helper", "member", _BROKEN.format("re-export-binding"), "if(there, 'symbol:src/base' || n || '.ts#helper', null)", 1),
    ("'Local' || k || '.run'", "this.inner", "this-member", "'same-class-private-method'", _SYMBOL + "'Local' || k || '.inner'", 1),
    ("'Local' || k || '.run'", "this.run", "this-member", "'potentially-polymorphic-this-call'", "null", 1),
    ("'Local' || k || '.run'", "' || 'Local' || k || '.make", "member", "'static-class-method'", _SYMBOL + "'Local' || k || '.make'", 1),
    ("'main'", "Box", "constructor", _BROKEN.format("implicit-default-constructor"), "if(there, 'symbol:src/util' || n || '.ts#Box', null)", 1),
    ("'main'", "Box.create", "member", _BROKEN.format("static-class-method"), "if(there, 'symbol:src/util' || n || '.ts#Box.create', null)", 1),
    ("'main'", "Box.missing", "member", _BROKEN.format("missing-class-member"), "null", 1),
    ("'main'", "ext.call", "member", "'external-module'", "null", 1),
    ("'main'", "lost.go", "member", "'unsupported-member-call'", "null", 1),
    ("'main'", "h", "identifier", _BROKEN.format("re-export-binding"), "if(there, 'symbol:src/base' || n || '.ts#helper', null)", 2),
    ("'main'", "' || 'Local' || k || '", "constructor", "'explicit-constructor'", _SYMBOL + "'Local' || k || '.constructor'", 1),
    ("'shadow'", "h", "identifier", "'local-binding-shadowed-import'", "null", 1),
    ("'shadow'", "Shape.of", "member", "'type-only-binding'", "null", 1),
    ("'shadow'", "ns.absent", "member", _BROKEN.format("missing-export"), "null", 1),
    ("'shadow'", "ns", "identifier", "'namespace-called-as-function'", "null", 1),
    (None, "main", "identifier", "'same-module-declaration'", _SYMBOL + "'main'", 1),
    (None, "Missing", "constructor", "'missing-class-binding'", "null", 1),
]


def _expected(caller: str | None, reference: str, form: str, reason: str, target: str, count: int) -> str:
    who = "'file:src/s' || k || '.ts'" if caller is None else _SYMBOL + caller
    return f"select 'src/s' || k || '.ts' as path, {who} as caller, '{reference}' as reference, '{form}' as form, {reason} as reason, {target} as target, {count} as occurrence_count from s"


QUERIES = {"source_calls": source_calls, "source_members": source_members, "source_declarations": source_declarations}
ORACLES = {
    "source_calls": _MODULES + ", c as (" + " union all ".join(_expected(*c) for c in _CALLS)
    + """ union all select 'src/util' || n || '.ts', 'symbol:src/util' || n || '.ts#Box.create', 'Box', 'constructor', 'implicit-default-constructor', 'symbol:src/util' || n || '.ts#Box', 1 from u
      union all select 'src/base' || n || '.ts', 'symbol:src/base' || n || '.ts#helper', 'unknown', 'identifier', 'unknown-name', null, 1 from u)
      select *, case when target is not null then 'resolved' when reason = 'external-module' then 'external' else 'unresolved' end as status from c""",
    "source_members": _MODULES + """ select 'src/s' || k || '.ts' as path, 'Local' || k as owner, name, kind, static, visibility, 1 as heads from s,
      (values ('constructor', 'constructor', false, 'public'), ('make', 'method', true, 'public'), ('inner', 'method', false, 'private'), ('run', 'method', false, 'public')) as m(name, kind, static, visibility)
      union all select 'src/util' || n || '.ts', 'Box', 'create', 'method', true, 'public', 1 from u""",
    "source_declarations": _MODULES + """ select 'src/s' || k || '.ts' as path, name, kind, exported from s, lateral (values ('Local' || k, 'class', true), ('main', 'function', true), ('shadow', 'function', false)) as m(name, kind, exported)
      union all select 'src/util' || n || '.ts', name, kind, true from u, (values ('Box', 'class'), ('Shape', 'interface')) as m(name, kind) union all select 'src/base' || n || '.ts', 'helper', 'variable', true from u""",
}
