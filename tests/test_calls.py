"""Callers, members and outcomes of calls on small sources."""

from evidentia.operators import calls
from evidentia.plans.repository_graph import resolved_calls

A = """import { f, f as twice, K, type T, I, loop, missing } from './b';
import d, * as all from './b';
import { f as double } from './b';
import { g as double } from './b';
import { x } from './nowhere';

export abstract class P<Q> extends K {
\t#secret(v: string) { return twice(v); }
\tget size(): number { return this.#secret('f()') + f(1); }
\tprivate one<V>(v: V): V { return v; }
\tprivate two() { return 1; }
\tprivate two(x) { return x; }
\tprotected three() { this.one(1); this.two(); this.three(); this.none(); }
\tstatic four() { return P.four() + P.three() + P.none(); }
\tfield = f(3);
\tabstract five(): void;
}

const arrow = (f) => { f(1); };
const other = async (a, { b }) => {
  const d = a();
  d();
  for (const K of a) { new K(); }
  if (twice) { twice(2); }
};
function outer() {
  function inner(y) { return f(y); }
  return inner(1) + I() + loop() + missing() + double() + x() + d() + all.f() + all.K() + K.make() + f.call() + unknown.y.z();
}
new P();
new d();
this.nothing();
"""
B = """export default function named() { return 1; }
export function f(x) { return x; }
export function g() {}
export class K { constructor() {} static make() {} }
export interface I { f(): void }
export type T = { f(): void };
export { loop } from './c';
"""
C = "export { loop } from './b';\n"


def rows(spark, **files):
    return spark.createDataFrame([(f"{k}.ts", v) for k, v in files.items()], "path string, text string")


def test_outcomes(spark):
    got = {(r.caller.replace("symbol:a.ts#", ""), r.reference, r.form): (r.status, r.reason, r.target, r.occurrence_count) for r in resolved_calls(rows(spark, a=A, b=B, c=C)).where("path = 'a.ts'").collect()}
    unresolved = lambda reason, n=1: ("unresolved", reason, None, n)
    f = ("resolved", "local-export-binding", "symbol:b.ts#f", 1)
    want = {
        ("P.secret", "twice", "identifier"): f, ("P.size", "f", "identifier"): f, ("P", "f", "identifier"): f,
        ("P.size", "this.secret", "this-member"): ("resolved", "same-class-private-method", "symbol:a.ts#P.secret", 1), ("P.three", "this.one", "this-member"): ("resolved", "same-class-private-method", "symbol:a.ts#P.one", 1), ("P.three", "this.two", "this-member"): ("ambiguous", "ambiguous-private-method", None, 1),
        ("P.three", "this.three", "this-member"): unresolved("potentially-polymorphic-this-call"), ("P.three", "this.none", "this-member"): unresolved("missing-class-member"),
        ("P.four", "P.four", "member"): ("resolved", "static-class-method", "symbol:a.ts#P.four", 1), ("P.four", "P.three", "member"): unresolved("static-member-not-found"), ("P.four", "P.none", "member"): unresolved("missing-class-member"),
        ("arrow", "f", "identifier"): unresolved("local-binding-shadowed-import"), ("other", "a", "identifier"): unresolved("unknown-name"), ("other", "d", "identifier"): unresolved("local-binding-shadowed-import"),
        ("other", "K", "constructor"): unresolved("local-binding-shadowed-constructor"), ("other", "twice", "identifier"): f, ("outer", "f", "identifier"): f, ("outer", "inner", "identifier"): unresolved("unknown-name"),
        ("outer", "I", "identifier"): unresolved("non-callable-export"), ("outer", "loop", "identifier"): unresolved("re-export-cycle"), ("outer", "missing", "identifier"): unresolved("missing-export"),
        ("outer", "double", "identifier"): ("ambiguous", "ambiguous-import-binding", None, 1), ("outer", "x", "identifier"): unresolved("missing-relative-module"), ("outer", "d", "identifier"): ("resolved", "local-export-binding", "symbol:b.ts#named", 1),
        ("outer", "all.f", "member"): f, ("outer", "all.K", "member"): unresolved("non-callable-export"), ("outer", "K.make", "member"): ("resolved", "static-class-method", "symbol:b.ts#K.make", 1), ("outer", "f.call", "member"): unresolved("static-member-on-non-class"),
        ("file:a.ts", "P", "constructor"): ("resolved", "implicit-default-constructor", "symbol:a.ts#P", 1), ("file:a.ts", "d", "constructor"): unresolved("constructor-target-not-class"), ("file:a.ts", "this.nothing", "this-member"): unresolved("this-member-outside-class"),
    }
    assert {k: v for k, v in got.items() if got[k] != want.get(k)} == {} and set(got) == set(want)


def test_members(spark):
    got = {(r.name, r.kind, r.static, r.visibility, r.heads) for r in calls.members(rows(spark, a=A)).collect()}
    assert got == {
        ("secret", "method", False, "private", 1), ("size", "accessor", False, "public", 1), ("one", "method", False, "private", 1), ("two", "method", False, "private", 2), ("three", "method", False, "protected", 1),
        ("four", "method", True, "public", 1), ("five", "method", False, "public", 1),
    }


def test_odd_sources(spark):
    files = rows(spark, null=None, empty="", long="function big() {\n" + "  f();\n" * 20000 + "}\n", crlf="function w() {\r\n  g();\r\n}\r\nh();\r\n", line="class Z { m() { return k(); } }")
    got = {(r.path, r.owner, r.member, r.callee, r.occurrence_count) for r in calls.owned_calls(files).collect()}
    assert got == {("long.ts", "big", None, "f", 20000), ("crlf.ts", "w", None, "g", 1), ("crlf.ts", None, None, "h", 1), ("line.ts", "Z", "m", "k", 1)}
    assert resolved_calls(files.limit(0)).count() == 0


def test_written_modules_are_read_back(spark):
    import duckdb

    from tests import written_sources

    con = duckdb.connect()
    for name in ("supplier", "nation"):
        con.execute(f"create view {name} as select * from '/root/testdata/sf0.001/{name}.parquet'")
    for name, query in written_sources.QUERIES.items():
        got = query(spark, "/root/testdata/sf0.001")
        want = con.execute(f"select {', '.join(got.columns)} from ({written_sources.ORACLES[name]})").fetchall()
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and want
