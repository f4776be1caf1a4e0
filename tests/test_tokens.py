"""The lexer, canonical hashes, broken sources, and facts of forms that a pattern over lines gets wrong."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import calls, facts
from evidentia.operators.tokens import Source, bracket_balance, source_hashes, statements, token_table, tokenize


def sources(spark, **texts):
    return spark.createDataFrame([(k.replace("_", "."), v) for k, v in texts.items()], "path string, text string")


def texts(text, jsx=False):
    source = Source(text, jsx)
    return [[source.text[i] for i in range(a, b)] for a, b in source.statements()]


def test_literals_hide_what_looks_like_code():
    text = r"""const a = 'it\'s // no', b = "/* no */", c = `x${f(`}${g()}`)}y`, d = /[/"'`]\/{/g.test(a / b / c);"""
    (got,) = texts(text)
    assert got == [
        "const", "a", "=", r"it\'s // no", ",", "b", "=", "/* no */", ",", "c", "=", "`", "x", "${", "f", "(", "`", "}", "${", "g", "(", ")", "}", "`", ")", "}", "y", "`",
        ",", "d", "=", r"""/[/"'`]\/{/g""", ".", "test", "(", "a", "/", "b", "/", "c", ")", ";",
    ]


def test_statements_end_without_semicolons():
    text = "import a from './a'\nconst x = {\n  y: 1\n}\n[x].map(f)\nlet q =\n  1\nfoo\n  .bar()\n@dec({ a: 1 })\nexport class A {\n}\nexport type T =\n  | 'a'\n  | { b: 1 }\ninterface I { a: 1 }\nif (x) {\n} else {\n}\ndo { } while (x)\nz()"
    assert [s[:3] for s in texts(text)] == [
        ["import", "a", "from"], ["const", "x", "="], ["[", "x", "]"], ["let", "q", "="], ["foo", ".", "bar"], ["@", "dec", "("], ["export", "type", "T"], ["interface", "I", "{"],
        ["if", "(", "x"], ["do", "{", "}"], ["z", "(", ")"],
    ]


def test_jsx_text_is_no_code():
    (a, b) = texts("const A = () => <p title=\"it's\" on={() => f('<')}>Don't call g(1) at http://x {h(<b/>)} <></></p>;\nconst b = <T,>(x: T) => i < j;\n", jsx=True)
    assert "Don't call g(1) at http://x" in a and [t for t in a if t in ("f", "g", "h")] == ["f", "h"] and b[:4] == ["const", "b", "=", "<"]


def test_depths_brackets_and_type_arguments(spark):
    rows = token_table(sources(spark, a_ts="const m = new Map<A, B[]>(f(1)), n = a < b;")).orderBy("i").collect()
    assert [(r.text, r.depth) for r in rows if r.text in ("A", "1", "n", "f")] == [("A", 0), ("f", 1), ("1", 2), ("n", 0)]
    assert {r.name for r in facts.declarations(sources(spark, a_ts="const m = new Map<A, B>(1), n = a < b, o: X<Y, Z> = 3, { p } = q, r = c > d;")).collect()} == {"m", "n", "o", "r"}


def test_every_token_is_found_again(spark):
    """Random sequences of tokens, written with random blanks and comments between them, give the same tokens."""
    rng = random.Random(4)
    plain = ["a", "$b_1", "#c", "12", "1.5e3", "(", ")", "[", "]", "{", "}", ";", ",", "=>", "...", "?.", "==", "===", "!=", "=", "+", "&", "|", ":", "@", "'s'", '"t u"', "`v`"]
    gaps = [" ", "\n", "\t", " // x ' \" `\n", "/* { ( ` */", "/**/ "]
    for _ in range(300):
        chosen = [rng.choice(plain) for _ in range(rng.randint(1, 30))]
        source = Source("".join(t + rng.choice(gaps) for t in chosen), False)
        want = []
        for t in chosen:
            want += ["`", "v", "`"] if t == "`v`" else [t[1:-1]] if t[0] in "'\"" else [t]
        assert source.text == want and sum(b - a for a, b in source.statements()) == len(want)


@pytest.fixture(scope="module")
def hashes(spark):
    plain = "import { x } from './x';\nexport class A extends B { m(a: number) { return 'q' + a; } }\nexport const f = (a) => a + 1, g = 2;\nfunction h() { return 1; }\n"
    edits = {
        "comment": plain.replace("return 1", "/* one */ return /* two */ 1 // three\n"), "quotes": plain.replace("'q'", '"q"').replace("'./x'", '"./x"'), "blanks": plain.replace(" ", "\n  ").replace("import\n", "import "),
        "body": plain.replace("'q' + a", "'q' - a"), "head": plain.replace("extends B", "extends C"), "value": plain.replace("g = 2", "g = 3"), "literal": plain.replace("'q'", "'Q'"), "template": plain.replace("'q'", "`q`"),
    }
    files = tokenize(sources(spark, plain_ts=plain, **{f"{k}_ts": v for k, v in edits.items()}))
    whole = {r.path[:-3]: r.canonical_fingerprint for r in source_hashes(files).collect()}
    own = {(r.path[:-3], r.name): r.fingerprint for r in facts.declaration_rows(files).collect()}
    member = {r.path[:-3]: r.fingerprint for r in facts.member_rows(files).collect()}
    return whole, own, member


@pytest.mark.parametrize("edit", ["comment", "quotes", "blanks"])
def test_hashes_ignore(hashes, edit):
    whole, own, member = hashes
    assert whole[edit] == whole["plain"] and member[edit] == member["plain"]
    assert {n for (p, n), h in own.items() if p == edit and h == own["plain", n]} == {"A", "f", "g", "h"}


@pytest.mark.parametrize("edit, names, members", [("body", set(), True), ("head", {"A"}, False), ("value", {"g"}, False), ("literal", set(), True), ("template", set(), True)])
def test_hashes_tell_apart(hashes, edit, names, members):
    whole, own, member = hashes
    assert whole[edit] != whole["plain"] and (member[edit] != member["plain"]) == members
    assert {n for (p, n), h in own.items() if p == edit and h != own["plain", n]} == names


def test_broken_sources_are_flagged_and_keep_their_facts(spark):
    files = sources(
        spark, good_ts="f({ a: [1, (2)] }, `${x}`); const t = '}';", open_ts="const a = 1;\nfunction g() {\n  f(;\n", mixed_ts="const b = 2;\nf([1)];\nexport const after = 1;\n", closer_ts="f());\nconst c = 3;\n", text_ts="const d = 4;\nconst e = 'x\n;", template_ts="const h = `x ${y",
        cut_ts="const i = 1;\nclass K {\n  m() { n(;\nexport const j = 2;\n", empty_ts="", null_ts=None,
    )
    got = {r.path[:-3]: (r.unmatched, r.recovered, r.first_break) for r in bracket_balance(files).collect()}
    assert got == {
        "good": ("", False, None), "open": ("{(", True, 2), "mixed": ("([)]", True, 2), "closer": (")", True, 1), "text": ("", True, 2), "template": ("`$", True, 1), "cut": ("{{(", True, 2),
    }
    names = {(r.path[:-3], r.name) for r in facts.declarations(files).collect()}
    assert {("open", "a"), ("mixed", "b"), ("mixed", "after"), ("closer", "c"), ("text", "d"), ("cut", "i"), ("cut", "j")} <= names


def test_balance_does_not_depend_on_where_a_text_is_cut(spark):
    from evidentia.operators.tokens import _reduced

    rng = random.Random(6)
    rows = [("".join(rng.choice("()[]{}") for _ in range(rng.randint(0, 40))), rng.randint(0, 40)) for _ in range(300)]

    def left(text):
        while True:
            shorter = text.replace("()", "").replace("[]", "").replace("{}", "")
            if shorter == text:
                return text
            text = shorter

    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    frame = spark.createDataFrame(rows, "t string, cut int")
    one, two = _reduced(chars(F.substring("t", 1, 1000))), F.concat(_reduced(chars(F.expr("left(t, cut)"))), _reduced(chars(F.expr("substring(t, cut + 1)"))))
    got = frame.select("t", one.alias("one"), two.alias("two")).select("t", "one", _reduced(chars(F.col("two"))).alias("two")).collect()
    assert all(r.one == r.two == left(r.t) for r in got)


def test_declarations_of_every_form(spark):
    text = """export const enum E { A }
const a = 1, b = 2;
function *g() {}
export default function () { return 1; }
declare function s(x: string): void;
function s2(x: string): { a: number };
export abstract class P<T> {}
export class{}
namespace N { export function inner() { call(); } }
type T = { m(): void };
var v = 1; let {x, y: z} = v;
export async function k() {}
@dec() class D {}
"""
    got = {(r.name, r.kind, r.exported, r.is_default, r.abstract) for r in facts.declarations(sources(spark, a_ts=text)).collect()}
    assert got == {
        ("E", "enum", True, False, False), ("a", "variable", False, False, False), ("b", "variable", False, False, False), ("g", "function", False, False, False), ("default", "function", True, True, False),
        ("s", "function-signature", False, False, False), ("s2", "function-signature", False, False, False), ("P", "class", True, False, True), ("T", "type", False, False, False), ("v", "variable", False, False, False),
        ("k", "function", True, False, False), ("D", "class", False, False, False),
    }
    arrow = facts.declarations(sources(spark, b_ts="export default (a) => a;", c_ts="export default charge;", d_ts="export default async x => x")).collect()
    assert {(r.path, r.name, r.kind) for r in arrow} == {("b.ts", "default", "function"), ("d.ts", "default", "function")}


def test_members_of_every_form(spark):
    text = """export interface Gateway extends Base.G<{ a: 1 }>, Other { charge(): void; name: string, get(x: number): { a: 1 } }
export abstract class Base { abstract charge(): void; }
export class Payment extends mixin(Base) implements Gateway, A.B {
  @inject() private q() {} #hidden() { return 2; }
  static create() { return new Payment(); }
  constructor() { super(); }
  over(value: string): void;
  over(value: unknown) {}
  get size() { return 1; }
  field: Map<string, () => void> = new Map(); [key]() {} 'text'() {}
}
class One { m() { return k(); } static n() {} }
"""
    files = tokenize(sources(spark, a_ts=text))
    got = {(r.owner, r.name, r.kind, r.visibility, r.abstract, r.declaration_only) for r in facts.member_rows(files).collect()}
    assert got == {
        ("Gateway", "charge", "method-signature", "public", False, True), ("Gateway", "get", "method-signature", "public", False, True), ("Base", "charge", "method", "public", True, True),
        ("Payment", "q", "method", "private", False, False), ("Payment", "hidden", "method", "private", False, False), ("Payment", "create", "static-method", "public", False, False),
        ("Payment", "constructor", "constructor", "public", False, False), ("Payment", "over", "method", "public", False, True), ("Payment", "over", "method", "public", False, False),
        ("Payment", "size", "accessor", "public", False, False), ("One", "m", "method", "public", False, False), ("One", "n", "static-method", "public", False, False),
    }
    assert {(r.owner, r.relation, r.reference, r.form) for r in facts.heritage(files).collect()} == {
        ("Gateway", "extends", "Base.G", "member"), ("Gateway", "extends", "Other", "identifier"), ("Payment", "extends", "mixin()", "dynamic"), ("Payment", "implements", "Gateway", "identifier"),
        ("Payment", "implements", "A.B", "member"),
    }
    assert {r.reason for r in facts.unsupported(files).collect()} == {
        "class-computed-member-name", "class-public-field-definition-unsupported", "class-accessor-unsupported", "interface-property-signature-unsupported", "dynamic-extends-unsupported",
    }


def test_calls_without_false_rows(spark):
    text = """class Z { m() { return k(); } @inject() private q() {} }
namespace N { export function inside(a) { if (a) { b(); } } }
const o = { p() { return c(); }, async r(x): Promise<void> { await d(x); }, s: function () {}, t: e ? g(1) : h };
ns.charge(); ns['charge'](); ns[method](); call?.(); a.b.c(); f()(); w<string>(x); tag`t${u(1)}`; new Foo; new ns.Bar(); new (mk())(); new.target;
function over(a: string): void;
function over(a) { super.x(); import('./y'); return (z)(a); }
switch (a) { case i(1): { j(); } }
if (l) (v)();
of(1); for (const x of (y)) { z as (A); }
"""
    got = [(r.owner, r.member, r.receiver, r.callee, r.form) for r in facts.call_sites(sources(spark, a_ts=text)).orderBy("line", "column").collect()]
    assert got == [
        ("Z", "m", None, "k", "identifier"), ("Z", "q", None, "inject", "identifier"), (None, None, None, "b", "identifier"), ("o", None, None, "c", "identifier"), ("o", None, None, "d", "identifier"), ("o", None, None, "g", "identifier"),
        (None, None, "ns", "charge", "member"), (None, None, None, None, "dynamic"), (None, None, None, None, "dynamic"), (None, None, None, None, "dynamic"), (None, None, None, None, "dynamic"), (None, None, None, "f", "identifier"), (None, None, None, None, "dynamic"),
        (None, None, None, "w", "identifier"), (None, None, None, "tag", "identifier"), (None, None, None, "u", "identifier"), (None, None, None, "Foo", "constructor"), (None, None, None, None, "dynamic-constructor"), (None, None, None, None, "dynamic-constructor"),
        (None, None, None, "mk", "identifier"), ("over", None, "super", "x", "member"), ("over", None, None, None, "dynamic"), ("over", None, None, None, "dynamic"), (None, None, None, "i", "identifier"), (None, None, None, "j", "identifier"), (None, None, None, None, "dynamic"), (None, None, None, "of", "identifier"),
    ]


def test_tokens_of_odd_tables(spark):
    rows = spark.createDataFrame([(None, "f();"), ("a.ts", None), ("a.ts", ""), ("a.ts", " \n// x"), ("b.ts", "g()"), ("b.ts", "g()")], "path string, text string").withColumns({"n": F.lit(1), "i": F.lit(2), "kind": F.lit("x")})
    assert sorted((r.path or "", r.n, len(r.tokens)) for r in tokenize(rows).collect()) == [("", 0, 4), ("b.ts", 0, 3), ("b.ts", 0, 3)]
    assert statements(tokenize(rows)).columns == ["path", "n", "start", "members", "tokens"] and tokenize(rows.limit(0)).count() == 0
    for derive in (facts.imports, facts.exports, facts.declarations, facts.member_rows, facts.heritage, facts.call_sites, facts.unsupported, calls.owned_calls, bracket_balance, source_hashes):
        assert derive(rows.limit(0)).count() == 0
    assert {(r.path, r.callee, r.occurrence_count) for r in facts.calls(rows).collect()} == {(None, "f", 1), ("b.ts", "g", 2)}
