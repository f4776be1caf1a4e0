"""Facts of TypeScript sources as column expressions over their tokens: imports, exports, declarations, members, heritage, calls.

Every function takes sources (path, text) or the rows of ``tokens.tokenize`` made of them, which a caller writes once and
reads for all facts. Names that are computed, and what a declaration's form doesn't say, yield no fact rather than a guess.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.tokens import MODIFIERS, OPERATORS, canonical, statements

_NAME = r"[A-Za-z_$ª-\x{10ffff}][\w$ª-\x{10ffff}]*"
#: The beginning of a statement, its tokens parted by one space.
_HEAD = (
    rf"^(export )?(default )?(declare )?(abstract )?(async )?"
    rf"(?:(const enum|function \*|function|class|interface|enum|const|let|var)(?: (?!(?:extends|implements) )({_NAME}))?|(type) ({_NAME})(?= [=<]))(?= |$)"
)
_BINDING = rf"(type )?({_NAME})(?: as ({_NAME}))?"
#: Words before a bracket that are no calls.
_KEYWORDS = (*OPERATORS, "constructor", "super")
_CONTROL = ("if", "while", "for", "switch", "with", "catch")


def _token(i: Column) -> Column:
    return F.get("tokens", i)


def _text(i: Column) -> Column:
    """The text of a token that isn't a literal, which could look like anything; empty beyond the statement."""
    t = _token(i)
    return F.when(t["kind"].isNull(), "").when(t["kind"].isin("word", "punct", "open", "close"), t["text"]).otherwise('"')


def _where(condition) -> Column:
    """The places of the tokens for which condition(token, place) holds."""
    return F.filter(F.transform("tokens", lambda t, i: F.when(condition(t, i), i)), lambda i: i.isNotNull())


def _joined(first: Column, size: Column) -> Column:
    plain = lambda t: F.when(t["kind"].isin("word", "punct", "open", "close"), t["text"]).otherwise('"')
    return F.array_join(F.transform(F.slice("tokens", first, F.greatest(size, F.lit(0))), plain), " ")


def _filled(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def heads(files: DataFrame) -> DataFrame:
    """path, n, tokens, start, members, head (the first words), keyword (null: declares nothing), name, and flags."""
    rows = statements(files).select("path", "n", "tokens", "start", "members", _joined(F.col("start") + 1, F.lit(12)).alias("head"))
    part = lambda n: F.regexp_extract("head", _HEAD, n)
    arrow = F.col("head").rlike(rf"^export default (?:async )?(?:\(|{_NAME} =>)") & (F.size(_where(lambda t, i: (t["text"] == "=>") & (t["up"] < 0))) > 0)
    word = F.coalesce(_filled(part(6)), _filled(part(8)), F.when(arrow, "function"))
    keyword = F.when(word == "const enum", "enum").when(word == "function *", "function").otherwise(word)
    is_default = F.col("head").startswith("export default ")
    name = F.coalesce(_filled(part(7)), _filled(part(9)), F.when(is_default & keyword.isin("function", "class"), "default"))
    return rows.select(
        "path", "n", "tokens", "start", "members", "head", keyword.alias("keyword"), name.alias("name"), F.col("head").startswith("export ").alias("exported"),
        is_default.alias("is_default"), (part(4) != "").alias("abstract"),
    )


def _declarators() -> Column:
    """Places of the names that a const, let or var statement declares at its top."""
    bound = F.col("keyword").isin("const", "let", "var")
    before = lambda i: _text(i - 1).isin("const", "let", "var", ",")
    behind = lambda i: _text(i + 1).isin("=", ":", ";", ",", "!", "")
    return F.when(bound, _where(lambda t, i: (t["kind"] == "word") & (t["up"] < 0) & (i > F.col("start")) & before(i) & behind(i))).otherwise(F.array().cast("array<int>"))


def declaration_rows(files: DataFrame) -> DataFrame:
    """path, n, name, kind, exported, is_default, abstract, line, fingerprint: top-level declarations, repeated ones each.

    The fingerprint is the canonical hash of the declaration's tokens: of the head only for classes and interfaces, of the
    declarator for variables, without decorators, ``export`` and ``default``.
    """
    rows = heads(files).where("keyword is not null").withColumn("names", _declarators())
    body = _where(lambda t, i: (t["text"] == "{") & (t["kind"] == "open") & (t["up"] < 0) & (i > F.col("start")) & ~_text(i - 1).isin(":", "|", "&", "=>", ""))
    rows = rows.withColumn("body", F.array_min(body))
    end = F.when(_text(F.size("tokens") - 1) == ";", F.size("tokens") - 1).otherwise(F.size("tokens"))
    start = F.col("start") + F.when(F.col("is_default"), 2).when(F.col("exported"), 1).otherwise(0)
    hash_ = lambda first, end: canonical(F.slice("tokens", first + 1, F.greatest(end - first, F.lit(0)))).alias("fingerprint")
    one = lambda first, end, name: F.struct(name.alias("name"), _token(first)["line"].alias("line"), hash_(first, end))
    head_end = F.when(F.col("keyword").isin("class", "interface"), F.coalesce("body", end)).otherwise(end)
    # The next declarator is the last one's neighbour in the list, so each looks at two places only.
    many = F.transform("names", lambda i, k: one(i, F.coalesce(F.get("names", k + 1) - 1, end), _token(i)["text"]))
    kind = F.when(F.col("keyword").isin("const", "let", "var"), "variable").when((F.col("keyword") == "function") & F.col("body").isNull() & ~F.col("head").rlike("^export default (async )?[(]|=>"), "function-signature")
    listed = F.when(F.col("keyword").isin("const", "let", "var"), many).otherwise(F.array(one(start, head_end, F.col("name"))))
    rows = rows.select("path", "n", kind.otherwise(F.col("keyword")).alias("kind"), "exported", "is_default", "abstract", listed.alias("listed"))
    # Exploded in a step of its own: what stands beside an explode is computed for each of its rows.
    rows = rows.withColumn("d", F.explode("listed")).where("d.name is not null")
    return rows.select("path", "n", "d.name", "kind", "exported", "is_default", "abstract", "d.line", "d.fingerprint")


def declarations(files: DataFrame) -> DataFrame:
    """path, name, kind, exported, is_default, abstract: top-level declarations. Kinds: function, function-signature, class, interface, type, enum, variable."""
    return declaration_rows(files).select("path", "name", "kind", "exported", "is_default", "abstract").distinct()


def member_rows(files: DataFrame) -> DataFrame:
    """path, owner, owner_kind, name, kind, static, visibility, abstract, declaration_only, line, fingerprint: methods of classes and interfaces.

    Kinds: method, static-method, constructor, method-signature (of an interface), accessor. One row for each head.
    """
    rows = heads(files).where("keyword in ('class', 'interface') and name is not null")
    size = lambda m: m["end"] - m["part"] - F.when(_text(m["end"] - 1).isin(";", ","), 1).otherwise(0)
    body = lambda m: F.exists(
        F.sequence(m["bracket"], m["end"] - 1),
        lambda i: (_text(i) == "{") & (_token(i)["kind"] == "open") & (_token(i)["up"] == _token(m["at"])["up"]) & ~_text(i - 1).isin(":", "|", "&", "=>"),
    )
    listed = F.transform(
        "members",
        lambda m: F.struct(
            _token(m["at"])["text"].alias("name"), _token(m["at"])["line"].alias("line"), body(m).alias("body"),
            F.transform(F.slice("tokens", m["part"] + 1, m["at"] - m["part"]), lambda t: t["text"]).alias("words"), canonical(F.slice("tokens", m["part"] + 1, size(m))).alias("fingerprint"),
        ),
    )
    found = rows.select("path", F.col("name").alias("owner"), F.col("keyword").alias("owner_kind"), listed.alias("listed"))
    found = found.select("path", "owner", "owner_kind", F.explode("listed").alias("m")).select("path", "owner", "owner_kind", "m.*")
    has = lambda word: F.array_contains("words", word)
    kind = (
        F.when((F.col("owner_kind") == "class") & (F.col("name") == "constructor"), "constructor").when(has("get") | has("set"), "accessor")
        .when(F.col("owner_kind") == "interface", "method-signature").when(has("static"), "static-method").otherwise("method")
    )
    visibility = F.when(has("private") | F.col("name").startswith("#"), "private").when(has("protected"), "protected").otherwise("public")
    return found.select(
        "path", "owner", "owner_kind", F.replace("name", F.lit("#"), F.lit("")).alias("name"), kind.alias("kind"), ((F.col("owner_kind") == "class") & has("static")).alias("static"),
        visibility.alias("visibility"), has("abstract").alias("abstract"), (~F.col("body")).alias("declaration_only"), "line", "fingerprint",
    )


def unsupported(files: DataFrame) -> DataFrame:
    """path, reason: what classes and interfaces hold that has no fact of its own: fields, accessors, computed names; and dynamic heritage."""
    rows = heads(files).where("keyword in ('class', 'interface')")
    roles = rows.select("path", "keyword", F.array_distinct(F.filter(F.transform("tokens", lambda t: t["role"]), lambda r: r.isin("field", "computed"))).alias("roles"))
    roles = roles.select("path", "keyword", F.explode("roles").alias("role"))
    reason = F.when(F.col("role") == "computed", F.concat("keyword", F.lit("-computed-member-name"))).when(F.col("keyword") == "class", "class-public-field-definition-unsupported")
    named = roles.select("path", reason.otherwise("interface-property-signature-unsupported").alias("reason"))
    accessors = member_rows(files).where("kind = 'accessor'").select("path", F.concat("owner_kind", F.lit("-accessor-unsupported")).alias("reason"))
    dynamic = heritage(files).where("form = 'dynamic'").select("path", F.concat(F.lit("dynamic-"), "relation", F.lit("-unsupported")).alias("reason"))
    return named.unionByName(accessors).unionByName(dynamic).distinct()


def methods(files: DataFrame) -> DataFrame:
    """path, name, heads: heads of methods with a body, and how many of the name a file has."""
    rows = member_rows(files).where("owner_kind = 'class' and not declaration_only and kind <> 'constructor'")
    return rows.groupBy("path", "name").agg(F.count("*").alias("heads"))


def imports(files: DataFrame) -> DataFrame:
    """path, specifier, kind, local_name, imported_name, type_only; one row a binding.

    Kinds: default, namespace, named, side-effect, re-export, namespace-export, export-all.
    """
    literal = F.array_min(_where(lambda t, i: (t["kind"] == "string") & (t["up"] < 0)))
    rows = heads(files).where("head like 'import %' or head rlike '^export (type )?[{*]'").withColumn("literal", literal).where("literal is not null")
    verb = _text(F.col("start"))
    clause = F.regexp_replace(_joined(F.col("start") + 2, F.col("literal") - F.col("start") - 1), r"(^| )from$", "")
    rows = rows.select("path", verb.alias("verb"), clause.alias("clause"), _token(F.col("literal"))["text"].alias("specifier"), (_text(F.col("literal") - 1) == "from").alias("sourced"))
    rows = rows.where("sourced or (verb = 'import' and clause = '')")
    type_only = F.col("clause").rlike(r"^type (?!,|from$)(?=[\w$ª-\x{10ffff}{*])")
    rows = rows.withColumn("type_only", type_only).withColumn("clause", F.when(type_only, F.substr("clause", F.lit(6))).otherwise(F.col("clause")))
    rows = rows.withColumn("names", F.regexp_extract("clause", r"\{([^}]*)\}", 1))
    listed = F.filter(F.split("names", ","), lambda b: F.trim(b) != "")
    binding = lambda b, n: _filled(F.regexp_extract(F.trim(b), rf"^{_BINDING}", n))
    named = F.transform(
        listed,
        lambda b: F.struct(
            F.when(F.col("verb") == "export", "re-export").otherwise("named").alias("kind"), F.coalesce(binding(b, 3), binding(b, 2)).alias("local_name"),
            binding(b, 2).alias("imported_name"), (F.col("type_only") | F.trim(b).rlike(rf"^type {_NAME}")).alias("type_only"),
        ),
    )
    outside = F.regexp_replace("clause", r"\{[^}]*\}", "")
    nothing = F.lit(None).cast("string")
    one = lambda kind, local, imported: F.struct(F.lit(kind).alias("kind"), local.alias("local_name"), imported.alias("imported_name"), F.col("type_only").alias("type_only"))
    space, default = _filled(F.regexp_extract(outside, rf"\* as ({_NAME})", 1)), _filled(F.regexp_extract(outside, rf"^({_NAME})", 1))
    is_import = F.col("verb") == "import"
    parts = F.array(
        F.when(is_import & default.isNotNull(), one("default", default, F.lit("default"))),
        F.when(is_import & space.isNotNull(), one("namespace", space, F.lit("*"))),
        F.when(~is_import & space.isNotNull(), one("namespace-export", space, F.lit("*"))),
        F.when(is_import & (F.col("clause") == ""), one("side-effect", nothing, nothing)),
        F.when(~is_import & outside.rlike(r"^\s*\*\s*$"), one("export-all", F.lit("*"), F.lit("*"))),
    )
    found = rows.select("path", "specifier", F.explode(F.concat(F.filter(parts, lambda p: p.isNotNull()), named)).alias("b"))
    return found.select("path", "specifier", "b.*").distinct()


def heritage(files: DataFrame) -> DataFrame:
    """path, owner, relation (extends, implements), reference, form (identifier, member, dynamic); one row a name, without type arguments."""
    rows = heads(files).where("keyword in ('class', 'interface') and name is not null")
    body = F.array_min(_where(lambda t, i: (t["text"] == "{") & (t["kind"] == "open") & (t["up"] < 0) & (i > F.col("start"))))
    argument = lambda t: (t["text"].isin("<", ">") & (t["match"] >= 0)) | (t["up"] >= 0)
    kept = F.filter(F.slice("tokens", F.col("start") + 1, F.greatest(F.coalesce(body, F.size("tokens")) - F.col("start"), F.lit(0))), lambda t: ~argument(t))
    text = F.concat(F.lit(" "), F.array_join(F.transform(kept, lambda t: t["text"]), " "), F.lit(" "))
    rows = rows.select("path", F.col("name").alias("owner"), text.alias("head"))
    part = lambda relation, end: F.struct(F.lit(relation).alias("relation"), F.regexp_extract("head", rf" {relation} (.*?)(?: {end}|$)", 1).alias("names"))
    parts = rows.select("path", "owner", F.explode(F.array(part("extends", "implements "), part("implements", "extends "))).alias("p"))
    names = parts.select("path", "owner", "p.relation", F.explode(F.split("p.names", ",")).alias("reference")).withColumn("reference", F.replace(F.trim("reference"), F.lit(" "), F.lit("")))
    form = F.when(F.col("reference").rlike(rf"^{_NAME}$"), "identifier").when(F.col("reference").rlike(rf"^{_NAME}(\.{_NAME})+$"), "member").otherwise("dynamic")
    return names.where("reference <> ''").withColumn("form", form).distinct()


def _bound_names() -> Column:
    """Names that variables and parameters of a statement bind, wherever in it."""
    listed = lambda u: (
        ~_text(u - 1).isin(*_CONTROL)
        & (
            _text(_token(u)["match"] + 1).isin("=>", "{")
            | (F.coalesce(_token(u)["role"], F.lit("")) == "head")
            | (_text(u - 1) == "function") | (_text(u - 2) == "function") | ((_text(u - 2) == "*") & (_text(u - 3) == "function"))
            | ((_text(_token(u)["match"] + 1) == ":") & (_token(u - 1)["kind"] != "word") & ~_text(u - 1).isin("?", ")", "]"))
            | ((_text(_token(u)["match"] + 1) == ":") & _text(u - 2).isin("{", ",", "}", ";") & (_text(_token(u)["up"]) == "{"))
        )
    )
    parameter = lambda t, i: (t["up"] >= 0) & (_text(t["up"]) == "(") & _text(i - 1).isin("(", ",", "...", *MODIFIERS) & listed(t["up"])
    variable = lambda t, i: _text(i - 1).isin("const", "let", "var")
    bound = _where(lambda t, i: (t["kind"] == "word") & (variable(t, i) | (_text(i + 1) == "=>") | parameter(t, i)))
    return F.array_distinct(F.transform(bound, lambda i: _token(i)["text"]))


def call_sites(files: DataFrame) -> DataFrame:
    """path, n, line, column, owner, owner_kind, member, receiver, callee, form, shadowed: a row for each call and ``new``.

    Forms: identifier, member (receiver.callee), this-member, constructor, dynamic and dynamic-constructor; the last two have
    no callee (computed or longer chains, optional calls, calls of results). ``owner`` is the top-level declaration around the
    call, null where there is none, ``member`` the method of its class. ``shadowed``: a variable or parameter anywhere in the
    same top-level declaration binds the call's first name.
    """
    rows = heads(files).where("keyword is null or keyword not in ('interface', 'type')")
    open_ = lambda t, i: (t["kind"] == "open") & t["text"].isin("(", "`") & (i > 0) & (F.coalesce(t["role"], F.lit("")) != "head")
    opens = F.transform(_where(open_), lambda i: F.struct(i.alias("i"), F.when((_text(i - 1) == ">") & (_token(i - 1)["match"] >= 0), _token(i - 1)["match"] - 1).otherwise(i - 1).alias("j")))
    built = F.transform(_where(lambda t, i: (t["kind"] == "word") & (t["text"] == "new") & ~_text(i + 1).isin(".", ":", "(", ";", "=", "?", ",", ")", "") & (_text(i - 1) != ".") & t["role"].isNull()), lambda i: F.struct(i.alias("i"), (i + 1).alias("j")))
    dynamic_new = F.transform(_where(lambda t, i: (t["text"] == "new") & (t["kind"] == "word") & (_text(i + 1) == "(") & (_text(i - 1) != ".") & t["role"].isNull()), lambda i: F.struct(i.alias("i"), (i + 1).alias("j")))
    near = lambda c: F.struct(
        c["i"].alias("i"), _text(c["i"]).alias("at"), _token(c["j"])["kind"].alias("kind"), _text(c["j"]).alias("p"), _text(c["j"] - 1).alias("q"), _text(c["j"] - 2).alias("r"), _token(c["j"] - 2)["kind"].alias("r_kind"),
        _text(c["j"] - 3).alias("s"), _text(c["j"] + 1).alias("next"), _text(_token(c["i"])["match"] + 1).alias("after"), _text(_token(c["i"])["up"]).alias("around"), _text(_token(c["j"])["match"] - 1).alias("control"),
        _token(c["i"])["part"].alias("part"), _token(c["i"])["line"].alias("line"), _token(c["i"])["column"].alias("column"),
    )
    bound = F.col("keyword").isin("const", "let", "var")
    owners = F.when(bound, F.transform(_declarators(), lambda i: F.struct(i.alias("i"), _token(i)["text"].alias("name")))).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.col("name").alias("name"))))
    names = F.transform("members", lambda m: F.struct(m["part"].alias("part"), _token(m["at"])["text"].alias("name")))
    found = rows.select("path", "n", "keyword", owners.alias("owners"), names.alias("names"), _bound_names().alias("bound"), F.transform(F.concat(opens, built, dynamic_new), near).alias("sites"))
    # Exploded in a step of its own: what stands beside an explode is computed for each of its rows.
    found = found.select("path", "n", "keyword", "owners", "names", "bound", F.explode("sites").alias("c")).select("path", "n", "keyword", "owners", "names", "bound", "c.*")

    new = F.col("at") == "new"
    # Behind a dot any word is a name; some operators are names where no value stands before them.
    name = F.col("q").isin(".", "?.") | (F.col("p").isin("of", "is", "as", "satisfies") & ~F.col("q").rlike(r"[\w$)\]}\"]$"))
    word = (F.col("kind") == "word") & (~F.col("p").isin(*OPERATORS) | name)
    head = (F.col("q") == "function") | ((F.col("q") == "*") & (F.col("r") == "function")) | (F.col("after") == "{") | (
        (F.col("after") == ":") & (F.col("around") == "{") & F.col("q").isin("{", ",", ";", "}", "*", *MODIFIERS)
    ) | ((F.col("p") == "async") & (F.col("after") == "=>"))
    constructed = (F.col("q") == "new") | ((F.col("q") == ".") & (F.col("s") == "new"))
    simple = (F.col("q") == ".") & (F.col("r_kind") == "word") & ~F.col("s").isin(".", "?.")
    plain = F.when(head | constructed, None).when(F.col("p").isin("super", "import"), "dynamic").when(simple & (F.col("r") == "this"), "this-member").when(simple, "member").when(F.col("q").isin(".", "?."), "dynamic").otherwise("identifier")
    result = F.col("p").isin(")", "]", "?.") & (F.col("kind") != "string") & (F.col("after") != "{") & ~F.col("control").isin(*_CONTROL, "new")
    form = (
        F.when(new & (F.col("kind") == "word") & ~F.col("next").isin(".", "["), "constructor").when(new, "dynamic-constructor").when(word | (F.col("p") == "import"), plain)
        .when((F.col("at") == "(") & result, "dynamic")
    )
    receiver = F.when(form.isin("member", "this-member"), F.col("r"))
    callee = F.when(form.isin("identifier", "member", "this-member", "constructor"), F.replace("p", F.lit("#"), F.lit("")))
    owner = F.filter("owners", lambda o: o["i"] <= F.col("i"))
    owned = F.when(F.size(owner) > 0, F.element_at(owner, -1)["name"])
    kind = F.when(F.col("keyword").isin("const", "let", "var"), "variable").otherwise(F.col("keyword"))
    member = F.get(F.filter("names", lambda m: (m["part"] == F.col("part")) & (F.col("part") >= 0)), 0)["name"]
    out = found.withColumn("form", form).where("form is not null").select(
        "path", "n", "line", "column", owned.alias("owner"), F.when(owned.isNotNull(), kind).alias("owner_kind"), F.replace(member, F.lit("#"), F.lit("")).alias("member"),
        receiver.alias("receiver"), callee.alias("callee"), "form", F.coalesce(owned.isNotNull() & F.array_contains("bound", F.coalesce(receiver, callee)), F.lit(False)).alias("shadowed"),
    )
    return out


def calls(files: DataFrame) -> DataFrame:
    """path, receiver, callee, constructs, occurrence_count, of the calls that aren't dynamic."""
    rows = call_sites(files).where("callee is not null").select("path", "receiver", "callee", (F.col("form") == "constructor").alias("constructs"))
    return rows.groupBy("path", "receiver", "callee", "constructs").agg(F.count("*").alias("occurrence_count"))


def exports(files: DataFrame) -> DataFrame:
    """module, name, source_module (a specifier), source_name: local exports (no source), re-exports and ``*``, as export_closure reads them once sources are resolved.

    Local exports are declarations, the names of clauses, default expressions and unpacked names, with their local name as
    source_name where that is another; ``* as ns`` exports ns.
    """
    nothing = F.lit(None).cast("string")
    local = lambda rows: rows.select(F.col("path").alias("module"), "name", nothing.alias("source_module"), nothing.alias("source_name"))
    declared = local(declarations(files).where("exported").select("path", F.when(F.col("is_default"), "default").otherwise(F.col("name")).alias("name")))
    renamed = lambda rows: rows.select(F.col("path").alias("module"), "name", nothing.alias("source_module"), F.when(F.col("own") != F.col("name"), F.col("own")).alias("source_name"))
    rows = heads(files).where("exported")
    sourced = F.size(_where(lambda t, i: (t["kind"] == "string") & (t["up"] < 0) & (_text(i - 1) == "from"))) > 0
    clause = F.regexp_extract(_joined(F.col("start") + 1, F.size("tokens")), r"^export (?:type )?\{ ?([^}]*)\}", 1)
    listed = rows.where(F.col("head").rlike(r"^export (type )?\{")).where(~sourced).select("path", F.explode(F.filter(F.split(clause, ","), lambda b: F.trim(b) != "")).alias("b"))
    own = F.regexp_extract(F.trim("b"), rf"^{_BINDING}", 2)
    clauses = renamed(listed.select("path", own.alias("own"), F.coalesce(_filled(F.regexp_extract(F.trim("b"), rf"^{_BINDING}", 3)), own).alias("name")))
    value = _filled(F.regexp_extract("head", rf"^export default ({_NAME})(?: ;)?$", 1))
    default = renamed(rows.where("is_default and keyword is null").select("path", F.lit("default").alias("name"), value.alias("own")))
    # a, a: b, a = 1, ...rest: the local name is the last one before a default value.
    pattern = rows.where("keyword in ('const', 'let', 'var')").where(_text(F.col("start") + 2).isin("{", "["))
    inside = lambda t: t["up"] == F.col("start") + 2
    last = _where(lambda t, i: (t["kind"] == "word") & inside(t) & _text(i + 1).isin(",", "=", "}", "]") & _text(i - 1).isin("{", "[", ",", ":", "..."))
    unpacked = local(pattern.select("path", F.transform(last, lambda i: _token(i)["text"]).alias("names")).select("path", F.explode("names").alias("name")))
    again = imports(files).where("kind in ('re-export', 'export-all', 'namespace-export')").select(
        F.col("path").alias("module"), F.col("local_name").alias("name"), F.col("specifier").alias("source_module"), F.col("imported_name").alias("source_name"),
    )
    return declared.unionByName(clauses).unionByName(default).unionByName(unpacked).unionByName(again).distinct()
