"""Tokens of TypeScript and JavaScript sources: one pass over a text, one row for each top-level statement.

A token has its kind, its text without quotes, where it stands, how deep and in which bracket, and the bracket's other end.
Comments and blanks leave no token. Inside a class or interface, ``part`` is the first token of the member. All facts are
column expressions over these rows; what they need of a source's structure is here and nowhere else.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of tokens: word, string, number, regex, template and jsx (pieces of text), open, close, punct, broken.
TOKEN = "struct<kind:string,text:string,line:int,column:int,depth:int,up:int,match:int,part:int,role:string>"
MEMBER = "struct<at:int,part:int,end:int,bracket:int>"
SCHEMA = f"path string, n int, start int, members array<{MEMBER}>, tokens array<{TOKEN}>"

_CODE = re.compile(
    r"""(?P<blank>(?:\s|//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/)+)
    |(?P<string>"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+')
    |(?P<number>\d[\w.]*|\.\d[\w.]*)
    |(?P<word>\#?[A-Za-z_$ª-\U0010ffff][\w$]*)
    |(?P<open>[(\[{`])|(?P<close>[)\]}])
    |(?P<broken>["']|/\*)
    |(?P<punct>\.\.\.|=>|\?\.(?!\d)|[=!]==?|.)""",
    re.X | re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"((?:[^`\\$]|\\.|\$(?!\{))*+)(`|\$\{|\Z)", re.S)
_TAG = re.compile(r"""(?P<blank>\s+)|(?P<jsx>[\w$.:\-]+|=)|(?P<string>"[^"]*+"|'[^']*+')|(?P<open>\{)|(?P<end>/>|>)|(?P<broken>.)""", re.S)
_ELEMENT = re.compile(r"<(?=[A-Za-z_$>])(?![A-Za-z_$][\w$]*\s*(?:,|extends\b))")
_CLOSES = {"(": ")", "[": "]", "{": "}", "${": "}", "`": "`", "<": "</>"}

#: Words after which an expression goes on, so that they are no value, end no statement and aren't called.
OPERATORS = (
    "return typeof await void delete in of instanceof new case do else yield throw as satisfies extends implements keyof is infer "
    "if for while switch catch with function import export default const let var"
).split()
_GOES_ON = {"extends", "implements", "as", "in", "of", "instanceof", "satisfies", "is", "from", "else", "catch", "finally"}
_HOLDS_ON = {
    *OPERATORS, "declare", "abstract", "async", "class", "interface", "type", "enum", "namespace", "module", "static", "public",
    "private", "protected", "readonly", "override", "get", "set",
}
_BLOCKS = {"function", "class", "interface", "enum", "namespace", "module", "if", "for", "while", "switch", "try", "do", "{"}
MODIFIERS = ("public", "private", "protected", "static", "async", "readonly", "override", "abstract", "get", "set", "declare", "accessor")
_IN_TYPES = set(". , | & ? : => [ ] { } ( ) -".split())


class Source:
    """The tokens of one text as parallel lists."""

    def __init__(self, text: str, jsx: bool):
        self.kind: list[str] = []
        self.text: list[str] = []
        self.start: list[int] = []
        self._lex(text, jsx)
        n = len(self.kind)
        line, at, breaks = 1, 0, []
        self.line, self.column = [], []
        for s in self.start:
            seen = text.count("\n", at, s)
            breaks.append(seen > 0)
            line += seen
            at = s
            self.line.append(line)
            self.column.append(s - text.rfind("\n", 0, s) - 1)
        self.newline = breaks
        self.up, self.match, self.depth = [-1] * n, [-1] * n, [0] * n
        self._nest()

    def _add(self, kind: str, text: str, at: int) -> None:
        self.kind.append(kind)
        self.text.append(text)
        self.start.append(at)

    def _after_value(self) -> bool:
        """Whether the last token ends a value, so that a slash divides and an angle bracket compares."""
        if not self.kind:
            return False
        kind, text = self.kind[-1], self.text[-1]
        return kind in ("string", "number", "regex") or (kind == "close" and text != "}") or (kind == "word" and text not in OPERATORS)

    def _lex(self, text: str, jsx: bool) -> None:
        modes, pos = [["code", 0]], 0  # a mode, and how many braces are open in it
        while pos < len(text):
            mode = modes[-1]
            if mode[0] == "template":
                m = _TEMPLATE.match(text, pos)
                if m[1]:
                    self._add("template", m[1], pos)
                if m[2] == "`":
                    self._add("close", "`", m.end() - 1)
                    modes.pop()
                elif m[2]:
                    self._add("open", "${", m.end() - 2)
                    modes.append(["code", 0])
                pos = m.end()
            elif mode[0] == "text":
                end = min((x for x in (text.find("<", pos), text.find("{", pos)) if x >= 0), default=len(text))
                if text[pos:end].strip():
                    self._add("jsx", " ".join(text[pos:end].split()), pos)
                pos = end
                if text.startswith("</", pos):
                    end = text.find(">", pos)
                    self._add("close", "</>", pos)
                    modes.pop()
                    pos = end + 1 if end >= 0 else len(text)
                elif pos < len(text):
                    self._add("open", text[pos], pos)
                    modes.append(["tag", 0] if text[pos] == "<" else ["code", 0])
                    pos += 1
            elif mode[0] == "tag":
                m = _TAG.match(text, pos)
                if m.lastgroup == "open":
                    self._add("open", "{", pos)
                    modes.append(["code", 0])
                elif m.lastgroup == "end" and m[0] == "/>":
                    self._add("close", "</>", pos)
                    modes.pop()
                elif m.lastgroup == "end":
                    self._add("jsx", ">", pos)
                    mode[0] = "text"
                elif m.lastgroup != "blank":
                    self._add(m.lastgroup, m[0][1:-1] if m.lastgroup == "string" else m[0], pos)
                pos = m.end()
            else:
                m = (_REGEX.match(text, pos) if text[pos] == "/" and not self._after_value() else None) or None
                element = _ELEMENT.match(text, pos) if jsx and text[pos] == "<" and not self._after_value() else None
                if m:
                    self._add("regex", m[0], pos)
                elif element:
                    self._add("open", "<", pos)
                    modes.append(["tag", 0])
                    pos += 1
                    continue
                else:
                    m = _CODE.match(text, pos)
                    kind = m.lastgroup
                    if kind == "string":
                        self._add(kind, m[0][1:-1], pos)
                    elif kind != "blank":
                        self._add(kind, m[0], pos)
                    if m[0] == "`":
                        modes.append(["template", 0])
                    elif m[0] == "{":
                        mode[1] += 1
                    elif m[0] == "}":
                        mode[1] -= 1
                        if mode[1] < 0:
                            mode[1] = 0
                            if len(modes) > 1:
                                modes.pop()
                pos = m.end()

    def _nest(self) -> None:
        """Pairs brackets, and the angle brackets of type arguments. An import or export at the left edge ends what is still open."""
        stack: list[int] = []
        closers: Counter = Counter()  # the closers that what is open waits for
        angles: list[list[int]] = [[]]  # for each open bracket, the angle brackets that may open type arguments in it
        pairs = []
        for i, (kind, text) in enumerate(zip(self.kind, self.text, strict=True)):
            if stack and kind == "word" and text in ("import", "export") and self.column[i] == 0 and self.newline[i]:
                stack, angles = [], [[]]
                closers.clear()
            if kind == "close" and closers[text]:
                found = False
                while not found:
                    o = stack.pop()
                    angles.pop()
                    found = _CLOSES[self.text[o]] == text
                    closers[_CLOSES[self.text[o]]] -= 1
                self.match[o], self.match[i] = i, o
            self.up[i] = stack[-1] if stack else -1
            self.depth[i] = len(stack)
            if kind == "open":
                stack.append(i)
                angles.append([])
                closers[_CLOSES[text]] += 1
            elif kind == "punct":
                own = angles[-1]
                if text == "<" and i and self.kind[i - 1] == "word" and self.text[i - 1] not in OPERATORS:
                    own.append(i)
                elif text == ">" and own:
                    pairs.append((own.pop(), i))
                elif text not in _IN_TYPES and text != "<":
                    own.clear()
        for o, i in pairs:
            kind, text = (self.kind[i + 1], self.text[i + 1]) if i + 1 < len(self.kind) else ("punct", "")
            if kind not in ("number", "string", "regex") and (kind != "word" or text in _GOES_ON or self.newline[i + 1]):
                self.match[o], self.match[i] = i, o
        brackets, inside = list(self.up), []
        for i in range(len(self.kind)):
            if inside and self.match[inside[-1]] == i:
                inside.pop()
            if inside and brackets[i] == brackets[inside[-1]]:
                self.up[i] = inside[-1]
            if self.kind[i] == "punct" and self.text[i] == "<" and self.match[i] > i:
                inside.append(i)

    def _undecorated(self, i: int, end: int) -> int:
        """The first token behind decorators."""
        while i + 1 < end and self.text[i] == "@":
            i += 2
            while i + 1 < end and self.text[i] == ".":
                i += 2
            if i < end and self.text[i] == "(" and self.match[i] > i:
                i = self.match[i] + 1
        return i

    def _begins(self, i: int, first: int, block: bool) -> bool:
        """Whether what began at ``first`` ends before token i of the same level. ``block``: a brace may end it in mid-line."""
        p, kind, text = i - 1, self.kind[i], self.text[i]
        if self.text[p] == ";" and self.kind[p] == "punct":
            return True
        if i <= self._undecorated(first, i):
            return False
        if kind == "word" and text in ("import", "export") and self.column[i] == 0 and self.newline[i]:
            return True
        if self.text[p] == "from" and self.text[self._undecorated(first, i)] in ("import", "export"):
            return False
        if (kind == "word" and text in _GOES_ON) or (text == "while" and self.text[first] == "do"):
            return False
        value = kind in ("word", "string", "number") or text == "@"
        if self.kind[p] == "close" and self.text[p] == "}":
            return (block or self.newline[i]) and (value or text in ("[", "*", "(") or (text == "{" and self.newline[i]))
        ends = self.kind[p] in ("string", "number", "regex", "close") or (self.kind[p] == "word" and self.text[p] not in _HOLDS_ON)
        return self.newline[i] and ends and value

    def statements(self) -> Iterator[tuple[int, int]]:
        """(first token, end) of the top-level statements."""
        first = 0
        block = self._is_block(0)
        for i in range(1, len(self.kind)):
            if self.up[i] < 0 and self.kind[i] != "close" and self._begins(i, first, block):
                yield first, i
                first, block = i, self._is_block(i)
        if self.kind:
            yield first, len(self.kind)

    def _is_block(self, i: int) -> bool:
        i = self._undecorated(i, len(self.kind))
        for j in range(i, min(i + 5, len(self.kind))):
            if self.text[j] in _BLOCKS and self.kind[j] in ("word", "open"):
                return self.text[j] != "{" or j == i
            if self.kind[j] != "word":
                return False
        return False

    def members(self, first: int, end: int) -> tuple[list[int], list[str | None], list[dict]]:
        """Of a class's or interface's tokens: the part of each, roles, and the methods (places of name, first token, end, bracket)."""
        parts: list[int] = [-1] * (end - first)
        roles: list[str | None] = [None] * (end - first)
        found: list[dict] = []
        at = self._undecorated(first, end)
        while at < end and self.text[at] in ("export", "default", "declare", "abstract"):
            at += 1
        body = next((j for j in range(at, end) if self.text[j] == "{" and self.up[j] < 0), None)
        if body is None or self.text[at] not in ("class", "interface"):
            return parts, roles, found
        stop = self.match[body] if self.match[body] > body else end
        part, assigned = -1, False
        for i in range(body + 1, stop):
            if self.up[i] == body and self.kind[i] != "close" and self.text[i] not in (";", ","):
                if part < 0 or self.text[i - 1] == "," or self._begins(i, part, not assigned):
                    if found and found[-1]["end"] < 0:
                        found[-1]["end"] = i - first
                    part, assigned = i, False
                    found += self._name(i, stop, first, roles)
                assigned = assigned or self.text[i] == "="
            parts[i - first] = part - first if part >= 0 else -1
        if found and found[-1]["end"] < 0:
            found[-1]["end"] = stop - first
        return parts, roles, found

    def _name(self, i: int, stop: int, first: int, roles: list) -> list[dict]:
        at = self._undecorated(i, stop)
        named = lambda j: j < stop and (self.kind[j] in ("word", "string", "number") or self.text[j] in ("[", "*"))
        while at < stop and (self.text[at] == "*" or (self.text[at] in MODIFIERS and named(at + 1))):
            at += 1
        if at >= stop:
            return []
        if self.text[at] == "[" or self.kind[at] in ("string", "number"):
            roles[at - first] = "computed"
        behind = (self.match[at] if self.text[at] == "[" and self.match[at] > at else at) + 1
        while behind < stop and self.text[behind] in ("?", "!"):
            behind += 1
        if behind < stop and self.text[behind] == "<" and self.match[behind] > behind:
            behind = self.match[behind] + 1
        method = behind < stop and self.text[behind] == "("
        if method:
            roles[behind - first] = "head"
        if self.kind[at] != "word":
            return []
        roles[at - first] = "member" if method else "field"
        return [{"at": at - first, "part": i - first, "end": -1, "bracket": behind - first}] if method else []

    def rows(self) -> Iterator[tuple[int, list[dict], list[dict]]]:
        """(start, members, tokens) of each statement."""
        for first, end in self.statements():
            parts, roles, found = self.members(first, end)
            near = lambda j: j - first if first <= j < end else -1
            tokens = [
                {
                    "kind": self.kind[i], "text": self.text[i], "line": self.line[i], "column": self.column[i], "depth": self.depth[i],
                    "up": near(self.up[i]), "match": near(self.match[i]), "part": parts[i - first], "role": roles[i - first],
                }
                for i in range(first, end)
            ]
            yield min(self._undecorated(first, end), end - 1) - first, found, tokens


def tokenize(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, n, start, members, tokens: a row for each top-level statement of a source, in order; a null, empty or blank text has none.

    Positions in ``tokens`` count from the statement's start: ``up`` is the bracket around a token, ``match`` a bracket's other
    end, ``part`` the first token of the member around it, each -1 where there is none. ``role`` is, in
    classes and interfaces, member, field, computed (names) or head (a member's bracket). ``start`` is the first token behind
    decorators, ``members`` are the methods: places of the name, of the first token, of the end and of the bracket. Lines count from 1, columns from 0.
    Sources of the ending .ts have no JSX, all others may have. Other columns are ignored; repeated rows are sources each.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member = pa.struct([(n, pa.int32()) for n in ("at", "part", "end", "bracket")])
        token = pa.struct([(n, pa.string() if n in ("kind", "text", "role") else pa.int32()) for n in "kind text line column depth up match part role".split()])
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = list(Source(content.as_py(), not (name or "").lower().endswith(".ts")).rows())
                if rows:
                    start, members, tokens = zip(*rows, strict=True)
                    made = [pa.array(range(len(rows)), pa.int32()), pa.array(start, pa.int32()), pa.array(members, pa.list_(member)), pa.array(tokens, pa.list_(token))]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *made], names=["path", "n", "start", "members", "tokens"])

    return files.where(F.col(text).isNotNull()).select(F.col(path).alias("path"), F.col(text).alias("text")).mapInArrow(read, SCHEMA)


def statements(files: DataFrame) -> DataFrame:
    """The rows of :func:`tokenize`, for sources (path, text) as for rows that it has already made."""
    return files if "tokens" in files.columns else tokenize(files)


def token_table(files: DataFrame) -> DataFrame:
    """path, n (of the statement), i (in it), kind, text, line, column, depth: a row for each token."""
    found = statements(files).select("path", "n", F.posexplode("tokens").alias("i", "t"))
    return found.select("path", "n", "i", *[f"t.{c}" for c in ("kind", "text", "line", "column", "depth")])


def canonical(tokens: Column) -> Column:
    """SHA-256 over kinds and texts of tokens: comments, blanks and the sort of quotes don't count, all else does."""
    kind = lambda t: F.when(t["kind"].isin("word", "punct", "open", "close"), "").otherwise(t["kind"])
    return F.sha2(F.array_join(F.transform(tokens, lambda t: F.concat(kind(t), F.lit(":"), t["text"])), "\0"), 256)


def source_hashes(files: DataFrame) -> DataFrame:
    """path, n_tokens, canonical_fingerprint of each source that has tokens: the hashes of its statements in order, hashed."""
    rows = statements(files).select("path", "n", F.size("tokens").alias("size"), canonical(F.col("tokens")).alias("hash"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "hash"))), lambda s: s["hash"]), "\0")
    return rows.groupBy("path").agg(F.sum("size").alias("n_tokens"), F.sha2(listed, 256).alias("canonical_fingerprint"))


#: How brackets are written where only they count: openers by their first character, closers by one that is theirs alone.
_CLOSER = {")": ")", "]": "]", "}": "}", "`": "'", "</>": ">"}
_PAIRS = ("()", "[]", "{}", "$}", "`'", "<>")


def _reduced(brackets: Column) -> Column:
    """What is left of an array of brackets when pairs go, again and again. Stretches may be reduced first, in any grouping."""
    pair = lambda left, c: F.concat(F.right(left, F.lit(1)), c).isin(*_PAIRS)
    return F.aggregate(brackets, F.lit(""), lambda left, c: F.when(pair(left, c), F.left(left, F.length(left) - 1)).otherwise(F.concat(left, c)))


def bracket_balance(files: DataFrame) -> DataFrame:
    """path, unmatched (what is left of its brackets), recovered, first_break (line), for each source that has tokens.

    A source is recovered if brackets are left or a literal or comment has no end; what stands before ``first_break`` is sound.
    Statements are reduced on their own, and only what is left of them meets in the source's sum.
    """
    closers = F.create_map(*[F.lit(x) for pair in _CLOSER.items() for x in pair])
    bracket = lambda t: F.when(t["kind"] == "open", F.left(t["text"], F.lit(1))).otherwise(F.element_at(closers, t["text"]))
    only = F.transform(F.filter("tokens", lambda t: t["kind"].isin("open", "close")), bracket)
    broken = F.filter("tokens", lambda t: t["kind"] == "broken")
    lonely = F.filter("tokens", lambda t: t["kind"].isin("open", "close") & (t["match"] < 0))
    rows = statements(files).select("path", "n", _reduced(only).alias("left"), F.array_min(F.transform(F.concat(broken, lonely), lambda t: t["line"])).alias("line"))
    left = F.array_sort(F.collect_list(F.when(F.col("left") != "", F.struct("n", "left"))))
    summed = rows.groupBy("path").agg(F.array_join(F.transform(left, lambda s: s["left"]), "").alias("left"), F.min("line").alias("first_break"))
    unmatched = _reduced(F.filter(F.split("left", ""), lambda c: c != ""))
    return summed.select("path", unmatched.alias("unmatched"), F.col("first_break").isNotNull().alias("recovered"), "first_break")
