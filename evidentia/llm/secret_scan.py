"""Secret scans: candidate strings in texts, and a random forest that removes false positives.

Candidates are long runs of key characters, cut at assignments so that a name is not part of its value, whole web tokens, and
values assigned to names like password, secret or token, however short and with any characters. Each is described by its length, the transitions between character classes, how
much of it dictionary words cover, its path and the neighbouring words. The forest is trained from labelled findings;
without any of one's own, :func:`example_findings` generates labelled ones by rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.textstats import put_back, set_aside

#: Runs of at least 16 key characters; the same patterns serve Spark (to skip texts) and the scan.
CANDIDATE = r"[A-Za-z0-9+/_=\-]{16,}"
#: A name of a secret up to where its value starts.
ASSIGNMENT = (
    r"(?:(?:passw(?:or)?d|passphrase|pwd|secret|token|credentials?|apikey|(?:api|access|private|secret|auth|account|signing|encryption)[ _.\-]?key)"
    r"(?:\\?[\"'])?[ \t]*(?:=>|:=|==?|:)|authorization(?:\\?[\"'])?[ \t]*[:=][ \t]*(?:\\?[\"'])?(?:bearer|basic|token)[ \t])[ \t]*"
)
# Its value: quoted, in escaped quotes, or up to white space, a quote or the next assignment.
_VALUE = r"""(?:"((?:[^"\\\r\n]|\\.){4,})"|'((?:[^'\\\r\n]|\\.){4,})'|\\"([^"\r\n]{4,}?)\\"|\\?["'`]?((?:(?![&,;|][A-Za-z0-9_.\-]+["']?[=:])[^\x00-\x20"'`<>]){4,}))"""
_CANDIDATE = re.compile(CANDIDATE)
_PART = re.compile(r"[^=]+(?:=+\Z)?")
_WEB_TOKEN = re.compile(r"eyJ[A-Za-z0-9_\-]{8,}(?:\.[A-Za-z0-9_\-]+){1,4}")
_ASSIGNED = re.compile(ASSIGNMENT + _VALUE, re.IGNORECASE | re.ASCII)
_WORD = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

# Fixed word lists.
SECRET_WORDS = "api apikey auth authorization aws bearer client credential credentials key passwd password private pwd secret signature token".split()
SECRET_ENDINGS = ("apikey", "password", "passwd", "passphrase", "secret", "token")
BENIGN_WORDS = "build checksum commit digest etag example fingerprint hash id integrity md5 module path revision sha sha1 sha256 test uuid version".split()
BENIGN_PATHS = "doc example fixture lock mock sample test vendor".split()
DICTIONARY = (
    "able access account action address age analysis application are area array base behavior build button call cation change class client code color command common config connect "
    "content control copy count data date default description development directory dist document element engine entity environment error event example field file filter format "
    "function general get group handler have height here image import index info information input insert instance integer interface internal item key language length level library line "
    "link list local manager map message method model module name network node not number object option order package page parameter parent path pattern plate point position post "
    "process product project property query read record reference region register report request resource response result return review root router rule sample schema script search "
    "section select self server service session set setting size source space state status storage stream string structure style system table tag target task template test text the time "
    "title tree type update upload user value variable version view web width window with word work write your").split()
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "glpat-", "sk_live_", "sk-", "xoxb-", "xoxp-", "AIza", "npm_", "eyJ")
FEATURES = ("length", "digits", "uppers", "symbols", "transitions", "letter_digit", "case_changes", "distinct", "entropy", "hex", "vowels", "dictionary", "prefix", "secret_words", "benign_words", "assigned", "quoted", "benign_path")


def candidate_spans(text: str) -> list[tuple[int, int]]:
    """Distinct (start, end) of the candidates in a text, in order; they may overlap.

    A run is cut at its assignments, and its parts of at least 16 characters are candidates. Where the last part is
    shorter, the whole run is one, too.
    """
    found = {m.span() for m in _WEB_TOKEN.finditer(text)}
    for m in _CANDIDATE.finditer(text):
        parts = [(m.start() + p.start(), m.start() + p.end()) for p in _PART.finditer(m[0])]
        found.update((a, b) for a, b in parts if b - a >= 16)
        if not parts or parts[-1][1] - parts[-1][0] < 16:
            found.add(m.span())
    for m in _ASSIGNED.finditer(text):
        a, b = m.span(m.lastindex)
        if m.lastindex == 4:
            b = a + len(m[4].rstrip(".,;:)]}"))
        if b - a >= 4:
            found.add((a, b))
    return sorted(found)


def features(candidate: str, before: str, after: str, path: str) -> list[float]:
    """One row of FEATURES; ``before`` and ``after`` are the text around the candidate."""
    n = len(candidate)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s" for c in candidate]
    pairs = list(zip(kinds, kinds[1:], strict=False))
    counts = np.unique(list(candidate), return_counts=True)[1] / n
    low, covered = candidate.lower(), 0
    for word in sorted(DICTIONARY, key=len, reverse=True):
        if len(word) > 2 and word in low:
            covered += low.count(word) * len(word)
            low = low.replace(word, "\0")
    near = [w.lower() for w in _WORD.findall(_CAMEL.sub(" ", before[-60:]))[-4:]]
    tail = before[-4:].rstrip()
    return [
        min(n, 200), kinds.count("d") / n, kinds.count("u") / n, kinds.count("s") / n, sum(a != b for a, b in pairs) / n, sum({a, b} in ({"l", "d"}, {"u", "d"}) for a, b in pairs) / n,
        sum({a, b} == {"l", "u"} for a, b in pairs) / n, len(counts) / min(n, 64), float(-(counts * np.log2(counts)).sum()), sum(c in "0123456789abcdefABCDEF" for c in candidate) / n,
        sum(c in "aeiouAEIOU" for c in candidate) / max(1, kinds.count("l") + kinds.count("u")), min(covered, n) / n, float(candidate.startswith(PREFIXES)),
        float(sum(w in SECRET_WORDS or w.endswith(SECRET_ENDINGS) for w in near)), float(sum(w in BENIGN_WORDS for w in near)), float(tail.rstrip("\"'").rstrip().endswith(("=", ":", "=>"))),
        float(tail.endswith(('"', "'")) and after[:1] in ('"', "'")), float(any(w in (path or "").lower() for w in BENIGN_PATHS)),
    ]


def example_findings(rows: int = 3000, seed: int = 11) -> pd.DataFrame:
    """Labelled findings by rule: candidate, before, after, path, label (1: a secret)."""
    rng = np.random.default_rng(seed)
    pick = lambda values: values[int(rng.integers(len(values)))]
    chars = lambda alphabet, n: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))
    hexes, alnum = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    syllables = "an be ch de ei en er es ge he ie in ing ion is it ly ment ne nd on or ou que re sch st te th ti tion tre un und ver".split()
    prose = lambda n: " ".join("".join(pick(syllables) for _ in range(int(rng.integers(1, 4)))) for _ in range(n))
    names = "password passwd pwd passphrase secret token api_key".split()
    out = []
    for _ in range(rows):
        label = int(rng.integers(2))
        quote, path = pick(['"', "'", ""]), pick(["src0", "src7", "app/config.py", "deploy/prod.env", "web/index.js", "crawl"])
        assign = pick([" = ", "=", ": ", " : "])
        if label:
            candidate = [
                lambda: chars(hexes, pick([32, 40, 48, 64])), lambda: chars(hexes.upper(), pick([32, 40, 64])), lambda: chars(alnum, int(rng.integers(20, 64))),
                lambda: pick(PREFIXES[:-1]) + chars(alnum, int(rng.integers(20, 40))), lambda: chars(alnum + "+/", 40) + pick(["", "=", "=="]),
            ][int(rng.integers(5))]()
            word = pick(SECRET_WORDS)
            before = prose(5) + " " + pick([word, word.upper(), f"my_{word}"]) + assign + quote
            form = int(rng.integers(6))
            if form == 0:  # a short or punctuated value of a name
                word = "".join(pick(syllables) for _ in range(int(rng.integers(1, 5))))
                candidate = [
                    lambda: word + chars("0123456789", int(rng.integers(1, 5))) + pick(["", *syllables]), lambda: word.capitalize() + pick("@!.&:#$%*") + chars(alnum, int(rng.integers(3, 9))),
                    lambda: chars(alnum + "@!.&:#$%*", int(rng.integers(8, 20))), lambda: word + pick("@!.&:#$%") + pick(syllables) + chars("0123456789", 2) + pick(["", "!", "?"]),
                ][int(rng.integers(4))]().ljust(6, "7")
                before = prose(4) + " " + pick(["", "db_", "my_", "?", "&", "export "]) + pick(names) + assign + quote
            elif form == 1:  # unspaced assignments in shells and addresses
                quote = ""
                before = prose(3) + pick([" ", " export ", " https://web/page?", " https://web/page?user=1&", " --"]) + pick([*names, "API_KEY", "access_token", "AUTH_TOKEN", "AWS_SECRET_ACCESS_KEY", "client_secret"]) + "="
            elif form == 2:  # bare keys that their prefix tells, and web tokens
                quote = pick(["", "", '"'])
                web = "eyJ" + chars(alnum, int(rng.integers(15, 60))) + "." + "eyJ" + chars(alnum, int(rng.integers(15, 90))) + "." + chars(alnum + "_-", 43)
                candidate = pick([pick(PREFIXES[:-1]) + chars(alnum, int(rng.integers(20, 40))), pick(["AKIA", "ASIA"]) + chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), web])
                before = prose(5) + pick([" ", ": ", " = ", "=", " Authorization: Bearer "]) + quote
        else:
            kind = int(rng.integers(9))
            benign = pick(BENIGN_WORDS)
            if kind == 0:
                candidate, before = (w := "".join(pick(syllables) for _ in range(12))[: int(rng.integers(16, 30))]), prose(6) + " "
                candidate = pick([w, w.upper(), w.capitalize()])
            elif kind == 1:
                candidate, before = pick(["_", "-", "/"]).join(pick(DICTIONARY) for _ in range(int(rng.integers(4, 7)))), prose(4) + pick([" ", " = "])
            elif kind == 2:
                candidate, before = chars(hexes, pick([32, 40, 64])), f"{prose(3)} {benign}{pick([' ', ': ', ' = '])}"
            elif kind == 3:
                h = chars(hexes, 32)
                candidate, before = f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", f"{prose(3)} {pick(['id', 'uuid', 'request'])}{assign}{quote}"
            elif kind == 4:
                filler = pick(["x" * 24, "0" * 32, "your-api-key-goes-here", "EXAMPLE-KEY-EXAMPLE", "changeme-changeme-changeme", "1234567890123456", "=" * 30, "-" * 40, "_" * 24])
                candidate, before = filler, prose(3) + " " + pick(SECRET_WORDS) + assign + quote
            elif kind == 6:  # words, code and placeholders as the value of a name
                candidate = pick([pick(DICTIONARY), pick(syllables) + pick(syllables) + pick(syllables), f"{pick(DICTIONARY)}.{pick(DICTIONARY)}", f"{pick(DICTIONARY)}{pick(DICTIONARY).capitalize()}(",
                    f"{pick(DICTIONARY)}_{pick(names)}", "${" + pick(names).upper() + "}", "{{" + pick(names), "*" * 8, "xxxxxxxx", "null", "None", "true", "changeme", "required", "string", f"your-{pick(names)}", "os.environ", "process.env.TOKEN", "oauth2", "%(value)s", "..."])
                before = prose(3) + " " + pick(["", "db_", "my_", "the "]) + pick(names) + assign + quote
            elif kind == 7:  # unspaced assignments of what is no secret
                quote = ""
                candidate = pick([chars(hexes, 32), chars(hexes, 40), chars(alnum, 24), "_".join(pick(DICTIONARY) for _ in range(4)), "/".join(pick(DICTIONARY) for _ in range(4))])
                before = prose(3) + pick([" ", " https://web/page?", " --"]) + pick([*BENIGN_WORDS, "page", "name", "ref"]) + "="
            elif kind == 8:  # names of secrets, with or without a value
                candidate, before = pick([f"my_{pick(DICTIONARY)}_{pick(names)}", f"{pick(DICTIONARY)}_{pick(DICTIONARY)}_{pick(names)}".upper(), f"{pick(DICTIONARY)}_{pick(names)}=", f"{pick(names)}={pick(DICTIONARY)}"]), prose(3) + pick([" ", " export ", "?"])
            else:
                candidate, before, path = chars(alnum, int(rng.integers(20, 40))), prose(3) + f" {pick(SECRET_WORDS)}{assign}{quote}", f"{pick(BENIGN_PATHS)}s/{prose(1)}.txt"
            if kind not in (6, 8):
                candidate = candidate.ljust(16, "e")
        out.append((candidate, before, quote + " " + prose(2), path, label))
    return pd.DataFrame(out, columns=["candidate", "before", "after", "path", "label"])


class Forest:
    """Gini trees on bootstrap rows and random halves of the features at every node; the score is their mean share of label 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 9, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            nodes: list[list] = []
            self._grow(x, y, rng.integers(0, len(y), len(y)), depth, rng, nodes)
            self.trees.append(tuple(np.array(c) for c in zip(*nodes, strict=True)))
        self.depth = depth

    def _grow(self, x, y, rows, depth, rng, nodes) -> int:
        at, total, n = len(nodes), y[rows].sum(), len(rows)
        nodes.append([0, np.inf, at, at, total / n])  # feature, threshold, left, right, share
        best = (1e-9, 0, np.inf)
        if depth and 0 < total < n:
            for f in rng.permutation(x.shape[1])[: x.shape[1] // 2]:
                order = np.argsort(x[rows, f], kind="stable")
                v, ones = x[rows, f][order], np.cumsum(y[rows][order])
                cut = np.flatnonzero(v[1:] > v[:-1])
                if len(cut):
                    left, hits = cut + 1, ones[cut]
                    gain = total * (n - total) / n - hits * (left - hits) / left - (total - hits) * (n - left - total + hits) / (n - left)
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (gain[i], int(f), float((v[cut[i]] + v[cut[i] + 1]) / 2))
        if best[2] < np.inf:
            low = x[rows, best[1]] <= best[2]
            nodes[at][:2] = best[1:]
            nodes[at][2] = self._grow(x, y, rows[low], depth - 1, rng, nodes)
            nodes[at][3] = self._grow(x, y, rows[~low], depth - 1, rng, nodes)
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth + 1):
                at = np.where(x[np.arange(len(x)), feature[at]] <= threshold[at], left[at], right[at])
            total += share[at]
        return total / len(self.trees)


def train(findings: pd.DataFrame | None = None) -> Forest:
    """A forest from labelled findings (candidate, before, after, path, label), which the driver holds."""
    findings = example_findings() if findings is None else findings
    rows = zip(findings["candidate"], findings["before"], findings["after"], findings["path"], strict=True)
    return Forest(np.array([features(*r) for r in rows]), findings["label"].to_numpy(np.float64))


def scan(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5, mask: str = "[SECRET]", text: str = "text", path: str = "source") -> DataFrame:
    """Adds n_candidates, n_secrets, findings (start and length in code points, score) and redacted (the text with secrets masked) to every row.

    A null text has no candidates and stays null; a null path counts as none. Repeated rows are scanned each. Columns of
    ``docs`` with the added names are replaced. Whole texts are scanned, however long.
    """
    forest = forest or train()

    @F.pandas_udf("n_candidates long, findings array<struct<start:int,length:int,score:double>>, redacted string")
    def look(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, paths in batches:
            spans, rows = [], []
            for i, (content, where) in enumerate(zip(texts, paths, strict=True)):
                for a, b in candidate_spans(content or ""):
                    spans.append((i, a, b))
                    rows.append(features(content[a:b], content[max(0, a - 80) : a], content[b : b + 2], where))
            scores = forest.score(np.array(rows)) if rows else []
            seen, found = np.zeros(len(texts), np.int64), [[] for _ in texts]
            for (i, a, b), score in zip(spans, scores, strict=True):
                seen[i] += 1
                if score < threshold:
                    continue
                last = found[i][-1] if found[i] else None
                if last and a < last["start"] + last["length"]:  # candidates that overlap make one finding
                    last["length"], last["score"] = max(last["length"], b - last["start"]), max(last["score"], float(score))
                else:
                    found[i].append({"start": a, "length": b - a, "score": float(score)})
            masked = []
            for content, hits in zip(texts, found, strict=True):
                parts, at = [], 0
                for h in hits:
                    parts += [content[at : h["start"]], mask]
                    at = h["start"] + h["length"]
                masked.append("".join([*parts, content[at:]]) if hits else None)
            yield pd.DataFrame({"n_candidates": seen, "findings": found, "redacted": masked})

    docs, names, (text, path) = set_aside(docs, ("n_candidates", "n_secrets", "findings", "redacted"), ("_found",), text, path)
    own = docs.columns
    where = F.col(path) if path in docs.columns else F.lit(None).cast("string")
    # Only texts with a candidate go to Python.
    rows = docs.select(*own, look(F.when(F.col(text).rlike(f"{CANDIDATE}|(?i:{ASSIGNMENT})"), F.col(text)), where).alias("_found"))
    out = rows.select(
        *own, "_found.n_candidates", F.size("_found.findings").cast("long").alias("n_secrets"), "_found.findings", F.coalesce("_found.redacted", text).alias("redacted"),
    )
    return put_back(out, names)
