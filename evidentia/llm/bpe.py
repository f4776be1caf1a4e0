"""Byte-level BPE inside tasks: texts fall into segments that encode independently, and repeated segments are cached.

A run of white space always starts a pre-token of the patterns used here, and no pre-token crosses that start. So a text
may be cut before every such run; each segment (white space, then the characters up to the next run) gives the same ids
alone as in its text. Most segments are a word with one space before it, which ``str.split(" ")`` finds.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import Any

#: White space as the tokenizers' patterns see it (the Unicode property White_Space).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SEGMENT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: A space inside a longer run: there the text can't be cut before the space.
_IN_RUN = re.compile(f"[{SPACE}] (?:[{SPACE}]|\\Z)")


class SegmentCoder:
    """Values of a text's segments. ``encode`` turns segments into values; those of short segments are kept.

    At most ``most`` values are kept, then all are forgotten: memory stays bounded whatever the vocabulary.
    ``whole`` tells which texts may not be cut at all (a special string may take white space with it).
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[Any]], most: int = 250_000, longest: int = 48, whole: Callable[[str], bool] = lambda text: False):
        self.encode, self.most, self.longest, self.whole = encode, most, longest, whole
        self.after_space: dict[str, Any] = {}
        self.plain: dict[str, Any] = {}

    def _look_up(self, kept: dict[str, Any], keys: list[str], before: str) -> list[Any]:
        values = list(map(kept.get, keys))
        if None in values:
            missing = list({k for k, v in zip(keys, values, strict=True) if v is None})
            found = dict(zip(missing, self.encode([before + k for k in missing]), strict=True))
            values = [found[k] if v is None else v for k, v in zip(keys, values, strict=True)]
            if len(kept) + len(found) > self.most:
                kept.clear()
            kept.update((k, v) for k, v in found.items() if len(k) <= self.longest)
        return values

    def values(self, text: str) -> tuple[list[str], list[Any]]:
        """The segments, each but the first without its leading space where ``spaced``, and their values."""
        if not text:
            return [], []
        if self.whole(text):
            return [text], list(self.encode([text]))
        if _IN_RUN.search(text):
            segments = _SEGMENT.findall(text)
            return segments, self._look_up(self.plain, segments, "")
        first, *rest = text.split(" ")
        values = self._look_up(self.after_space, rest, " ")
        segments = [" " + k for k in rest]
        if first:
            segments.insert(0, first)
            values[:0] = self._look_up(self.plain, [first], "")
        return segments, values


def library_model(path: str) -> Any:
    """The tokenizers library's model of a .json file, without truncation and padding."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return model


def _raw_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 is itself, the others follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level_encoding(path: str) -> tuple[Any, dict[bytes, int]] | None:
    """A tiktoken encoding, without special strings, and its ranks, where a .json file is plain byte-level BPE whose merges are in the order of their ids."""
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as source:
        file = json.load(source)
    kind, before = file["model"], file["pre_tokenizer"] or {}
    special = {t["content"] for t in file["added_tokens"]}
    plain = {t: i for t, i in kind.get("vocab", {}).items() if t not in special} if kind.get("type") == "BPE" else {}
    merged = [plain.get(m.replace(" ", "") if isinstance(m, str) else "".join(m)) for m in kind.get("merges", [])]
    usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and file["normalizer"] is None and not kind.get("dropout") and not kind.get("ignore_merges")
    if not usual or len(merged) != len(plain) - 256 or merged != list(range(256, len(plain))):
        return None
    byte = _raw_bytes()
    ranks = {bytes(byte[c] for c in t): i for t, i in plain.items()}
    return tiktoken.Encoding("json", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def whole_text_encoder(path: str) -> Callable[[str], list[int]]:
    """Ids of a whole text, as the tokenizers library gives them for a .json file by its defaults, without added special tokens.

    Where the file is plain byte-level BPE whose merges are in the order of their ids, tiktoken encodes with the same
    vocabulary, several times as fast; texts that hold a special string, and other files, go to the library itself.
    """
    model = library_model(path)
    library = lambda text: model.encode(text, add_special_tokens=False).ids
    found = byte_level_encoding(path)
    if found is None:
        return library
    special = [t.content for t in model.get_added_tokens_decoder().values()]
    return lambda text: library(text) if any(s in text for s in special) else found[0].encode_ordinary(text)


def load_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
