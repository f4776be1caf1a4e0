"""Token counts by prefix dynamic programming.

For each text the exact number of tokens of every prefix is kept. No token crosses the start of a run of white space, so
``count(prefix + part of a segment) = count(prefix) + count(part)`` for segments that start there. Parts of short segments
are encoded; in long ones a dynamic program finds the last token of each part of a pre-token: the one that forms a pair
with the last token before it which the encoder leaves as it is. One look-up in these arrays then answers how many tokens
a prefix has and how much of a text fits a budget, without encoding again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.bpe import SPACE, SegmentCoder, byte_level_encoding, library_model, whole_text_encoder

SCHEMA = "doc_id long, n_bytes long, prefix_ends array<int>, prefix_tokens array<int>"
#: Segments up to this length are encoded part by part; output batches hold about so many prefixes.
SHORT, PREFIXES = 24, 1 << 20


class PieceCounts:
    """Token counts of every prefix (code points) of a pre-token."""

    def __init__(self, encoding, ranks: dict[bytes, int]):
        self.single, self.ranks, self.longest = encoding._core_bpe.encode_single_piece, ranks, max(map(len, ranks))
        self.pairs: dict[tuple[bytes, bytes], bool] = {}

    def _joins(self, left: bytes, right: bytes) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 250_000:
                self.pairs.clear()
            known = self.pairs[left, right] = self.single(left + right) == ([self.ranks[left], self.ranks[right]] if left else [self.ranks[right]])
        return known

    def __call__(self, piece: str) -> list[int]:
        raw = piece.encode()
        last, counts = [b""], [0]
        for end in range(1, len(raw) + 1):
            for size in range(1, min(end, self.longest) + 1):
                token = raw[end - size : end]
                if token in self.ranks and self._joins(last[end - size], token):
                    last.append(token)
                    counts.append(counts[end - size] + 1)
                    break
            else:
                raise ValueError(f"no token ends at byte {end}")
        return [counts[e] for e in np.cumsum([len(c.encode()) for c in piece])]


def segment_counts(path: str) -> Callable[[str], np.ndarray]:
    """For a segment the token counts of all its prefixes (code points), as the tokenizers library gives them for the file.

    Files other than plain byte-level BPE get theirs by encoding every prefix, at a cost of the length squared.
    """
    import regex

    encode, plain = whole_text_encoder(path), byte_level_encoding(path)
    special = [t.content for t in library_model(path).get_added_tokens_decoder().values()]
    direct = lambda text: [len(encode(text[:e])) for e in range(1, len(text) + 1)]
    if plain is None:
        return lambda text: np.array(direct(text), np.int32)
    of_piece = PieceCounts(*plain)
    ordinary, single = plain[0]._core_bpe.encode_ordinary, of_piece.single
    pieces = regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    run, stops = regex.compile(f"[{SPACE}]*"), regex.compile("|".join(map(regex.escape, special)) or r"(?!)")

    def unbroken(text: str) -> list[int]:
        """Counts without special strings. White space is only at the start; its parts are one pre-token each."""
        spaces = run.match(text).end()
        out = of_piece(text[:spaces]) if spaces else []
        done = 0
        for m in pieces.finditer(text) if len(text) > spaces else ():
            if m.end() > spaces:
                # A contraction's parts are other pre-tokens than itself.
                part = m[0]
                counts = [len(ordinary(part[:e])) for e in range(1, len(part) + 1)] if len(part) <= SHORT else of_piece(part)
                out += [done + c for c in counts[max(0, spaces - m.start()) :]]
                done += counts[-1]
            else:
                done += len(ordinary(m[0]))
        return out

    def counts(text: str) -> np.ndarray:
        word = text[1:] if text[0] == " " else text
        if len(text) <= SHORT and word.isalpha() and max(word) < "\u0250":  # each part is one pre-token
            raw = text.encode()
            if len(raw) == len(text):
                return np.array([len(single(raw[:e])) for e in range(1, len(raw) + 1)], np.int32)
            return np.array([len(single(text[:e].encode())) for e in range(1, len(text) + 1)], np.int32)
        if len(text) <= SHORT:
            return np.array(direct(text) if stops.search(text) else [len(ordinary(text[:e])) for e in range(1, len(text) + 1)], np.int32)
        out: list[int] = []
        at = done = 0
        for m in stops.finditer(text):
            # Before its last character the special string is plain text.
            out += [done + c for c in unbroken(text[at : m.end() - 1])]
            done += (len(ordinary(text[at : m.start()]))) + 1
            out.append(done)
            at = m.end()
        return np.array(out + [done + c for c in unbroken(text[at:])], np.int32)

    return counts


def prefix_token_counts(docs: DataFrame, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, and for every prefix end (each code point) in ``prefix_ends`` its token count in ``prefix_tokens``.

    A null text counts as empty; an empty text has empty arrays, 0 bytes and 0 tokens. Repeated rows and ids give a row
    each. Other columns are ignored. A null doc_id stays null.
    """
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_segment = segment_counts(tokenizer)
        # Special strings that hold or take white space don't let a text be cut there.
        loose = [t.content for t in library_model(tokenizer).get_added_tokens_decoder().values() if t.lstrip or t.rstrip or t.single_word or not t.content or any(c.isspace() for c in t.content)]
        if loose or byte_level_encoding(tokenizer) is None:
            encode = whole_text_encoder(tokenizer)
            of_whole = lambda text: np.array([len(encode(text[:e])) for e in range(1, len(text) + 1)], np.int32)
        coder = SegmentCoder(lambda segments: [(of_whole if any(s in x for s in loose) else of_segment)(x).tobytes() for x in segments], whole=lambda text: any(s in text for s in loose))

        def rows(ids: list, ends: list, counts: list, sizes: list) -> pa.RecordBatch:
            starts = np.cumsum([0, *map(len, counts)], dtype=np.int32)
            flat = lambda parts: pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32), pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), flat(ends), flat(counts)], names=["doc_id", "n_bytes", "prefix_ends", "prefix_tokens"])

        for batch in batches:
            ids, ends, counts, sizes, held = [], [], [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                values = coder.values(text)[1]
                parts = np.frombuffer(b"".join(values), np.int32)
                if len(values) > 1:
                    lengths = np.fromiter(map(len, values), np.int64, len(values)) // parts.itemsize
                    whole = parts[np.cumsum(lengths) - 1]
                    parts = parts + np.repeat(np.cumsum(whole) - whole, lengths).astype(np.int32)
                ids.append(doc)
                counts.append(parts)
                ends.append(np.arange(1, len(parts) + 1, dtype=np.int32))
                sizes.append(len(text.encode()))
                held += len(parts)
                if held > PREFIXES:
                    yield rows(ids, ends, counts, sizes)
                    ids, ends, counts, sizes, held = [], [], [], [], 0
            if ids:
                yield rows(ids, ends, counts, sizes)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(count, SCHEMA)


def total_tokens() -> Column:
    return F.coalesce(F.try_element_at("prefix_tokens", F.lit(-1)), F.lit(0)).cast("long")


def tokens_at(end: int | Column) -> Column:
    """Tokens of the prefix of ``end`` code points; of the whole text where it is shorter."""
    end = F.lit(end) if isinstance(end, int) else end
    return F.coalesce(F.get("prefix_tokens", F.least(end, F.size("prefix_ends")) - 1), F.lit(0))


def fitting_end(budget: int | Column) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens. A longer prefix may have fewer tokens than a shorter one."""
    fitting = F.filter("prefix_ends", lambda e: F.get("prefix_tokens", e - 1) <= budget)
    return F.coalesce(F.try_element_at(fitting, F.lit(-1)), F.lit(0))
