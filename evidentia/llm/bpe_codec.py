"""Byte-level BPE encoding and decoding over whole texts, by overlapping chunks.

A text is cut into chunks that overlap; each chunk is pre-tokenised on its own. A chunk may start inside a pre-token, so
its first boundaries are in doubt; where one of them coincides with a boundary that is known to be true, both go on alike.
From the text's start, which is a true boundary, this carries from chunk to chunk, and pieces are cut there. Only ends of
pre-tokens that don't end in white space are cut at: a run of white space at a piece's end would be pre-tokenised in
another way than inside the text. If two chunks never agree within the overlap, the open piece is pre-tokenised anew
through the second. The pieces are encoded; decoding concatenates the tokens' raw bytes.

All texts take this path. One of few chunks takes it inside its task, the chunks and then the pieces of a longer one are dealt out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.bpe import load_ranks

#: Code points of a chunk without its overlap, and of the overlap; chunks that a task takes without dealing them out.
CHUNK, OVERLAP, ALONE = 4_096, 256, 16


def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


def piece_coder(path: str, pattern: str) -> Callable[[str], tuple[bytes, bytes]]:
    """For a piece: the decimal ids joined by commas, and the raw bytes that the ids decode to."""
    encoding = _encoding(path, pattern)
    names = [b"%d" % i for i in range(encoding.n_vocab)]

    def code(piece: str) -> tuple[bytes, bytes]:
        ids = encoding.encode_ordinary(piece)
        return b",".join([names[i] for i in ids]), encoding.decode_bytes(ids)

    return code


def _digests(ids: bytes, raw: bytes) -> tuple[int, str, str]:
    import hashlib

    return (ids.count(b",") + 1 if ids else 0), hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest()


def compiled(pattern: str):
    """The pattern with white space as the encoder's own library sees it (the Unicode property, without U+001C to U+001F)."""
    import regex

    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def boundaries(text: str, pattern) -> list[int]:
    """Ends of the pre-tokens of a text that is cut off at its end: the last two are in doubt and left out."""
    return [m.end() for m in pattern.finditer(text)][:-2]


def split(text: str, chunk: int, overlap: int) -> list[str]:
    """The overlapping chunks of a text; the last may lie within the overlap of the one before."""
    return [text[at : at + chunk + overlap] for at in range(0, max(1, len(text)), chunk)]


def chunk_marks(text: str, chunk: int, overlap: int, pattern) -> tuple[list[int], list[int]]:
    """Boundaries in the first ``overlap`` characters (0 among them) and those from ``chunk`` on."""
    ends = boundaries(text, pattern)
    return [0] + [b for b in ends if b < overlap], [b for b in ends if b >= chunk]


def stitch(chunks: list[str], chunk: int, overlap: int, pattern, marks: list[tuple[list[int], list[int]]] | None = None) -> list[str]:
    """Pieces that concatenate to the text, each encoded alone as in the text.

    ``chunks[i]`` starts at ``i * chunk`` and runs ``overlap`` further; ``marks`` are its boundaries (head, tail), both
    relative to its start, as :func:`chunk_marks` gives them.
    """
    pattern = compiled(pattern) if isinstance(pattern, str) else pattern
    marks = marks or [chunk_marks(c, chunk, overlap, pattern) for c in chunks]
    pieces: list[str] = []
    begun, failed = 0, 0  # where the open piece starts; chunks since true boundaries were last known

    def between(a: int, b: int) -> str:
        """The text from a to b; b lies before the end of the chunk that holds b - 1, its overlap included."""
        k, last = a // chunk, max(a, b - 1) // chunk
        return "".join(c[:chunk] for c in chunks[k:last])[a - k * chunk :] + chunks[last][max(0, a - last * chunk) : b - last * chunk]

    true = list(marks[0][1])  # boundaries known to be true, from the next chunk's start on
    for i in range(1, len(chunks)):
        start = i * chunk
        head = {start + b for b in marks[i][0]}
        agreed = [b for b in true if b in head]
        if agreed:
            # A cut before white space needs no agreement about other characters' classes; one after it is never made.
            cuts = [b for b in agreed if not between(b - 1, b).isspace()]
            if cuts:
                cut = min(cuts, key=lambda b: (not between(b, b + 1).isspace(), b))
                pieces.append(between(begun, cut))
                begun = cut
            true, failed = [start + b for b in marks[i][1]], 0
            continue
        failed += 1
        true = []
        if failed & (failed - 1) == 0:  # 1, 2, 4, ... chunks: each is then read twice at most
            end = start + len(chunks[i])
            true = [b for b in (begun + e for e in boundaries(between(begun, end), pattern)) if b >= start + chunk]
    pieces.append(between(begun, (len(chunks) - 1) * chunk + len(chunks[-1])))
    return pieces


def encode_documents(
    docs: DataFrame, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP, output: str = "digests", doc_id: str = "doc_id", text: str = "text",
    alone: int = ALONE,
) -> DataFrame:
    """Encodes every whole text, then decodes the ids.

    ``output="digests"``: doc_id, n_tokens, ids_sha256, decoded_sha256. ``output="ids"``: doc_id, ids array<int>, decoded
    binary. A null text counts as empty (0 tokens), a null doc_id stays. Repeated rows are encoded each; extra columns are
    ignored; an empty table gives no rows. Texts above ``alone`` chunks are dealt out over tasks, by chunks and then by pieces.
    """
    ranks = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    digests = output == "digests"
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, decoded binary"
    kinds = [pa.int64(), pa.string(), pa.string()] if digests else [pa.list_(pa.int32()), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def row(ids: bytes, raw: bytes) -> tuple:
        return _digests(ids, raw) if digests else ([int(x) for x in ids.split(b",")] if ids else [], raw)

    def joined(coded: list[tuple[bytes, bytes]]) -> tuple:
        return row(b",".join([c[0] for c in coded if c[0]]), b"".join([c[1] for c in coded]))

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    is_long = F.length("text") > chunk * alone

    def encode_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, matcher = piece_coder(ranks, pattern), compiled(pattern)
        for batch in batches:
            out = []
            for content in batch.column(1):
                chunks = split(content.as_py(), chunk, overlap)
                out.append(joined([code(p) for p in stitch(chunks, chunk, overlap, matcher)]))
            out = list(zip(*out, strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, k) for x, k in zip(out, kinds, strict=True)]], names=names)

    short = rows.where(~is_long).mapInArrow(encode_whole, schema)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, doc, content in zip(*(batch.column(c).to_pylist() for c in range(2)), batch.column(2), strict=True):
                chunks = split(content.as_py(), chunk, overlap)
                for at in range(0, len(chunks), 1024):
                    part = chunks[at : at + 1024]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(part)), pa.array([doc] * len(part), pa.int64()), pa.array(range(at, at + len(part)), pa.int32()), pa.array(part)], names=["key", "doc_id", "i", "text"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, matcher = pa.list_(pa.int32()), compiled(pattern)
        for batch in batches:
            found = [chunk_marks(t, chunk, overlap, matcher) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], kind), pa.array([x[1] for x in found], kind)], names=["key", "doc_id", "i", "text", "head", "tail"])

    def join_chunks(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("i")
        marks = [(list(h), list(t)) for h, t in zip(found["head"], found["tail"], strict=True)]
        pieces = stitch(list(found["text"]), chunk, overlap, pattern, marks)
        return pd.DataFrame({"key": key[0], "doc_id": found["doc_id"].iloc[0], "piece": range(len(pieces)), "text": pieces})

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = piece_coder(ranks, pattern)
        for batch in batches:
            out = [code(t) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], names=["key", "doc_id", "piece", "ids", "raw"])

    def whole(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("piece")
        return pd.DataFrame([[found["doc_id"].iloc[0], *joined(list(zip(found["ids"], found["raw"], strict=True)))]], columns=names)

    # Rows have numbers of their own, so that repeated rows don't meet in one group.
    numbered = rows.where(is_long).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    chunks = numbered.mapInArrow(deal, "key long, doc_id long, i int, text string").repartition("key", "i")
    marked = chunks.mapInArrow(mark, "key long, doc_id long, i int, text string, head array<int>, tail array<int>")
    pieces = marked.groupBy("key").applyInPandas(join_chunks, "key long, doc_id long, piece int, text string")
    encoded = pieces.repartition("key", "piece").mapInArrow(encode_pieces, "key long, doc_id long, piece int, ids binary, raw binary")
    return short.unionByName(encoded.groupBy("key").applyInPandas(whole, schema))


def decode(encoded: DataFrame, ranks: str | None = None, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary): the raw bytes of an ``ids`` column's tokens, concatenated; null for null ids."""
    ranks = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    @F.pandas_udf("binary")
    def raw_bytes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        token = {i: t for t, i in load_ranks(ranks).items()}
        for batch in batches:
            yield batch.map(lambda x: None if x is None else b"".join([token[i] for i in x]))

    return encoded.withColumn("decoded", raw_bytes(F.col(ids)))
