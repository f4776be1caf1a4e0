"""WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a skippable frame at the end of a bundle holds the seek table
(compressed and raw size of every frame). The index maps a record to its bundle, frame and offset within the raw frame,
so one record is read by decompressing one frame. Each task writes one bundle under a name of its own, and only
bundles of tasks that succeeded are in the index: a lost executor leaves at most a file that nothing refers to.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.scratch import Scratch

# Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
#: Raw bytes after which a frame is closed.
FRAME_BYTES = 1 << 19
INDEX = "bundle string, frame int, record_ids array<long>, starts array<long>, lengths array<long>"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame for frames of (compressed, raw) sizes."""
    entries = b"".join(struct.pack("<II", *s) for s in sizes)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + 9) + entries + struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)


def frame_spans(source) -> list[tuple[int, int]]:
    """(offset, compressed size) of every frame, from the seek table at the end of an open random-access file."""
    source.seek(source.size() - 9)
    count, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE_MAGIC or flags & 0x7F:
        raise ValueError("not a seekable bundle without checksums")
    source.seek(source.size() - 9 - 8 * count)
    table, at, spans = source.read(8 * count), 0, []
    for compressed, _ in struct.iter_unpack("<II", table):
        spans.append((at, compressed))
        at += compressed
    return spans


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One response record, or a revisit of ``refers_to``: its HTTP head, which tells the payload's length, without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(content: bytes) -> tuple:
    """A row of RECORDS from one record; a payload that doesn't match its digest is an error."""
    import base64
    import hashlib

    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda name: int(x) if (x := fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None
    if fields["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} doesn't match its digest")
    return number("WARC-Record-ID"), size, digest, fields["WARC-Type"], number("WARC-Refers-To"), fields.get("WARC-Target-URI"), payload if fields["WARC-Type"] == "response" else None


def with_references(pages: DataFrame, least: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, refers_to: the smallest page_id with an equal payload of at least ``least`` bytes, null on that page itself."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    digests = rows.where(F.octet_length("payload") >= least).select("page_id", F.sha1("payload").alias("sha1"))
    repeated = digests.groupBy("sha1").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Narrow rows only: a payload that a third of all pages share is dealt out by page below.
    revisits = digests.join(repeated, "sha1").where("page_id > refers_to").distinct()
    return rows.withColumn("sha1", F.sha1("payload")).join(revisits, ["page_id", "sha1"], "left").drop("sha1")


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes rows of :func:`with_references` to bundles in ``folder``; lazily gives the index, a row for each frame (INDEX)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64
        import hashlib
        import uuid

        import zstandard
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        name = f"bundle-{uuid.uuid4().hex}.warc.zst"
        press = zstandard.ZstdCompressor(level=3)
        out, sizes, open_records, raw, index = None, [], [], 0, []

        def close_frame() -> None:
            nonlocal open_records, raw
            content = b"".join(r for _, r in open_records)
            frame = press.compress(content)
            out.write(frame)
            starts, at = [], 0
            for _, r in open_records:
                starts.append(at)
                at += len(r)
            index.append((f"{folder}/{name}", len(sizes), [i for i, _ in open_records], starts, [len(r) for _, r in open_records]))
            sizes.append((len(frame), len(content)))
            open_records, raw = [], 0

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                if out is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                open_records.append((page_id, record(page_id, url, payload, digest, refers_to, date)))
                raw += len(open_records[-1][1])
                if raw >= FRAME_BYTES:
                    close_frame()
        if open_records:
            close_frame()
        if out is not None:
            out.write(seek_table(sizes))
            out.close()
        many = pa.list_(pa.int64())
        columns = zip(*index, strict=True) if index else ([],) * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.int32(), many, many, many], strict=True)], names=["bundle", "frame", "record_ids", "starts", "lengths"])

    return pages.select("page_id", "url", "payload", "refers_to").mapInArrow(write, INDEX)


def read_archives(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record that a written index lists (RECORDS; without ``payloads`` that column is null), frame by frame."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in RECORDS.split(", ")]
        press, spans = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for bundle, frame, starts, lengths in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "starts", "lengths")), strict=True):
                store, path = fs.FileSystem.from_uri(bundle)
                with store.open_input_file(path) as source:
                    if bundle not in spans:
                        spans = {bundle: frame_spans(source)}
                    at, size = spans[bundle][frame]
                    source.seek(at)
                    content = press.decompress(source.read(size))
                rows = [parse(content[a : a + n]) for a, n in zip(starts, lengths, strict=True)]
                if not payloads:
                    rows = [(*r[:-1], None) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return index.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame").mapInArrow(read, RECORDS)


def find_records(index: DataFrame, wanted: DataFrame, page_id: str = "page_id") -> DataFrame:
    """The index entries of the wanted pages only, to be read by :func:`read_archives`."""
    entries = index.select("bundle", "frame", F.explode(F.arrays_zip("record_ids", "starts", "lengths")).alias("r"))
    hits = entries.select("bundle", "frame", F.col("r.record_ids").alias("_id"), "r.starts", "r.lengths").join(wanted.select(F.col(page_id).alias("_id")).distinct(), "_id", "left_semi")
    grouped = hits.groupBy("bundle", "frame").agg(F.collect_list(F.struct("_id", "starts", "lengths")).alias("r"))
    return grouped.select("bundle", "frame", F.col("r._id").alias("record_ids"), "r.starts", "r.lengths")


def archive_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes an archive of all pages to the shared folder and reads it back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload; null ids and urls are kept as nulls. Among rows with equal payloads those of the
    smallest page_id are responses, also where a row is repeated; rows without page_id are responses.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    index = scratch.keep(write_archives(with_references(pages, least), scratch.path("bundles")), "index")
    return read_archives(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
