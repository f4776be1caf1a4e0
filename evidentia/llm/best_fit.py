"""Best-fit packing by matching: as few sequences as possible, documents whole unless they are longer than a sequence.

A document's whole windows are sequences of their own, and what remains is one item shorter than the window. A histogram of
these lengths, one count for each, is all that the driver sees, whatever the corpus. Items above a third of the window
pair at most twice in a sequence, so they are matched greedily: the longest first, each with the longest partner that still
fits, which gives the most pairs there can be. Smaller items then go, the longest first, into the tightest gap that takes
them. All steps move whole classes of equal items and equal sequences, so their number depends on the window alone.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.bpe import whole_text_encoder
from evidentia.llm.scratch import Scratch

_TOKENS = "key long, doc_id long, doc_tokens long, rest int, rest_crc long, whole_crcs array<long>"


class _Plan:
    """Classes of equal sequences by their gap, and the slots that items of one length take in them, by rank.

    A slot (length, rank_from, rank_to, times, first, at) says: the items of that length with these ranks fill the sequences
    from ``first`` on, ``times`` in each, side by side from offset ``at``.
    """

    def __init__(self, histogram: np.ndarray, window: int):
        self.left, self.window = [int(n) for n in histogram], window
        self.placed = [0] * len(self.left)
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.slots: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0

    def fill(self, first: int, count: int, gap: int, length: int, times: int) -> int:
        """Puts ``times`` items into each of ``count`` sequences with this gap; their new gap."""
        n = count * times
        self.slots.append((length, self.placed[length], self.placed[length] + n, times, first, self.window - gap))
        self.placed[length] += n
        self.left[length] -= n
        return gap - length * times

    def open(self, count: int) -> int:
        first, self.sequences = self.sequences, self.sequences + count
        return first

    def keep(self, first: int, count: int, gap: int) -> None:
        if gap and count:
            self.gaps[gap].append((first, count))

    def match_large(self) -> None:
        least = self.window // 3 + 1
        for a in range(self.window - 1, least - 1, -1):
            partner = min(a, self.window - a)
            while self.left[a]:
                while partner >= least and self.left[partner] < (2 if partner == a else 1):
                    partner -= 1
                if partner < least:
                    count = self.left[a]
                    first = self.open(count)
                    self.keep(first, count, self.fill(first, count, self.window, a, 1))
                elif partner == a:
                    count = self.left[a] // 2
                    first = self.open(count)
                    self.keep(first, count, self.fill(first, count, self.window, a, 2))
                else:
                    count = min(self.left[a], self.left[partner])
                    first = self.open(count)
                    gap = self.fill(first, count, self.window, a, 1)
                    self.keep(first, count, self.fill(first, count, gap, partner, 1))

    def fit_small(self) -> None:
        for length in range(self.window // 3, 0, -1):
            while self.left[length]:
                gap = min((g for g, classes in self.gaps.items() if g >= length and classes), default=None)
                if gap is None:
                    gap, count = self.window, -(-self.left[length] // (self.window // length))
                    first = self.open(count)
                else:
                    first, count = self.gaps[gap].pop()
                times = gap // length
                full = min(count, self.left[length] // times)
                if full:
                    self.keep(first, full, self.fill(first, full, gap, length, times))
                rest = self.left[length] if full < count else 0
                if rest:
                    self.keep(first + full, 1, self.fill(first + full, 1, gap, length, rest))
                taken = full + (1 if rest else 0)
                self.keep(first + taken, count - taken, gap)


def plan(histogram: np.ndarray, window: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Slots (length, rank from, rank to, times, first sequence, offset) for counts by length, and the number of sequences."""
    found = _Plan(histogram, window)
    found.match_large()
    found.fit_small()
    return found.slots, found.sequences


def _tokenize(docs: DataFrame, tokenizer: str, window: int, end_id: int, doc_id: str, text: str) -> DataFrame:
    """Per row: key (unique), doc_tokens, length and CRC of the first, shorter piece, CRCs of the whole windows behind it."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        ids_of = whole_text_encoder(tokenizer)
        for batch in batches:
            sizes, rests, rest_crcs, crcs = [], [], [], []
            for content in batch.column(2):
                ids = np.array([*ids_of(content.as_py()), end_id], "<u4").tobytes()
                size = len(ids) // 4
                rest = size % window
                sizes.append(size)
                rests.append(rest)
                rest_crcs.append(zlib.crc32(ids[: 4 * rest]))
                crcs.append([zlib.crc32(ids[4 * i : 4 * (i + window)]) for i in range(rest, size, window)])
            made = [pa.array(sizes, pa.int64()), pa.array(rests, pa.int32()), pa.array(rest_crcs, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *made], names=["key", "doc_id", "doc_tokens", "rest", "rest_crc", "whole_crcs"]
            )

    id_, content = F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    return docs.select(F.monotonically_increasing_id().alias("key"), id_, content).mapInArrow(encode, _TOKENS)


def pack_best_fit(
    docs: DataFrame,
    tokenizer: str | None = None,
    window: int = 1024,
    end_id: int = 2,
    rows_a_bucket: int = 100_000,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), start, length, ids_crc32, sequence_id, offset.

    A document is its ids, then ``end_id``. One of at most ``window`` ids is one piece; a longer one is cut into whole windows
    behind a first piece that takes what doesn't fill a window. A null text counts as empty (one id, ``end_id``), a null
    doc_id is kept. Repeated rows are documents of their own. Other columns are ignored; an empty table gives no rows.
    Sequence numbers have gaps. One table, of a few numbers a document, stays in the shared folder, since the result reads it.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    tokens = Scratch(spark, "best-fit").keep(_tokenize(docs, tokenizer, window, end_id, doc_id, text), "tokens")

    # At most ``window`` rows: one for each length of a shorter piece.
    histogram = np.zeros(window, np.int64)
    for r in tokens.where("rest > 0").groupBy("rest").count().collect():
        histogram[r["rest"]] = r["count"]
    slots, sequences = plan(histogram, window)
    buckets = int(max(32, histogram.sum() // rows_a_bucket))

    # The rank of each shorter piece among those of its length: within buckets first, then the buckets' own counts.
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")
    shorter = tokens.where("rest > 0").select("key", "doc_id", "rest", "rest_crc", bucket)
    before = shorter.groupBy("rest", "bucket").count()
    before = before.withColumn("before", F.sum("count").over(Window.partitionBy("rest").orderBy("bucket")) - F.col("count")).drop("count")
    in_bucket = F.row_number().over(Window.partitionBy("rest", "bucket").orderBy("key"))
    ranked = shorter.withColumn("n", in_bucket).join(before, ["rest", "bucket"]).withColumn("rank", F.col("before") + F.col("n") - 1)

    # Bounded by the window, not by the data: a few thousand slots.
    slot_rows = spark.createDataFrame(slots, "slot_rest int, rank_from long, rank_to long, times long, first long, at long")
    in_slot = (F.col("rest") == F.col("slot_rest")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    turn = F.col("rank") - F.col("rank_from")
    long = lambda c: c.cast("long")
    first_pieces = ranked.join(F.broadcast(slot_rows), in_slot).select(
        "doc_id", F.lit(0).alias("piece"), long(F.lit(0)).alias("start"), long(F.col("rest")).alias("length"), F.col("rest_crc").alias("ids_crc32"),
        (F.col("first") + F.floor(turn / F.col("times"))).alias("sequence_id"), long(F.col("at") + turn % F.col("times") * F.col("rest")).alias("offset"),
    )
    whole = tokens.select("doc_id", "rest", F.posexplode("whole_crcs").alias("k", "ids_crc32")).select(
        "doc_id", (F.col("k") + F.when(F.col("rest") > 0, 1).otherwise(0)).alias("piece"), (F.col("rest") + long(F.col("k")) * window).alias("start"),
        long(F.lit(window)).alias("length"), "ids_crc32", (F.monotonically_increasing_id() + sequences).alias("sequence_id"), long(F.lit(0)).alias("offset"),
    )
    return first_pieces.unionByName(whole)
