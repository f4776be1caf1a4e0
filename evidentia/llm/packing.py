"""Packing documents into sequences of at most one window of tokens, with a non-negative least-squares plan.

A document's whole windows are sequences of their own; what remains has a length below the window. The histogram of these
lengths (as many counts as the window has tokens, whatever the corpus) goes to the driver, which enumerates shallow
combinations of lengths that fill a window exactly, solves for non-negative repeat counts against the histogram, and
rounds them down; fillings of what is left are packed greedily. Ranks within a length deal the remainders to the
combinations' slots. The residual remainders are laid end to end and cut at window ends; the last, partial window is cut into powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.bpe import whole_text_encoder
from evidentia.llm.scratch import Scratch

OUTPUT = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def combinations(window: int) -> list[dict[int, int]]:
    """Length -> how often, for shallow fillings of a window: a power of two alone, two lengths, one length twice or thrice and another."""
    found = [{1 << k: 1} for k in range(window.bit_length() - 1)]
    for times in (1, 2, 3):
        for a in range(1, (window - 1) // times + 1):
            rest = window - times * a
            if times > 1 or a <= rest:
                found.append({a: times + (a == rest)} | ({rest: 1} if rest != a else {}))
    return found


def solve_counts(columns: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative x for the least |columns @ x - histogram|², by multiplicative updates (all terms are non-negative)."""
    x = np.full(columns.shape[1], max(histogram.mean(), 1e-9))
    target = columns.T @ histogram
    for _ in range(steps):
        x *= target / np.maximum(columns.T @ (columns @ x), 1e-12)
    return x


def plan(histogram: np.ndarray, window: int) -> tuple[list[tuple], int, np.ndarray]:
    """Slots (length, rank from, rank to, times, first sequence, offset), the number of sequences, what is left of the histogram."""
    found = combinations(window)
    columns = np.zeros((window, len(found)))
    for j, lengths in enumerate(found):
        for length, times in lengths.items():
            columns[length, j] = times
    counts = np.floor(solve_counts(columns, histogram.astype(float)) + 1e-9).astype(np.int64)
    left, used, slots, sequences = histogram.astype(np.int64).copy(), np.zeros(window, np.int64), [], 0
    solved = [(int(j), int(counts[j])) for j in np.argsort(-counts, kind="stable")]
    # What rounding down has left is packed greedily: fillings with the longest piece first, as often as lengths are left for them.
    greedy = sorted(range(len(found)), key=lambda j: (-max(found[j]), sum(found[j].values())))
    for j, most in solved + [(j, int(histogram.sum())) for j in greedy]:
        n = min(most, *(int(left[length]) // times for length, times in found[j].items()))
        if n <= 0:
            continue
        offset = 0
        for length, times in sorted(found[j].items()):
            slots.append((length, int(used[length]), int(used[length]) + n * times, times, sequences, offset))
            used[length] += n * times
            left[length] -= n * times
            offset += length * times
        sequences += n
    return slots, sequences, left


def _tokenize(docs: DataFrame, tokenizer: str, window: int, end_id: int, doc_id: str, text: str) -> DataFrame:
    """Per row: key (unique), doc_tokens, the CRC of each whole window, and length, CRC and ids (32 bits each) of the rest."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        ids_of = whole_text_encoder(tokenizer)
        step = 4 * window
        for batch in batches:
            rows = []
            for content in batch.column(2).to_pylist():
                ids = np.array([*ids_of(content), end_id], "<u4").tobytes()
                whole = len(ids) // step
                rest = ids[whole * step :]
                rows.append((len(ids) // 4, [zlib.crc32(ids[i * step : (i + 1) * step]) for i in range(whole)], len(rest) // 4, zlib.crc32(rest), rest))
            n, crcs, size, crc, rest = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(size, pa.int32()), pa.array(crc, pa.int64()), pa.array(rest, pa.binary())],
                names=["key", "doc_id", "doc_tokens", "whole_crcs", "rest", "rest_crc", "rest_ids"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(encode, "key long, doc_id long, doc_tokens long, whole_crcs array<long>, rest int, rest_crc long, rest_ids binary")


def pack(
    docs: DataFrame, tokenizer: str | None = None, window: int = 1024, end_id: int = 0, rows_a_bucket: int = 100_000, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids, then ``end_id``; a null text counts as empty (one token). Repeated rows are documents of their
    own. Every id lies in exactly one piece; sequences are full windows or a power of two long, so none is padded. Other
    columns are ignored; an empty table gives no rows.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    tokens = scratch.keep(_tokenize(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), window, end_id, doc_id, text), "tokens")

    # At most ``window`` rows: one for each length of a rest.
    per_length = {r["rest"]: r for r in tokens.groupBy("rest").agg(F.count("*").alias("n"), F.sum(F.size("whole_crcs")).alias("whole")).collect()}
    histogram = np.zeros(window, np.int64)
    for length, r in per_length.items():
        histogram[length] = r["n"]
    histogram[0] = 0
    slots, sequences, left = plan(histogram, window)
    buckets = int(max(32, sum(r["n"] for r in per_length.values()) // rows_a_bucket))
    dealt = tokens.select("key", "doc_id", "doc_tokens", "rest", "rest_crc", "whole_crcs", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))

    # The rank of each rest among those of its length: within buckets first, then the buckets' own counts.
    rests = dealt.where("rest > 0").drop("whole_crcs")
    before = rests.groupBy("rest", "bucket").count().select("rest", "bucket", (F.sum("count").over(Window.partitionBy("rest").orderBy("bucket")) - F.col("count")).alias("before"))
    ranked = (
        rests.withColumn("n", F.row_number().over(Window.partitionBy("rest", "bucket").orderBy("key"))).join(before, ["rest", "bucket"])
        .withColumn("rank", F.col("before") + F.col("n") - 1)
    )
    # Bounded by the enumeration, not by the data: a few thousand slots.
    slot_rows = spark.createDataFrame(slots, "slot_rest int, rank_from long, rank_to long, times int, first long, at int")
    in_slot = (F.col("rest") == F.col("slot_rest")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    turn = F.col("rank") - F.col("rank_from")
    used = histogram - left
    starts = np.concatenate([[0], np.cumsum(left * np.arange(window))])[:window]
    total = int((left * np.arange(window)).sum())
    full = total // window * window
    ends, at = [], full
    for k in reversed(range(window.bit_length())):
        if (total - full) >> k & 1:
            at += 1 << k
            ends.append(at)
    longs = lambda values: F.array(*[F.lit(int(v)) for v in values]).cast("array<long>")
    placed = scratch.keep(
        ranked.join(F.broadcast(slot_rows), in_slot, "left").select(
            "key", "doc_id", "doc_tokens", "rest", "rest_crc",
            (F.col("first") + F.floor(turn / F.col("times"))).alias("sequence_id"), (F.col("at") + turn % F.col("times") * F.col("rest")).alias("offset"),
            (F.get(longs(starts), F.col("rest")) + (F.col("rank") - F.get(longs(used), F.col("rest"))) * F.col("rest")).alias("position"),
        ),
        "placed",
    )
    whole_before = F.col("doc_tokens") - F.col("rest")
    in_slots = placed.where("sequence_id is not null").select("doc_id", whole_before.alias("start"), F.col("rest").cast("long").alias("length"), F.col("rest_crc").alias("ids_crc32"), "doc_tokens", "sequence_id", F.col("offset").cast("long").alias("offset"))

    # Residual rests lie end to end at ``position``; ``cuts`` are the sequence ends inside them.
    tail = longs(ends)
    next_end = (F.floor(F.col("position") / window) + 1) * window
    inside = lambda c: (c > F.col("position")) & (c < F.col("position") + F.col("rest"))
    all_ends = F.array_sort(F.array_distinct(F.concat(F.array(next_end), tail)))
    residual = placed.where("sequence_id is null").withColumn("cuts", F.filter(all_ends, inside))
    sequence = lambda p: F.lit(sequences) + F.when(p < full, F.floor(p / window)).otherwise(F.lit(full // window) + F.size(F.filter(tail, lambda e: e <= p)))
    offset = lambda p: F.when(p < full, p % window).otherwise(p - F.coalesce(F.array_max(F.filter(tail, lambda e: e <= p)), F.lit(full)))
    uncut = residual.where("size(cuts) = 0").select("doc_id", whole_before.alias("start"), F.col("rest").cast("long").alias("length"), F.col("rest_crc").alias("ids_crc32"), "doc_tokens", sequence(F.col("position")).alias("sequence_id"), offset(F.col("position")).alias("offset"))
    parts = F.transform(
        F.arrays_zip(F.concat(F.array("position"), "cuts").alias("a"), F.concat("cuts", F.array(F.col("position") + F.col("rest"))).alias("b")),
        lambda p: F.struct((p["a"] - F.col("position")).alias("from"), (p["b"] - p["a"]).alias("length"), sequence(p["a"]).alias("sequence_id"), offset(p["a"]).alias("offset")),
    )
    cut = (
        residual.where("size(cuts) > 0").join(tokens.select("key", "rest_ids"), "key")
        .select("doc_id", "doc_tokens", "rest", "rest_ids", F.explode(parts).alias("p"))
        .select("doc_id", (whole_before + F.col("p.from")).alias("start"), "p.length", F.crc32(F.substring("rest_ids", F.col("p.from").cast("int") * 4 + 1, F.col("p.length").cast("int") * 4)).alias("ids_crc32"), "doc_tokens", "p.sequence_id", "p.offset")
    )

    # Whole windows: numbered within buckets, after the sequences above.
    per_bucket = dealt.groupBy("bucket").agg(F.sum(F.size("whole_crcs")).alias("n"))  # a row for each ``rows_a_bucket`` rests
    first = per_bucket.select("bucket", (F.lit(sequences + full // window + len(ends)) + F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("first"))
    running = F.sum(F.size("whole_crcs")).over(Window.partitionBy("bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)) - F.size("whole_crcs")
    whole = (
        dealt.where("size(whole_crcs) > 0").withColumn("running", running).join(first, "bucket").select("doc_id", "doc_tokens", "whole_crcs", (F.col("first") + F.col("running")).alias("first"))
        .select("doc_id", "doc_tokens", "first", F.posexplode("whole_crcs").alias("k", "ids_crc32"))
        .select("doc_id", (F.col("k").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("first") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    )
    out = [part.select(*[F.col(c).cast("long").alias(c) for c in OUTPUT]) for part in (whole, in_slots, uncut, cut)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
