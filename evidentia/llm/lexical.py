"""Ranked lexical search over blocks of documents, with per-term maxima that tell which blocks needn't be scored.

The index is a table with one row for each block, a range of documents in the order in which a task arranged them. A block
holds its documents' terms and counts (a forward index) and, for each of its terms, the highest part of a score that the
term gives to any of its documents. For a query, the maxima of its terms, times their weights, add up to a bound on the
score of every document of the block.

A search first bounds every block by its maxima alone and scores each query's most promising blocks. Their k-th score is a
threshold that goes to all tasks, which then take the blocks in the order of their bounds and score those whose bound still
reaches the query's k-th score so far. All sums are whole numbers, so no rounding can drop or swap a document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.scratch import Scratch, rows_a_batch

#: Terms are runs of ASCII digits and letters, and of everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes that aren't in a term become a space, A-Z become a-z; what is beyond ASCII stays.
FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))
#: How many documents a task arranges at a time, and how many postings or documents end a block or such a chunk.
CHUNK, CHUNK_POSTINGS, BLOCK, BLOCK_POSTINGS = 2048, 500_000, 64, 65_536
#: Up to so many different terms, a batch of queries is sent to all tasks to count who holds them; beyond, Spark joins.
BROADCAST_TERMS = 500_000
#: Spark's reader decodes up to 4,096 rows of a row group at once, long lists and all. Small groups bound what a task holds, however large its files.
GROUPS = {"parquet.block.size": "4194304", "parquet.page.size.row.check.min": "4", "parquet.page.size.row.check.max": "16"}
#: How many documents and blocks go to Python at once. Batches of 64 MB, Spark's own limit, take three times that outside the heap for each task.
DOCS_A_BATCH, BLOCKS_A_BATCH = 1024, 32
#: How many (query, entry) pairs and bounds are in memory at a time.
PAIRS_AT_ONCE, BOUNDS_AT_ONCE = 1_000_000, 1_000_000
_INDEX = (
    "block long, doc_ids array<long>, lengths array<long>, sizes array<int>, codes array<int>, counts array<int>, "
    "terms array<binary>, holding array<long>, maxima array<long>"
)
#: Where a document has no id: behind all others among equal scores.
NO_ID = np.iinfo(np.int64).max


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def parts(counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term that stands ``counts`` times in a document of ``lengths`` terms gives to its score, before its weight."""
    norm = 10 + (90 * lengths * n_docs) // n_terms
    return (1_000_000_000 * counts) // (1000 * counts + 8 * norm)


@dataclass(frozen=True)
class LexicalIndex:
    """The blocks, the number of documents with a term, and the number of their terms."""

    blocks: DataFrame
    n_docs: int
    n_terms: int


def _blocks(docs: list[tuple[int | None, Counter, int]], number: int, n_docs: int, n_terms: int) -> Iterator[dict]:
    """Rows of the index for a chunk of documents. Those with the same most frequent term (so of one language) lie together, by length."""
    docs.sort(key=lambda d: (max(d[1].items(), key=lambda x: (x[1], x[0]))[0], d[2]))
    at = 0
    while at < len(docs):
        vocabulary: dict[bytes, int] = {}
        code_of, codes, counts, end = vocabulary.setdefault, [], [], at
        while end < len(docs) and end - at < BLOCK and (end == at or len(codes) + len(docs[end][1]) <= BLOCK_POSTINGS):
            codes += [code_of(term, len(vocabulary)) for term in docs[end][1]]
            counts += docs[end][1].values()
            end += 1
        own = docs[at:end]
        sizes = np.array([len(d[1]) for d in own], np.int32)
        lengths = np.array([d[2] for d in own], np.int64)
        code, count = np.array(codes, np.int32), np.array(counts, np.int64)
        maxima = np.zeros(len(vocabulary), np.int64)
        np.maximum.at(maxima, code, parts(count, np.repeat(lengths, sizes), n_docs, n_terms))
        yield {
            "block": number, "doc_ids": [d[0] for d in own], "lengths": lengths, "sizes": sizes, "codes": code, "counts": count.astype(np.int32),
            "terms": list(vocabulary), "holding": np.bincount(code, minlength=len(vocabulary)), "maxima": maxima,
        }
        number, at = number + 1, end


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> LexicalIndex:
    """The index of all rows; those without a term (null, empty or of separators only) have no entry and count nowhere.

    Ids may be null or repeated: each row is a document. Other columns are ignored. The table of blocks is written to the
    shared folder and stays there as long as it is of use.
    """
    spark = docs.sparkSession
    n_in_row = F.regexp_count(F.col(text), F.lit(TERM))
    totals = docs.select(n_in_row.alias("n")).agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = totals["docs"], totals["terms"]
    kinds = [pa.int64(), *[pa.list_(k) for k in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())]]
    names = ["block", "doc_ids", "lengths", "sizes", "codes", "counts", "terms", "holding", "maxima"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, chunk, postings = TaskContext.get().partitionId() << 40, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, chunk, postings
            for row in _blocks(chunk, number, n_docs, n_terms):
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([row[n]], k) for n, k in zip(names, kinds, strict=True)], names=names)
            chunk, postings = [], 0

        for batch in batches:
            for i, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = terms_of(content.as_py())
                if words:
                    found = Counter(words)
                    chunk.append((i, found, len(words)))
                    postings += len(found)
                if len(chunk) == CHUNK or postings >= CHUNK_POSTINGS:
                    yield from flush()
        yield from flush()

    given = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    with rows_a_batch(spark, DOCS_A_BATCH):
        return LexicalIndex(Scratch(spark, "lexical").keep(given.mapInArrow(cut, _INDEX), "blocks", **GROUPS), n_docs, n_terms)


class Queries:
    """Queries of one block of them, by term: ``pointer`` says where a term's queries and weights lie."""

    def __init__(self, rows: list[tuple[int, bytes, int]], n: int, k: int):
        rows = sorted(rows, key=lambda r: r[1])
        self.n, self.k = n, k
        self.vocabulary = sorted({r[1] for r in rows})
        number = {t: i for i, t in enumerate(self.vocabulary)}
        self.query = np.array([r[0] for r in rows], np.int64)
        self.weight = np.array([r[2] for r in rows], np.int64)
        self.pointer = np.searchsorted(np.array([number[r[1]] for r in rows]), np.arange(len(number) + 1))

    def rows_at_once(self) -> int:
        """How many blocks are bounded at a time: about a million bounds."""
        return max(1, BOUNDS_AT_ONCE // max(1, self.n))

    def known(self, terms: pa.Array) -> np.ndarray:
        """The number of each term here, or -1."""
        return pc.fill_null(pc.index_in(terms, value_set=pa.array(self.vocabulary, pa.binary())), -1).to_numpy(zero_copy_only=False)

    def spread(self, terms: np.ndarray, rows: np.ndarray, values: np.ndarray, n_rows: int, wanted: np.ndarray | None = None) -> np.ndarray:
        """n_rows x queries: the sums of weight times value over the entries (term, row, value), for the wanted queries (or all)."""
        there = terms >= 0
        terms, rows, values = terms[there], rows[there], values[there]
        width, column = self.n, None
        if wanted is not None:
            width, column = len(wanted), np.full(self.n, -1)
            column[wanted] = np.arange(width)
        sums = np.zeros(n_rows * width, np.int64)
        first, n = self.pointer[terms], self.pointer[terms + 1] - self.pointer[terms]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + PAIRS_AT_ONCE, side="right")) - 1)
            own = n[at:to]
            asked = np.repeat(first[at:to] - (ends[at:to] - ends[at]), own) + np.arange(own.sum())
            query, row, value = self.query[asked], np.repeat(rows[at:to], own), self.weight[asked] * np.repeat(values[at:to], own)
            if column is not None:
                query = column[query]
                row, value, query = row[query >= 0], value[query >= 0], query[query >= 0]
            np.add.at(sums, row * width + query, value)
            at = to
        return sums.reshape(n_rows, width)


class Best:
    """The k best (score, doc_id) of every query so far, best first; scores of 0 are empty places."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.scores, self.ids, self.k = np.zeros((n, k), np.int64), np.full((n, k), NO_ID), k
        #: A document below this score is of no use: others are known elsewhere that reach it.
        self.least = least

    def threshold(self) -> np.ndarray:
        return np.maximum(np.maximum(self.scores[:, -1], self.least), 1)

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: documents x queries."""
        found = np.concatenate([self.scores[queries], scores.T], axis=1)
        of = np.concatenate([self.ids[queries], np.broadcast_to(ids, (len(queries), len(ids)))], axis=1)
        order = np.lexsort((of, -found), axis=1)[:, : self.k]
        self.scores[queries], self.ids[queries] = np.take_along_axis(found, order, 1), np.take_along_axis(of, order, 1)

    def rows(self) -> pa.RecordBatch:
        query, place = np.nonzero(self.scores >= np.maximum(self.least, 1)[:, None])
        ids = self.ids[query, place]
        return pa.RecordBatch.from_arrays(
            [pa.array(query), pa.array(ids, mask=ids == NO_ID), pa.array(self.scores[query, place])], names=["query", "doc_id", "score"]
        )


def _flat(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The values of a list column's rows, and where each row's values begin and end."""
    return column.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))]).astype(np.int64)


def _numbers(column: pa.ListArray, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False)


def _bounds(asked: Queries, terms: pa.Array, starts: np.ndarray, maxima: np.ndarray) -> np.ndarray:
    """Blocks x queries: no document of the block scores more."""
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return asked.spread(asked.known(terms), rows, maxima, len(starts) - 1)


def _promising(asked: Queries, first: int):
    """The blocks of the highest bounds for each query, of those that a task sees: block, query, bound."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, blocks = np.zeros((0, asked.n), np.int64), np.zeros((0, asked.n), np.int64)
        for batch in batches:
            step = asked.rows_at_once()
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                terms, starts = _flat(part.column(1))
                own = _bounds(asked, terms, starts, _flat(part.column(2))[0].to_numpy(zero_copy_only=False))
                bounds = np.concatenate([bounds, own])
                blocks = np.concatenate([blocks, np.broadcast_to(part.column(0).to_numpy()[:, None], own.shape)])
                order = np.argsort(-bounds, axis=0, kind="stable")[:first]
                bounds, blocks = np.take_along_axis(bounds, order, 0), np.take_along_axis(blocks, order, 0)
        place, query = np.nonzero(bounds)
        yield pa.RecordBatch.from_arrays([pa.array(blocks[place, query]), pa.array(query), pa.array(bounds[place, query])], names=["block", "query", "bound"])

    return of


def _scores(asked: Queries, n_docs: int, n_terms: int, least: np.ndarray):
    """A task's k best documents of every query. Blocks are scored by falling bound, for the queries whose k-th score it reaches."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(asked.n, asked.k, least)
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            terms, starts = _flat(column["terms"])
            known = asked.known(terms)
            maxima = _flat(column["maxima"])[0].to_numpy(zero_copy_only=False)
            step = asked.rows_at_once()
            for at in range(0, batch.num_rows, step):
                to = min(at + step, batch.num_rows)
                own = starts[at : to + 1]
                rows = np.repeat(np.arange(to - at), np.diff(own))
                bounds = asked.spread(known[own[0] : own[-1]], rows, maxima[own[0] : own[-1]], to - at)
                for i in np.argsort(-bounds.max(axis=1), kind="stable").tolist() if asked.n else []:
                    queries = np.flatnonzero(bounds[i] >= best.threshold())
                    if not len(queries):
                        continue
                    sizes, lengths = _numbers(column["sizes"], at + i), _numbers(column["lengths"], at + i)
                    codes, counts = _numbers(column["codes"], at + i), _numbers(column["counts"], at + i).astype(np.int64)
                    ids = column["doc_ids"][at + i].values.fill_null(NO_ID).to_numpy(zero_copy_only=False)
                    value = parts(counts, np.repeat(lengths, sizes), n_docs, n_terms)
                    term = known[own[i] : own[i + 1]][codes]
                    best.add(queries, asked.spread(term, np.repeat(np.arange(len(sizes)), sizes), value, len(sizes), queries), ids)
        yield best.rows()

    return of


def search(index: LexicalIndex, items: DataFrame, k: int = 10, pairs_a_round: int = 100_000, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score: the k documents of the highest score above 0 for every item, ties by doc_id.

    An item is all rows of one id (null is an id, too), its terms are those of all their texts, once each; items without
    terms, or with terms that no document holds, have no rows. A null doc_id comes last among equal scores; rows with equal
    ids are ranked each. Queries go through the index in rounds of about ``pairs_a_round`` (item, term) pairs, which bounds
    what the driver and a task hold of them; each round reads the index twice. Other columns are ignored.
    """
    spark = index.blocks.sparkSession
    scratch = Scratch(spark, "lexical-search")
    lower = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = items.select(F.col(item_id).alias("item_id"), F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(f"({TERM})"), F.lit(1)))).alias("term"))
    pairs = found.distinct().withColumn("term", F.col("term").cast("binary"))
    holding = index.blocks.select(F.explode(F.arrays_zip("terms", "holding")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.holding").alias("n"))
    terms = scratch.keep(pairs.select("term").distinct(), "terms")
    terms = F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms
    holding = holding.join(terms, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(index.n_docs) + 2).cast("double") / (2 * F.col("df") + 1))).alias("weight")
    pairs = scratch.keep(pairs.join(holding, "term").select("item_id", "term", weight), "pairs")
    rounds = -(-pairs.count() // pairs_a_round)
    schema = "query long, doc_id long, score long"
    answers = []
    for number in range(rounds):
        own = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == number) if rounds > 1 else pairs
        rows = own.collect()  # about ``pairs_a_round`` of them
        ids = sorted({r["item_id"] for r in rows}, key=lambda i: (i is None, i))
        place = {i: n for n, i in enumerate(ids)}
        asked = Queries([(place[r["item_id"]], bytes(r["term"]), r["weight"]) for r in rows], len(ids), k)
        nothing = np.zeros(asked.n, np.int64)

        # Each query's most promising blocks: two a query, so bounded by the round and fit for a broadcast.
        seen = index.blocks.select("block", "terms", "maxima").mapInArrow(_promising(asked, 2), "block long, query long, bound long")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "block"))
        seeds = seen.withColumn("rank", rank).where("rank <= 2").select("block").distinct()
        seeded = index.blocks.join(F.broadcast(seeds), "block", "left_semi").mapInArrow(_scores(asked, index.n_docs, index.n_terms, nothing), schema)
        kth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
        least = nothing.copy()
        with rows_a_batch(spark, BLOCKS_A_BATCH):
            for r in seeded.withColumn("rank", kth).where(F.col("rank") == k).select("query", "score").collect():  # one row a query
                least[r["query"]] = r["score"]
            # At most k rows a query and task, written, so that no later plan holds the queries of several rounds.
            scored = scratch.keep(index.blocks.mapInArrow(_scores(asked, index.n_docs, index.n_terms, least), schema), f"scored-{number}")
        best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
        ranked = scored.withColumn("rank", best).where(F.col("rank") <= k)
        named = spark.createDataFrame(list(enumerate(ids)), f"query long, item_id {dict(pairs.dtypes)['item_id']}")
        answers.append(ranked.join(F.broadcast(named), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    if not answers:
        return pairs.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    return out
