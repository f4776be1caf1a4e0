"""N-gram Jaccard join by count vectors in R-trees, with the number of links of every set and the components of the links.

A text's set of word shingles is hashed. Two sets with a similarity of at least t share a shingle among the first few of
each, in any common order; the order here puts shingles that many documents hold last, by counts over all documents. The
sets that hold such a first shingle form a star around one of them, its pivot: first inside a task, then the pivots of the
tasks around one of them. So shards, the members of a pivot's stars, lose no link; a set is in as many shards as it has
different pivots, which for near copies is one or two; and what is shuffled for a shingle that a third of all documents
hold is one entry a task.

In every shard, shingles hashed into groups give each set a vector of group counts, a point in an R-tree that is bulk-loaded
by coordinates. The summed coordinate minima of two points bound the sets' overlap, and those of two nodes' upper corners
bound it for all pairs below them. The tree joined with itself lists the pairs that the bound admits; nothing else lists
pairs. First only points are shuffled, which are made with the first shingles, and only to shards in which another set is near
enough in size; the sets of members with an admitted partner follow and are verified. A pair counts in the first shard that both its
sets are in. Tasks return a row for each set, with its links and one set that it reaches, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.bitmaps import bit_blocks, having_bit
from evidentia.llm.scratch import Scratch

#: Buckets of the shingle counts. With 5e12 shingles in all, one that 15,000 documents hold still stands out of its bucket.
BUCKETS = 1 << 20
#: Coordinates of the point of a set of up to SMALL shingles, and members of a leaf.
GROUPS, SMALL, LEAF = 256, 1024, 64
#: Points, and shingles of sets, in a block of a shard's members; a task holds two blocks at most.
POINTS, UNIT = 4096, 1 << 20
#: First shingles that a task sorts at a time and about as many in a part of all entries, rows of a slice of a batch, and words and sets that a task remembers.
ENTRIES, SLICE, WORDS, SEEN = 1 << 20, 256, 150_000, 200_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOW = (1 << 32) - 1


class _WordHashes(dict):
    """64-bit hashes of words; at most a bounded number is kept."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str, size: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words; a shorter text is one shingle, one without words none."""
    words = text.encode().lower().split()  # bytes: only A-Z are lowered, only \x20 and \x09-\x0D separate
    if not words:
        return np.empty(0, np.uint64)
    found = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(size, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * _STEP + found[k : len(found) - n + 1 + k]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


def set_key(found: np.ndarray) -> tuple[int, int]:
    """128 bits of hash of a whole set, as two signed longs."""
    import xxhash

    value = xxhash.xxh3_128_intdigest(found.tobytes())
    return (value >> 64) - (1 << 63), (value & ((1 << 64) - 1)) - (1 << 63)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that only few texts are held as Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


# --- Counts over all documents ---


def common_buckets(texts: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """A class for each bucket of shingles: 0, or higher the more documents hold its shingles beyond what chance gives; and the number of all shingles.

    Every task sends its counts in compressed blocks; blocks are summed over a thousand tasks at a time, then over those.
    """
    block = 4096

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        from pyspark import TaskContext

        total, hashes = np.zeros(BUCKETS, np.int64), _WordHashes()
        held, n = [], 0
        for batch in slices(batches):
            held += [shingles(text, size, hashes) for text in batch.column(0).to_pylist()]
            n += sum(map(len, held[-batch.num_rows :]))
            if n > ENTRIES:
                total += np.bincount((np.concatenate(held) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
                held, n = [], 0
        if n:
            total += np.bincount((np.concatenate(held) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        rows = [(k, r) for k, r in enumerate(total.reshape(-1, block)) if r.any()]
        lane = [TaskContext.get().partitionId() >> 10] * len(rows)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array(lane, pa.int32()), pa.array([zlib.compress(r.tobytes(), 1) for _, r in rows], pa.binary())], names=["block", "lane", "counts"])

    def add(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        import zlib

        total = np.zeros(block, np.int64)
        for packed in found["counts"]:
            total += np.frombuffer(zlib.decompress(packed), np.int64)
        return pd.DataFrame({"block": [key[0]], "counts": [zlib.compress(total.tobytes(), 1)]})

    lanes = texts.select("text").mapInArrow(count, "block int, lane int, counts binary").groupBy("block", "lane").applyInPandas(add, "block int, counts binary")
    counts = np.zeros((BUCKETS // block, block), np.int64)
    for r in lanes.groupBy("block").applyInPandas(add, "block int, counts binary").collect():  # BUCKETS counts, whatever the corpus
        import zlib

        counts[r["block"]] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    counts = counts.ravel()
    over = counts - counts.mean()
    return np.where(over <= 6 * np.sqrt(counts.mean()) + 4, 0, 1 + np.floor(np.log2(np.maximum(over, 1)))).astype(np.uint8), int(counts.sum())


# --- Shards: stars of sets that share a first shingle ---


def _pack_entries(base: int, tokens: np.ndarray, own: np.ndarray) -> bytes:
    """Sorted 48-bit shingles and, for each, a 32-bit number that counts from ``base``."""
    import zlib

    body = (tokens >> np.uint64(32)).astype("<u2").tobytes() + (tokens & np.uint64(_LOW)).astype("<u4").tobytes() + own.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return base.to_bytes(8, "little") + zlib.compress(body, 1)


def _unpack_entries(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zlib

    body = zlib.decompress(block[8:])
    n = len(body) // 10
    tokens = np.frombuffer(body, "<u2", n).astype(np.uint64) << np.uint64(32) | np.frombuffer(body, "<u4", n, 2 * n)
    own = np.frombuffer(body, np.uint8, 4 * n, 6 * n).reshape(4, n).T.copy().view("<u4").ravel()
    return tokens, own.astype(np.int64) + int.from_bytes(block[:8], "little")


def _stars(tokens: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted (token, own) rows: where each token starts, and distinct (member, pivot) of members other than their token's first."""
    starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.empty(0, np.int64)
    pivot = np.repeat(own[starts], np.diff(np.r_[starts, len(tokens)]))
    pairs = np.unique(np.stack([own, pivot], 1)[own != pivot], axis=0)
    return starts, pairs[:, 0], pairs[:, 1]


FOUND = "kind int, doc_id long, row long, th long, n int, hi long, lo long, ref long, part int, block binary, pivot long, point binary"


def first_shingles(texts: DataFrame, classes: np.ndarray, size: int, percent: int, bits: int) -> DataFrame:
    """Rows of FOUND. Kind 0: a document with its set's key and ``ref``, a number that equal sets of a task share, and with the first of these their point. Kind 1:
    entries of the first shingles of a task's sets, by their ``bits`` top bits. Kind 2: (ref, pivot), a member of a star inside a task."""
    shared = texts.sparkSession.sparkContext.broadcast(classes)  # BUCKETS bytes
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("row", pa.int64()), ("th", pa.int64()), ("n", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64()), ("ref", pa.int64()), ("part", pa.int32()), ("block", pa.binary()), ("pivot", pa.int64()), ("point", pa.binary())])

    def rows(kind: int, **columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        full = columns | {"kind": np.full(n, kind, np.int32)}
        return pa.RecordBatch.from_arrays([c if isinstance(c := full.get(f.name), pa.Array) else pa.array(c, f.type) if c is not None else pa.nulls(n, f.type) for f in schema], schema=schema)

    def flush(base: int, tokens: list, counts: list) -> Iterator[pa.RecordBatch]:
        flat, own = np.concatenate(tokens), np.repeat(np.arange(len(counts)), counts)
        order = np.argsort(flat, kind="stable")  # own ascends within a token
        flat, own = flat[order], own[order]
        starts, member, pivot = _stars(flat, own)
        if len(member):
            yield rows(2, ref=member + base, pivot=pivot + base)
        flat, own = flat[starts], own[starts]
        part = (flat >> np.uint64(48 - bits)).astype(np.int32)
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        yield rows(1, part=part[cuts[:-1]], block=pa.array([_pack_entries(base, flat[a:b], own[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        classes, hashes, seen = shared.value, _WordHashes(), {}
        base = TaskContext.get().partitionId() << 32
        tokens, counts, held, at = [], [], 0, base
        for batch in slices(batches):
            n, keys, refs, points = [], [], [], []
            for text in batch.column(3).to_pylist():
                found = shingles(text, size, hashes)
                n.append(len(found))
                points.append(None)
                if not len(found):
                    keys.append((None, None))
                    refs.append(None)
                    continue
                keys.append(key := set_key(found))
                ref = seen.get(key)
                if ref is None:
                    if len(seen) > SEEN:
                        seen.clear()
                    ref = seen[key] = at + len(counts)
                    points[-1] = pack_point(group_counts(found))
                    own = classes[(found % np.uint64(BUCKETS)).astype(np.int64)]
                    first = np.argsort(own, kind="stable")[: len(found) - -(-percent * len(found) // 100) + 1]
                    tokens.append(found[first] >> np.uint64(16))
                    counts.append(len(first))
                    held += len(first)
                refs.append(ref)
            yield rows(0, doc_id=batch.column(0), row=batch.column(1), th=batch.column(2), n=n, hi=[k[0] for k in keys], lo=[k[1] for k in keys], ref=refs, point=points)
            if held > ENTRIES:
                yield from flush(at, tokens, counts)
                at += len(counts)
                tokens, counts, held = [], [], 0
        if held:
            yield from flush(at, tokens, counts)

    return texts.select("doc_id", "row", "th", "text").mapInArrow(find, FOUND)


def join_stars(entries: DataFrame) -> DataFrame:
    """(ref, pivot) of the stars that entries (part, block) of different tasks form. A group has one entry of a shingle from a task at most."""

    def merge(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        unpacked = [_unpack_entries(b) for b in found["block"]]
        tokens, own = (np.concatenate(x) for x in zip(*unpacked, strict=True))
        order = np.lexsort((own, tokens))
        _, member, pivot = _stars(tokens[order], own[order])
        return pd.DataFrame({"ref": member, "pivot": pivot})

    return entries.groupBy("part").applyInPandas(merge, "ref long, pivot long")


# --- R-trees over group counts ---


def group_counts(found: np.ndarray) -> np.ndarray:
    """How many of a set's hashes fall into each of GROUPS groups, or of more (a power of two times as many) in sets above SMALL."""
    groups = GROUPS
    while groups * SMALL < len(found) * GROUPS:
        groups *= 2
    return np.bincount(((found >> np.uint64(8)) % np.uint64(groups)).astype(np.int64), minlength=groups)


def pack_point(counts: np.ndarray) -> bytes:
    """Counts in 8 bits each where they fit, else in 32, compressed; the first byte tells which."""
    import zlib

    return b"\1" + zlib.compress(counts.astype(np.uint8).tobytes(), 1) if counts.max() < 256 else b"\4" + zlib.compress(counts.astype("<u4").tobytes(), 1)


def unpack_point(packed: bytes) -> np.ndarray:
    import zlib

    return np.frombuffer(zlib.decompress(packed[1:]), np.uint8 if packed[0] == 1 else "<u4").astype(np.int32)


def _folded(point: np.ndarray, groups: int) -> np.ndarray:
    return point if len(point) == groups else point.reshape(-1, groups).sum(axis=0)


class RTree:
    """Bulk-loaded: members are parted by their number of coordinates, then halved by size where sizes are too far apart to link, else along the coordinate of the widest range.

    A node keeps the upper corner of its points and the range of its sizes. All points of a leaf have equally many
    coordinates; two leaves are compared with those that both have.
    """

    def __init__(self, points: list[np.ndarray], sizes: np.ndarray, percent: int):
        self.points, self.sizes, self.percent = points, sizes, percent
        self.coarse = np.stack([_folded(p, GROUPS) for p in points])
        self.groups = np.array([len(p) for p in points])
        self.nodes: list[tuple] = []  # upper corner, least and largest size, children, members, their points
        self._load(np.arange(len(points)))

    def _load(self, members: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        low, high, children, fine = int(self.sizes[members].min()), int(self.sizes[members].max()), (), None
        fewest = self.groups[members].min()
        if (finer := self.groups[members] > fewest).any():
            children = (self._load(members[~finer]), self._load(members[finer]))
        elif len(members) > LEAF:
            own = self.coarse[members]
            by = self.sizes[members] if self.percent * high > 100 * low else own[:, int((own.max(axis=0) - own.min(axis=0)).argmax())]
            order = members[np.argsort(by, kind="stable")]
            children = (self._load(order[: len(order) // 2]), self._load(order[len(order) // 2 :]))
        else:
            fine = self.coarse[members] if fewest == GROUPS else np.stack([self.points[m] for m in members])
            fine = fine.astype(np.uint16) if fine.max() < 1 << 16 else fine
        self.nodes[at] = (self.coarse[members].max(axis=0), low, high, children, members, fine)
        return at

    def _may_link(self, overlap, a, b):
        return (100 + self.percent) * overlap >= self.percent * (a + b)

    def join(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(a, b, admitted): members of two leaves, or twice of one, and whether the bound admits each pair; within one leaf only i < j."""
        pairs = [(0, 0)]
        while pairs:
            x, y = pairs.pop()
            (up_a, low_a, high_a, children_a, a, fine_a), (up_b, low_b, high_b, children_b, b, fine_b) = self.nodes[x], self.nodes[y]
            if self.percent * low_a > 100 * high_b or self.percent * low_b > 100 * high_a:
                continue
            if x != y and not self._may_link(min(int(np.minimum(up_a, up_b).sum(dtype=np.int64)), high_a, high_b), low_a, low_b):
                continue
            if children_a or children_b:
                if x == y:
                    p, q = children_a
                    pairs += [(p, p), (p, q), (q, q)]
                elif children_a and (not children_b or len(a) >= len(b)):
                    pairs += [(c, y) for c in children_a]
                else:
                    pairs += [(x, c) for c in children_b]
                continue
            groups = min(fine_a.shape[1], fine_b.shape[1])
            fold = lambda fine: fine if fine.shape[1] == groups else fine.reshape(len(fine), -1, groups).sum(axis=1)  # noqa: B023, E731
            p, q = fold(fine_a), fold(fine_b)
            overlap = np.minimum(p[:, None, :], q[None, :, :]).sum(axis=2, dtype=np.int64)
            admitted = self._may_link(overlap, self.sizes[a][:, None], self.sizes[b][None, :])
            if x == y:
                admitted = np.triu(admitted, 1)
            if admitted.any():
                yield a, b, admitted


class Unit:
    """Members of one block of a shard, or of two blocks, of which only pairs across are meant. ``pairs`` joins its tree."""

    def __init__(self, shard: int, unit: int, points: list[np.ndarray], sizes: np.ndarray, blocks: np.ndarray, places: list[bytes], percent: int):
        self.tree = RTree(points, sizes, percent)
        self.blocks = blocks if unit >> 20 != unit & 0xFFFFF else None
        # Bits for the earlier shards that several members are in: a pair with a common one is that shard's.
        before: dict[int, list[int]] = {}
        for i, packed in enumerate(places):
            own = np.frombuffer(packed, np.int64)
            for s in own[own < shard].tolist():
                before.setdefault(s, []).append(i)
        several = [m for m in before.values() if len(m) > 1]
        self.bits = np.zeros((len(places), -(-len(several) // 8)), np.uint8) if several else None
        for k, m in enumerate(several):
            self.bits[m, k // 8] |= np.uint8(1 << (k % 8))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for a, b, admitted in self.tree.join():
            if self.blocks is not None:
                admitted = admitted & (self.blocks[a][:, None] != self.blocks[b][None, :])
            if self.bits is not None:
                for k in range(self.bits.shape[1]):
                    admitted = admitted & ((self.bits[a, k][:, None] & self.bits[b, k][None, :]) == 0)
            if admitted.any():
                yield a, b, admitted


def own_block(ref: int, blocks: int) -> int:
    return (ref * 0x9E3779B97F4A7C15 >> 24 & 0xFFFFF) % blocks


def units_of(own: int, blocks: int) -> list[int]:
    """The units that a block is in, of a shard of so many: each pair of blocks with it."""
    return [(min(own, k) << 20) | max(own, k) for k in range(blocks)]


def whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole units, of rows sorted by (shard, unit) that start with these columns, and where each unit starts."""

    def starts(rows: pa.Table) -> np.ndarray:
        shard, unit = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        return np.r_[0, np.flatnonzero((shard[1:] != shard[:-1]) | (unit[1:] != unit[:-1])) + 1]

    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        cuts = starts(rows)
        if len(cuts) > 1:
            yield rows.slice(0, cuts[-1]), cuts[:-1]
        rest = rows.slice(cuts[-1])
    if rest is not None:
        yield rest, starts(rest)


# --- The two searches: points of all members, then sets of those with an admitted partner ---


def _fetch(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(ref, hi, lo, shards, into, text) of the wanted sets, from one document each. A bit for each wanted hash, among 16 times as many or more, skips most other texts before the shuffle."""
    hashes = 1 << min(29, max(20, (16 * wanted.count()).bit_length()))
    place = F.pmod("th", F.lit(hashes)).alias("place")
    near = having_bit(texts.select("th", "text", place), "place", bit_blocks(wanted.select(place), "place"), hashes >> 15).drop("place")
    # A merge join leaves rows in the order of th, so that dropping repeated rows neither shuffles nor sorts.
    return near.join(wanted.hint("merge"), "th").dropDuplicates(["th", "ref"])


def _dealt(members: DataFrame, size: int, sets: bool) -> DataFrame:
    """Rows (shard, unit, ref, block, n, content, places), dealt and sorted by shard and unit; content is the set, of the text, or its point; places its earlier shards."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, kinds = _WordHashes(), [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

        def contents(c: dict[str, list]) -> Iterator[tuple[int, bytes] | None]:
            if not sets:
                yield from zip(c["n"], c["point"], strict=True)
                return
            for key, text in zip(zip(c["hi"], c["lo"], strict=True), c["text"], strict=True):
                found = shingles(text, size, hashes)
                # None: a text of the same 64-bit hash as the wanted one
                yield (len(found), found.tobytes()) if set_key(found) == key else None

        for batch in slices(batches):
            out, c = [], {name: batch.column(k).to_pylist() for k, name in enumerate(batch.schema.names)}
            for ref, shards, into, content in zip(c["ref"], c["shards"], c["into"], contents(c), strict=True):
                if content is None:
                    continue
                places = np.sort(shards).astype(np.int64)
                for shard, blocks in ((x["shard"], x["blocks"]) for x in into):
                    own, before = own_block(ref, blocks), places[: np.searchsorted(places, shard)].tobytes()
                    out += [(shard, unit, ref, own, *content, before) for unit in units_of(own, blocks)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["shard", "unit", "ref", "block", "n", "content", "places"])

    rows = members.mapInArrow(deal, "shard long, unit long, ref long, block int, n int, content binary, places binary")
    return rows.repartition("shard", "unit").sortWithinPartitions("shard", "unit", "ref")


def _unit(rows: pa.Table, a: int, b: int, points: list[np.ndarray], percent: int) -> Unit:
    part = rows.slice(a, b - a)
    return Unit(part.column(0)[0].as_py(), part.column(1)[0].as_py(), points, part.column(4).to_numpy().astype(np.int64), part.column(3).to_numpy(), part.column(6).to_pylist(), percent)


def admitted_members(dealt: DataFrame, percent: int) -> DataFrame:
    """(shard, ref, n) of the members of dealt points for whom the trees list a partner."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_units(batches):
            keep = np.zeros(rows.num_rows, bool)
            content = rows.column(5)
            for a, b in zip(starts, [*starts[1:], rows.num_rows], strict=True):
                if b - a < 2:
                    continue
                for i, j, admitted in _unit(rows, a, b, [unpack_point(x) for x in content.slice(a, b - a).to_pylist()], percent).pairs():
                    keep[a + i[admitted.any(axis=1)]] = True
                    keep[a + j[admitted.any(axis=0)]] = True
            yield from rows.select(["shard", "ref", "n"]).filter(pa.array(keep)).to_batches()

    return dealt.mapInArrow(search, "shard long, ref long, n int").distinct()


def verified(dealt: DataFrame, percent: int) -> DataFrame:
    """(ref, links, least) for members of dealt sets with links in a unit: their number and the least ref that they reach there."""

    def check(rows: pa.Table, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        sets = [np.frombuffer(x, np.uint64) for x in rows.column(5).slice(a, b - a).to_pylist()]
        sizes = np.array([len(s) for s in sets])
        names = np.unique(np.concatenate(sets), return_inverse=True)[1]
        ends = np.cumsum(sizes)
        named = np.split(names, ends[:-1])
        mark = np.zeros(int(names.max()) + 1, bool)
        links, label = np.zeros(len(sets), np.int64), np.arange(len(sets))
        for i, j, admitted in _unit(rows, a, b, [group_counts(s) for s in sets], percent).pairs():
            columns = np.flatnonzero(admitted.any(axis=0))
            j, admitted = j[columns], admitted[:, columns]
            flat, starts = np.concatenate([named[k] for k in j]), np.cumsum([0, *sizes[j][:-1]])
            for x in np.flatnonzero(admitted.any(axis=1)):
                k = i[x]
                mark[named[k]] = True
                shared = np.add.reduceat(mark[flat], starts, dtype=np.int64)
                mark[named[k]] = False
                hit = j[admitted[x] & ((100 + percent) * shared >= percent * (sizes[k] + sizes[j]))]
                if len(hit):
                    links[k] += len(hit)
                    links[hit] += 1
                    least = min(label[k], label[hit].min())
                    for other in np.unique(label[np.r_[k, hit]]):
                        if other != least:
                            label[label == other] = least
        return links, label

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_units(batches):
            refs, links, label = rows.column(2).to_numpy(), np.zeros(rows.num_rows, np.int64), np.arange(rows.num_rows)
            for a, b in zip(starts, [*starts[1:], rows.num_rows], strict=True):
                if b - a > 1:
                    links[a:b], found = check(rows, a, b)
                    label[a:b] = found + a
            yield pa.RecordBatch.from_arrays([pa.array(refs), pa.array(links), pa.array(refs[label])], names=["ref", "links", "least"]).filter(pa.array(links > 0))

    return dealt.mapInArrow(search, "ref long, links long, least long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, comp) for every key in an edge (a, b): the smallest key that it reaches. Minima spread along edges, then labels jump to their labels' labels."""
    both = edges.select(F.col("a").alias("key"), F.col("b").alias("other")).union(edges.select("b", "a"))
    edges = scratch.keep(both.distinct(), "edges")
    labels = scratch.keep(edges.groupBy("key").agg(F.least("key", F.min("other")).alias("comp")), "labels-0")
    step = 0
    while True:
        step += 1
        heard = edges.join(labels.withColumnRenamed("key", "other"), "other").groupBy("key").agg(F.min("comp").alias("heard"))
        lower = labels.join(heard, "key").select("key", F.col("comp").alias("was"), F.least("comp", "heard").alias("comp"))
        jump = labels.select(F.col("key").alias("comp"), F.col("comp").alias("further"))
        new = scratch.keep(lower.join(jump, "comp", "left").select("key", "was", F.least("comp", F.coalesce("further", "comp")).alias("comp")), f"labels-{step}")
        changed = new.where("comp <> was").limit(1).count()
        scratch.drop(f"labels-{step - 1}")
        labels = new.select("key", "comp")
        if not changed:
            return labels


def shard_members(found: DataFrame, refs: DataFrame) -> DataFrame:
    """Distinct (shard, ref, n) of the members of all shards, in numbers of classes of equal sets; of shards with the same members one is kept."""
    named = lambda pairs: pairs.join(refs.select("ref", F.col("id").alias("a")), "ref").join(refs.select(F.col("ref").alias("pivot"), F.col("id").alias("b")), "pivot").where("a <> b").select("a", "b").distinct()
    inside = named(found.where("kind = 2").select("ref", "pivot"))
    across = named(join_stars(found.where("kind = 1").select("part", "block")))
    # A member of a star inside a task is in the shards that the star's pivot is in.
    further = inside.withColumnRenamed("b", "via").join(across.select(F.col("a").alias("via"), "b"), "via").select("a", "b")
    stars = inside.union(across).union(further).where("a <> b")
    members = stars.union(stars.select("b", "b")).toDF("ref", "shard").distinct()
    sized = members.join(refs.where("ref = id").select("ref", "n"), "ref")
    return sized.select("shard", "ref", "n")


def near_in_size(members: DataFrame, percent: int) -> DataFrame:
    """The members (shard, ref, n) of shards in which another member's size doesn't rule out a link.

    Sizes are counted by classes, inside which all may link, so a shard has few rows however many its members are. One alone
    in its class is compared with the nearest sizes of the classes beside it.
    """
    width = max(math.log(100 / percent), 0.01)
    classed = members.withColumn("size", F.floor(F.log("n") / width).cast("int"))
    there = classed.groupBy("shard", "size").agg(F.count("*").alias("c"), F.min("n").alias("low"), F.max("n").alias("high"))
    by_size = Window.partitionBy("shard").orderBy("size")
    may_link = lambda small, large: 100 * small.cast("long") >= percent * large.cast("long")
    near = (F.col("c") > 1) | may_link(F.lag("high").over(by_size), F.col("low")) | may_link(F.col("high"), F.lead("low").over(by_size))
    return classed.join(there.withColumn("near", near).where("near").select("shard", "size"), ["shard", "size"], "left_semi").select("shard", "ref", "n")


def join_documents(docs: DataFrame, size: int = 5, percent: int = 75, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """Per row: row (that column of ``docs``, a long, or null), doc_id, n_shingles, component_id, n_links and component, a number of the row's component (null for empty sets).

    See :func:`near_duplicates`.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    own_row = F.col(row).cast("long") if row else F.lit(None).cast("long")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), own_row.alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = texts.select("*", F.xxhash64("doc_id", "text").alias("th"))
    classes, n_shingles = common_buckets(texts, size)
    # A set has about a quarter of its shingles as entries, so a part has ENTRIES of them whatever the corpus.
    bits = max(6, min(24, (n_shingles // (4 * ENTRIES)).bit_length()))
    found = scratch.keep(first_shingles(texts, classes, size, percent, bits), "found")

    documents = found.where("kind = 0").select("row", "doc_id", "n", "ref", "hi", "lo", "th")
    sets = documents.where("ref is not null").groupBy("ref", "hi", "lo").agg(F.min("n").alias("n"), F.min("doc_id").alias("doc_id"), F.min("th").alias("th"))
    classes = sets.groupBy("hi", "lo").agg(F.min("ref").alias("id"), F.min("doc_id").alias("least_id"), F.min("th").alias("th"))
    refs = scratch.keep(sets.select("ref", "hi", "lo", "n").join(classes, ["hi", "lo"]), "refs")

    members = scratch.keep(near_in_size(shard_members(found, refs), percent), "members")
    shape = members.groupBy("shard").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("ref")).alias("x"), F.bit_xor(F.xxhash64("ref", F.lit(1))).alias("y"))
    first = shape.groupBy("c", "x", "y").agg(F.min("shard").alias("shard"))

    def in_blocks(members: DataFrame, blocks: Column) -> DataFrame:
        """(ref, into) from (shard, ref, n): a set's shards, as many at most as it has first shingles, with their numbers of blocks."""
        sized = members.groupBy("shard").agg(F.ceil(blocks).cast("int").alias("blocks"))
        return members.join(sized, "shard").groupBy("ref").agg(F.collect_list(F.struct("shard", "blocks")).alias("into"))

    places = in_blocks(members.join(first.select("shard"), "shard", "left_semi"), F.count("*") / POINTS)
    keys = refs.where("ref = id").select("ref", "hi", "lo", "th", "n")
    wanted = scratch.keep(places.withColumn("shards", F.col("into.shard")).join(keys, "ref"), "wanted")

    points = wanted.join(found.where("point is not null").select("ref", "point"), "ref").select("ref", "n", "shards", "into", "point")
    hits = scratch.keep(admitted_members(_dealt(points, size, False), percent), "hits")
    again = scratch.keep(wanted.drop("into").join(in_blocks(hits, F.sum("n") / UNIT), "ref"), "again")
    links = scratch.keep(verified(_dealt(_fetch(texts, again), size, True), percent), "links")

    labels = components(links.where("ref <> least").select(F.col("ref").alias("a"), F.col("least").alias("b")), scratch)
    counted = links.groupBy("ref").agg(F.sum("links").alias("n_links"))
    named = refs.where("ref = id").select("id", "least_id").join(labels.withColumnRenamed("key", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    of_class = named.join(named.groupBy("comp").agg(F.min("least_id").alias("component_id")), "comp").join(counted.withColumnRenamed("ref", "id"), "id", "left")
    of_ref = refs.select("ref", "id").join(of_class.select("id", "comp", "component_id", "n_links"), "id").drop("id")
    out = documents.join(of_ref, "ref", "left").select(
        "row", "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("comp").alias("component"),
    )
    return scratch.last(out, "joined")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75, doc_id: str = "doc_id", text: str = "text", count_links: bool = False) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, the smallest doc_id that links of similarity >= percent / 100 reach, and
    with ``count_links`` n_links, the number of other sets that the row's set links to. Every link is verified either way.

    Words are runs of characters other than \\x20 and \\x09-\\x0D, A-Z lowered. A document's set has its distinct shingles of
    ``size`` words; with fewer words the whole sequence; null, empty and blank texts have an empty set and no link. Equal
    sets are one set with several documents, all of one component. Repeated rows give a row each. A null doc_id never
    becomes a component's id, unless all are null. Other columns are ignored; an empty table gives no rows.

    Shingles are compared by 64 bits of hash, sets by 128: two sets of 20,000 different shingles have a chance of 2e-11 of a
    common one, and among 1e10 sets that of two wrongly equal ones is 2e-19.
    """
    return join_documents(docs, size, percent, doc_id, text).select("doc_id", "n_shingles", "component_id", *["n_links"] * count_links)
