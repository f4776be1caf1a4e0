"""Periodic runs of words: maximal stretches in which words a period apart are identical, found by Lyndon words.

Each run holds, at the place of one of its Lyndon roots, the longest Lyndon word that starts there, under one order of the
words or under the reverse order. A stack scanned from right to left gives these words under both orders; comparing two
suffixes and extending a root both ways ask for longest common extensions, which a binary search over rolling hashes
answers. Each answer is compared word by word; if a hash was wrong, the text is done again with another base. Inside a run
that is known already, the run itself answers, so that long extensions aren't asked for again and again.

Only the stretches that can hold a run are scanned: a run of at least 12 words and two periods has at least six words in a
row that stand again one period on, so every word of it lies in a window of six words that occurs twice in the text.
Windows are told apart by hashes, which can only make the stretches longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A Mersenne prime: hashes of stretches are polynomials in a base below it.
PRIME = (1 << 61) - 1
BASES = (0x1B873593CC9E2D51, 0x0A24BAED4963EE40, 0x1FC25C0B6C2AE3D7, 0x05851F42D4C957F3)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class WrongHash(ArithmeticError):
    """Two different stretches had one hash."""


class Extensions:
    """How far two places of a word sequence agree, to the right and to the left."""

    def __init__(self, words: list[int], base: int):
        self.words, total, power = words, 0, 1
        self.sums, self.powers = [0], [1]
        for w in words:
            total = (total * base + w + 1) % PRIME
            power = power * base % PRIME
            self.sums.append(total)
            self.powers.append(power)

    def equal(self, i: int, j: int, size: int) -> bool:
        sums = self.sums
        return (sums[i + size] - sums[j + size] - (sums[i] - sums[j]) * self.powers[size]) % PRIME == 0

    def right(self, i: int, j: int) -> int:
        """The number of equal words from i and from j > i on."""
        words, most, size = self.words, len(self.words) - j, 0
        while size < 4:
            if size == most or words[i + size] != words[j + size]:
                return size
            size += 1
        step = 8
        while size + step <= most and self.equal(i + size, j + size, step):
            size += step
            step *= 2
        while step:
            if size + step <= most and self.equal(i + size, j + size, step):
                size += step
            step //= 2
        if words[i : i + size] != words[j : j + size] or (size < most and words[i + size] == words[j + size]):
            raise WrongHash
        return size

    def left(self, i: int, j: int) -> int:
        """The number of equal words before i and before j > i."""
        words, size, step = self.words, 0, 1
        while size + step <= i and self.equal(i - size - step, j - size - step, step):
            size += step
            step *= 2
        while step:
            if size + step <= i and self.equal(i - size - step, j - size - step, step):
                size += step
            step //= 2
        if words[i - size : i] != words[j - size : j] or (size < i and words[i - size - 1] == words[j - size - 1]):
            raise WrongHash
        return size


def _scan(words: list[int], sign: int, ext: Extensions, least: int, found: dict[tuple[int, int], int]) -> None:
    """Adds the runs of the longest Lyndon words under one order: (start, period) -> length."""
    n = len(words)
    keys = words if sign > 0 else [-w for w in words]
    right = ext.right
    smaller = [n] * (n + 1)  # the next smaller suffix: where the longest Lyndon word that starts here ends
    known: dict[int, tuple[int, int]] = {}  # period -> the run found last, for the scan meets a run at each of its roots
    for i in range(n - 1, -1, -1):
        j, key, common = i + 1, keys[i], 0
        while j < n:
            other = keys[j]
            if key != other:
                if key > other:
                    common = 0
                    break
            else:
                inside = known.get(j - i)
                common = inside[1] - j if inside is not None and inside[0] <= i and j < inside[1] else right(i, j)
                if j + common == n or keys[i + common] > keys[j + common]:
                    break
            j = smaller[j]
        else:
            common = 0
        smaller[i] = j
        period = j - i
        inside = known.get(period)
        if inside is not None and inside[0] <= i and j + common <= inside[1]:
            continue
        missing = max(period, least - period) - common
        if missing > 0 and (missing > i or keys[i - 1] != keys[j - 1] or not ext.equal(i - missing, j - missing, missing)):
            continue
        start = i - ext.left(i, j)
        if i - start < missing:
            continue
        known[period] = (start, j + common)
        found[start, period] = j + common - start


def find_runs(words: list[int], least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of at least ``least`` words and two periods, by start, then period."""
    for base in BASES:
        try:
            ext, found = Extensions(words, base), {}
            _scan(words, 1, ext, least, found)
            _scan(words, -1, ext, least, found)
            return sorted((start, length, period) for (start, period), length in found.items())
        except WrongHash:
            continue
    raise WrongHash("every base gave a wrong hash")


def _stretches(words: list[bytes], size: int) -> list[tuple[int, int]]:
    """(from, to) of the stretches of words that lie in a window of ``size`` words which occurs at least twice."""
    n = len(words)
    codes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    windows = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        windows = windows * np.uint64(0x9E3779B97F4A7C15) + codes[k : n - size + 1 + k]
    # The upper bits mix all words; the lowest ones hardly do.
    windows ^= windows >> np.uint64(32)
    ranked = np.sort(windows)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return []
    at = np.flatnonzero(np.isin(windows, twice))
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    covered = np.concatenate([[False], np.cumsum(edge[:n]) > 0, [False]])
    border = np.flatnonzero(covered[1:] != covered[:-1])
    return list(zip(border[::2].tolist(), border[1::2].tolist(), strict=True))


def runs_of_words(words: list[bytes], least: int = 12) -> list[tuple[int, int, int]]:
    """:func:`find_runs` over words given as bytes, scanning only what can hold a run."""
    if len(words) < least:
        return []
    found = []
    for a, b in _stretches(words, (least + 1) // 2):
        if b - a < least:
            continue
        numbers: dict[bytes, int] = {}
        ranks = [numbers.setdefault(w, len(numbers)) for w in words[a:b]]
        found += [(a + start, length, period) for start, length, period in find_runs(ranks, least)]
    return found


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds behind its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    kept = np.cumsum(edge[:-1]) == 0
    return b" ".join([w for w, k in zip(words, kept.tolist(), strict=True) if k])


def periodic_runs(docs: DataFrame, least: int = 12, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, runs (by start, then period: start and length in words, smallest period), collapsed.

    Words are runs of anything but ASCII white space. A run is a stretch of words with smallest period q, at least ``least``
    words and two periods long, that no neighbouring word extends with that period. ``collapsed`` is the text without the
    words that any run holds behind its first q words, joined by single spaces. Null, empty and blank texts have no runs
    and collapse to an empty string. Ids may be null or repeated: each row is one document. Other columns are ignored; an
    empty table gives no rows. A text of n words takes memory in proportion to n, time to n log n, in one task.
    """
    if least < 2:
        raise ValueError("a run has two words at least")

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            runs, collapsed = [], []
            for content in batch.column(1):
                words = content.as_py().split()  # of bytes: exactly ASCII white space parts words
                found = runs_of_words(words, least)
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                collapsed.append(collapse(words, found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(runs, kind), pa.array(collapsed, pa.binary())], names=["doc_id", "runs", "collapsed"]
            )

    given = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    found = given.mapInArrow(detect, f"doc_id {kind}, runs {RUNS}, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))
