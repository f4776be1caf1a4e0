"""Semi-joins by bits, and which members of shards are sent on."""

import random

import pytest

from evidentia.llm import bitmaps, ngram_jaccard


@pytest.mark.parametrize("blocks", [bitmaps.BLOCKS, 0])
def test_rows_with_a_bit(spark, monkeypatch, blocks):
    monkeypatch.setattr(bitmaps, "BLOCKS", blocks)
    near = [0, 1, 7, 8, 32767, 32768, 32769, 65536, 65537, 1 << 33, (1 << 33) + 5, (3 << 33) + 40_000]
    keys = near[::2]
    rows = spark.createDataFrame([(k, f"t{k}") for k in near + near[:3]] + [(None, "none")], "k long, text string")
    bits = bitmaps.bit_blocks(spark.createDataFrame([(k,) for k in keys + keys[:2]], "k long"), "k")
    got = bitmaps.having_bit(rows, "k", bits, bits.count())
    assert got.columns == ["k", "text"]
    assert sorted(r.k for r in got.collect()) == sorted(k for k in near + near[:3] if k in keys)


@pytest.mark.parametrize("percent", [50, 75, 90, 100])
def test_members_near_in_size(spark, percent):
    rng = random.Random(percent)
    rows = [(shard, 100 * shard + k, rng.choice([1, 2, 3, 4, 5, 8, 16, 30, 40, 300, 399, 400, 533, 534, 5000])) for shard in range(60) for k in range(rng.randrange(1, 7))]
    may = lambda a, b: 100 * min(a, b) >= percent * max(a, b)
    needed = {x for x in rows if any(y[0] == x[0] and y != x and may(x[2], y[2]) for y in rows)}
    got = set(map(tuple, ngram_jaccard.near_in_size(spark.createDataFrame(rows, "shard long, ref long, n int"), percent).collect()))
    assert needed <= got <= set(rows)
    assert got == needed and len(needed) < len(rows)
