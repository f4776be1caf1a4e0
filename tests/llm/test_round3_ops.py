"""Best-fit packing, periodic runs and lexical search against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidentia.llm import best_fit, lexical, periodic_runs, quality_classifier, quality_rules, queries, secret_scan

SF = "/root/testdata/sf0.001"
JSON = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a  b\n\n c<|endoftext|> x"), (5, "a  b\n\n c<|endoftext|> x"), (6, "x" * 3000),
    (7, "it's\n \nok  \x1c! \xa0　 z"), (8, "word don't  \n\t 123 ... " * 400), (None, "no id here"), (9, "A a\xc0 \xe0 A1" * 3), (10, "?!. --- \x00"),
    (11, "same " * 5000), (-12, " ".join(f"w{i % 700}" for i in range(30_000))),
]
CLASH = (
    "n", "key", "Row", "rest", "bucket", "before", "rank", "runs", "collapsed", "term", "terms", "block", "score", "query", "Length", "piece",
    "words", "first", "period", "g", "start", "bound", "weight", "df", "holding", "TEXTS", "piece_", "_c",
)


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.createDataFrame(TEXTS, "doc_id long, text string")
    some = spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text").limit(60)
    return own.unionByName(some).withColumns({c: F.lit("clash") for c in CLASH}).repartition(3).cache()


def rows_of(docs):
    return [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]


# Best-fit packing


def sequences_one_by_one(items, window):
    """The number of sequences, and their gaps, where each large item takes the longest partner and each small one the tightest gap."""
    large, gaps = sorted((x for x in items if 3 * x > window), reverse=True), []
    while large:
        a = large.pop(0)
        partner = next((x for x in large if x <= window - a), None)
        if partner is not None:
            large.remove(partner)
        gaps.append(window - a - (partner or 0))
    for x in sorted((x for x in items if 3 * x <= window), reverse=True):
        fitting = [g for g in gaps if g >= x]
        if fitting:
            gaps.remove(min(fitting))
        gaps.append((min(fitting) if fitting else window) - x)
    return len(gaps), sorted(gaps)


@pytest.mark.parametrize("window", [2, 16, 30, 64, 1024])
def test_plan_equals_packing_one_by_one(window):
    rng = random.Random(window)
    for _ in range(60):
        items = [rng.randint(1, window - 1) if rng.random() < 0.5 else rng.randint(1, max(1, window // 5)) for _ in range(rng.randint(0, 150))]
        histogram = np.bincount(items, minlength=window) if items else np.zeros(window, int)
        slots, n = best_fit.plan(histogram, window)
        filled, ranks = defaultdict(list), set()
        for length, a, b, times, first, at in slots:
            for rank in range(a, b):
                ranks.add((length, rank))
                filled[first + (rank - a) // times].append((at + (rank - a) % times * length, length))
        assert ranks == {(x, i) for x, c in Counter(items).items() for i in range(c)}
        gaps = []
        for pieces in filled.values():
            end = 0
            for at, length in sorted(pieces):
                assert at == end
                end += length
            gaps.append(window - end)
        assert (n, sorted(gaps)) == sequences_one_by_one(items, window) and n == len(filled)


def test_large_items_get_as_many_pairs_as_any_matching():
    rng = random.Random(5)
    for _ in range(200):
        items = [rng.randint(6, 15) for _ in range(rng.randint(0, 9))]

        def most(left):
            if len(left) < 2:
                return 0
            return max([most(left[1:])] + [1 + most(left[1:i] + left[i + 1 :]) for i in range(1, len(left)) if left[0] + left[i] <= 16])

        assert best_fit.plan(np.bincount(items, minlength=16), 16)[1] == len(items) - most(items)


@pytest.mark.parametrize("window", [1024, 64])
def test_best_fit_pieces(docs, window):
    model = Tokenizer.from_file(JSON)
    want = Counter()
    for i, text in rows_of(docs):
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = sorted({0, len(ids), *range(len(ids) % window, len(ids), window)})
        want.update((i, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:])))
    got = best_fit.pack_best_fit(docs, window=window, rows_a_bucket=2).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        end = 0
        for at, length in sorted(pieces):
            assert at == end
            end += length
        assert end <= window
    whole = sum(r.length == window for r in got)
    assert len(sequences) == whole + sequences_one_by_one([r.length for r in got if r.length < window], window)[0]
    assert best_fit.pack_best_fit(docs.limit(0), window=window).collect() == []


# Periodic runs


def runs_by_definition(words, least=12):
    """Every period on its own: stretches of equal words a period apart; those with a smaller period fall away."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        same = [words[i] == words[i + q] for i in range(n - q)] + [False]
        start = None
        for i, equal in enumerate(same):
            if equal and start is None:
                start = i
            elif not equal and start is not None:
                if i - start >= q:
                    found.append((start, i - start + q, q))
                start = None
    smaller = lambda s, n, q: any(p < q and a <= s and a + m >= s + n for a, m, p in found)
    return sorted(r for r in found if r[1] >= least and not smaller(*r))


def odd_words(rng):
    letters = rng.choice([1, 2, 2, 3, 5])
    some = lambda n: [rng.randrange(letters) for _ in range(n)]
    if rng.random() < 0.5:
        return some(rng.randint(0, 60))
    unit = some(rng.randint(1, 15))
    return some(rng.randint(0, 8)) + unit * rng.randint(1, 6) + unit[: rng.randint(0, len(unit))] + some(rng.randint(0, 8))


def test_runs_equal_the_definition():
    rng = random.Random(2)
    for _ in range(2000):
        words, least = odd_words(rng), rng.choice([2, 3, 12, 12])
        want = runs_by_definition(words, least)
        assert periodic_runs.find_runs(words, least) == want
        assert periodic_runs.runs_of_words([b"%d" % w for w in words], least) == want


def test_wrong_hashes_change_no_result(monkeypatch):
    """With a tiny modulus most bases give wrong hashes: either another base gives the right runs, or none does and it says so."""
    monkeypatch.setattr(periodic_runs, "PRIME", 251)
    monkeypatch.setattr(periodic_runs, "BASES", tuple(range(2, 250)))
    rng, right = random.Random(3), 0
    for _ in range(200):
        words = [rng.randrange(3) for _ in range(4)] * 6 + [rng.randrange(3) for _ in range(10)]
        try:
            found = periodic_runs.find_runs(words)
        except periodic_runs.WrongHash:
            continue
        right += 1
        assert found == runs_by_definition(words)
    assert right


def test_periodic_runs_of_documents(docs):
    got = periodic_runs.periodic_runs(docs).collect()
    want = Counter()
    for i, text in rows_of(docs):
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        runs = [(0, len(words), 1)] if i == 11 else [(0, 30_000, 700)] if i == -12 else runs_by_definition(words)
        dropped = {p for s, n, q in runs for p in range(s + q, s + n)}
        want[i, tuple(runs), " ".join(w for p, w in enumerate(words) if p not in dropped)] += 1
    assert Counter((r.doc_id, tuple(map(tuple, r.runs)), r.collapsed) for r in got) == want
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_op12_plants_its_runs(spark, tmp_path):
    rows = [(i, " ".join(f"w{(i * j) % 97}" for j in range(i % 70))) for i in range(300)] + [(None, "a b a b"), (44, None), (51, "  ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, planted = queries.op12_periodic_runs(spark, str(tmp_path)).collect(), 0
    want = Counter()
    for i, text in rows:
        words = (text or "").split()
        n, h = len(words), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            planted += 1
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
        runs = runs_by_definition(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        dropped = {x for s, m, q in runs for x in range(s + q, s + m)}
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        kept = " ".join(w for x, w in enumerate(words) if x not in dropped)
        want[(i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(kept))] += 1
    assert Counter(map(tuple, got)) == want and planted > 10


# Lexical search


def search_by_definition(docs, items, k):
    terms = lambda t: re.findall(lexical.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(i, Counter(terms(t))) for i, t in docs]
    docs = [(i, tf, sum(tf.values())) for i, tf in docs if tf]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, tf, _ in docs for t in tf)
    asked = defaultdict(set)
    for i, t in items:
        asked[i].update(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, tf, n in docs:
            m = 10 + 90 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in wanted if t in tf)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return out


ITEMS = [(1, "word 123 one"), (2, None), (3, "  ... "), (4, "nowhere-to-be-found"), (5, "a b c x"), (5, "ok Z"), (None, "same w3 w699"), (6, "À à a1"), (7, "x" * 3000)]


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 3, "CHUNK": 11}, {"BLOCK": 1, "BROADCAST_TERMS": 0}, {"BLOCK_POSTINGS": 40}])
@pytest.mark.parametrize("limits", [{}, {"k": 1}, {"k": 3, "pairs_a_round": 200}])
def test_search_equals_scoring_every_document(spark, docs, monkeypatch, sizes, limits):
    for name, value in sizes.items():
        monkeypatch.setattr(lexical, name, value)
    some = spark.read.parquet(f"{SF}/benchmark.parquet").select((F.col("item_id") + 100).alias("item_id"), "text")
    items = spark.createDataFrame(ITEMS, "item_id long, text string").unionByName(some).withColumns({c: F.lit("clash") for c in CLASH})
    got = lexical.search(lexical.build_index(docs), items, **limits).collect()
    want = search_by_definition(rows_of(docs), [(r.item_id, r.text) for r in items.collect()], limits.get("k", 10))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key) and len(got) > 30


def test_search_of_empty_tables(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(lexical.build_index(docs.limit(0)), items).collect() == []
    assert lexical.search(lexical.build_index(docs), items.limit(0)).collect() == []
    assert lexical.search(lexical.build_index(docs.where("doc_id in (1, 2, 3, 10)")), items).collect() == []


def test_blocks_below_the_threshold_are_not_scored(spark, monkeypatch):
    """One document holds the rare term; other blocks' maxima rule them out once it is known."""
    scored = []
    plain = lexical.Best.add
    monkeypatch.setattr(lexical.Best, "add", lambda self, queries, scores, ids: (scored.append(ids.tolist()), plain(self, queries, scores, ids))[1])
    rows = list(lexical._blocks([(i, Counter({b"rare": 1} if i == 7 else {b"common": 1 + i % 3}), 4) for i in range(512)], 0, 512, 2048))
    assert len(rows) > 3
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{k: v.tolist() if hasattr(v, "tolist") else v for k, v in r.items()} for r in rows])
    asked = lexical.Queries([(0, b"common", 2), (0, b"rare", 9000)], 1, 1)
    (out,) = lexical._scores(asked, 512, 2048, np.zeros(1, np.int64))(iter([batch]))
    assert out.column(1).to_pylist() == [7] and len(scored) == 1


def test_row_groups_of_the_index_stay_small_in_large_files(spark):
    """A reader decodes a row group's blocks at once, so a group must not grow with what a task writes."""
    words = F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("doc_id", i), F.lit(100_000))))
    docs = spark.range(3000).select(F.col("id").alias("doc_id")).withColumn("text", F.array_join(words, " ")).coalesce(1)
    index = lexical.build_index(docs)
    import pyarrow.parquet as pq

    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in index.blocks.inputFiles()]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    assert len(files) == 1 and sum(g.num_rows for g in groups) == index.blocks.count() > 40
    # Rows are taken up to a check of the size, so a group may hold somewhat more.
    assert max(g.num_rows for g in groups) <= 20 and max(g.total_byte_size for g in groups) < 2 * int(lexical.GROUPS["parquet.block.size"])


def test_bounds_of_many_queries_take_bounded_memory(monkeypatch):
    """A term that all queries ask for is spread over them for every block: some at a time, to the same sums."""
    import tracemalloc

    asked = lexical.Queries([(q, b"%d" % t, 1 + (q + t) % 7) for q in range(1000) for t in range(40)], 1000, 10)
    terms, rows, values = np.tile(np.arange(-1, 40), 250), np.repeat(np.arange(250), 41), np.arange(250 * 41)
    tracemalloc.start()
    got = asked.spread(terms, rows, values, 250)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150_000_000, peak
    weight = np.array([[1 + (q + int(asked.vocabulary[t])) % 7 for q in range(1000)] for t in range(40)])
    assert (got == values.reshape(250, 41)[:, 1:] @ weight).all()
    wanted = np.array([3, 500, 999])
    for at_once in (1, 2500, 10**9):
        monkeypatch.setattr(lexical, "PAIRS_AT_ONCE", at_once)
        assert (asked.spread(terms[:410], rows[:410], values[:410], 10, wanted) == got[:10][:, wanted]).all()
    assert (asked.spread(np.full(3, -1), np.arange(3), np.arange(3), 3) == 0).all()


def test_few_large_rows_go_to_python_at_once(spark, docs):
    """The limit holds while the search works, and the session's own one afterwards; what a search returns reads no index again."""
    import pyarrow as pa

    from evidentia.llm.scratch import rows_a_batch

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "777")
        with rows_a_batch(spark, 32):
            sizes = spark.range(100).coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long").collect()
        with pytest.raises(ZeroDivisionError), rows_a_batch(spark, 32):
            raise ZeroDivisionError
        found = lexical.search(lexical.build_index(docs), spark.createDataFrame(ITEMS, "item_id long, text string"))
        assert [r.n for r in sizes] == [32, 32, 32, 4] and spark.conf.get(name) == "777"
    finally:
        spark.conf.set(name, before)
    assert "MapInArrow" not in found._jdf.queryExecution().toString() and found.count() > 10


# Columns named like an operator's own ones, in any case

OWN_NAMES = ("_H", "_s", "_L", "_W", "_t", "N_lines", "Word_Chars", "_order", "_Found", "Quality", "_doc", "__w", "_x")


@pytest.mark.parametrize("added, apply", [
    (("N_WORDS", "Kept", "base_Failed"), lambda d: quality_rules.apply_rules(d)),
    (("KEPT",), lambda d: quality_rules.apply_rules(d, statistics=False)),
    (("Score", "HELD_out", "Predicted"), lambda d: quality_classifier.classify(d, d.select("doc_id", F.lit(1).alias("quality")))),
    (("Findings", "REDACTED", "n_Secrets"), lambda d: secret_scan.scan(d, path="no such column")),
])
def test_columns_of_any_name_stay(spark, added, apply):
    plain = spark.createDataFrame([(1, "some words here " * 30), (2, None), (2, "key = 'a8f3b1c9d7e2f4a6b8c0'"), (None, "")], "doc_id long, text string")
    clashing = plain.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in (*OWN_NAMES, *added)})
    got, want = apply(clashing), apply(plain)
    assert set(got.columns) == {*want.columns, *(c for c in OWN_NAMES if c.lower() not in {w.lower() for w in want.columns})}
    key = lambda r: repr(tuple(r))
    assert sorted(got.select(*want.columns).collect(), key=key) == sorted(want.collect(), key=key)
    assert all(r[c] == f"{c}:{'-' if r['doc_id'] is None else r['doc_id']}" for r in got.collect() for c in OWN_NAMES if c in got.columns and c not in want.columns)
