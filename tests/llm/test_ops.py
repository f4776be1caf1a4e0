"""The numbered operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidentia.llm import bpe_codec, chat_format, ngram_jaccard, packing, quality_classifier, quality_rules, secret_scan, token_counts, topk, warc
from evidentia.llm.bpe import load_ranks, whole_text_encoder

SF = "/root/testdata/sf0.001"
JSON = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a  b\n\n c<|endoftext|> x"), (5, "a  b\n\n c<|endoftext|> x"), (6, "x" * 3000), (7, "it's\n \nok  \x1c! \xa0　 z"),
    (8, "word don't  \n\t 123 ... " * 300), (None, "no id here"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Small documents, tricky ones, and columns whose names operators use themselves."""
    own = spark.createDataFrame(TEXTS, "doc_id long, text string")
    some = spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text").limit(60)
    clash = {c: F.lit("clash") for c in ("n", "key", "row", "score", "kept", "_w", "n_words", "held_out", "symbols", "ids", "rest", "source", "findings", "bucket")}
    return own.unionByName(some).withColumns(clash).cache()


def texts_of(docs):
    return [(r[0], r[1] or "") for r in docs.select("doc_id", "text").collect()]


def test_token_counts_match_the_library(docs):
    model = Tokenizer.from_file(JSON)
    count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    got = token_counts.prefix_token_counts(docs).select("*", token_counts.total_tokens().alias("n"), token_counts.fitting_end(7).alias("end")).collect()
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append((r.n_bytes, r.n))
    want = defaultdict(list)
    for i, t in texts_of(docs):
        want[i].append((len(t.encode()), count(t)))
    assert {k: sorted(v) for k, v in by_id.items()} == {k: sorted(v) for k, v in want.items()}
    text = dict(TEXTS)[8]
    row = next(r for r in got if r.doc_id == 8)
    for end, n in list(zip(row.prefix_ends, row.prefix_tokens))[:40]:
        assert count(text[:end]) == n
    assert row.end == max(e for e, n in zip(row.prefix_ends, row.prefix_tokens) if n <= 7)
    assert token_counts.prefix_token_counts(docs.limit(0)).count() == 0


def test_token_counts_at_every_prefix(spark):
    model = Tokenizer.from_file(JSON)
    count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    texts = ["ab1+" * 60, "日本語の文章。" * 20, "  \n\n it's we're\t x", "one two<|endoftext|>'re three <|end <|endoftext|><|endoftext|>" + "y" * 40, " " * 50 + "z'll" * 20, "https://a.b/c?d=e&f=0123456789abcdef"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ends = [1, 7, 30, 10_000]
    answers = [token_counts.tokens_at(e).alias(f"at_{e}") for e in ends]
    got = {r.doc_id: r for r in token_counts.prefix_token_counts(rows).select("*", *answers, token_counts.fitting_end(9).alias("fit")).collect()}
    for i, text in enumerate(texts):
        want = [count(text[:e]) for e in range(1, len(text) + 1)]
        assert (got[i].prefix_ends, got[i].prefix_tokens) == (list(range(1, len(text) + 1)), want)
        assert [got[i][f"at_{e}"] for e in ends] == [want[min(e, len(text)) - 1] for e in ends]
        assert got[i].fit == max(e for e, n in enumerate(want, 1) if n <= 9)


def test_whole_text_encoder_equals_the_library():
    fast, model = whole_text_encoder(JSON), Tokenizer.from_file(JSON)
    for _, text in TEXTS:
        assert fast(text or "") == model.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("sizes", [{}, {"chunk": 500, "overlap": 40}])
def test_bpe_codec(docs, sizes):
    model = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = []
    for i, t in texts_of(docs):
        ids = model.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert Counter(map(tuple, bpe_codec.encode_documents(docs, **sizes).collect())) == Counter(want)
    ids = bpe_codec.encode_documents(docs.where("doc_id = 7"), output="ids", **sizes)
    assert bpe_codec.decode(ids.drop("decoded")).first().decoded.decode() == dict(TEXTS)[7]


BLANKS = [" ", "\n", "\u00a0", "\t", "\u3000", "\x1c", "\r"]


def test_pieces_encode_alone_as_in_the_text_at_every_cut():
    model = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    chunk, overlap = bpe_codec.CHUNK, bpe_codec.OVERLAP
    runs = [a + b for a in BLANKS for b in BLANKS] + [a + b + c for a in BLANKS[:4] for b in BLANKS[:4] for c in BLANKS]
    for shift in (0, 1, 2):
        for run in runs:
            for after in ("next text", "'s it", "12 x", "!? y"):
                text = ("some words 12, it's " * 300)[: chunk - len(run) + shift - 1] + "a" + run + after + " and more words" * 40
                pieces = bpe_codec.stitch(bpe_codec.split(text, chunk, overlap), chunk, overlap, public_tokenizers.PATTERN)
                assert "".join(pieces) == text and [i for p in pieces for i in model.encode_ordinary(p)] == model.encode_ordinary(text)
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice([*BLANKS, "a", "bc", "don't", "7", "345", "?", "…", "é", "日本", " x", "  y", "w" * 90]) for _ in range(900))
        pieces = bpe_codec.stitch(bpe_codec.split(text, 200, 24), 200, 24, public_tokenizers.PATTERN)
        assert "".join(pieces) == text and [i for p in pieces for i in model.encode_ordinary(p)] == model.encode_ordinary(text)


def test_true_boundaries_carry_from_the_start_with_a_pattern_of_ones_own():
    threes = r"\p{N}{1,3}|\p{L}+|\s+(?!\S)|\s+"
    text = "1" * 40 + " " + "2" * 2000 + "x  y " + "3" * 501 + "z"
    pieces = bpe_codec.stitch(bpe_codec.split(text, 100, 20), 100, 20, threes)
    ends = {m.end() for m in bpe_codec.compiled(threes).finditer(text)}
    at = [sum(map(len, pieces[: i + 1])) for i in range(len(pieces))]
    assert "".join(pieces) == text and set(at) <= ends and len(pieces) > 1


def test_long_texts_are_dealt_out_at_default_sizes(spark):
    model = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = [("word, it's " * 9000)[: 4096 * 17 - 3] + " \u00a0" + "next", "ab" * 50_000, "日本語 テキスト " * 9000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])] * 2
    want = Counter((i, len(x := model.encode_ordinary(t)), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert Counter(map(tuple, bpe_codec.encode_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == want


def test_chunks_that_never_agree_stay_one_piece():
    text = "ab" * 4000
    chunks = [text[i : i + 500 + 40] for i in range(0, len(text), 500)]
    assert "".join(bpe_codec.stitch(chunks, 500, 40, public_tokenizers.PATTERN)) == text


def test_packing_covers_every_id_once_without_padding(docs):
    encode = whole_text_encoder(JSON)
    ids = [np.array([*encode(t), 0], "<u4") for _, t in texts_of(docs.where("doc_id is not null and doc_id <> 5"))]
    by_doc = dict(zip([i for i, _ in texts_of(docs.where("doc_id is not null and doc_id <> 5"))], ids))
    got = packing.pack(docs).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
        if r.doc_id in by_doc:
            part = by_doc[r.doc_id][r.start : r.start + r.length]
            assert zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(by_doc[r.doc_id])
    for i, x in by_doc.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(x)
    assert sum(n for _, n in pieces[5]) == 2 * (len(encode(dict(TEXTS)[5])) + 1)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 1024 or at < 1024 and at & (at - 1) == 0
    assert packing.pack(docs.limit(0)).count() == 0


def test_archives_round_trip(spark):
    rows = [(1, "u", "same"), (2, "u", "same"), (2, "u", "same"), (3, None, None), (4, "a\r\nb", ""), (None, "u", "same"), (9, "u", "y" * 700_000), (10, "u", "é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("sha1", F.lit(2))
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {}
    for i, _, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(t or "", i)
    want = Counter((i, len((t or "").encode()), digest(t), *(("response", None) if i in (None, first[t or ""]) else ("revisit", first[t or ""]))) for i, _, t in rows)
    assert Counter(map(tuple, warc.archive_round_trip(pages).collect())) == want
    scratch = warc.Scratch(spark, "test")
    index = scratch.keep(warc.write_archives(warc.with_references(pages), scratch.path("bundles")), "index")
    hit = warc.read_archives(warc.find_records(index, spark.createDataFrame([(10,)], "page_id long"))).collect()
    assert [(r.page_id, r.payload.decode()) for r in hit] == [(10, "é")]
    assert warc.archive_round_trip(pages.limit(0)).count() == 0
    assert all(r.record_type == "response" for r in warc.archive_round_trip(pages, least=10**9).collect())


def test_rules(docs, spark):
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs).collect()}
    assert (got[1].n_words, got[1].base_failed, got[1].kept) == (0, True, False)
    assert got[3].n_words == 0 and got[8].base_failed and got[8].n_repeat_words == 1200
    good = " ".join(f"word{i}" for i in range(60))
    extra = spark.createDataFrame([(1, good), (2, good.upper()), (3, good.replace(" ", " ### ")), (4, (good + "\n") * 4)], "doc_id long, text string")
    assert {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.apply_rules(extra).collect()} == {1: (False, True), 2: (False, False), 3: (False, False), 4: (True, False)}
    assert quality_rules.apply_rules(docs.limit(0)).count() == 0


def test_rules_without_statistics_keep_the_same(spark, docs):
    some = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").union(docs.select("doc_id", "text")).union(spark.createDataFrame([(-1, "A" * 3_000_000), (-2, "many words " * 200_000)], "doc_id long, text string"))
    full, lean = (Counter((r.doc_id, r.kept) for r in quality_rules.apply_rules(some, statistics=s).collect()) for s in (True, False))
    assert full == lean and 0 < sum(n for (_, kept), n in full.items() if kept) < sum(full.values())
    assert [r.name for r in quality_rules.order_rules(some)] == [r.name for r in quality_rules.order_rules(some)]
    first = lambda rules: quality_rules.order_rules(spark.createDataFrame([(1, "WORD # " * 60)] * 3, "doc_id long, text string"), rules)[0].name
    dear = quality_rules.Rule("dear", lambda t, w: F.length(t) > 0, lambda t, w: F.length(t) * 1000)
    assert first((dear, quality_rules.RULES[0])) == "symbols" and first((quality_rules.RULES[2], dear)) == "dear"
    assert quality_rules.apply_rules(docs, statistics=False).columns[-1] == "kept" and quality_rules.apply_rules(docs.limit(0), statistics=False).count() == 0


def test_exact_top_k(spark):
    rng = np.random.default_rng(3)
    points = np.round(rng.normal(size=(700, 8)), 1)
    points[100:400] = points[100]  # a large group of equal vectors
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(5, points[5].tolist()), (800, None), (801, [None] * 8), (802, [float("nan")] * 8), (803, [float("inf")] * 8)]
    vectors = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(0)))
    got = defaultdict(list)
    for r in topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5, rows_a_shard=150, queries_a_block=4).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    stored = [(i, np.floor(256 * np.asarray(p, np.float32).astype(float))) for i, p in rows if i < 800]
    for q in range(0, 700, 50):
        scores = sorted((-int(stored[q][1] @ p), i) for i, p in stored if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0
    lone = vectors.where("vec_id = 7")
    assert topk.top_k(lone, lone).count() == 0


def test_clusters_and_shards_are_skipped_and_nothing_is_lost(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(6, 5)) * 20
    points = np.round(np.concatenate([c + rng.normal(size=(60, 5)) * 0.2 for c in centers]), 2)
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(1000 + i, [1.0, 2.0]) for i in range(4)] + [(2000, [1e30] * 5), (2001, []), (2002, [])]
    vectors = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    kept, keep = {}, topk.Scratch.keep
    monkeypatch.setattr(topk.Scratch, "keep", lambda self, rows, name: kept.setdefault(name, keep(self, rows, name).cache()))
    monkeypatch.setattr(topk.Scratch, "last", lambda self, rows, name: rows)
    queries = vectors.where("vec_id % 50 = 0 or vec_id = 2001")
    got = defaultdict(list)
    for r in topk.top_k(vectors, queries, 3, rows_a_shard=25, clusters=6).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    stored = [(i, [int(256 * x // 1) for x in p]) for i, p in rows]
    score = lambda a, b: max(min(sum(x * y for x, y in zip(a, b)), 2**63 - 1), 1 - 2**63)
    for q, point in stored:
        if q % 50 == 0 or q == 2001:
            scores = sorted((-score(point, p), i) for i, p in stored if i != q and len(p) == len(point))[:3]
            assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    # The huge vector, which every query has to look at, is a cluster of its own.
    shards = kept["stored"].where("dims = 5 and cluster >= 0").select("cluster").distinct().count()
    searched = kept["routed-2"].where("dims = 5 and cluster >= 0 and query_id <> 2000").count()
    assert shards == 6 and searched < 0.5 * 5 * kept["routed-0"].where("dims = 5").count()
    assert kept["routed-1"].count() > 0 and 2000 in {r.vec_id for r in kept["stored"].collect()}


def test_wide_vectors_and_repeated_query_ids(spark):
    """Components of any finite size are scored in whole numbers; a query id with several vectors asks with the least of them."""
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1, 1]) * rng.choice([0.5, 3.0, 4e5, 1e6, 123456.789, 2e7, 1e12, 3e38]) for _ in range(3)]) for i in range(300)]
    rows += [(0, [256.0, 1.0, 0.0]), (0, [-8192.0, 5.0, 1e6]), (7, rows[7][1]), (400, [0.0] * 3)]
    for parts in (1, 5):
        vectors = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts))
        got = defaultdict(list)
        for r in topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 6, rows_a_shard=40, clusters=5).collect():
            got[r.query_id].append((r.rank, r.vec_id, r.score))
        stored = [(i, [int(256 * x // 1) for x in p]) for i, p in rows]
        for q in range(0, 401, 50):
            vectors_of = [p for i, p in stored if i == q]
            if vectors_of:
                score = lambda p: max(min(sum(x * y for x, y in zip(min(vectors_of), p)), 2**63 - 1), 1 - 2**63)  # noqa: B023, E731
                best = sorted((-score(p), i) for i, p in stored if i != q)[:6]
                assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\/s>", "<<SYS>>", "<<<SYS>><</s>", "[TURN AA]x[/TURN]", "\\", "[\\\\INST]", "", None, "plain", "a\nb", "[/INST", "<"]
    roles = ["user", "assistant", "system", "tool]\n", None, ""]
    rng = random.Random(2)
    rows = [(c, t, rng.choice(roles), rng.choice(nasty)) for c in range(40) for t in range(rng.randrange(1, 8))] + [(50, None, "user", "x"), (50, 0, "user", "x"), (50, 0, "user", "x"), (51, 0, "assistant", "y" * 50_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash")).withColumn("plain", F.lit(1))
    formatted = chat_format.format_conversations(frame)
    source = defaultdict(list)
    for c, t, r, x in rows:
        source[c].append((-1 if t is None else t, r or "", x or ""))
    for r in formatted.collect():
        assert [(t.role, t.text) for t in r.turns] == [x[1:] for x in sorted(source[r.conv_id])]
    for r in chat_format.digests(formatted).collect():
        turns = sorted(source[r.conv_id])
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
    assert chat_format.digests(chat_format.format_conversations(frame.limit(0))).count() == 0


def test_classifier_on_the_held_out_fold(spark, docs):
    all_docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality_classifier.classify(all_docs.select("doc_id", "text"), labels).join(labels, "doc_id").toPandas()
    fold = scored[scored["held_out"]]
    assert (fold["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in fold["doc_id"]]).all()
    assert len(fold) > 40 and (fold["predicted"] == fold["quality"]).mean() > 0.95 and scored["score"].between(0, 1).all()
    tricky = quality_classifier.classify(docs, labels).collect()
    assert len(tricky) == docs.count() and all(0 <= r.score <= 1 for r in tricky)
    empty = quality_classifier.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in empty} == {0.5}
    assert quality_classifier.classify(docs.limit(0), labels).count() == 0


def test_secrets(spark, docs):
    forest = secret_scan.train()
    held = secret_scan.example_findings(400, seed=99)
    x = np.array([secret_scan.features(*r) for r in zip(held["candidate"], held["before"], held["after"], held["path"])])
    assert ((forest.score(x) >= 0.5) == held["label"]).mean() > 0.97
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(1, f'é some token = "{key}" and more', "src1"), (2, f"see commit {key} for this", "src1"), (3, None, None), (4, "a verylongordinarywordindeed here", None), (5, f'token = "{key}" ' * 3, "x")]
    got = {r.doc_id: r for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"), forest).collect()}
    assert got[1].redacted == 'é some token = "[SECRET]" and more' and (got[1].findings[0].start, got[1].findings[0].length) == (16, 40)
    assert (got[2].n_candidates, got[2].n_secrets, got[3].redacted, got[4].n_secrets, got[5].n_secrets) == (1, 0, None, 0, 3)
    assert secret_scan.scan(docs, forest).count() == docs.count() and secret_scan.scan(docs.limit(0), forest).count() == 0


def test_secrets_of_every_form_are_masked_whole(spark):
    key, prefixed = "9f8a7b6c5d4e3f2a1b0c9d8e7f6a5b4c", "ghp_aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC1dE3fG5h"
    web = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
    forms = [
        ('password = "{}" # x', "hunter2secret"), ("DB_PASSWORD={} x", "P@ssw0rd!x"), ("pwd: {}, then", "Tr0ub4dor&3"), ("?user=1&password={}&x=1", "s3cr.et!9"), ('accessToken: "{}"', "zx81!kp"),
        ("export API_KEY={} x", key), ("https://x.org/a?access_token={}&page=2", key), ("it is {} here", prefixed), ("Authorization: Bearer {} x", web), ('{{\\"password\\": \\"{}\\"}}', "hunter2secret"),
    ]
    plain = ["the secret: nobody knows", "password = getPassword()", 'password = os.environ["PW"]', "password: ${DB_PASSWORD}", f"commit={key}", f"?id={key}", "max_tokens=4096", "a/path/to/some/module_name"]
    rows = [(i, f.format(v), "src1") for i, (f, v) in enumerate(forms)] + [(100 + i, t, "src1") for i, t in enumerate(plain)]
    got = {r.doc_id: r for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [got[i].redacted for i in range(len(forms))] == [f.format("[SECRET]") for f, _ in forms]
    assert all(got[i].n_secrets == 1 and got[i].findings[0].length == len(v) for i, (_, v) in enumerate(forms))
    assert [got[100 + i].redacted for i in range(len(plain))] == plain


def brute_components(rows, percent=75):
    def shingles(text):
        words = text.encode().lower().split()
        return frozenset() if not words else frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return Counter((doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(rows))


def near_rows(seed=4):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    passage = [rng.choice(words) for _ in range(40)]
    rows = [(i, t) for i, t in TEXTS]
    for family in range(6):
        base = [rng.choice(words) for _ in range(rng.randrange(5, 90))]
        for copy in range(25):
            text = base[:]
            for _ in range(rng.randrange(0, 5)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((1000 + family * 100 + copy, " ".join(text + (passage if copy % 5 == 0 else []))))
    rows += [(2000 + i, " ".join(passage + [rng.choice(words) for _ in range(30)])) for i in range(30)]
    return rows + [(3000, "A B c"), (3001, "a b C"), (3002, "a b c d"), (3003, "a b c"), (3003, "a b c")]


@pytest.mark.parametrize("unit", [4096, 16])
def test_near_duplicates(spark, monkeypatch, unit):
    monkeypatch.setattr(ngram_jaccard, "UNIT", unit)
    monkeypatch.setattr(ngram_jaccard, "POINTS", unit)
    rows = near_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "key", "row", "token", "comp", "component_id")}).repartition(5)
    got = Counter(map(tuple, ngram_jaccard.near_duplicates(frame).collect()))
    assert got == brute_components([(i, t or "") for i, t in rows])
    assert ngram_jaccard.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("unit", [4096, 16])
def test_every_link_is_counted(spark, monkeypatch, unit):
    monkeypatch.setattr(ngram_jaccard, "UNIT", unit)
    monkeypatch.setattr(ngram_jaccard, "POINTS", unit)
    rows = [(i, t or "") for i, t in near_rows()]
    sets = []
    for _, t in rows:
        w = t.encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    distinct = set(sets) - {frozenset()}
    linked = {a: sum(a != b and 100 * len(a & b) >= 75 * len(a | b) for b in distinct) for a in distinct}
    got = ngram_jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), count_links=True).collect()
    assert Counter((r.doc_id, r.n_links) for r in got) == Counter((i, linked.get(s, 0)) for (i, _), s in zip(rows, sets))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows) and max(linked.values()) > 2


def test_tree_lists_every_pair_that_may_link():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, int(n)).astype(np.uint64) for n in np.r_[rng.integers(1, 900, 240), 3000, 9000]]
    sets += [np.r_[s[: len(s) - len(s) // 9], rng.integers(0, 2**63, len(s) // 9).astype(np.uint64)] for s in sets]
    points, sizes = [ngram_jaccard.group_counts(s) for s in sets], np.array([len(s) for s in sets])
    assert all((ngram_jaccard.unpack_point(ngram_jaccard.pack_point(p)) == p).all() for p in points) and len({len(p) for p in points}) > 2
    tree = ngram_jaccard.RTree(points, sizes, 75)
    found = Counter(tuple(sorted((int(a[i]), int(b[j])))) for a, b, admitted in tree.join() for i, j in zip(*np.nonzero(admitted)))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))]
    overlap = lambda i, j, n: np.minimum(ngram_jaccard._folded(points[i], n), ngram_jaccard._folded(points[j], n)).sum()
    want = {(i, j) for i, j in pairs if 175 * overlap(i, j, min(len(points[i]), len(points[j]))) >= 75 * (sizes[i] + sizes[j])}
    assert set(found) == want and max(found.values()) == 1 and len(want) > 200 and len(tree.nodes) > 10
    assert {(i, j) for i, j in pairs if 175 * len(np.intersect1d(sets[i], sets[j])) >= 75 * (sizes[i] + sizes[j])} <= want
