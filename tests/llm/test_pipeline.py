"""The pipeline against a plain version of its stages."""

import math
import re
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from evidentia.llm.bpe import whole_text_encoder
from evidentia.llm.ngram_jaccard import near_duplicates
from evidentia.llm.quality_classifier import classify, train
from evidentia.llm.quality_rules import apply_rules
from evidentia.llm.secret_scan import scan

SF = "/root/testdata/sf0.001"


def test_run_matches_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.predicted}
    ruled = {r.doc_id for r in apply_rules(docs).collect() if r.kept and r.doc_id in good}
    kept = docs.where(docs.doc_id.isin(sorted(ruled)))
    single = {r.doc_id for r in near_duplicates(kept).collect() if r.component_id == r.doc_id}
    texts = {r.doc_id: r.redacted for r in scan(kept).collect() if r.doc_id in single}
    import public_tokenizers

    encode = whole_text_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == {i: len(encode(t)) + 1 for i, t in texts.items()}
    assert 50 < len(got) < docs.count()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


CLASHING = ("digits", "symbols", "n_lines", "score", "n_words", "kept", "_w", "_l", "row", "_row", "held_out", "findings", "redacted", "n_secrets", "key", "component", "rest")


def odd_documents(spark):
    """Nulls, an empty, a blank and a very long text, repeated rows, different texts under one id, copies without an id, and clashing columns."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    a, b, c = prose(120), prose(150), prose(90)
    near = " ".join([*a.split()[:-2], "quite", "other"])
    rows = [
        (1, a), (2, near), (3, a), (3, a), (4, b), (4, c), (5, f"{c} and more at the end of it"), (None, b), (None, prose(80)), (None, None), (6, None), (7, ""), (8, " \n "), (9, prose(40_000)),
        (10, prose(70) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + prose(20)), (11, "the same word " * 100), (12, "SHOUTED WORDS HERE " * 40), (13, prose(30) + "\n" + "\n".join([prose(4)] * 60)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("src1").alias("source"), F.length("text").cast("long").alias("n_chars"), *[F.lit("clash").alias(c) for c in CLASHING])


def brute_rules(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    repeats = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    if len(words) < 50 or 100 * len(repeats) > 50 * len(words):
        return False
    chars = sum(map(len, words))
    return not (
        100 * len(re.findall(r"[#*$%&|<>]", text)) > 20 * len(words) or chars < 2 * len(words) or chars > 20 * len(words) or 100 * (len(lines) - len(set(lines))) > 70 * len(lines)
        or 100 * sum(w.upper() == w and w.lower() != w for w in words) > 60 * len(words)
    )


def brute_firsts(rows):
    """Positions of the rows that stay: one of each component of texts whose sets of 5-word shingles are alike."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    group = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 75 * len(x | sets[j]) and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    best = {}
    for i, (doc, _) in enumerate(rows):
        order = (doc is None, doc or 0, i)
        best[group[i]] = min(best.get(group[i], (order, i)), (order, i))
    return sorted(i for _, i in best.values())


def brute_quality(model, text):
    """The compiled rules read by plain Python: statistics, conditions, weights."""
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    count = lambda chars: sum(c in chars for c in text) / n
    x = {
        "log_words": math.log1p(len(words)), "word_length": sum(map(len, words)) / n, "symbols": count("#*$%&|<>"), "exclamations": count("!"), "bars": count("|"), "digits": count("0123456789"),
        "shouted": sum(w.upper() == w and w.lower() != w for w in words) / n, "distinct": len(set(words)) / n, "stutter": sum(v == w for v, w in zip(words, words[1:])) / n,
        "dup_lines": (len(lines) - len(set(lines))) / max(1, len(lines)),
    }
    total = model.intercept + sum(w for conditions, w in model.rules if all((x[f] > t) == above for f, t, above in conditions))
    return 1 / (1 + math.exp(-total))


def test_stages_equal_plain_ones_on_odd_rows(spark, tmp_path):
    odd_documents(spark).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    ids = lambda frame: Counter((r.doc_id, r.text) for r in frame.collect())
    stages = dict(corpus_pipeline.STAGES)
    for name in list(stages)[:-1]:
        out = stages[name](spark, docs, str(tmp_path))
        assert out.columns == docs.columns and stages[name](spark, docs.limit(0), str(tmp_path)).count() == 0
        assert all(r[c] == "clash" for r in out.collect() for c in CLASHING)
    assert ids(stages["quality_rules"](spark, docs, str(tmp_path))) == Counter(r for r in rows if brute_rules(r[1]))
    assert ids(stages["ngram_jaccard"](spark, docs, str(tmp_path))) == Counter(rows[i] for i in brute_firsts(rows))
    assert len(brute_firsts(rows)) < len(rows) - 4
    scanned = {(r.doc_id, r.text): r.n_chars for r in stages["secret_scan"](spark, docs, str(tmp_path)).collect()}
    masked = [(d, t and t.replace("04dbebab91ab85687d33eeaaf9ac699e1188f962", "[SECRET]")) for d, t in rows]
    assert scanned == {r: None if r[1] is None else len(r[1]) for r in masked}


def test_classifier_stage_equals_plain_reading_of_its_rules(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert model.rules
    tricky = docs.select("doc_id", "text").union(odd_documents(spark).select("doc_id", "text"))
    scores = Counter((r.doc_id, r.text, round(r.score, 9)) for r in classify(tricky, spark.read.parquet(f"{SF}/labels.parquet")).collect())
    # The training rows are those of ``docs`` only, whose ids the odd rows partly repeat: so both are fitted anew.
    model = train(tricky, spark.read.parquet(f"{SF}/labels.parquet"))
    assert scores == Counter((r.doc_id, r.text, round(brute_quality(model, r.text), 9)) for r in tricky.collect())
    kept = {r.doc_id for r in corpus_pipeline.quality_classifier(spark, docs, SF).collect()}
    own = train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert kept == {r.doc_id for r in docs.collect() if brute_quality(own, r.text) >= 0.3}


def test_texts_are_not_shuffled_for_the_rows_that_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for a table of any size
    try:
        out = corpus_pipeline.ngram_jaccard(spark, docs, SF)
        assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
        assert 0 < out.count() < docs.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
