"""Receipts of commands against a plain dictionary, in one batch and as a stream that is stopped and started."""

import random

from evidentia.operators import receipts
from evidentia.streaming.receipts import answer_stream

COMMANDS = "context string, idempotency_key string, position int, kind string, request string, candidate string, event string"
EVENTS = "context string, idempotency_key string, event string, kind string"


def plain(commands):
    first, out = {}, set()
    for context, key, position, kind, request, candidate, event in sorted(commands, key=lambda c: c[2]):
        if context is None or key is None:
            out.add((position, "refused", receipts.NO_KEY, None, None))
        elif (context, key) not in first:
            first[context, key] = (kind, request, event, candidate)
            out.add((position, "accepted", None, event, candidate))
        elif first[context, key][:2] == (kind, request):
            out.add((position, "replayed", None, *first[context, key][2:]))
        else:
            out.add((position, "refused", receipts.CONFLICT, None, None))
    return out, first


def given(n=200):
    rng = random.Random(3)
    return [(rng.choice(["a", "b", None]), rng.choice(["k1", "k2", "k3", None]), i, rng.choice(["PROPOSE", "CONFIRM"]), rng.choice(["x", "x", "y", None]), f"c{i}", f"e{i}") for i in range(n)] + [("hot", "k", n + i, "PROPOSE", "x", None, f"h{i}") for i in range(n)]


def test_first_answers(spark):
    commands = given()
    none, events = spark.createDataFrame([], receipts.RECEIPT), spark.createDataFrame([], EVENTS)
    answers, added = receipts.answer(spark.createDataFrame([*commands, commands[-1]], COMMANDS), none, events)
    want, first = plain(commands)
    got = [(r.position, r.outcome, r.reason, r.event, r.candidate) for r in answers.collect()]
    assert set(got) == want and len(got) == len(commands) + 1
    assert {(r.context, r.idempotency_key): (r.kind, r.event, r.candidate) for r in added.collect()} == {k: (v[0], *v[2:]) for k, v in first.items()}
    again, more = receipts.answer(spark.createDataFrame(commands, COMMANDS), added, added.select("context", "idempotency_key", "event", "kind").unionByName(events))
    kept = {(p, "replayed" if o == "accepted" else o, *rest) for p, o, *rest in want if rest[1] is None or not rest[1].startswith("h")}
    assert {(r.position, r.outcome, r.reason, r.event, r.candidate) for r in again.collect() if r.context != "hot"} == kept and more.count() == 0
    # A proposal without a candidate has no result to give again.
    assert {(r.outcome, r.reason) for r in again.where("context = 'hot'").collect()} == {("refused", receipts.NO_RESULT)}
    assert [t.count() for t in receipts.answer(spark.createDataFrame([], COMMANDS), added, events)] == [0, 0]


def test_stored_receipts_and_events(spark):
    fp = lambda kind, request: spark.range(1).select(receipts.fingerprint("command-request", *[receipts.F.lit(x) for x in (kind, request)])).first()[0]
    stored = [("a", "good", "PROPOSE", fp("PROPOSE", "x"), "c", "e1"), ("a", "gone", "PROPOSE", fp("PROPOSE", "x"), "c", "e2"), ("a", "other", "PROPOSE", fp("PROPOSE", "x"), "c", "e3"), ("a", "bare", "CONFIRM", fp("CONFIRM", "x"), None, "e4")]
    events = [("a", "good", "e1", "PROPOSE"), ("a", "other", "e3", "CONFIRM"), ("a", "bare", "e4", "CONFIRM"), ("a", "old", "e5", "PROPOSE"), (None, None, "e6", None)]
    commands = [("a", k, i, "CONFIRM" if k == "bare" else "PROPOSE", "x", "new", "n") for i, k in enumerate(["good", "gone", "other", "bare", "old", "fresh"])] + [("a", "good", 9, "PROPOSE", "y", "new", "n")]
    answers, added = receipts.answer(spark.createDataFrame(commands, COMMANDS), spark.createDataFrame(stored, receipts.RECEIPT), spark.createDataFrame(events, EVENTS))
    assert {(r.idempotency_key, r.position): (r.outcome, r.reason, r.event) for r in answers.collect()} == {
        ("good", 0): ("replayed", None, "e1"), ("gone", 1): ("refused", receipts.NO_RESULT, None), ("other", 2): ("refused", receipts.NO_RESULT, None), ("bare", 3): ("replayed", None, "e4"),
        ("old", 4): ("refused", receipts.LEGACY, None), ("fresh", 5): ("accepted", None, "n"), ("good", 9): ("refused", receipts.CONFLICT, None),
    }
    assert [r.idempotency_key for r in added.collect()] == ["fresh"]


def test_stream_equals_batch_after_a_restart(spark, tmp_path):
    commands = [c if c[0] != "hot" else (*c[:5], "c", c[6]) for c in given(60)]
    want, first = plain(commands)
    for part in (commands[:40], commands[40:]):
        spark.createDataFrame(part, COMMANDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(2):
            stream = spark.readStream.schema(COMMANDS).parquet(str(tmp_path / "in"))
            query = answer_stream(stream, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
            query.processAllAvailable()
            query.stop()
    got = spark.read.parquet(str(tmp_path / "out/answers")).collect()
    assert {(r.position, r.outcome, r.reason, r.event, r.candidate) for r in got} == want and len(got) == len(commands)
    assert spark.read.parquet(str(tmp_path / "out/receipts")).count() == len(first)
