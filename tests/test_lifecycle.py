"""The reducer of lifecycles against a plain one that goes event by event."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evidentia.operators import lifecycle as lc

CANDIDATES = "context string, candidate string, position int, schema string, repository string, project string, revision string"
EVENTS = "context string, event string, position int, predecessor string, type string, candidate string, replaces string, schema string, repository string, project string"


def reduced(candidates, events):
    """(status, tip, active, pending, number of events, reason) of one context."""
    corrupt = lambda reason: ("corrupt", None, None, None, None, reason)
    seen, origin = {}, None
    for _, c, _, schema, repo, project, revision in sorted(candidates, key=lambda x: (x[2], x[1])):
        origin = origin or (repo, project)
        if c in seen:
            return corrupt(lc.CANDIDATE_CORRUPT)
        if schema != "candidate-1" or not (repo and project and revision):
            return corrupt(lc.CANDIDATE_INVALID)
        if (repo, project) != origin:
            return corrupt(lc.CANDIDATE_INCONSISTENT)
        seen[c] = (repo, project)
    ids = {}
    for e in sorted(events, key=lambda x: (x[2], x[1])):
        _, event, _, _, kind, c, replaces, schema, repo, project = e
        if schema != "event-1" or not (event and repo and project) or event in ids or c not in seen:
            return corrupt(lc.EVENT_CORRUPT)
        if (repo, project) != seen[c]:
            return corrupt(lc.EVENT_MISMATCH)
        if kind not in lc.TYPES:
            return corrupt(lc.EVENT_UNSUPPORTED)
        if kind != "CONFIRM" and replaces is not None:
            return corrupt(lc.EVENT_REPLACES)
        ids[event] = e
    if not events:
        return ("none", None, None, None, None, None)
    if sum(e[3] is None for e in events) != 1:
        return corrupt(lc.CHAIN["root-invalid"])
    followers = Counter(e[3] for e in events)
    if any(e[3] is not None and (e[3] == e[1] or e[3] not in ids or followers[e[3]] > 1) for e in events):
        return corrupt(lc.CHAIN["predecessor-invalid"])
    after, chain = {e[3]: e for e in events}, []
    while (chain[-1][1] if chain else None) in after:
        chain.append(after[chain[-1][1] if chain else None])
    if len(chain) < len(events):
        return corrupt(lc.CHAIN["disconnected"])
    pending, active, named = None, None, set()
    for _, _, _, _, kind, c, replaces, *_ in chain:
        if kind == "PROPOSE":
            if c in named or pending:
                return corrupt(lc.PROPOSED_TWICE if c in named else lc.SEVERAL_PENDING)
            pending = c
        elif kind in ("CONFIRM", "REJECT"):
            if c != pending:
                return corrupt(lc.CONFIRM_NOT_PENDING if kind == "CONFIRM" else lc.REJECT_NOT_PENDING)
            if kind == "CONFIRM":
                if active and replaces != active:
                    return corrupt(lc.CONFIRM_TARGET)
                if not active and replaces is not None:
                    return corrupt(lc.CONFIRM_WITHOUT_ACTIVE)
                active = c
            pending = None
        else:
            if c != active:
                return corrupt(lc.REVOKE_NOT_ACTIVE)
            active = None
        named.add(c)
    return ("active" if active else "pending" if pending else "inactive", chain[-1][1], active, pending, len(chain), None)


def valid_context(rng, name, n):
    """Candidates and events of a lifecycle that breaks no rule."""
    candidates, events, pending, active, tip = [], [], None, None, None
    for i in range(n):
        kinds = (["CONFIRM", "REJECT"] if pending else ["PROPOSE"]) + (["REVOKE"] if active else [])
        kind, replaces = rng.choice(kinds), None
        if kind == "PROPOSE":
            pending = subject = f"{name}k{len(candidates)}"
            candidates.append((name, subject, len(candidates), "candidate-1", "repo", "p", "r"))
        elif kind == "REVOKE":
            subject, active = active, None
        else:
            subject, pending = pending, None
            if kind == "CONFIRM":
                replaces, active = active, subject
        events.append((name, f"{name}e{i}", i, tip, kind, subject, replaces, "event-1", "repo", "p"))
        tip = f"{name}e{i}"
    return candidates, events


def damaged(rng, candidates, events):
    """One cell of one row changed, or a row repeated or gone."""
    rows = rng.choice([candidates, events, events, events, events])
    if not rows:
        return
    i = rng.randrange(len(rows))
    how = rng.random()
    if how < 0.1:
        rows.append((*rows[i][:2], 1000, *rows[i][3:]))
    elif how < 0.2:
        rows.pop(i)
    else:
        at = rng.choice(range(3, len(rows[i])))
        values = [r[at] for r in rows] + [None, "", "other", *lc.TYPES] + [e[1] for e in events]
        rows[i] = (*rows[i][:at], rng.choice(values), *rows[i][at + 1 :])


@pytest.mark.parametrize("stretch", [65_536, 3])
def test_reducer_equals_the_plain_one(spark, stretch):
    rng, all_candidates, all_events, want = random.Random(8), [], [], {}
    for i in range(400):
        candidates, events = valid_context(rng, f"c{i}", rng.choice([0, 1, 2, 5, 12]))
        for _ in range(rng.choice([0, 1, 1, 2])):
            damaged(rng, candidates, events)
        all_candidates += candidates
        all_events += events
        want[f"c{i}"] = reduced(candidates, events)
    candidates, events = spark.createDataFrame(all_candidates, CANDIDATES), spark.createDataFrame(all_events, EVENTS)
    contexts = spark.createDataFrame([(f"c{i}",) for i in range(400)], "context string")
    got = {r[0]: tuple(r[1:]) for r in lc.reduce_lifecycles(contexts, candidates, events, stretch=stretch).collect()}
    assert got == want
    reasons = Counter(r[5] for r in want.values())
    assert len(reasons) >= 12 and {r[0] for r in want.values()} == {"none", "pending", "active", "inactive", "corrupt"}


def test_one_context_holds_most_events(spark):
    rng = random.Random(9)
    candidates, events = valid_context(rng, "hot", 3000)
    rng.shuffle(events)
    small = [valid_context(rng, f"s{i}", 3) for i in range(50)]
    all_candidates, all_events = candidates + [x for c, _ in small for x in c], events + [x for _, e in small for x in e]
    contexts = spark.createDataFrame([("hot",), ("s1",), ("s1",)], "context string")
    got = {r[0]: tuple(r[1:]) for r in lc.reduce_lifecycles(contexts, spark.createDataFrame(all_candidates, CANDIDATES), spark.createDataFrame(all_events, EVENTS), stretch=100).collect()}
    assert got == {"hot": reduced(candidates, events), "s1": reduced(*small[1])}
    placed = lc.states_before(spark.createDataFrame([("hot", e[1], i, e[4], e[5]) for i, e in enumerate(sorted(events, key=lambda e: e[2]))], "context string, event string, position long, type string, candidate string"), 100)
    assert placed.where("type = 'PROPOSE' and (pending is not null or mentioned)").count() == 0


def test_no_rows(spark):
    nothing = spark.createDataFrame([], CANDIDATES), spark.createDataFrame([], EVENTS)
    assert lc.reduce_lifecycles(spark.createDataFrame([], "context string"), *nothing).collect() == []
    assert [tuple(r) for r in lc.reduce_lifecycles(spark.createDataFrame([("a",)], "context string").withColumn("position", F.lit(1)), *nothing).collect()] == [("a", "none", None, None, None, None, None)]


def test_short_chains_are_one_row_each_and_long_ones_agree(spark, monkeypatch):
    """Short chains must not be joined with themselves level by level (F3)."""
    from evidentia.operators import chains

    rng, rows = random.Random(11), []
    for key in range(60):
        n = rng.randint(1, 12)
        events = [(key, f"e{i}", f"e{i - 1}" if i else None, i * 10) for i in range(n)]
        if rng.random() < 0.5:
            i = rng.randrange(n)
            events[i] = (key, f"e{i}", rng.choice([None, "gone", f"e{rng.randrange(n)}"]), i * 10)
        rows += events
    rows += [(60, "e0", None, 0), (60, "e1", "e2", 10), (60, "e2", "e1", 20)]
    table = spark.createDataFrame(rows, "key int, event string, predecessor string, more int")
    found = []
    for short in (256, 4, 1):
        monkeypatch.setattr(chains, "SHORT", short)
        status, positions = chains.chain_positions(table, "more")
        found.append(({tuple(r) for r in status.collect()}, {(r.key, r.event, r.position, r.more) for r in positions.collect()}))
        assert {tuple(r) for r in chains.chain_status(table).collect()} == found[-1][0]
    assert found[0] == found[1] == found[2]
    assert {s for _, _, s in found[0][0]} == {"linear", "root-invalid", "predecessor-invalid", "disconnected"}
    assert all(m == p * 10 for _, _, p, m in found[0][1])
