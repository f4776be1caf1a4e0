"""Receipts of commands: a command sent again under its key gets its first answer, and another one under that key is refused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.fingerprints import fingerprint

# Why a command has no answer.
NO_KEY, CONFLICT = "idempotency-key-invalid", "idempotency-conflict"
LEGACY, NO_RESULT = "legacy-lkg-idempotency-replay-unavailable", "lkg-idempotency-result-unavailable"
KEY = ("context", "idempotency_key")
RECEIPT = "context string, idempotency_key string, kind string, request string, candidate string, event string"


def answer(commands: DataFrame, receipts: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers to ``commands``, and the receipts that they add.

    ``commands``: context, idempotency_key, position, kind, request, candidate, event (the last two are what carrying it out would
    give). ``receipts`` (see RECEIPT; request is a fingerprint, and a key is there once) and ``events`` (context, idempotency_key,
    event, kind) are what is stored. Answers: position, context, idempotency_key, kind, outcome (accepted, replayed, refused),
    reason (null unless refused), event, candidate (null if refused). A stored receipt answers, else the key's first command by
    position (ties: by kind, fingerprint of the request, and event); rows that repeat it are that command. Refused in this order: no context or key; an
    event stored under the key without a receipt; another kind or request; a receipt whose event is gone or of another kind, or
    that proposed without a candidate. The first commands of all keys are one aggregation, so one key may hold most rows.
    """
    rows = commands.select(*KEY, "position", "kind", fingerprint("command-request", "kind", "request").alias("request"), "candidate", "event")
    named = rows.where("context is not null and idempotency_key is not null")
    first = named.groupBy(*KEY).agg(F.min(F.struct("position", "kind", "request", "event", "candidate")).alias("f"))
    kinds = events.select("event", F.col("kind").alias("_k")).where("event is not null").distinct()
    sound = F.count_if((F.col("_k") == F.col("kind")) & ((F.col("kind") != "PROPOSE") | F.col("candidate").isNotNull())) > 0
    stored = receipts.join(kinds, "event", "left").groupBy(*KEY).agg(F.min(F.struct("kind", "request", "event", "candidate")).alias("s"), sound.alias("sound"))
    legacy = events.where("context is not null and idempotency_key is not null").select(*KEY, F.lit(True).alias("legacy")).distinct()
    held = first.join(stored, list(KEY), "left").join(legacy, list(KEY), "left")
    base = lambda c: F.when(F.col("s").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(f"f.{c}")).alias(f"b_{c}")
    held = held.select(*KEY, "f", "sound", (F.col("s").isNull() & F.coalesce("legacy", F.lit(False))).alias("legacy"), *[base(c) for c in ("kind", "request", "event", "candidate")])
    told = rows.join(held, list(KEY), "left")
    same = F.col("kind").eqNullSafe(F.col("b_kind")) & F.col("request").eqNullSafe(F.col("b_request"))
    reason = F.when(F.col("context").isNull() | F.col("idempotency_key").isNull(), NO_KEY).when(F.col("legacy"), LEGACY).when(~same, CONFLICT).when(~F.col("sound"), NO_RESULT)
    own = F.col("sound").isNull() & F.struct("position", "kind", "request", "event", "candidate").eqNullSafe(F.col("f"))
    outcome = F.when(reason.isNotNull(), "refused").when(own, "accepted").otherwise("replayed")
    answers = told.select("position", *KEY, "kind", outcome.alias("outcome"), reason.alias("reason"), *[F.when(reason.isNull(), F.col(f"b_{c}")).alias(c) for c in ("event", "candidate")])
    added = held.where("sound is null and not legacy").select(*KEY, "f.kind", "f.request", "f.candidate", "f.event")
    return answers, added
