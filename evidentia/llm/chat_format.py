"""Chat formatting checked by a grammar round trip.

Turns are rendered with marks around each text. The rendered conversation is parsed again; if the turns found differ
from the source, its texts are escaped (a backslash inside every control string, which the parser takes out again) and
it is parsed once more. A conversation that still differs is an error. All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the known roles; any other role is written in hex inside its opening mark.
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("<s>", "</s>")}
OTHER = ("[TURN ", "]", "[/TURN]")

_TAIL = r"(/?INST\]|TURN |/TURN\]|/?s>|</?SYS>>)"
_CONTROL = r"([\[<])(\\*)" + _TAIL
_ESCAPED = r"([\[<])\\(\\*)" + _TAIL
_TURN = r"(?s)\[INST\] .*? \[/INST\]|<<SYS>>.*?<</SYS>>|<s>.*?</s>|\[TURN [0-9A-F]*\].*?\[/TURN\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def render(role: Column, text: Column) -> Column:
    out = F.concat(F.lit(OTHER[0]), F.hex(F.encode(role, "UTF-8")), F.lit(OTHER[1]), text, F.lit(OTHER[2]))
    for name, (before, after) in MARKS.items():
        out = F.when(role == name, F.concat(F.lit(before), text, F.lit(after))).otherwise(out)
    return out


def parse_turn(turn: Column) -> Column:
    """(role, text) of one rendered turn."""
    inner = lambda before, after: unescape(F.substring(turn, F.lit(len(before) + 1), F.length(turn) - len(before) - len(after)))
    code = F.regexp_extract(turn, r"^\[TURN ([0-9A-F]*)\]", 1)
    skip = F.length(code) + len(OTHER[0]) + len(OTHER[1])
    out = F.struct(F.decode(F.unhex(code), "UTF-8").alias("role"), unescape(F.substring(turn, skip + 1, F.length(turn) - skip - len(OTHER[2]))).alias("text"))
    for name, (before, after) in MARKS.items():
        out = F.when(turn.startswith(before), F.struct(F.lit(name).alias("role"), inner(before, after).alias("text"))).otherwise(out)
    return out


def format_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted, turns (role, text; parsed from ``formatted``), loss_spans (start and length in ``formatted`` of each assistant text, escapes included).

    Rows are turns in the order of ``turn``, ties by role and text; null turns come first. A null role or text is an
    empty string. Repeated rows are turns each; extra columns are ignored. A conversation's turns meet in one row, as its
    text does; conversations are dealt out by id.
    """
    said = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    grouped = rows.select(F.col(conv_id).cast("long").alias("conv_id"), said.alias("t")).groupBy("conv_id").agg(F.collect_list("t").alias("t"))
    source = F.transform(F.array_sort("t"), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    parts = lambda c: F.regexp_extract_all(F.col(c), F.lit(_TURN), F.lit(0))
    joined = lambda made: F.array_join(F.transform("source", made), "")
    steps = (
        grouped.select("conv_id", source.alias("source")).withColumn("plain", joined(lambda t: render(t["role"], t["text"]))).withColumn("found", parts("plain"))
        .withColumn("fits", (F.array_join("found", "") == F.col("plain")) & (F.transform("found", parse_turn) == F.col("source")))
        .withColumn("formatted", F.when(F.col("fits"), F.col("plain")).otherwise(joined(lambda t: render(t["role"], escape(t["text"])))))
        .withColumn("found", parts("formatted")).withColumn("turns", F.transform("found", parse_turn))
    )
    before, after = MARKS["assistant"]
    zero = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    span = lambda acc, t: F.array(F.struct((acc["at"] + len(before)).alias("start"), (F.length(t) - len(before) - len(after)).alias("length")))
    step = lambda acc, t: F.struct((acc["at"] + F.length(t)).alias("at"), F.when(t.startswith(before), F.concat(acc["spans"], span(acc, t))).otherwise(acc["spans"]).alias("spans"))
    checked = F.when((F.array_join("found", "") == F.col("formatted")) & (F.col("turns") == F.col("source")), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation can't be read back from its format")))
    return steps.select("conv_id", checked.alias("formatted"), "turns", F.aggregate("found", zero, step, lambda acc: acc["spans"]).alias("loss_spans"))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of :func:`format_conversations`."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"], s["length"]))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return formatted.withColumn("loss", loss).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
