"""Commands and their receipts: lines are commands of their customers, orders of even number have stored receipts or events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidentia.operators import receipts
from evidentia.tables import table

# What follows reads alike in Spark and in DuckDB.
_PARTS = {
    "commands": """select concat('c', cast(o_custkey as string)) as context, case when l_partkey % 41 <> 0 then concat('k', cast(l_orderkey % 12 as string)) end as idempotency_key, l_orderkey * 10 + l_linenumber as position,
      case when o_custkey % 3 = 0 and l_linenumber % 3 = 0 then 'CONFIRM' else 'PROPOSE' end as kind, concat('r', cast(case when o_custkey % 5 = 0 then l_partkey % 2 else o_custkey % 7 end as string)) as request,
      concat('d', cast(l_orderkey as string)) as candidate, concat('v', cast(l_orderkey as string), ':', cast(l_linenumber as string)) as event from lineitem join orders on o_orderkey = l_orderkey""",
    "stored": """select distinct concat('c', cast(o_custkey as string)) as context, concat('k', cast(o_custkey % 12 as string)) as idempotency_key, 'PROPOSE' as kind, concat('r', cast(o_custkey % 7 as string)) as request,
      case when o_custkey % 8 <> 0 then 'stored' end as candidate, concat('w', cast(o_custkey as string)) as event from orders where o_custkey % 2 = 0""",
    "events": """select distinct concat('c', cast(o_custkey as string)) as context, concat('k', cast(case when o_custkey % 6 = 1 then 3 else o_custkey % 12 end as string)) as idempotency_key, concat('w', cast(o_custkey as string)) as event,
      case when o_custkey % 10 = 0 then 'CONFIRM' else 'PROPOSE' end as kind from orders where o_custkey % 2 = 0 and o_custkey % 14 <> 0 or o_custkey % 6 = 1""",
}


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    for name in ("orders", "lineitem"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    t = {name: spark.sql(text) for name, text in _PARTS.items()}
    stored = t["stored"].withColumn("request", receipts.fingerprint("command-request", "kind", "request"))
    return receipts.answer(t["commands"], stored, t["events"])


def command_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir)[0]


def command_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir)[1]


_SQL = (
    "with "
    + ", ".join(f"{name} as ({text.replace('as string)', 'as varchar)')})" for name, text in _PARTS.items())
    + f""", f as (select * from commands where idempotency_key is not null qualify row_number() over (partition by context, idempotency_key order by position, kind, sha256('command-request' || chr(0) || kind || chr(0) || request), event, candidate) = 1),
  j as (select c.*, s.context is not null as is_stored, s.context is null and l.context is not null as legacy, case when s.context is null then f.kind else s.kind end as b_kind, case when s.context is null then f.request else s.request end as b_request,
      case when s.context is null then f.event else s.event end as b_event, case when s.context is null then f.candidate else s.candidate end as b_candidate, s.candidate as s_candidate, e.kind as e_kind, f.position as first
    from commands c left join f on f.context = c.context and f.idempotency_key = c.idempotency_key left join stored s on s.context = c.context and s.idempotency_key = c.idempotency_key
    left join events l on l.context = c.context and l.idempotency_key = c.idempotency_key left join events e on e.event = s.event),
  a as (select *, case when idempotency_key is null then '{receipts.NO_KEY}' when legacy then '{receipts.LEGACY}' when kind <> b_kind or request <> b_request then '{receipts.CONFLICT}'
    when is_stored and (e_kind is distinct from b_kind or s_candidate is null) then '{receipts.NO_RESULT}' end as reason from j)"""
)
QUERIES = {"command_answers": command_answers, "command_receipts": command_receipts}
ORACLES = {
    "command_answers": _SQL
    + """ select position, context, idempotency_key, kind, case when reason is not null then 'refused' when not is_stored and position = first then 'accepted' else 'replayed' end as outcome, reason,
      case when reason is null then b_event end as event, case when reason is null then b_candidate end as candidate from a""",
    "command_receipts": _SQL
    + """ select context, idempotency_key, kind, sha256('command-request' || chr(0) || kind || chr(0) || request) as request, candidate, event from f
      where (context, idempotency_key) not in (select (context, idempotency_key) from stored) and (context, idempotency_key) not in (select (context, idempotency_key) from events)""",
}
