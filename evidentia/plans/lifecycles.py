"""Lifecycles of customers whose orders stand for candidates: each is proposed, then confirmed or rejected, and some are revoked.

Customers whose number leaves 1 to 19 when divided by 25 break one rule each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import lifecycle
from evidentia.tables import table

# What follows reads alike in Spark and in DuckDB. n: orders of a customer by number r; t: what becomes of the candidate.
_ORDERS = """n as (select o_custkey as context, o_custkey % 25 as c, o_orderkey % 4 as t, concat('k', cast(o_orderkey as string)) as k,
    row_number() over (partition by o_custkey order by o_orderkey) as r, count(*) over (partition by o_custkey) as most,
    lead(concat('k', cast(o_orderkey as string))) over (partition by o_custkey order by o_orderkey) as next_k,
    first_value(concat('k', cast(o_orderkey as string))) over (partition by o_custkey order by o_orderkey) as first_k from orders),
  m as (select context, k, lag(t) over (partition by context order by r) as before_t, lag(k) over (partition by context order by r) as before_k from n where t > 0)"""
_CANDIDATES = """select context, k as candidate, r as position, case when c = 2 and r = 2 then 'candidate-0' else 'candidate-1' end as schema,
    case when c = 3 and r = 2 then 'fork' else 'repo' end as repository, 'p' as project, concat('r', cast(r as string)) as revision from n
  union all select context, k, 1000, 'candidate-1', 'repo', 'p', 'r' from n where c = 1 and r = 1"""
_EVENTS = """i as (select context, c, r, most, t, k, next_k, first_k, 1 as step, 'PROPOSE' as type, cast(null as string) as replaces from n
    union all select n.context, c, r, most, t, n.k, next_k, first_k, 2, case when t = 0 then 'REJECT' else 'CONFIRM' end, case when t > 0 and before_t in (1, 2) then before_k end
      from n left join m on m.context = n.context and m.k = n.k
    union all select context, c, r, most, t, k, next_k, first_k, 3, 'REVOKE', cast(null as string) from n where t = 3),
  l as (select *, 3 * r + step as position, concat(k, ':', cast(step as string)) as own,
    lag(concat(k, ':', cast(step as string))) over (partition by context order by r, step) as before from i),
  e as (select context, position, case when c = 18 and r = 1 and step = 2 then before else own end as event,
    case when c = 8 and r = 2 and step = 1 then null when c = 9 and r = 2 and step = 1 then 'gone' when c = 10 and r = most and step = 1 then concat(k, case when t = 3 then ':3' else ':2' end)
      else before end as predecessor,
    case when c = 6 and r = 2 and step = 2 then 'APPROVE' when c = 12 and r = 1 and step = 2 and next_k is not null then 'PROPOSE' when c = 13 and r = 2 and step = 1 then 'CONFIRM'
      when c = 16 and r = 2 and step = 1 then 'REJECT' when c = 17 and r = 1 and step = 1 then 'REVOKE' else type end as type,
    case when c = 4 and r = 2 and step = 1 then 'gone' when c = 11 and r = 2 and step = 1 then first_k when c = 12 and r = 1 and step = 2 and next_k is not null then next_k else k end as candidate,
    case when c = 7 and r = 2 and step = 1 then 'x' when c = 12 and r = 1 and step = 2 then null when c in (14, 15) and r = case when c = 14 then 3 else 1 end and step = 2 then k else replaces end as replaces,
    case when c = 19 and r = 3 and step = 1 then 'event-0' else 'event-1' end as schema, 'repo' as repository, case when c = 5 and r = 2 and step = 1 then 'q' else 'p' end as project from l)"""


def lifecycle_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reduced lifecycle of every customer."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    contexts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("context"))
    candidates = spark.sql(f"with {_ORDERS} {_CANDIDATES}")
    return lifecycle.reduce_lifecycles(contexts, candidates, spark.sql(f"with {_ORDERS}, {_EVENTS} select * from e"))


_DUCK = lambda text: text.replace("as string)", "as varchar)")
QUERIES = {"lifecycle_states": lifecycle_states}
ORACLES = {
    "lifecycle_states": f"""with recursive {_DUCK(_ORDERS)}, {_DUCK(_EVENTS)}, k as ({_DUCK(_CANDIDATES)}),
  k1 as (select *, row_number() over (partition by context, candidate order by position) as copy, first_value(repository) over w as repository1 from k window w as (partition by context order by position)),
  wrong_k as (select context, arg_min(reason, position) as reason from (select *, case when copy > 1 then 'lkg-candidate-context-or-identity-corrupt' when schema <> 'candidate-1' then 'lkg-candidate-contract-invalid'
    when repository <> repository1 then 'lkg-candidate-provenance-inconsistent' end as reason from k1) where reason is not null group by context),
  e1 as (select e.*, row_number() over (partition by e.context, event order by e.position) as copy, x.candidate is not null as known from e left join (select distinct context, candidate from k) x on x.context = e.context and x.candidate = e.candidate),
  wrong_e as (select context, arg_min(reason, position) as reason from (select *, case when schema <> 'event-1' or copy > 1 or not known then 'lkg-event-context-or-identity-corrupt' when project <> 'p' then 'lkg-event-candidate-provenance-mismatch'
    when type not in ('PROPOSE', 'CONFIRM', 'REJECT', 'REVOKE') then 'lkg-event-type-unsupported' when type <> 'CONFIRM' and replaces is not null then 'lkg-event-replacement-on-non-confirm-invalid' end as reason from e1)
    where reason is not null and context not in (select context from wrong_k) group by context),
  sound as (select * from e where context not in (select context from wrong_k union all select context from wrong_e)),
  links as (select s.context, count(*) as n_events, count(*) filter (where s.predecessor is null) as roots, count(*) filter (where s.predecessor is not null and (p.event is null or p.event = s.event)) as bad,
    count(s.predecessor) - count(distinct s.predecessor) as branches from sound s left join (select distinct context, event from sound) p on p.context = s.context and p.event = s.predecessor group by s.context),
  w as (select context, cast(null as varchar) as event, 0 as n, cast(null as varchar) as pending, cast(null as varchar) as active, cast([] as varchar[]) as seen, cast(null as varchar) as reason from links where roots = 1 and bad = 0 and branches = 0
    union all select w.context, s.event, n + 1, case type when 'PROPOSE' then candidate when 'REVOKE' then pending end, case type when 'CONFIRM' then candidate when 'REVOKE' then null else active end, list_append(seen, candidate),
      case when reason is not null then reason when type = 'PROPOSE' and list_contains(seen, candidate) then 'lkg-candidate-proposed-more-than-once' when type = 'PROPOSE' and pending is not null then 'lkg-multiple-pending-candidates'
        when type = 'CONFIRM' and pending is distinct from candidate then 'lkg-confirm-target-not-pending' when type = 'CONFIRM' and active is not null and replaces is distinct from active then 'lkg-confirm-replacement-target-invalid'
        when type = 'CONFIRM' and active is null and replaces is not null then 'lkg-confirm-replacement-without-active' when type = 'REJECT' and pending is distinct from candidate then 'lkg-reject-target-not-pending'
        when type = 'REVOKE' and active is distinct from candidate then 'lkg-revoke-target-not-active' end
    from w join sound s on s.context = w.context and s.predecessor is not distinct from w.event),
  ends as (select context, max(n) as n, arg_max(event, n) as event, arg_max({{'p': pending, 'a': active}}, n) as s, arg_max({{'r': reason}}, n).r as reason from w group by context),
  broken as (select links.context, case when roots <> 1 then 'lkg-event-chain-root-invalid' when bad > 0 or branches > 0 then 'lkg-event-chain-predecessor-invalid' when n < n_events then 'lkg-event-chain-disconnected' else reason end as reason
    from links left join ends on ends.context = links.context),
  reasons as (select * from wrong_k union all select * from wrong_e union all select * from broken where reason is not null)
  select c_custkey as context, case when reasons.reason is not null then 'corrupt' when ends.event is null then 'none' when s.a is not null then 'active' when s.p is not null then 'pending' else 'inactive' end as status,
    case when reasons.reason is null then ends.event end as tip_event, case when reasons.reason is null then s.a end as active, case when reasons.reason is null then s.p end as pending,
    case when reasons.reason is null and ends.event is not null then cast(n as bigint) end as n_events, reasons.reason as reason
  from customer left join reasons on reasons.context = c_custkey left join ends on ends.context = c_custkey""",
}
