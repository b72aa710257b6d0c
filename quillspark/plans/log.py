"""Queries on cases, event logs and the star schema, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import events as E
from quillspark.operators import metrics as M
from quillspark.operators import store as S
from quillspark.registry import Registry, table

R = Registry()
KEY = ["case_id", "event_type", "from_status", "to_status", "trigger_subject", "trigger_entity", "detail", "created_at"]
FIRST = f"e as (select * exclude n from (select *, row_number() over (partition by {', '.join(KEY)} order by id) n from case_event_log) where n = 1)"


def _log(spark, d):
    return table(spark, d, "case_event_log")


@R.add("keyset_page", "select id, case_id, status from cases where id < 150 order by id desc limit 50")
def keyset_page(spark, d):
    return E.page(table(spark, d, "cases").select("id", "case_id", "status"), "id", before=150)


@R.add("event_page", "select event_id, event_type from events where event_id > 500 order by event_id limit 200")
def event_page(spark, d):
    return E.page(table(spark, d, "events").select("event_id", "event_type"), "event_id", after=500, limit=200)


@R.add("idempotent_first", f"with {FIRST} select id, case_id, event_type from e")
def idempotent_first(spark, d):
    return E.first_delivery(_log(spark, d), KEY).select("id", "case_id", "event_type")


@R.add("transition_chain", f"with {FIRST}, t as (select *, lag(to_status) over (partition by case_id order by id) held from e where to_status is not null) select from_status, held, count(*) n, sum((from_status is not distinct from held)::int)::bigint consistent from t group by 1, 2")
def transition_chain(spark, d):
    c = E.chained(E.first_delivery(_log(spark, d), KEY))
    return c.groupBy("from_status", "held").agg(F.count("*").alias("n"), F.count_if("consistent").alias("consistent"))


@R.add("late_events", "with t as (select id, case_id, created_at, max(created_at) over (partition by case_id order by id rows between unbounded preceding and 1 preceding) latest from case_event_log) select id, case_id, epoch_us(latest) - epoch_us(created_at) late_us from t where created_at < latest")
def late_events(spark, d):
    return E.late(_log(spark, d)).select("id", "case_id", "late_us")


@R.add("final_states", f"with {FIRST} select case_id, arg_max(to_status, id) status, count(*) steps from e where to_status is not null group by case_id")
def final_states(spark, d):
    return E.final_states(E.first_delivery(_log(spark, d), KEY))


@R.add("stage_percentiles", f"with {FIRST}, l as (select to_status, cast(detail->>'latency_ms' as bigint) v from e where to_status is not null and detail->>'latency_ms' is not null) select to_status, count(*) n, quantile_disc(v, 0.5)::bigint p50, quantile_disc(v, 0.9)::bigint p90, max(v) most from l group by to_status")
def stage_percentiles(spark, d):
    a = E.attempts(E.first_delivery(_log(spark, d), KEY)).where("to_status is not null")
    return M.latency(a, "to_status", "latency_ms").select("to_status", "n", F.col("p50").cast("bigint").alias("p50"), F.col("p90").cast("bigint").alias("p90"), "most")


ADMIT = "list_reduce(x, lambda a, c: case when list_contains(a.seen, c.name) then {'seen': a.seen, 'spent': a.spent, 'out': list_append(a.out, {'o': c.o, 'r': 'duplicate'})} when len(a.seen) >= 4 then {'seen': a.seen, 'spent': a.spent, 'out': list_append(a.out, {'o': c.o, 'r': 'tool_limit'})} when a.spent >= 3000 then {'seen': a.seen, 'spent': a.spent, 'out': list_append(a.out, {'o': c.o, 'r': 'cost_limit'})} else {'seen': list_append(a.seen, c.name), 'spent': a.spent + c.cost, 'out': list_append(a.out, {'o': c.o, 'r': null::varchar})} end, {'seen': []::varchar[], 'spent': 0::double, 'out': []::struct(o bigint, r varchar)[]})"


@R.add("budget_admission", f"with g as (select case_id, list({{'o': id, 'name': event_type || coalesce(to_status, ''), 'cost': coalesce(cast(detail->>'latency_ms' as double), 0)}} order by id) x from case_event_log group by 1) select case_id, r.o id, r.r reason from (select case_id, unnest(({ADMIT}).out) r from g)")
def budget_admission(spark, d):
    """Calls of a case in order, repeats of a step first: four calls and 3,000 milliseconds."""
    log = _log(spark, d).withColumn("name", F.concat("event_type", F.coalesce("to_status", F.lit("")))).withColumn("cost", F.coalesce(F.get_json_object("detail", "$.latency_ms").cast("double"), F.lit(0.0)))
    return E.admitted(log, "case_id", "id", "name", "cost", 3000, 4)


@R.add("case_history", "with recursive w(case_id, owner_id, up, step) as (select case_id, owner_id, parent_case_id, 1 from cases where parent_case_id is not null union all select w.case_id, w.owner_id, p.parent_case_id, w.step + 1 from w join cases p on p.case_id = w.up and p.owner_id is not distinct from w.owner_id where w.step < 3 and p.parent_case_id is not null) select w.case_id, w.step, w.up ancestor from w join cases p on p.case_id = w.up and p.owner_id is not distinct from w.owner_id")
def case_history(spark, d):
    return E.ancestors(table(spark, d, "cases")).select("case_id", "step", "ancestor")


@R.add("latest_per_key", "select case_id, max(id) id, arg_max(event_type, id) event_type from case_event_log group by case_id")
def latest_per_key(spark, d):
    return S.latest(_log(spark, d).select("case_id", "id", "event_type"), ["case_id"], ["id"])


@R.add("case_audit", f"with {FIRST}, f as (select case_id, arg_max(to_status, id) last_status from e where to_status is not null group by 1) select status, last_status, count(*) n from cases left join f using (case_id) group by 1, 2")
def case_audit(spark, d):
    f = E.final_states(E.first_delivery(_log(spark, d), KEY)).select("case_id", F.col("status").alias("last_status"))
    return table(spark, d, "cases").join(f, "case_id", "left").groupBy("status", "last_status").agg(F.count("*").alias("n"))


@R.add("trace_export", f"with {FIRST} select case_id, string_agg(event_type || ':' || coalesce(to_status, '-'), '>' order by id) trace, count(*) n from e group by case_id")
def trace_export(spark, d):
    e = E.first_delivery(_log(spark, d), KEY)
    s = e.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("id", F.concat_ws(":", "event_type", F.coalesce("to_status", F.lit("-"))).alias("s")))).alias("x"), F.count("*").alias("n"))
    return s.select("case_id", F.array_join(F.transform("x", lambda x: x["s"]), ">").alias("trace"), "n")


@R.add("event_sessions", "with t as (select user_id, ts, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts)) > 86400000000 or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) session from t) select user_id, session::bigint as session, epoch_us(max(ts)) - epoch_us(min(ts)) length_us, count(*) n from s group by 1, 2")
def event_sessions(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return E.sessions(e, "user_id", "ts", 86400).select("user_id", "session", (F.unix_micros("end") - F.unix_micros("start")).alias("length_us"), "n")


@R.add("dispatch_scan", "select o_orderkey, c_custkey, o_totalprice from orders join customer on o_custkey = c_custkey where o_orderstatus = 'O' or (o_orderstatus = 'P' and o_orderdate <= timestamp '1996-01-01') order by o_orderdate, o_orderkey limit 100")
def dispatch_scan(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'O' or (o_orderstatus = 'P' and o_orderdate <= timestamp_ntz'1996-01-01')").orderBy("o_orderdate", "o_orderkey")
    j = o.join(table(spark, d, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    return j.orderBy("o_orderdate", "o_orderkey").limit(100).select("o_orderkey", "c_custkey", "o_totalprice")


@R.add("pricing_summary", "select l_returnflag, l_linestatus, count(*) n, round(sum(l_quantity), 2) qty, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue from lineitem group by 1, 2")
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
