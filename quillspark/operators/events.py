"""Event-log operators: pages by key, first deliveries, order checks, latencies, folds over a case's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, key: str, after=None, before=None, limit: int = 50) -> DataFrame:
    """One page by key: ascending after a cursor, or descending before one. The limit is the page size, the feature itself."""
    if before is not None:
        return df.where(F.col(key) < before).orderBy(F.desc(key)).limit(limit)
    return (df if after is None else df.where(F.col(key) > after)).orderBy(key).limit(limit)


def first_delivery(events: DataFrame, key: list[str], order: str = "id") -> DataFrame:
    """Events delivered more than once reduced to their first delivery."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_n = 1").drop("_n")


def chained(events: DataFrame, case: str = "case_id", order: str = "id") -> DataFrame:
    """Transitions with the state the case was left in by the one before, and whether that is where the transition starts."""
    w = Window.partitionBy(case).orderBy(order)
    held = F.lag("to_status").over(w)
    return events.where("to_status is not null").withColumn("held", held).withColumn("consistent", F.col("from_status").eqNullSafe(F.col("held")))


def late(events: DataFrame, case: str = "case_id", order: str = "id", time: str = "created_at") -> DataFrame:
    """Events whose time lies before that of an event of the case that arrived earlier, with the delay in microseconds."""
    w = Window.partitionBy(case).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("latest", F.max(time).over(w)).where(F.col(time) < F.col("latest")).withColumn("late_us", F.unix_micros(F.col("latest").cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp")))


def final_states(events: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, status, steps): the last state of each case and its number of transitions."""
    t = events.where("to_status is not null")
    return t.groupBy(case).agg(F.max_by("to_status", "id").alias("status"), F.count("*").alias("steps"))


def attempts(events: DataFrame) -> DataFrame:
    """Transitions with attempt and latency of their JSON detail."""
    d = F.from_json("detail", "attempt int, latency_ms bigint")
    return events.select("id", "case_id", "event_type", "to_status", d["attempt"].alias("attempt"), d["latency_ms"].alias("latency_ms"))


def admitted(log: DataFrame, by: str, order: str, name: str, cost: str, budget: float, calls: int) -> DataFrame:
    """(by, order, reason) of calls in order: duplicate for a name admitted before, tool_limit once `calls` are admitted, cost_limit once the admitted ones have spent `budget`, null where admitted.

    A rejected call uses nothing up. A fold over the calls of one run, which the limits keep short."""
    state = F.struct(F.array().cast("array<string>").alias("seen"), F.lit(0).alias("n"), F.lit(0.0).alias("spent"), F.array().cast(f"array<struct<o:{dict(log.dtypes)[order]},reason:string>>").alias("out"))

    def step(s, x):
        reason = F.when(F.array_contains(s["seen"], x["name"]), "duplicate").when(s["n"] >= calls, "tool_limit").when(s["spent"] >= budget, "cost_limit")
        ok = reason.isNull()
        seen = F.when(ok, F.array_append(s["seen"], x["name"])).otherwise(s["seen"])
        out = F.array_append(s["out"], F.struct(x["o"].alias("o"), reason.alias("reason")))
        return F.struct(seen.alias("seen"), (s["n"] + ok.cast("int")).alias("n"), (s["spent"] + F.when(ok, x["cost"]).otherwise(0.0)).alias("spent"), out.alias("out"))

    calls_of = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(name).cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(cost).cast("double"), F.lit(0.0)).alias("cost"))))
    run = log.groupBy(by).agg(calls_of.alias("x")).select(by, F.explode(F.aggregate("x", state, step, lambda s: s["out"])).alias("r"))
    return run.select(by, F.col("r.o").alias(order), F.col("r.reason").alias("reason"))


def ancestors(cases: DataFrame, depth: int = 3) -> DataFrame:
    """(case_id, step, ancestor): up to `depth` parents of the same owner, nearest first, by repeated joins on the parent."""
    base = cases.select(F.col("case_id").alias("pid"), F.col("owner_id").alias("powner"), F.col("parent_case_id").alias("next"))
    cur = cases.where("parent_case_id is not null").select("case_id", "owner_id", F.col("parent_case_id").alias("at"))
    out = None
    for step in range(1, depth + 1):
        hit = cur.join(base, cur["at"] == base["pid"]).where("owner_id <=> powner").select("case_id", "owner_id", "next", F.col("pid").alias("ancestor"))
        one = hit.select("case_id", F.lit(step).alias("step"), "ancestor")
        out = one if out is None else out.unionByName(one)
        cur = hit.where("next is not null").select("case_id", "owner_id", F.col("next").alias("at"))
    return out


def sessions(events: DataFrame, by: str, time: str, gap_s: int) -> DataFrame:
    """(by, session, start, end, n): events of a key parted by gaps above gap_s."""
    w = Window.partitionBy(by).orderBy(time)
    new = F.coalesce((F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp")) > gap_s * 1_000_000).cast("int"), F.lit(1))
    s = events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(by, "session").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"))
