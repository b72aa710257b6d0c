"""Reports over runs: outcomes with retries, arms of filters, strategies side by side, pools with provenance, parsed model outputs, attempts, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import metrics as M

MANY = "array<string>"


def final_outcome(first: Column, retry: Column) -> Column:
    """The outcome of a retry where there was one, else the first."""
    return F.coalesce(retry, first)


def condition_rows(trials: DataFrame, by: str) -> DataFrame:
    """(by, n, first_pass, after_retry, blocked, useful, precision): trials (outcome, retry, useful) by condition: passed at once, passed after a retry, blocked for good."""
    last = final_outcome(F.col("outcome"), F.col("retry"))
    given = F.count_if(last == "answered")
    useful = F.count_if((last == "answered") & F.col("useful"))
    return trials.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("outcome") != "blocked").alias("first_pass"), F.count_if((F.col("outcome") == "blocked") & (last != "blocked")).alias("after_retry"), F.count_if(last == "blocked").alias("blocked"), useful.alias("useful"), F.round(M.ratio(useful, given), 6).alias("precision"))


def arm_hits(arms: DataFrame, gold: DataFrame) -> DataFrame:
    """(arm, queries, hits, gained, lost) of results (arm, query_id, id) against gold (query_id, id); a query that an arm has no result for is a miss; gained and lost are against the arm "none"."""
    names = arms.select("arm").distinct()
    every = gold.select("query_id").distinct().crossJoin(F.broadcast(names))  # a few names
    hit = arms.join(gold, ["query_id", "id"]).select("arm", "query_id").distinct().withColumn("h", F.lit(True))
    j = every.join(hit, ["arm", "query_id"], "left").withColumn("h", F.coalesce("h", F.lit(False)))
    base = j.where("arm = 'none'").select("query_id", F.col("h").alias("b"))
    return j.join(base, "query_id").groupBy("arm").agg(F.count("*").alias("queries"), F.count_if("h").alias("hits"), F.count_if(F.col("h") & ~F.col("b")).alias("gained"), F.count_if(~F.col("h") & F.col("b")).alias("lost"))


def strategies(ranked: DataFrame, gold: DataFrame, texts: DataFrame, depth: int = 3) -> DataFrame:
    """(strategy, queries, hits, context_chars): rankings (strategy, query_id, rank, id) of several ways to chunk: hits within the depth and the mean length of the distinct contexts (id, context) of a query."""
    top = ranked.where(F.col("rank") <= depth)
    hit = top.join(gold, ["query_id", "id"]).select("strategy", "query_id").distinct().withColumn("h", F.lit(1))
    size = top.join(texts, "id").select("strategy", "query_id", "context").distinct().groupBy("strategy", "query_id").agg(F.sum(F.length("context")).alias("chars"))
    q = top.select("strategy", "query_id").distinct().join(hit, ["strategy", "query_id"], "left").join(size, ["strategy", "query_id"], "left")
    return q.groupBy("strategy").agg(F.count("*").alias("queries"), F.count("h").alias("hits"), F.round(F.avg(F.coalesce("chars", F.lit(0))), 3).alias("context_chars"))


def pool_with_gold(rankings: DataFrame, gold: DataFrame, depth: int) -> DataFrame:
    """(query_id, id, found_by): the best `depth` of all systems (system, query_id, rank, id) with system and rank, gold always among them."""
    top = rankings.where(F.col("rank") <= depth).select("query_id", "id", F.concat_ws("@", "system", F.col("rank").cast("string")).alias("m"))
    return top.unionByName(gold.select("query_id", "id", F.lit("gold").alias("m"))).groupBy("query_id", "id").agg(F.array_join(F.array_sort(F.collect_set("m")), ",").alias("found_by"))


def dialogue_issues(first: Column, follow_up: Column, topic: Column, used: Column) -> Column:
    """What keeps a dialogue out: topic_missing in its first turn, topic_repeated in the follow-up, reused source; null where nothing does."""
    return F.when(~F.contains(F.lower(first), F.lower(topic)), "topic_missing").when(F.contains(F.lower(follow_up), F.lower(topic)), "topic_repeated").when(used, "reused")


def routed(c: Column, intents: list[str], applied: list[str]) -> Column:
    """A router's JSON answer as struct<intent,applied,not_applied>: null for an unknown intent; filters only for the first intent, of which the keys in `applied` apply and the rest is noted."""
    p = F.from_json(c, "intent string, filters map<string,string>")
    empty = F.create_map().cast("map<string,string>")
    f = F.when(p["intent"] == intents[0], F.coalesce(p["filters"], empty)).otherwise(empty)
    out = F.struct(p["intent"].alias("intent"), F.map_filter(f, lambda k, v: k.isin(*applied) & (F.trim(v) != "")).alias("applied"), F.array_sort(F.map_keys(F.map_filter(f, lambda k, v: ~k.isin(*applied)))).alias("not_applied"))
    return F.when(p["intent"].isin(*intents), out)


def tool_call(c: Column, tools: dict[str, str]) -> Column:
    """A tool call of JSON {name, arguments} as struct<name,argument>; null unless the tool is known and its argument is a text that isn't blank."""
    p = F.from_json(c, "name string, arguments map<string,string>")
    arg = F.lit(None).cast("string")
    for name, key in tools.items():
        arg = F.when(p["name"] == name, F.trim(F.try_element_at(p["arguments"], F.lit(key)))).otherwise(arg)
    return F.when(F.coalesce(arg, F.lit("")) != "", F.struct(p["name"].alias("name"), arg.alias("argument")))


def sanitised(c: Column, kept: list[str]) -> Column:
    """A JSON object with the named fields only, in their order; fields that are missing are left out."""
    return F.to_json(F.from_json(c, ", ".join(f"{k} string" for k in kept)))


def attempt_kind(status: Column, sent: Column, elapsed: Column, limit: int) -> Column:
    """How a provider attempt ended: not_sent before transport, timeout above the limit, ok, throttled, server_error or client_error by status."""
    return F.when(~sent, "not_sent").when(elapsed > limit, "timeout").when(status.between(200, 299), "ok").when(status == 429, "throttled").when(status >= 500, "server_error").otherwise("client_error")


def iso_utc(c: Column) -> Column:
    """A time as ISO text in UTC with milliseconds."""
    return F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def judgment_rows(pool: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, doc, hash, label): every pooled sentence once a document, unlabelled ones irrelevant."""
    p = pool.select("query_id", "doc", "hash").distinct()
    return p.join(labels, ["query_id", "doc", "hash"], "left").select("query_id", "doc", "hash", F.coalesce("label", F.lit("irrelevant")).alias("label"))


def side_by_side(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, old, new, change) of two reports; one that lacks a key gives null."""
    j = a.select(key, F.col(value).alias("old")).join(b.select(key, F.col(value).alias("new")), key, "full_outer")
    return j.withColumn("change", F.col("new") - F.col("old"))


def canonical_hash(c: Column) -> Column:
    """The SHA-256 of a struct's compact JSON; fields must be given in key order."""
    return F.sha2(F.to_json(c), 256)


def paired_interval(df: DataFrame, by: str, a: str, b: str, key: str) -> DataFrame:
    """(by, mean, low, high) of the differences a - b by Poisson resampling."""
    return M.bootstrap_poisson(df.withColumn("_d", (F.col(a) - F.col(b)).cast("double")), by, "_d", key)


def element_counts(elements: DataFrame, key: str) -> DataFrame:
    """(key, elements, tables) of (key, kind)."""
    return elements.groupBy(key).agg(F.count("*").alias("elements"), F.count_if(F.col("kind").isin("table", "table_row")).alias("tables"))


def latency_gaps(events: DataFrame, by: str, order: str, time: str) -> DataFrame:
    """Events with the microseconds since the one before in their group; null for the first."""
    w = Window.partitionBy(by).orderBy(order)
    at = F.unix_micros(F.col(time).cast("timestamp"))
    return events.withColumn("gap_us", at - F.lag(at).over(w))
