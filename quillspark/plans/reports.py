"""Queries on reports over runs, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import judging as J
from quillspark.operators import reports as P
from quillspark.plans.judging import POOL, TRIALS, _pool, trials
from quillspark.plans.corpus import squash_sql
from quillspark.registry import Registry, table

R = Registry()


@R.add("condition_rows", f"with {TRIALS}, x as (select split, decision o, case when length(question) % 5 = 0 and decision = 'blocked' then 'answered' end r, correct u from tr), y as (select *, coalesce(r, o) f from x) select split, count(*) n, sum((o <> 'blocked')::int)::bigint first_pass, sum((o = 'blocked' and f <> 'blocked')::int)::bigint after_retry, sum((f = 'blocked')::int)::bigint blocked, sum((f = 'answered' and u)::int)::bigint useful, round(sum((f = 'answered' and u)::int) / nullif(sum((f = 'answered')::int), 0), 6) as precision from y group by 1")
def condition_rows(spark, d):
    t = trials(spark, d).select("split", F.col("decision").alias("outcome"), F.when((F.length("question") % 5 == 0) & (F.col("decision") == "blocked"), "answered").alias("retry"), F.col("correct").alias("useful"))
    return P.condition_rows(t, "split")


ARMS = "g as (select distinct sample_id query_id, unnest(gold_evidence_ids) id from queries), a as (select 'none' arm, query_id, id from g where length(id) % 2 = 0 union all select 'predicted', query_id, id from g where length(id) % 3 = 0 union all select 'gold', query_id, id from g)"


@R.add("filter_arms", f"with {ARMS}, q as (select distinct query_id from g), h as (select arm, query_id, exists (select 1 from a join g using (query_id, id) where a.arm = n.arm and a.query_id = q.query_id) h from q, (select distinct arm from a) n) select h.arm, count(*) queries, sum(h.h::int)::bigint hits, sum((h.h and not b.h)::int)::bigint gained, sum((not h.h and b.h)::int)::bigint lost from h join (select query_id, h from h where arm = 'none') b using (query_id) group by 1")
def filter_arms(spark, d):
    g = table(spark, d, "queries").select(F.col("sample_id").alias("query_id"), F.explode("gold_evidence_ids").alias("id")).distinct()
    arms = g.select(F.explode(F.filter(F.array(F.when(F.length("id") % 2 == 0, "none"), F.when(F.length("id") % 3 == 0, "predicted"), F.lit("gold")), lambda x: x.isNotNull())).alias("arm"), "query_id", "id")
    return P.arm_hits(arms, g)


@R.add("chunking_strategies", "with r as (select s strategy, sample_id query_id, i rank, case s when 'a' then id else reverse(id) end id from (select sample_id, unnest(gold_evidence_ids) id, generate_subscripts(gold_evidence_ids, 1) i from queries), (select unnest(['a', 'b']) s)), g as (select distinct sample_id query_id, unnest(gold_evidence_ids) id from queries), t as (select chunk_id id, coalesce(text, '') c from chunks), x as (select strategy, query_id, max((g.id is not null)::int) h from (select distinct * from r where rank <= 3) left join g using (query_id, id) group by 1, 2), z as (select strategy, query_id, sum(length(c)) chars from (select distinct strategy, query_id, c from r join t using (id) where rank <= 3) group by 1, 2) select strategy, count(*) queries, sum(h)::bigint hits, round(avg(coalesce(chars, 0)), 3) context_chars from x left join z using (strategy, query_id) group by 1")
def chunking_strategies(spark, d):
    q = table(spark, d, "queries").select(F.col("sample_id").alias("query_id"), F.posexplode("gold_evidence_ids").alias("p", "id"))
    r = q.select("query_id", (F.col("p") + 1).alias("rank"), F.explode(F.array(F.struct(F.lit("a").alias("s"), F.col("id")), F.struct(F.lit("b").alias("s"), F.reverse("id").alias("id")))).alias("x")).select(F.col("x.s").alias("strategy"), "query_id", "rank", F.col("x.id").alias("id"))
    return P.strategies(r, q.select("query_id", "id").distinct(), table(spark, d, "chunks").select(F.col("chunk_id").alias("id"), F.coalesce("text", F.lit("")).alias("context")))


@R.add("pool_with_gold", "with r as (select sample_id query_id, unnest(gold_evidence_ids) id, generate_subscripts(gold_evidence_ids, 1) rank from queries), m as (select query_id, id, 'x@' || rank m from r where rank <= 2 union select query_id, id || '-y', 'y@' || rank from r where rank <= 2 union select query_id, id, 'gold' from r) select query_id, id, string_agg(m, ',' order by m) found_by from m group by 1, 2")
def pool_with_gold(spark, d):
    q = table(spark, d, "queries").select(F.col("sample_id").alias("query_id"), F.posexplode("gold_evidence_ids").alias("p", "id")).withColumn("rank", F.col("p") + 1)
    x = q.select(F.lit("x").alias("system"), "query_id", "rank", "id").unionByName(q.select(F.lit("y").alias("system"), "query_id", "rank", F.concat("id", F.lit("-y")).alias("id")))
    return P.pool_with_gold(x, q, 2)


@R.add("dialogue_issues", "select sample_id, case when not contains(lower(question), lower(t)) then 'topic_missing' when contains(lower(f), lower(t)) then 'topic_repeated' when length(question) % 2 = 0 then 'reused' end issue from (select sample_id, question, expected_filters['topic'] t, coalesce(rationale, '') f from queries_authored) where t is not null")
def dialogue_issues(spark, d):
    q = table(spark, d, "queries_authored").withColumn("t", F.try_element_at("expected_filters", F.lit("topic"))).where("t is not null")
    return q.select("sample_id", P.dialogue_issues(F.col("question"), F.coalesce("rationale", F.lit("")), F.col("t"), F.length("question") % 2 == 0).alias("issue"))


@R.add("routed_queries", "select sample_id, intent, case when intent = 'popular_science' then expected_filters['period'] end period, case when intent = 'popular_science' then array_to_string(list_sort(list_filter(map_keys(expected_filters), lambda k: k not in ('period', 'source_type'))), ',') else '' end not_applied from queries_authored where intent in ('popular_science', 'emergency')")
def routed_queries(spark, d):
    raw = F.to_json(F.struct("intent", F.col("expected_filters").alias("filters")))
    q = table(spark, d, "queries_authored").select("sample_id", P.routed(raw, ["popular_science", "emergency"], ["source_type", "period"]).alias("r")).where("r is not null")
    return q.select("sample_id", F.col("r.intent").alias("intent"), F.try_element_at("r.applied", F.lit("period")).alias("period"), F.array_join("r.not_applied", ",").alias("not_applied"))


@R.add("tool_calls", "select event_id, case event_type when 'click' then 'search' when 'view' then 'expand' end as \"name\", 'k' || event_id argument from events where event_type in ('click', 'view')")
def tool_calls(spark, d):
    e = table(spark, d, "events")
    name = F.when(F.col("event_type") == "click", "search").when(F.col("event_type") == "view", "expand").otherwise(F.col("event_type"))
    raw = F.to_json(F.struct(name.alias("name"), F.create_map(F.lit("q"), F.concat(F.lit(" k"), F.col("event_id").cast("string"))).alias("arguments")))
    return e.select("event_id", P.tool_call(raw, {"search": "q", "expand": "q"}).alias("c")).where("c is not null").select("event_id", F.col("c.name").alias("name"), F.col("c.argument").alias("argument"))


@R.add("sanitised_responses", "select id, case when detail is null then null when detail->>'latency_ms' is null then '{\"attempt\":\"' || (detail->>'attempt') || '\"}' else '{\"attempt\":\"' || (detail->>'attempt') || '\"}' end body from case_event_log where detail is not null and detail->>'attempt' is not null")
def sanitised_responses(spark, d):
    e = table(spark, d, "case_event_log").where("detail is not null and get_json_object(detail, '$.attempt') is not null")
    return e.select("id", P.sanitised(F.col("detail"), ["attempt", "none"]).alias("body"))


@R.add("attempt_kinds", "select case when user_id % 9 = 0 then 'not_sent' when value > 40 then 'timeout' when event_id % 5 in (0, 1, 2) then 'ok' when event_id % 5 = 3 then 'throttled' else 'server_error' end kind, count(*) n from events group by 1")
def attempt_kinds(spark, d):
    e, n = table(spark, d, "events"), F.col("event_id") % 5
    status = F.when(n < 3, 200).when(n == 3, 429).otherwise(503)
    return e.select(P.attempt_kind(status, F.col("user_id") % 9 != 0, F.col("value"), 40).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@R.add("iso_times", "select id, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%gZ') iso from cases")
def iso_times(spark, d):
    return table(spark, d, "cases").select("id", P.iso_utc(F.col("created_at")).alias("iso"))


@R.add("judgment_rows", f"with {POOL}, s as (select distinct query_id, doc, sha256({squash_sql('sentence')}) h, length(sentence) n from po), l as (select query_id, doc, h, max(n) n from s group by 1, 2, 3) select query_id, case when n % 3 = 2 then 'relevant' else 'irrelevant' end as label, count(*) n from l group by 1, 2")
def judgment_rows(spark, d):
    p = _pool(spark, d).withColumn("hash", F.sha2(T.squash(F.col("sentence")), 256)).withColumn("n", F.length("sentence"))
    labels = p.groupBy("query_id", "doc", "hash").agg(F.max("n").alias("n")).where("n % 3 = 2").select("query_id", "doc", "hash", F.lit("relevant").alias("label"))
    return P.judgment_rows(p, labels).groupBy("query_id", "label").agg(F.count("*").alias("n"))


@R.add("version_comparison", "with a as (select source k, count(*)::bigint v from chunks where length(source) % 3 > 0 group by 1), b as (select source k, count(distinct source_id)::bigint v from chunks where length(source) % 5 > 0 group by 1) select k as source, a.v as \"old\", b.v as \"new\", b.v - a.v change from a full join b using (k)")
def version_comparison(spark, d):
    c = table(spark, d, "chunks")
    a = c.where(F.length("source") % 3 > 0).groupBy("source").agg(F.count("*").alias("v"))
    return P.side_by_side(a, c.where(F.length("source") % 5 > 0).groupBy("source").agg(F.countDistinct("source_id").alias("v")), "source", "v")


@R.add("canonical_hashes", "select sample_id, sha256(to_json({'bucket': bucket, 'ids': gold_evidence_ids, 'split': split})::varchar) h from queries where bucket is not null")
def canonical_hashes(spark, d):
    return table(spark, d, "queries").where("bucket is not null").select("sample_id", P.canonical_hash(F.struct("bucket", F.col("gold_evidence_ids").alias("ids"), "split")).alias("h"))


@R.add("paired_interval")
def paired_interval(spark, d):
    t = trials(spark, d).select("key", "split", F.col("correct").cast("int").alias("a"), F.col("answered").cast("int").alias("b"))
    return P.paired_interval(t, "split", "a", "b", "key")


@R.add("element_counts", "select source_id, count(*) elements, count(*) filter (where metadata.content_kind = 'pdf_text') tables from chunks group by 1")
def element_counts(spark, d):
    c = table(spark, d, "chunks").select("source_id", F.when(F.col("metadata.content_kind") == "pdf_text", "table").otherwise("paragraph").alias("kind"))
    return P.element_counts(c, "source_id")


@R.add("latency_gaps", "select id, epoch_us(created_at) - epoch_us(lag(created_at) over (partition by case_id order by id)) gap_us from case_event_log")
def latency_gaps(spark, d):
    return P.latency_gaps(table(spark, d, "case_event_log"), "case_id", "id", "created_at").select("id", "gap_us")


@R.add("source_totals", "select metadata.content_kind kind, count(distinct source) sources, count(distinct source_id) pages, count(*) chunks from chunks group by 1")
def source_totals(spark, d):
    c = table(spark, d, "chunks")
    return c.groupBy(F.col("metadata.content_kind").alias("kind")).agg(F.countDistinct("source").alias("sources"), F.countDistinct("source_id").alias("pages"), F.count("*").alias("chunks"))


@R.add("excluded_counts", "select split, count(*) filter (where bucket is null) no_bucket, count(*) filter (where bucket in ('no_evidence', 'out_of_scope')) unanswerable, count(*) filter (where bucket not in ('no_evidence', 'out_of_scope') and len(gold_evidence_ids) > 0) kept from queries group by 1")
def excluded_counts(spark, d):
    none = F.col("bucket").isin("no_evidence", "out_of_scope")
    return table(spark, d, "queries").groupBy("split").agg(F.count_if(F.col("bucket").isNull()).alias("no_bucket"), F.count_if(none).alias("unanswerable"), F.count_if(~none & (F.size("gold_evidence_ids") > 0)).alias("kept"))


@R.add("rewrite_summary", "select split, count(*) n, sum((trim(question) = question)::int)::bigint identical, sum((length(question) > 60)::int)::bigint long from queries group by 1")
def rewrite_summary(spark, d):
    q = table(spark, d, "queries").withColumn("r", F.trim("question"))
    return q.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("r") == F.col("question")).alias("identical"), F.count_if(F.length("question") > 60).alias("long"))


@R.add("scope_keys", "select scope || ':' || k as key, count(*) n from (select 'case' scope, idempotency_key k from cases union all select 'owner', owner_id from cases) where k is not null group by 1")
def scope_keys(spark, d):
    c = table(spark, d, "cases").select(F.explode(F.array(F.struct(F.lit("case").alias("s"), F.col("idempotency_key").alias("k")), F.struct(F.lit("owner").alias("s"), F.col("owner_id").alias("k")))).alias("x")).where("x.k is not null")
    return c.groupBy(F.concat_ws(":", "x.s", "x.k").alias("key")).agg(F.count("*").alias("n"))


@R.add("structural_review", f"with {TRIALS} select split, sum((len(retrieved) > 0 and len(list_filter(retrieved, lambda x: not list_contains(gold, x))) = 0)::int)::bigint passed, count(*) n from tr group by 1")
def structural_review(spark, d):
    t = trials(spark, d)
    return t.groupBy("split").agg(F.count_if((F.size("retrieved") > 0) & (F.size(F.array_except("retrieved", "gold")) == 0)).alias("passed"), F.count("*").alias("n"))


@R.add("label_sets", f"with {POOL} select query_id, array_to_string(list_sort(list(distinct doc)), ',') docs from po where length(sentence) % 3 = 2 group by 1")
def label_sets(spark, d):
    """Relevant documents of each query from graded labels."""
    p = _pool(spark, d).where(F.length("sentence") % 3 == 2)
    return p.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("doc")), ",").alias("docs"))
