"""Queries on records of the log and the corpus, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import events as E
from quillspark.operators import records as P
from quillspark.operators import text as X
from quillspark.plans.corpus import squash_sql
from quillspark.plans.log import FIRST, KEY
from quillspark.registry import Registry, table

R = Registry()
CLOSED = ["CLOSED_SUCCESS", "CLOSED_FAILED", "CLOSED_ESCALATED", "CLOSED_CANCELLED"]
REL = "rl as (select from_status, trigger_subject, to_status from (select from_status, trigger_subject, to_status, count(*) n from case_event_log where to_status is not null group by 1, 2, 3) where n >= 5)"


def _events(spark, d):
    return E.first_delivery(table(spark, d, "case_event_log"), KEY)


def _relation(spark, d):
    """The transitions seen at least five times stand in for the allowed ones."""
    e = table(spark, d, "case_event_log").where("to_status is not null")
    return e.groupBy("from_status", "trigger_subject", "to_status").count().where("count >= 5").drop("count")


@R.add("transition_verdicts", f"with {FIRST}, {REL}, h as (select *, lag(to_status) over (partition by case_id order by id) held from e where to_status is not null) select h.id, case when h.from_status = h.to_status then 'repeat' when h.from_status in ({', '.join(repr(c) for c in CLOSED)}) then 'terminal' when rl.to_status is null then 'unknown' when h.from_status is distinct from held then 'illegal' else 'ok' end verdict from h left join rl on rl.from_status is not distinct from h.from_status and rl.trigger_subject is not distinct from h.trigger_subject and rl.to_status = h.to_status")
def transition_verdicts(spark, d):
    return P.checked_transitions(_events(spark, d), _relation(spark, d), CLOSED).select("id", "verdict")


@R.add("reachable_states", f"with recursive {REL}, one as (select distinct from_status, to_status from rl where from_status is not null), w(f, t, n) as (select from_status, to_status, 1 from one union select w.f, o.to_status, w.n + 1 from w join one o on o.from_status = w.t where w.n < 16) select f from_status, t to_status, min(n) steps from w group by 1, 2")
def reachable_states(spark, d):
    return P.reachable(_relation(spark, d))


@R.add("lease_states", "select id, coalesce(until < timestamp '2026-01-01 01:00:00', false) expired, coalesce(until <= timestamp '2026-01-01 01:00:00', false) reclaimable from (select id, case when event_type like 'lease%' then date_trunc('hour', created_at) end until from case_event_log)")
def lease_states(spark, d):
    t = table(spark, d, "case_event_log").select("id", F.when(F.col("event_type").startswith("lease"), F.date_trunc("hour", F.col("created_at").cast("timestamp"))).alias("until"))
    return P.leases(t, "until", F.lit("2026-01-01 01:00:00").cast("timestamp")).select("id", "expired", "reclaimable")


@R.add("desynchronised_tasks", "with t as (select case_id, max(id) task_id, count(*) > 5 valid from case_event_log group by 1), c as (select case_id, arg_max(id, created_at) active from case_event_log where to_status is not null group by 1) select t.case_id, t.task_id from t where valid and not exists (select 1 from c where c.case_id = t.case_id and c.active = t.task_id)")
def desynchronised_tasks(spark, d):
    e = table(spark, d, "case_event_log")
    t = e.groupBy("case_id").agg(F.max("id").alias("task_id"), (F.count("*") > 5).alias("valid"))
    c = e.where("to_status is not null").groupBy("case_id").agg(F.max_by("id", "created_at").alias("active_task_id"))
    return P.desynchronised(t, c).select("case_id", "task_id")


@R.add("case_observations", "select case_id, sum(cast(detail->>'latency_ms' as bigint))::bigint latency_ms, count(*) filter (where event_type = 'provider_call') calls, sum(cast(detail->>'total_tokens' as bigint))::bigint tokens from case_event_log group by 1")
def case_observations(spark, d):
    return P.observed(table(spark, d, "case_event_log"), "case_id")


ENRICH = "with ev as (select id, case_id, to_status stage, coalesce(cast(detail->>'attempt' as int), 0) attempt, cast(detail->>'latency_ms' as bigint) latency_ms, created_at, case when event_type = 'error' then 'E1' end code from case_event_log), ar as (select case_id, stage, attempt, arg_max(latency_ms, id) artifact from (select * from ev where latency_ms is not null and stage is not null) group by 1, 2, 3) select id, artifact, epoch_us(created_at) - latency_ms * 1000 started_us, case when code = 'E1' then 'failed' end message from ev left join ar using (case_id, stage, attempt)"


@R.add("enriched_events", ENRICH)
def enriched_events(spark, d):
    e = table(spark, d, "case_event_log")
    j = F.from_json("detail", "attempt int, latency_ms bigint")
    ev = e.select("id", "case_id", F.col("to_status").alias("stage"), F.coalesce(j["attempt"], F.lit(0)).alias("attempt"), j["latency_ms"].alias("latency_ms"), "created_at", F.when(F.col("event_type") == "error", "E1").alias("code"))
    art = ev.where("latency_ms is not null and stage is not null").select("case_id", "stage", "attempt", F.col("id").alias("artifact_id"), F.col("latency_ms").alias("value"))
    out = P.enriched(ev, art, spark.createDataFrame([("E1", "failed")], "code string, message string"))
    return out.select("id", "artifact", F.unix_micros("started_at").alias("started_us"), "message")


@R.add("provider_attempts", "select case_id, count(*) attempts, count(*) - 1 retries, case when arg_max(event_type, id) = 'state_transition' then 'succeeded' else 'failed:' || arg_max(event_type, id) end outcome from case_event_log group by 1")
def provider_attempts(spark, d):
    e = table(spark, d, "case_event_log").withColumn("s", F.when(F.col("event_type") == "state_transition", "ok").otherwise(F.col("event_type")))
    return P.attempts_of(e, "case_id", "id", "s")


@R.add("report_versions", "select id, row_number() over (partition by owner_id order by id) as version from cases where owner_id is not null")
def report_versions(spark, d):
    return P.versions(table(spark, d, "cases").where("owner_id is not null").select("id", "owner_id"), "owner_id", "id").select("id", "version")


@R.add("invariant_audit", f"with {FIRST}, n as (select case_id, count(*) n from e where regexp_matches(to_status, '^CLOSED') group by 1), c as (select case_id, status like 'CLOSED%' closed, coalesce(n, 0) n from cases left join n using (case_id)) select case_id, case when closed then 'closing_events' else 'closed_again' end issue from c where (closed and n <> 1) or (not closed and n > 0) union all select case_id, 'repeated:' || to_status from e where to_status is not null group by case_id, to_status having count(*) > 1")
def invariant_audit(spark, d):
    return P.audited(table(spark, d, "cases"), _events(spark, d), "^CLOSED")


@R.add("citation_facts", "select sample_id as key, i - 1 claim_id, question claim, g chunk_id, case when length(g) % 2 = 0 then 'entailed' else 'partial' end verdict, 'judge@r1' verified_by from (select sample_id, question, unnest(gold_evidence_ids) g, generate_subscripts(gold_evidence_ids, 1) i from queries) where i <= 2")
def citation_facts(spark, d):
    q = table(spark, d, "queries")
    v = q.select(F.col("sample_id").alias("key"), F.transform("gold_evidence_ids", lambda g, i: F.struct(i.cast("bigint").alias("claim_id"), g.alias("chunk_id"), F.when(F.length(g) % 2 == 0, "entailed").otherwise("partial").alias("verdict"))).alias("verdicts"))
    c = q.select(F.col("sample_id").alias("key"), F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("claim_id"), F.col("question").alias("claim"))
    return P.citation_rows(v, c, "judge", "r1")


@R.add("url_map", "with o as (select distinct document_id doc, source_url url from sources where source_url is not null), b as (select doc, regexp_replace(regexp_replace(lower(trim(url)), '^https?://(www\\.)?', ''), '[?#].*$|/+$', '', 'g') u from o), n as (select u, min(doc) || '-v4' new_doc from b where length(doc) % 2 = 0 group by 1) select distinct b.doc old_doc, new_doc from b join n using (u)")
def url_map(spark, d):
    o = table(spark, d, "sources").where("source_url is not null").select(F.col("document_id").alias("doc"), F.col("source_url").alias("url")).distinct()
    new = o.where(F.length("doc") % 2 == 0).select(F.concat("doc", F.lit("-v4")).alias("doc"), F.concat(F.lit(" HTTP://www."), F.regexp_replace("url", "^https?://", ""), F.lit("?x=1")).alias("url"))
    return P.url_map(o, new, spark.createDataFrame([("none.example", "other.example")], "url string, target string"))


@R.add("corpus_extension", "with p as (select document_id slug, source_url url, coalesce(max(title), '') title, max(len(chunk_ids)) n from sources group by 1, 2), k as (select distinct url from p where length(slug) % 3 = 0 and url is not null), c as (select distinct slug, sha256(slug) h from p where n >= 2 and not regexp_matches(title, '简报') and (url is null or url not in (select url from k)) order by h, slug limit 50) select slug, row_number() over (order by h, slug) as rank from c")
def corpus_extension(spark, d):
    p = table(spark, d, "sources").groupBy(F.col("document_id").alias("slug"), F.col("source_url").alias("url")).agg(F.coalesce(F.max("title"), F.lit("")).alias("title"), F.max(F.size("chunk_ids")).alias("excerpts"))
    return P.extension(p, p.where(F.length("slug") % 3 == 0), "简报", 2, 50)


@R.add("gold_twins", f"with g as (select distinct sample_id query_id, unnest(gold_evidence_ids) id from queries), c as (select chunk_id id, {squash_sql('text')} s from chunks where text is not null) select query_id, id from g union select g.query_id, b.id from g join c a using (id) join c b on a.s = b.s union select sample_id, 'extra' from queries where bucket is null")
def gold_twins(spark, d):
    q = table(spark, d, "queries")
    g = q.select(F.col("sample_id").alias("query_id"), F.explode("gold_evidence_ids").alias("id")).distinct()
    extra = q.where("bucket is null").select(F.col("sample_id").alias("query_id"), F.lit("extra").alias("id"))
    return P.with_twins(g, table(spark, d, "chunks").select(F.col("chunk_id").alias("id"), "text"), extra)


@R.add("anchor_pool", "select chunk_id id, sha1(chunk_id) place from chunks where chunk_id not in (select unnest(gold_evidence_ids) from queries)")
def anchor_pool(spark, d):
    g = table(spark, d, "queries").select(F.explode("gold_evidence_ids").alias("id"))
    return P.never_gold(table(spark, d, "chunks").select(F.col("chunk_id").alias("id")), g)


@R.add("check_sheet", "with t as (select sample_id query_id, expected_filters['topic'] term from queries_authored where expected_filters['topic'] is not null and bucket = 'multi_part'), h as (select sample_id query_id, unnest(gold_evidence_ids) id from queries), u as (select distinct query_id, id, 'hit' m from h union select query_id, chunk_id, 'term' from t join chunks on contains(text, term) where length(term) >= 2) select query_id, id, string_agg(m, ',' order by m) found_by from u group by 1, 2")
def check_sheet(spark, d):
    term = F.try_element_at("expected_filters", F.lit("topic"))
    t = table(spark, d, "queries_authored").where("bucket = 'multi_part'").select(F.col("sample_id").alias("query_id"), term.alias("term")).where("term is not null")
    h = table(spark, d, "queries").select(F.col("sample_id").alias("query_id"), F.explode("gold_evidence_ids").alias("id"))
    return P.check_sheet(h, t, table(spark, d, "chunks").select(F.col("chunk_id").alias("id"), "text"))


@R.add("unified_queries", "select sample_id, origin, coalesce(intent, case bucket when 'emergency' then 'emergency' when 'out_of_scope' then 'out_of_scope' end, 'popular_science') intent from (select sample_id, 'v3' origin, null::varchar intent, bucket from queries union all select sample_id, 'authored', intent, bucket from queries_authored)")
def unified_queries(spark, d):
    q = table(spark, d, "queries").select("sample_id", "bucket")
    a = table(spark, d, "queries_authored").select("sample_id", "bucket", "intent")
    return P.unified([("authored", a), ("v3", q)], {"emergency": "emergency", "out_of_scope": "out_of_scope"}, "popular_science").select("sample_id", "origin", "intent")


EXCERPTS = f"with c as (select source_id doc, chunk_id id, row_number() over (partition by source_id order by chunk_id) seq, {squash_sql('text')} c from chunks where text is not null), e as (select id excerpt_id, doc, case seq % 3 when 0 then c[1:40] when 1 then right(c, 12) || coalesce(left(lead(c) over (partition by doc order by seq), 12), '') else c || '#' end e from c)"


@R.add("mapped_excerpts", EXCERPTS + ", x as (select excerpt_id, min(c.id) id from (select excerpt_id, doc, e, arg_min(id, (length(c), seq)) id from e join c using (doc) where e <> '' and contains(c, e) group by 1, 2, 3) m join c using (id) group by 1), w as (select doc, string_agg(c, '' order by seq) a from c group by 1), p as (select *, sum(length(c)) over (partition by doc order by seq) fin from c), s as (select excerpt_id, string_agg(p.id, ',' order by p.seq) ids from (select excerpt_id, doc, instr(a, e) pos, length(e) n from e join w using (doc) where excerpt_id not in (select excerpt_id from x) and e <> '' and instr(a, e) > 0) q join p using (doc) where fin - length(c) + 1 < pos + n and fin >= pos group by 1) select e.excerpt_id, case when x.id is not null then 'exact' when s.ids is not null then 'span' else 'failed' end how, coalesce(x.id, s.ids, '') ids from e left join x using (excerpt_id) left join s using (excerpt_id)")
def mapped_excerpts(spark, d):
    w = X.Window.partitionBy("doc").orderBy("id")
    c = table(spark, d, "chunks").where("text is not null").select(F.col("source_id").alias("doc"), F.col("chunk_id").alias("id"), T.squash(F.col("text")).alias("text"))
    c = c.withColumn("seq", F.row_number().over(w))
    nxt = F.coalesce(F.left(F.lead("text").over(w), F.lit(12)), F.lit(""))
    e = c.withColumn("nxt", nxt).select(F.col("id").alias("excerpt_id"), "doc", F.when(F.col("seq") % 3 == 0, F.left("text", F.lit(40))).when(F.col("seq") % 3 == 1, F.concat(F.right("text", F.lit(12)), "nxt")).otherwise(F.concat("text", F.lit("#"))).alias("text"))
    return P.mapped_excerpts(e, c).select("excerpt_id", "how", F.array_join("ids", ",").alias("ids"))


@R.add("dotted_paths", "select id, detail->>'$.attempt' attempt, detail->>'$.a.b' none from case_event_log")
def dotted_paths(spark, d):
    return table(spark, d, "case_event_log").select("id", P.at_path(F.col("detail"), "attempt").alias("attempt"), P.at_path(F.col("detail"), "a.b").alias("none"))


@R.add("flattened_documents", "select document_id, part, count(*) n, sum(length(t))::bigint chars from (select document_id, 'title' part, title t from sources union all select document_id, 'item', unnest(chunk_ids) from sources union all select document_id, 'row', coalesce(section, '') || '｜' || coalesce(usage, '') from sources) where coalesce(t, '') <> '' group by 1, 2")
def flattened_documents(spark, d):
    s = table(spark, d, "sources").withColumn("rows", F.array(F.array(F.coalesce("section", F.lit("")), F.coalesce("usage", F.lit("")))))
    return P.flattened(s, "document_id", "title", "chunk_ids", "rows").groupBy("document_id", "part").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@R.add("leaked_ids", "select distinct s.document_id id, 'note' field, s.document_id sample_id from sources s where length(document_id) % 2 = 0")
def leaked_ids(spark, d):
    s = table(spark, d, "sources").select(F.col("document_id").alias("id"), F.lit("note").alias("field"), F.concat(F.lit("see ("), "document_id", F.lit("), p. 3")).alias("value"))
    return P.leaked_ids(s, s.where(F.length("id") % 2 == 0).select(F.col("id").alias("sample_id")))


@R.add("leaked_answers", "with a as (select distinct lower(e.value) answer from (select unnest(map_entries(expected_filters)) e from queries_authored) where e.key = 'topic') select distinct chunk_id id, answer sample_id from chunks join a on contains(text, answer) where length(answer) > 2")
def leaked_answers(spark, d):
    a = table(spark, d, "queries_authored").select(F.explode("expected_filters").alias("k", "v")).where("k = 'topic'").select(F.lower("v").alias("answer")).distinct()
    return P.leaked_answers(table(spark, d, "chunks").select(F.col("chunk_id").alias("id"), F.col("text").alias("value")), a.withColumn("sample_id", F.col("answer")), 2)


@R.add("paragraph_duplicates")
def paragraph_duplicates(spark, d):
    # the columns stay beside the lines: no text is shuffled for them
    c = table(spark, d, "chunks").where("chunk_id is not null and source_id is not null and text is not null")
    rank = F.when(F.col("evidence_level").startswith("level_1"), 1).otherwise(9).alias("rank")
    ln = c.select("chunk_id", F.col("source_id").alias("doc"), rank, F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return P.paragraph_duplicates(ln.select("doc", F.concat_ws("#", "chunk_id", "line_no").alias("para"), F.col("line").alias("text"), "rank"))


@R.add("dataset_integrity", "select 'duplicate_id' issue, sample_id as key from queries group by 2 having count(*) > 1 union all select 'bucket_without_gold', sample_id from queries where bucket not in ('no_evidence', 'out_of_scope') and len(gold_evidence_ids) = 0 union all select 'gold_without_evidence_bucket', sample_id from queries where bucket in ('no_evidence', 'out_of_scope') and len(gold_evidence_ids) > 0 union all select 'no_bucket', sample_id from queries where bucket is null union all select distinct 'dangling_gold', sample_id from (select sample_id, unnest(gold_evidence_ids) id from queries) where id not in (select chunk_id from chunks)")
def dataset_integrity(spark, d):
    q = table(spark, d, "queries")
    empty, none = F.size("gold_evidence_ids") == 0, F.col("bucket").isin("no_evidence", "out_of_scope")
    def mark(df, issue):
        return df.select(F.lit(issue).alias("issue"), F.col("sample_id").alias("key"))

    gold = q.select("sample_id", F.explode("gold_evidence_ids").alias("chunk_id"))
    parts = [mark(q.groupBy("sample_id").count().where("count > 1"), "duplicate_id"), mark(q.where(~none & empty), "bucket_without_gold"), mark(q.where(none & ~empty), "gold_without_evidence_bucket"), mark(q.where("bucket is null"), "no_bucket"), mark(gold.join(table(spark, d, "chunks").select("chunk_id"), "chunk_id", "left_anti"), "dangling_gold").distinct()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
