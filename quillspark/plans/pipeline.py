"""Queries on the retrieval pipeline, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import cleaning as L
from quillspark.operators import metrics as M
from quillspark.operators import pipeline as P
from quillspark.operators import rank as K
from quillspark.operators import store as S
from quillspark.plans import corpus as CP
from quillspark.plans.cleaning import _bare_sql
from quillspark.plans.retrieval import DENSE, TOP, vector_asks, vectors
from quillspark.registry import Registry, table

R = Registry()
NEAR = f"s as ({DENSE}), n20 as (select query_id, id, score, rank from {TOP.format(t='s', k=20)})"
PAIR = "(q.query_id * 7 + q.id * 13) % 101 / 101.0"


def _near(spark, d, k=20):
    return K.dense(vectors(spark, d), vector_asks(spark, d), k)


def _pair_scores(pairs):
    """A stand-in for a cross encoder: a score a pair that depends on both ids."""
    return pairs.select("query_id", "id", ((F.col("query_id") * 7 + F.col("id") * 13) % 101 / 101.0).alias("score"))


@R.add("merged_lists", f"with {NEAR}, b as (select query_id, id, row_number() over (partition by query_id order by {PAIR} desc, id) r from n20 q), u as (select query_id, id, 0 src, rank r from n20 where rank <= 10 union all select query_id, id, 1, r from b where r <= 10), f as (select query_id, id, sum(1.0::double / (60 + r)) score, min(src * 1000 + r) f from u group by 1, 2) select query_id, id, rank, round(score, 7) score from (select *, row_number() over (partition by query_id order by round(score, 12) desc, f) rank from f) where rank <= 3")
def merged_lists(spark, d):
    a = _near(spark, d)
    b = K.top(_pair_scores(a), 10)
    return P.merged([a.where("rank <= 10"), b]).select("query_id", "id", "rank", F.round("score", 7).alias("score"))


@R.add("reranked", f"with {NEAR} select query_id, id, rank, round(score, 6) score from (select query_id, id, {PAIR} score, row_number() over (partition by query_id order by round({PAIR}, 9) desc, id) rank from n20 q) where rank <= 5")
def reranked(spark, d):
    a = _near(spark, d)
    twice = a.unionByName(a.withColumn("rank", F.col("rank") + 20))
    return P.rerank(twice, P.memoised(a.select("query_id", "id"), _pair_scores), 5).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@R.add("fixed_pipeline", f"with {NEAR} select query_id, id, rank from (select query_id, id, row_number() over (partition by query_id order by round({PAIR}, 9) desc, id) rank from n20 q) where rank <= 5")
def fixed_pipeline(spark, d):
    a = _near(spark, d)
    return P.pipeline(a, _pair_scores(P.once(a)), None, 5)


@R.add("diversified_pipeline")
def diversified_pipeline(spark, d):
    a = _near(spark, d)
    return P.pipeline(a, _pair_scores(P.once(a)), vectors(spark, d).select("id", "vector"), 5)


@R.add("hyde_search", f"with s as (select q.vec_id query_id, v.vec_id id, list_dot_product(h.embedding::double[], v.embedding::double[]) / (sqrt(list_dot_product(h.embedding::double[], h.embedding::double[])) * sqrt(list_dot_product(v.embedding::double[], v.embedding::double[]))) score, list_dot_product(q.embedding::double[], v.embedding::double[]) own from embeddings q join embeddings h on h.vec_id = q.vec_id + 1, embeddings v where q.vec_id % 100 = 0), n as (select query_id, id, own from {TOP.format(t='s', k=20)}) select query_id, id, rank from (select *, row_number() over (partition by query_id order by round(own, 9) desc, id) rank from n) where rank <= 5")
def hyde_search(spark, d):
    """A search by a hypothetical text's vector (the next row's), reranked against the question's own."""
    v = vectors(spark, d)
    hyp = v.withColumn("query_id", F.col("id") - 1).where("query_id % 100 = 0").select("query_id", "vector")
    hits = K.dense(v, hyp, 20)
    own = vector_asks(spark, d).withColumnRenamed("vector", "q")
    dot = F.aggregate(F.zip_with("q", "vector", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    scores = hits.select("query_id", "id").join(own, "query_id").join(v.select("id", "vector"), "id").select("query_id", "id", dot.alias("score"))
    return P.rerank(hits, scores, 5).select("query_id", "id", "rank")


@R.add("linear_with_vectors", f"with {NEAR}, c as (select query_id, id, score from n20), b as (select query_id, id, {PAIR} score from n20 q where id % 3 > 0) select query_id, id, rank, round(score, 6) score from (select query_id, id, score, row_number() over (partition by query_id order by round(score, 9) desc, id) rank from (select query_id, id, 0.2 * coalesce(b.score, 0) + 0.8 * coalesce(c.score, 0) score from c full join b using (query_id, id))) where rank <= 10")
def linear_with_vectors(spark, d):
    """A linear mix with a dense leg."""
    a = _near(spark, d)
    return K.top(K.linear(_pair_scores(a).where("id % 3 > 0"), a.select("query_id", "id", "score"), 0.2), 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


FIL = "f as (select sample_id query_id, e.key k, e.value v from (select sample_id, unnest(list_concat(list_filter(map_entries(expected_filters), lambda e: e.key not in ('section_type', 'colour', 'period')), map_entries(map {'section_type': coalesce(intent, ' '), 'colour': 'x', 'period': case when bucket is null then 'latest' else '1999' end}))) e from queries_authored))"


def _filters(spark, d):
    m = F.map_concat(F.map_filter("expected_filters", lambda k, v: ~k.isin("section_type", "colour", "period")), F.create_map(F.lit("section_type"), F.coalesce("intent", F.lit(" ")), F.lit("colour"), F.lit("x"), F.lit("period"), F.when(F.col("bucket").isNull(), "latest").otherwise("1999")))
    return table(spark, d, "queries_authored").select(F.col("sample_id").alias("query_id"), F.explode(m).alias("key", "value"))


def _names(spark, d):
    """(doc, name) of document titles."""
    t = table(spark, d, "sources").where("title is not null").select(F.col("document_id").alias("doc"), F.explode(L.title_names(F.col("title"))).alias("name"))
    return t.distinct()


TITLES = f"nm as (select distinct document_id doc, unnest(list_filter([{_bare_sql('title')}], lambda x: length(x) >= 2)) \"name\" from sources where title is not null and not regexp_matches(title, '[（(]'))"


@R.add("filter_validation", f"with {FIL}, {TITLES}, ok as (select distinct v from f join nm on contains(nm.name, lower(v)) where k = 'topic'), p as (select max(left(accessed_at, 7)) last from sources), pp as (select distinct left(accessed_at, 7) v from sources where accessed_at is not null) select query_id, k as key, case when r is null and k = 'period' and v = 'latest' then last else v end as value, r reason from (select *, case when k not in ('topic', 'section_type', 'source_type', 'period') then 'unknown_key' when trim(v) = '' then 'invalid_value' when k = 'section_type' and trim(v) not in ('popular_science', 'emergency') then 'not_in_enum' when k = 'period' and v <> 'latest' and v not in (select v from pp) then 'not_in_corpus' when k = 'topic' and lower(v) not in (select lower(v) from ok) then 'unknown_topic' end r from f, p)")
def filter_validation(spark, d):
    names = _names(spark, d)
    f = _filters(spark, d)
    topics = f.where("key = 'topic'").select(F.lower("value").alias("value"), F.col("value").alias("v"))
    hit = P.contained(topics, names, "value", "name").select(F.col("needle").alias("value")).distinct()
    known = topics.join(hit, "value").select(F.col("v").alias("value")).distinct()
    periods = table(spark, d, "sources").where("accessed_at is not null").select(F.left("accessed_at", F.lit(7)).alias("period"))
    return P.validated(f, {"section_type": ["popular_science", "emergency"]}, periods, known)


ALIAS = [("糖尿病", "血糖"), ("流感", "感冒")]


@R.add("topic_resolution", f"with {TITLES}, v as (select distinct {_bare_sql('e.value')} v from (select unnest(map_entries(expected_filters)) e from queries_authored) where e.key = 'topic'), k as (select v, v kw from v union select v, '血糖' from v where contains(v, '糖尿病') union select v, '感冒' from v where contains(v, '流感')) select distinct v as value, doc from k join nm on contains(nm.name, kw) or (length(nm.name) >= 3 and contains(kw, nm.name)) where length(v) >= 2")
def topic_resolution(spark, d):
    v = table(spark, d, "queries_authored").select(F.explode("expected_filters").alias("k", "v")).where("k = 'topic'").select(L.bare_name(F.col("v")).alias("value")).distinct()
    names = table(spark, d, "sources").where("title is not null").select(F.col("document_id").alias("doc"), F.explode(L.title_names(F.col("title"))).alias("name"))
    return P.resolved_topics(v, names, spark.createDataFrame(ALIAS, "alias string, target string"))


INDEX = "ix as (select chunk_id id, metadata.section section_type, metadata.content_kind source_type, left(metadata.accessed_at, 4) period from chunks), fl as (select sample_id query_id, case when bucket = 'direct' then '预防' end section_type, case when split = 'dev' then 'pdf_text' end source_type, case when source is null then '2025' end period from queries where split in ('dev', 'check'))"


def _index(spark, d):
    return table(spark, d, "chunks").select(F.col("chunk_id").alias("id"), F.col("metadata.section").alias("section_type"), F.col("metadata.content_kind").alias("source_type"), F.left("metadata.accessed_at", F.lit(4)).alias("period"))


def _wanted(spark, d):
    q = table(spark, d, "queries").where("split in ('dev', 'check')")
    return q.select(F.col("sample_id").alias("query_id"), F.when(F.col("bucket") == "direct", "预防").alias("section_type"), F.when(F.col("split") == "dev", "pdf_text").alias("source_type"), F.when(F.col("source").isNull(), "2025").alias("period"))


@R.add("allowed_ids", f"with {INDEX} select query_id, count(*) n, min(id) first_id from fl join ix on (fl.section_type is null or fl.section_type = ix.section_type) and (fl.source_type is null or fl.source_type = ix.source_type) and (fl.period is null or fl.period = ix.period) where coalesce(fl.section_type, fl.source_type, fl.period) is not null group by 1")
def allowed_ids(spark, d):
    return P.allowed(_index(spark, d), _wanted(spark, d)).groupBy("query_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@R.add("relaxation_record", f"with {INDEX}, lv as (select *, 0 lvl from fl union all select query_id, null, source_type, period, 1 from fl union all select query_id, null, null, period, 2 from fl union all select query_id, null, null, null, 3 from fl), n as (select query_id, lvl, (select count(*) from ix where (l.section_type is null or l.section_type = ix.section_type) and (l.source_type is null or l.source_type = ix.source_type) and (l.period is null or l.period = ix.period)) n from lv l), s as (select *, coalesce(min(case when n >= 300 then lvl end) over (partition by query_id), max(lvl) over (partition by query_id)) stop from n) select query_id, lvl as level, n results, lvl = stop chosen from s where lvl <= stop")
def relaxation_record(spark, d):
    """Attempts with fewer and fewer conditions until 300 rows are met. Combinations of conditions are counted once, whatever the number of queries."""
    f, ix = _wanted(spark, d), _index(spark, d)
    keys = ["section_type", "source_type", "period"]
    levels = None
    for n in range(4):
        one = f.select("query_id", F.lit(n).alias("level"), *[F.when(F.lit(n <= i), F.col(k)).alias(k) for i, k in enumerate(keys)])
        levels = one if levels is None else levels.unionByName(one)
    every = ix.count()
    kinds = levels.select(*keys).distinct().withColumn("query_id", F.xxhash64(*[F.coalesce(k, F.lit("\u0000")) for k in keys]))
    sizes = P.allowed(ix, kinds).groupBy("query_id").agg(F.count("*").alias("n")).withColumnRenamed("query_id", "h")
    free = F.lit(True)
    for k in keys:
        free = free & F.col(k).isNull()
    n = levels.withColumn("h", F.xxhash64(*[F.coalesce(k, F.lit("\u0000")) for k in keys])).join(sizes, "h", "left").withColumn("n", F.when(free, F.lit(every)).otherwise(F.coalesce("n", F.lit(0))))
    return P.relaxation(n.select("query_id", "level", "n"), 300)


@R.add("history_queries", "select owner_id, id, question latest, array_to_string(list(question) over (partition by owner_id order by id rows 3 preceding), ' ') joined from cases where owner_id is not null")
def history_queries(spark, d):
    return P.history_query(table(spark, d, "cases").where("owner_id is not null"), "owner_id", "id", "question")


@R.add("rewrite_acceptance", "select sample_id, coalesce(trim(r) <> '' and length(r) <= 120 and not contains(r, chr(10)) and len(list_filter(regexp_extract_all(r, '\\d+(?:\\.\\d+)?'), lambda x: not contains(question, x))) = 0, false) accepted from (select sample_id, question, case when len(gold_evidence_ids) > 1 then question || ' 99123' else trim(question) end r from queries)")
def rewrite_acceptance(spark, d):
    q = table(spark, d, "queries").select("sample_id", "question", F.when(F.size("gold_evidence_ids") > 1, F.concat("question", F.lit(" 99123"))).otherwise(F.trim("question")).alias("r"))
    return q.select("sample_id", P.accepted_rewrite(F.col("r"), F.col("question")).alias("accepted"))


@R.add("evidence_selection", "select sample_id, array_to_string(case when bucket is null then [] else list_filter(case when split = 'train' then g[1:1] else g end, lambda x: not contains(x, ':r:')) end, ',') kept, array_to_string(list_sort(list_distinct(list_concat(list_filter(g, lambda x: not contains(x, ':r:')), g[1:1]))), ',') fall from (select sample_id, split, bucket, list_sort(list_distinct(gold_evidence_ids)) g from queries)")
def evidence_selection(spark, d):
    q = table(spark, d, "queries").select("sample_id", "split", "bucket", F.array_sort(F.array_distinct("gold_evidence_ids")).alias("g"))
    wrong = F.filter("g", lambda x: F.contains(x, F.lit(":r:")))
    chosen = F.when(F.col("split") == "train", F.slice("g", 1, 1))
    return q.select("sample_id", F.array_join(P.selection(F.col("g"), wrong, chosen, F.col("bucket").isNotNull()), ",").alias("kept"), F.array_join(F.array_sort(P.fallback(F.col("g"), wrong, F.slice("g", 1, 1))), ",").alias("fall"))


@R.add("frozen_evidence", "with e as (select sample_id query_id, question query, i, g id from (select sample_id, question, unnest(gold_evidence_ids) g, generate_subscripts(gold_evidence_ids, 1) i from queries)), t as (select query_id, query, list({'chunk_hash': sha256(text), 'chunk_id': id} order by i) evidence from e join chunks on chunk_id = id where text is not null group by 1, 2) select query_id, 'eb_' || left(sha256(to_json({'corpus_hash': 'c0', 'evidence': evidence, 'query': query, 'retrieval_config_hash': 'r0'})::varchar), 24) bundle_id, len(evidence)::int n from t")
def frozen_evidence(spark, d):
    q = table(spark, d, "queries")
    e = q.select(F.col("sample_id").alias("query_id"), F.posexplode("gold_evidence_ids").alias("rank", "id"))
    e = e.join(table(spark, d, "chunks").where("text is not null").select(F.col("chunk_id").alias("id"), "text"), "id")
    return P.frozen(e, q.select(F.col("sample_id").alias("query_id"), F.col("question").alias("query")), "c0", "r0")


@R.add("document_fingerprints", "select source_id, left(sha256(to_json(list([chunk_id, coalesce(text, '')] order by chunk_id))::varchar), 16) fingerprint from chunks group by 1")
def document_fingerprints(spark, d):
    return P.fingerprint(table(spark, d, "chunks"), "source_id", "chunk_id", "text")


STORE = CP.R.sql["scd2_upsert"]


@R.add("store_lookups", f"select status, count(distinct doc) docs, count(*) \"rows\" from ({STORE}) group by 1")
def store_lookups(spark, d):
    return P.lookups(CP.scd2_upsert(spark, d))


@R.add("store_by_hash", f"with st as ({STORE}) select doc, version, status from st where content_hash in (select content_hash from st where status = 'retired')")
def store_by_hash(spark, d):
    st = CP.scd2_upsert(spark, d)
    return P.by_hash(st, st.where("status = 'retired'")).select("doc", "version", "status")


@R.add("store_covers", f"with st as ({STORE}) select distinct source_id id from chunks where source_id not in (select doc from st where version = 2)")
def store_covers(spark, d):
    st = CP.scd2_upsert(spark, d)
    return S.uncovered(st.where("version = 2").select(F.col("doc").alias("id")), table(spark, d, "chunks").select(F.col("source_id").alias("id")))


@R.add("active_knn", f"with s as ({DENSE} and v.vec_id % 5 <> 0 and v.label in (1, 3)) select query_id, id, rank, round(score, 5) score from {TOP.format(t='s', k=5)}")
def active_knn(spark, d):
    """Exact neighbours among active rows with a label in a set."""
    v = vectors(spark, d).withColumn("status", F.when(F.col("id") % 5 == 0, "retired").otherwise("active"))
    return K.dense(v.where("status = 'active' and label in (1, 3)"), vector_asks(spark, d), 5).select("query_id", "id", "rank", F.round("score", 5).alias("score"))


CACHED = "list_reduce(x, lambda a, t: case when a.f is not null and t - a.f < 3600000000 then {'f': a.f, 'o': list_append(a.o, {'t': t, 'h': true})} else {'f': t, 'o': list_append(a.o, {'t': t, 'h': false})} end, {'f': null::bigint, 'o': []::struct(t bigint, h boolean)[]})"


@R.add("cache_log", f"with g as (select user_id, list(epoch_us(ts) order by ts) x from events group by 1) select user_id, r.t at_us, r.h hit from (select user_id, unnest(({CACHED}).o) r from g)")
def cache_log(spark, d):
    return P.cache_log(table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", 3600)


@R.add("parent_expansion", "with h as (select sample_id, unnest(gold_evidence_ids) id from queries), p as (select source_id pid, string_agg(text, '' order by chunk_id) pt from chunks where text is not null group by 1 having count(*) > 1), x as (select sample_id, h.id, coalesce(pt, text) context from h join chunks c on c.chunk_id = h.id left join p on p.pid = c.source_id where text is not null) select sample_id, count(*) hits, sum(length(context)) filter (where n = 1)::bigint chars from (select *, row_number() over (partition by sample_id, context order by id) n from x) group by 1")
def parent_expansion(spark, d):
    """Hits with their document as parent; the context is the length of the distinct parents."""
    c = table(spark, d, "chunks").where("text is not null")
    parents = c.groupBy(F.col("source_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))), lambda x: x["text"]), "").alias("text"), F.count("*").alias("n")).where("n > 1").drop("n")
    h = table(spark, d, "queries").select("sample_id", F.explode("gold_evidence_ids").alias("id")).join(c.select(F.col("chunk_id").alias("id"), "text", F.col("source_id").alias("parent_id")), "id")
    x = K.expand_parents(h, parents)
    w = M.Window.partitionBy("sample_id", "context").orderBy("id")
    x = x.withColumn("n", F.row_number().over(w))
    return x.groupBy("sample_id").agg(F.count("*").alias("hits"), F.sum(F.when(F.col("n") == 1, F.length("context"))).alias("chars"))
