"""Queries on answer measures, evaluation sets and reports, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import answers as A
from quillspark.operators import rank as K
from quillspark.registry import Registry, table

R = Registry()
FEW_TOPICS = 1000

# Each question with a stand-in decision: it is answered if it has a source, and cites the first of its gold passages if its id is even.
OUTCOMES = """o as (select split, bucket, case when bucket is null then 'invalid' when source is null and len(gold_evidence_ids) > 0 then 'refused' when source is null then 'correct_refusal' when len(gold_evidence_ids) = 0 then 'false_answer' when cast(substr(sample_id, 2) as bigint) % 2 = 0 then 'correct' else 'wrong' end outcome from queries)"""


def _outcomes(spark, d):
    even = F.expr("cast(substr(sample_id, 2) as bigint) % 2 = 0")
    cited = F.when(even, F.slice("gold_evidence_ids", 1, 1)).otherwise(F.array(F.lit("none")))
    return table(spark, d, "queries").select("split", "bucket", A.outcome(F.when(F.col("bucket").isNotNull(), F.col("source").isNotNull()), cited, F.col("gold_evidence_ids")).alias("outcome"))


@R.add("outcome_metrics", f"with {OUTCOMES} select split, outcome, count(*) n from o group by 1, 2")
def outcome_metrics(spark, d):
    return A.confusion(_outcomes(spark, d), "split", "outcome").select(F.col("actual").alias("split"), F.col("predicted").alias("outcome"), "n")


@R.add("answer_f1", f"with {OUTCOMES}, c as (select split, count(*) n, sum((outcome = 'correct')::int) c, sum((outcome in ('correct', 'wrong', 'false_answer'))::int) g, sum((outcome in ('correct', 'wrong', 'refused'))::int) u from o group by 1), x as (select split, n, c / nullif(g, 0) p, c / nullif(u, 0) r from c) select split, n, round(p, 9) as precision, round(r, 9) recall, round(case when p + r > 0 then 2 * p * r / (p + r) end, 9) f1 from x")
def answer_f1(spark, d):
    return A.answer_f1(_outcomes(spark, d), ["split"]).select("split", "n", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@R.add("router_confusion", "select intent actual, bucket predicted, count(*) n from queries_authored group by 1, 2")
def router_confusion(spark, d):
    return A.confusion(table(spark, d, "queries_authored"), "intent", "bucket")


@R.add("context_precision", "with r as (select sample_id query_id, g.id, row_number() over (partition by sample_id order by g.id) as rk, c.content_kind = 'web_page' relevant from (select distinct sample_id, unnest(gold_evidence_ids) id from queries) g join (select chunk_id id, metadata.content_kind content_kind from chunks) c using (id)), p as (select query_id, relevant, sum(relevant::int) over (partition by query_id order by rk) / rk p from r) select query_id, round(coalesce(avg(p) filter (where relevant), 0), 9) context_precision from p group by 1")
def context_precision(spark, d):
    g = table(spark, d, "queries").select(F.col("sample_id").alias("query_id"), F.explode("gold_evidence_ids").alias("id")).distinct()
    c = table(spark, d, "chunks").select(F.col("chunk_id").alias("id"), (F.col("metadata.content_kind") == "web_page").alias("relevant"))
    r = g.join(c, "id").withColumn("rank", F.row_number().over(A.Window.partitionBy("query_id").orderBy("id")))
    return A.context_precision(r).select("query_id", F.round("context_precision", 9).alias("context_precision"))


@R.add("citation_scores", "with s as (select sample_id, list_transform(gold_evidence_ids, lambda x: x like '%:p:%') alone, len(gold_evidence_ids) > 1 together from queries) select sample_id, together::int citation_recall, round(case when len(alone) > 0 then case when together then len(list_filter(alone, lambda x: x)) / len(alone) else 0.0 end end, 9) citation_precision from s")
def citation_scores(spark, d):
    s = table(spark, d, "queries").select("sample_id", F.transform("gold_evidence_ids", lambda x: x.like("%:p:%")).alias("alone"), (F.size("gold_evidence_ids") > 1).alias("together"))
    return A.citation_scores(s, "together", "alone").select("sample_id", "citation_recall", F.round("citation_precision", 9).alias("citation_precision"))


@R.add("stratified_split", "with n as (select split, count(*) c from queries group by 1), q as (select split, 100 * c / sum(c) over () want, floor(100 * c / sum(c) over ()) base from n), t as (select split, base + (row_number() over (order by want - base desc, split) <= 100 - sum(base) over ())::int take from q), r as (select sample_id, split, row_number() over (partition by split order by sha1(sample_id), sample_id) n from queries) select sample_id, split from r join t using (split) where n <= take")
def stratified_split(spark, d):
    return A.stratified(table(spark, d, "queries").select("sample_id", "split"), "sample_id", "split", 100)


@R.add("hash_sample", "select sample_id from queries order by sha1(sample_id), sample_id limit 64")
def hash_sample(spark, d):
    return A.hash_order(table(spark, d, "queries").select("sample_id"), "sample_id", 64)


@R.add("number_support", "select chunk_id, len(list_filter(regexp_extract_all(metadata.title, '[0-9]+(?:[.][0-9]+)?'), lambda x: not contains(text, x))) = 0 supported from chunks where text is not null and metadata.title is not null")
def number_support(spark, d):
    c = table(spark, d, "chunks").where("text is not null and metadata.title is not null")
    return c.select("chunk_id", A.numbers_supported(F.col("metadata.title"), F.col("text")).alias("supported"))


@R.add("table_row_text", "select n_nationkey, '国家：' || n_name || '；列2：' || n_regionkey as text from nation")
def table_row_text(spark, d):
    return table(spark, d, "nation").select("n_nationkey", A.row_text(F.array(F.lit("国家")), F.array(F.col("n_name"), F.col("n_regionkey").cast("string"))).alias("text"))


@R.add("safe_urls", "select document_id, count(*) n, sum(regexp_matches(coalesce(source_url, ''), '^https?://[^/\\s]+')::int)::bigint safe from sources group by 1")
def safe_urls(spark, d):
    return table(spark, d, "sources").groupBy("document_id").agg(F.count("*").alias("n"), F.sum(A.safe_url(F.coalesce("source_url", F.lit(""))).cast("int")).alias("safe"))


@R.add("truncated_texts", "select chunk_id, case when length(text) > 200 then left(text, 200) || '[TRUNCATED:' || length(text) || ']' else text end as text from chunks")
def truncated_texts(spark, d):
    return table(spark, d, "chunks").select("chunk_id", A.truncated(F.col("text"), 200).alias("text"))


@R.add("filter_relaxation", "with q as (select sample_id query_id, expected_filters['topic'] topic from queries_authored), c as (select chunk_id id, metadata.title title, metadata.content_kind kind, evidence_level lvl from chunks), l as (select query_id, 0 as level, id from q join c on contains(title, topic) and kind = 'pdf_text' and lvl = 'level_1_guideline' union all select query_id, 1, id from q join c on contains(title, topic) and kind = 'pdf_text' union all select query_id, 2, id from q join c on contains(title, topic)), n as (select query_id, level, count(*) n from l group by 1, 2), ch as (select query_id, coalesce(min(level) filter (where n >= 3), max(level)) level from n group by 1) select query_id, level, count(*) hits from l join ch using (query_id, level) group by 1, 2")
def filter_relaxation(spark, d):
    """Per query the first level of ever fewer conditions that has three hits.

    Up to FEW_TOPICS distinct topics are sent to the titles; more are met by an equi-join with the titles' substrings. Hits are counted a topic before queries join."""
    q = table(spark, d, "queries_authored").select(F.col("sample_id").alias("query_id"), F.col("expected_filters")["topic"].alias("topic")).where("topic is not null")
    c = table(spark, d, "chunks").select(F.col("chunk_id").alias("id"), F.col("metadata.title").alias("title"), F.col("metadata.content_kind").alias("kind"), F.col("evidence_level").alias("lvl"))
    topics = q.select("topic").distinct()
    titles = c.where("title is not null").select("id", "kind", "lvl", "title")
    if topics.count() <= FEW_TOPICS:
        hit = titles.join(F.broadcast(topics), F.contains("title", F.col("topic")))
    else:
        lengths = sorted(r.n for r in topics.select(F.length("topic").alias("n")).distinct().collect())
        cut = F.array_distinct(F.concat(*[T.windows(F.col("title"), n) for n in lengths]))
        hit = titles.select("id", "kind", "lvl", F.explode(cut).alias("topic")).join(topics, "topic")
    at = F.when((F.col("kind") == "pdf_text") & (F.col("lvl") == "level_1_guideline"), 0).when(F.col("kind") == "pdf_text", 1).otherwise(2)
    levels = hit.select("topic", "id", F.explode(F.sequence(at, F.lit(2))).alias("level"))
    best = K.relaxed(levels.withColumnRenamed("topic", "query_id"), 3).groupBy("query_id", "level").agg(F.count("*").alias("hits"))
    return q.join(best.withColumnRenamed("query_id", "topic"), "topic").select("query_id", "level", "hits")


@R.add("parent_context", "with r as (select sample_id query_id, id, row_number() over (partition by sample_id order by id) rk from (select distinct sample_id, unnest(gold_evidence_ids) id from queries)), t as (select r.query_id, c.source_id, min(length(p.text)) n from r join chunks c on c.chunk_id = r.id join (select source_id, string_agg(text, '' order by chunk_id) as text from chunks where text is not null group by 1) p on p.source_id = c.source_id where rk <= 3 group by 1, 2) select query_id, sum(n)::bigint context_chars from t group by 1")
def parent_context(spark, d):
    """Characters of the distinct parents (whole sources) of the first three passages of each question."""
    g = table(spark, d, "queries").select(F.col("sample_id").alias("query_id"), F.explode("gold_evidence_ids").alias("id")).distinct()
    g = g.withColumn("rank", F.row_number().over(A.Window.partitionBy("query_id").orderBy("id"))).where(F.col("rank") <= 3)
    c = table(spark, d, "chunks").select(F.col("chunk_id").alias("id"), "source_id", F.length("text").alias("n"))
    size = c.where("n is not null").groupBy("source_id").agg(F.sum("n").alias("n"))
    return g.join(c.select("id", "source_id"), "id").select("query_id", "source_id").distinct().join(size, "source_id").groupBy("query_id").agg(F.sum("n").alias("context_chars"))
