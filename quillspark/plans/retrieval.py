"""Queries on retrieval and its evaluation, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import metrics as M
from quillspark.operators import rank as K
from quillspark.registry import Registry, table
from quillspark.session import spread

R = Registry()

# --- shared parts of the SQL ---
TOK = "flatten(list_transform(regexp_extract_all(lower({t}), '[㐀-鿿]+|[a-z0-9]+'), lambda p: case when regexp_full_match(p, '[㐀-鿿]{{2,}}') then list_transform(range(1, length(p)), lambda i: substring(p, i, 2)) else [p] end))"
DOCS = f"docs as (select chunk_id as id, {TOK.format(t='text')} as tokens from chunks where text is not null)"
ASK = f"asks as (select sample_id as query_id, {TOK.format(t='question')} as tokens from queries where cast(substr(sample_id, 2) as bigint) % 100 = 0)"
BM25_SQL = f"""
{DOCS}, {ASK},
stat as (select count(*) n, avg(len(tokens)) avgdl from docs),
post as (select id, term, count(*) tf, any_value(dl) dl from (select id, unnest(tokens) term, len(tokens) dl from docs) group by id, term),
raw as (select term, ln(n - df + 0.5) - ln(df + 0.5) idf, avgdl from (select term, count(*) df from post group by term), stat),
idf as (select term, avgdl, case when idf < 0 then 0.25 * (select avg(idf) from raw) else idf end idf from raw),
qt as (select query_id, term, count(*) qtf from (select query_id, unnest(tokens) term from asks) group by query_id, term),
bm as (select query_id, id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) score from post join qt using (term) join idf using (term) group by query_id, id)
"""
TOP = "(select *, row_number() over (partition by query_id order by round(score, 9) desc, id) rank from {t}) where rank <= {k}"


def docs(spark, d):
    return spread(table(spark, d, "chunks").where("text is not null").select("chunk_id", "text")).select(F.col("chunk_id").alias("id"), T.token_bag(F.col("text")).alias("tokens"))


def asks(spark, d):
    """Every question whose id is divisible by 100, against all chunks."""
    q = table(spark, d, "queries").where("cast(substr(sample_id, 2) as bigint) % 100 = 0")
    return q.select(F.col("sample_id").alias("query_id"), T.token_bag(F.col("question")).alias("tokens"))


def qrels(spark, d):
    q = table(spark, d, "queries").where("cast(substr(sample_id, 2) as bigint) % 100 = 0")
    return q.select(F.col("sample_id").alias("query_id"), F.explode("gold_evidence_ids").alias("id"))


def bm25_scores(spark, d, index=None):
    return K.bm25(index if index is not None else docs(spark, d), asks(spark, d))


def bm25_best(spark, d, k, index=None):
    return K.bm25_top(index if index is not None else docs(spark, d), asks(spark, d), k)


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def vector_asks(spark, d):
    return vectors(spark, d).where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")


@R.add("bm25_topk", f"with {BM25_SQL} select query_id, id, rank, round(score, 5) score from {TOP.format(t='bm', k=10)}")
def bm25_topk(spark, d):
    return bm25_best(spark, d, 10).select("query_id", "id", "rank", F.round("score", 5).alias("score"))


@R.add("bm25_normalised", f"with {BM25_SQL} select query_id, id, rank, round(score / m, 5) score from (select *, max(score) over (partition by query_id) m from {TOP.format(t='bm', k=20)})")
def bm25_normalised(spark, d):
    return K.normalised(bm25_best(spark, d, 20)).select("query_id", "id", "rank", F.round("score", 5).alias("score"))


COVER_SQL = f"""
{DOCS}, {ASK}, nn as (select count(*) n from docs),
post as (select distinct id, term from (select id, unnest(tokens) term from docs)),
df as (select term, count(*) df from post group by term),
qi as (select query_id, term, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) idf from (select distinct query_id, unnest(tokens) term from asks) left join df using (term), nn),
mass as (select query_id, sum(idf) mass from qi group by query_id),
cov as (select query_id, id, sum(idf) / any_value(mass) score from post join qi using (term) join mass using (query_id) group by query_id, id)
"""


@R.add("coverage_topk", f"with {COVER_SQL} select query_id, id, rank, round(score, 6) score from {TOP.format(t='cov', k=10)}")
def coverage_topk(spark, d):
    return K.top(K.coverage(docs(spark, d), asks(spark, d)), 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


DENSE = "select q.vec_id query_id, v.vec_id id, list_dot_product(q.embedding::double[], v.embedding::double[]) / (sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_dot_product(v.embedding::double[], v.embedding::double[]))) score, v.label label, q.label qlabel from embeddings q, embeddings v where q.vec_id % 100 = 0"


@R.add("dense_topk", f"with s as ({DENSE}) select query_id, id, rank, round(score, 5) score from {TOP.format(t='s', k=10)}")
def dense_topk(spark, d):
    return K.dense(vectors(spark, d), vector_asks(spark, d), 10).select("query_id", "id", "rank", F.round("score", 5).alias("score"))


@R.add("knn_filtered", f"with s as ({DENSE} and v.label in (1, 3, 5)) select query_id, id, rank, round(score, 5) score from {TOP.format(t='s', k=5)}")
def knn_filtered(spark, d):
    return K.dense(vectors(spark, d).where("label in (1, 3, 5)"), vector_asks(spark, d), 5).select("query_id", "id", "rank", F.round("score", 5).alias("score"))


@R.add("rrf_fuse", f"with {BM25_SQL}, nn as (select count(*) n from docs), df as (select term, count(*) df from post group by term), qi as (select query_id, term, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) idf from (select distinct query_id, unnest(tokens) term from asks) left join df using (term), nn), mass as (select query_id, sum(idf) mass from qi group by query_id), cov as (select query_id, id, sum(idf) / any_value(mass) score from post join qi using (term) join mass using (query_id) group by query_id, id), u as (select query_id, id, 1.0 / (60 + rank) s, 0 src from {TOP.format(t='bm', k=20)} union all select query_id, id, 1.0 / (60 + rank), 1 from {TOP.format(t='cov', k=20)}), f as (select query_id, id, sum(s::double) score, string_agg(src::varchar, ',' order by src) sources from u group by query_id, id) select query_id, id, rank, round(score, 7) score, sources from {TOP.format(t='f', k=10)}")
def rrf_fuse(spark, d):
    ix = K.indexed(docs(spark, d))
    a, b = bm25_best(spark, d, 20, ix), K.coverage_top(ix, asks(spark, d), 20)
    f = K.rrf([a, b]).select("query_id", "id", "score", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))
    return K.top(f, 10).select("query_id", "id", "rank", F.round("score", 7).alias("score"), "sources")


@R.add("hybrid_linear_topk", f"with {BM25_SQL}, nn as (select count(*) n from docs), df as (select term, count(*) df from post group by term), qi as (select query_id, term, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) idf from (select distinct query_id, unnest(tokens) term from asks) left join df using (term), nn), mass as (select query_id, sum(idf) mass from qi group by query_id), cov as (select query_id, id, sum(idf) / any_value(mass) score from post join qi using (term) join mass using (query_id) group by query_id, id), nb as (select query_id, id, score / max(score) over (partition by query_id) score from bm), f as (select query_id, id, 0.2 * coalesce(c.score, 0) + 0.8 * coalesce(b.score, 0) score from cov c full join nb b using (query_id, id)) select query_id, id, rank, round(score, 6) score from {TOP.format(t='f', k=10)}")
def hybrid_linear_topk(spark, d):
    ix = K.indexed(docs(spark, d))
    return K.hybrid_top(ix, asks(spark, d), 0.2, 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@R.add("mmr_select")
def mmr_select(spark, d):
    v = vectors(spark, d)
    return K.mmr(K.dense(v, vector_asks(spark, d), 20).select("query_id", "id", "score"), v.select("id", "vector"), 5)


GOLD = "gold as (select distinct sample_id query_id, unnest(gold_evidence_ids) id from queries where cast(substr(sample_id, 2) as bigint) % 100 = 0)"
METRICS = f"""
rk as (select * from {TOP.format(t='bm', k=10)}), {GOLD}, ng as (select query_id, count(*) n_gold from gold group by query_id),
h as (select query_id, rank, row_number() over (partition by query_id order by rank) k from rk join gold using (query_id, id)),
a as (select query_id, max((rank <= 1)::int) h1, max((rank <= 3)::int) h3, max((rank <= 5)::int) h5, count(*) found, min(rank) first, sum(k / rank) ap, sum(1 / log2(rank + 1)) dcg from h group by query_id),
pq as (select query_id, coalesce(h1, 0) hit_1, coalesce(h3, 0) hit_3, coalesce(h5, 0) hit_5, coalesce(found, 0) / n_gold recall, coalesce(found, 0) / 10 as precision, coalesce(1 / first, 0) rr, coalesce(ap / n_gold, 0) ap,
  coalesce(dcg / (select sum(1 / log2(i + 1)) from range(1, least(n_gold, 10) + 1) t(i)), 0) ndcg from ng left join a using (query_id))
"""


def flagship(spark, d):
    """Ranking metrics of BM25 by split and bucket, for all questions of a small corpus."""
    q = table(spark, d, "queries")
    ranked = K.top(K.bm25(docs(spark, d), q.select(F.col("sample_id").alias("query_id"), T.token_bag(F.col("question")).alias("tokens"))), 10)
    gold = q.select(F.col("sample_id").alias("query_id"), F.explode("gold_evidence_ids").alias("id"))
    m = M.per_query(ranked, gold).join(q.select(F.col("sample_id").alias("query_id"), "split", "bucket"), "query_id")
    return m.groupBy("split", "bucket").agg(F.count("*").alias("n"), F.avg("hit_3").alias("hit_3"), F.avg("rr").alias("mrr"), F.avg("ndcg").alias("ndcg"))


def _per_query(spark, d):
    return M.per_query(bm25_best(spark, d, 10), qrels(spark, d))


@R.add("rank_metrics", f"with {BM25_SQL}, {METRICS} select query_id, hit_1, hit_3, hit_5, round(recall, 6) recall, round(precision, 6) as precision, round(rr, 6) rr, round(ap, 6) ap, round(ndcg, 6) ndcg from pq")
def rank_metrics(spark, d):
    return _per_query(spark, d).select("query_id", "hit_1", "hit_3", "hit_5", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "rr", "ap", "ndcg")])


@R.add("hit_by_bucket", f"with {BM25_SQL}, {METRICS} select q.split, q.bucket, count(*) n, sum(hit_3)::bigint hits, round(avg(rr), 6) mrr from pq join queries q on q.sample_id = pq.query_id group by 1, 2")
def hit_by_bucket(spark, d):
    q = table(spark, d, "queries").select(F.col("sample_id").alias("query_id"), "split", "bucket")
    return _per_query(spark, d).join(q, "query_id").groupBy("split", "bucket").agg(F.count("*").alias("n"), F.sum("hit_3").alias("hits"), F.round(F.avg("rr"), 6).alias("mrr"))


@R.add("judgment_pool", f"with {BM25_SQL}, nn as (select count(*) n from docs), df as (select term, count(*) df from post group by term), qi as (select query_id, term, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) idf from (select distinct query_id, unnest(tokens) term from asks) left join df using (term), nn), mass as (select query_id, sum(idf) mass from qi group by query_id), cov as (select query_id, id, sum(idf) / any_value(mass) score from post join qi using (term) join mass using (query_id) group by query_id, id), u as (select query_id, id, 'bm25' m from {TOP.format(t='bm', k=5)} union all select query_id, id, 'coverage' from {TOP.format(t='cov', k=5)}) select query_id, id, string_agg(m, ',' order by m) methods from u group by query_id, id")
def judgment_pool(spark, d):
    ix = K.indexed(docs(spark, d))
    return M.pool([("bm25", bm25_best(spark, d, 5, ix)), ("coverage", K.coverage_top(ix, asks(spark, d), 5))], 5)


LABELLED = f"with s as ({DENSE}), t as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) rank from s where id <> query_id)"


def _nearest(spark, d, k=1):
    v, q = vectors(spark, d), vector_asks(spark, d)
    near = K.dense(v, q, k + 1).where("id <> query_id")
    near = near.withColumn("rank", F.row_number().over(M.Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= k)
    return near.join(v.select("id", "label"), "id").join(v.select(F.col("id").alias("query_id"), F.col("label").alias("qlabel")), "query_id")


@R.add("risk_coverage", LABELLED + ", o as (select round(score, 4) s, label = qlabel ok from t where rank = 1), g as (select s, count(*) c, sum((not ok)::int) w from o group by s) select s threshold, sum(c) over (order by s desc)::bigint n, round(sum(c) over (order by s desc) / sum(c) over (), 6) coverage, round(sum(w) over (order by s desc) / sum(c) over (order by s desc), 6) risk from g")
def risk_coverage(spark, d):
    o = _nearest(spark, d).select("query_id", F.round("score", 4).alias("s"), (F.col("label") == F.col("qlabel")).alias("ok"))
    return M.risk_coverage(o, "s", "ok").select("threshold", "n", F.round("coverage", 6).alias("coverage"), F.round("risk", 6).alias("risk"))


@R.add("abstention_curve", LABELLED + ", o as (select round(score, 4) s, label = qlabel ok from t where rank = 1) select x threshold, sum((s > x)::int)::bigint answered, sum((s > x and ok)::int)::bigint useful, sum((s > x and not ok)::int)::bigint false_answers from o, (select unnest([0.0::double, 0.1::double, 0.2::double, 0.3::double, 0.4::double, 0.5::double]) x) group by x")
def abstention_curve(spark, d):
    o = _nearest(spark, d).select(F.round("score", 4).alias("s"), (F.col("label") == F.col("qlabel")).alias("ok"))
    return M.abstention(o, "s", "ok", [0.0, 0.1, 0.2, 0.3, 0.4, 0.5])


@R.add("threshold_select", LABELLED + ", o as (select round(score, 4) s, label = qlabel ok from t where rank = 1), d as (select distinct s from (select s from o union all select 0.0)), c as (select (s + lead(s) over (order by s)) / 2 x from d union all select 0.0) select x::double threshold, coalesce(sum((s > x and ok)::int), 0)::bigint useful, coalesce(sum((s > x and not ok)::int), 0)::bigint false_answers from c, o where x is not null group by x order by coalesce(sum((s > x and ok)::int), 0) - coalesce(sum((s > x and not ok)::int), 0) desc, x limit 1")
def threshold_select(spark, d):
    o = _nearest(spark, d).select(F.round("score", 4).alias("s"), (F.col("label") == F.col("qlabel")).alias("ok"))
    return M.select_threshold(o, "s", "ok")


@R.add("auroc", LABELLED + ", o as (select round(score, 4) s, label = qlabel ok from t where rank <= 10) select round(avg(case when p.s > n.s then 1.0 when p.s = n.s then 0.5 else 0.0 end), 9) auroc from (select s from o where ok) p, (select s from o where not ok) n")
def auroc(spark, d):
    o = _nearest(spark, d, 10).select(F.round("score", 4).alias("s"), (F.col("label") == F.col("qlabel")).alias("ok"))
    return M.auroc(o, "s", "ok").select(F.round("auroc", 9).alias("auroc"))


@R.add("paired_compare", f"with {BM25_SQL}, {METRICS}, o as (select hit_3 a, hit_1 b from pq) select count(*) n, round(avg(a), 6) mean_a, round(avg(b), 6) mean_b, round(avg(a) - avg(b), 6) diff, count(*) filter (where a > b) wins, count(*) filter (where a < b) losses, count(*) filter (where a = b) ties from o")
def paired_compare(spark, d):
    r = M.paired(_per_query(spark, d), "hit_3", "hit_1")
    return r.select("n", *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "diff")], "wins", "losses", "ties")


@R.add("wilson", "with g as (select split, count(*) n, sum((len(gold_evidence_ids) > 0)::int) h from queries group by split) select split, n, h::bigint as hits, round(greatest(0, (h/n + 1.9208/n - 1.96*sqrt(h/n*(1-h/n)/n + 3.8416/(4*n*n))) / (1 + 3.8416/n)), 6) low, round(least(1, (h/n + 1.9208/n + 1.96*sqrt(h/n*(1-h/n)/n + 3.8416/(4*n*n))) / (1 + 3.8416/n)), 6) high from g")
def wilson(spark, d):
    g = table(spark, d, "queries").groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.size("gold_evidence_ids") > 0).alias("hits"))
    low, high = M.wilson(F.col("hits"), F.col("n"))
    return g.select("split", "n", "hits", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@R.add("cohen_kappa", "with c as (select case when bucket is null then null else split end a, case when source in ('forum_sample', 'clinic_hotline') then 'train' else 'dev' end b from queries), p as (select * from c where a is not null and b is not null), n as (select count(*) n from p), o as (select count(*) / any_value(n) o from p, n where a = b), e as (select sum(x.c * y.c) / any_value(n * n) e from (select a, count(*) c from p group by a) x join (select b, count(*) c from p group by b) y on x.a = y.b, n) select n, round(o, 9) observed, round(e, 9) expected, round((o - e) / (1 - e), 9) kappa from n, o, e")
def cohen_kappa(spark, d):
    q = table(spark, d, "queries").select(F.when(F.col("bucket").isNotNull(), F.col("split")).alias("a"), F.when(F.col("source").isin("forum_sample", "clinic_hotline"), "train").otherwise("dev").alias("b"))
    return M.kappa(q, "a", "b").select("n", *[F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")])


@R.add("random_hit", "with q as (select sample_id, len(gold_evidence_ids) g from queries), n as (select count(*) n from chunks) select sample_id, round(1 - (greatest(n - g, 0) / n) * (greatest(n - g - 1, 0) / (n - 1)) * (greatest(n - g - 2, 0) / (n - 2)), 9) expected from q, n")
def random_hit(spark, d):
    n = table(spark, d, "chunks").agg(F.count("*").alias("n"))
    q = table(spark, d, "queries").select("sample_id", F.size("gold_evidence_ids").alias("g")).crossJoin(F.broadcast(n))
    return q.select("sample_id", F.round(M.random_hit(F.col("n"), F.col("g"), 3), 9).alias("expected"))


@R.add("bootstrap_mean")
def bootstrap_mean(spark, d):
    """Every question against all chunks."""
    q = table(spark, d, "queries").select(F.col("sample_id").alias("query_id"), "split", "question", "gold_evidence_ids")
    gold = q.select("query_id", F.explode("gold_evidence_ids").alias("id"))
    ranked = K.bm25_reached(docs(spark, d), q.select("query_id", T.token_bag(F.col("question")).alias("tokens")), gold, 10)
    return M.bootstrap_mean(M.per_query(ranked, gold).join(q.select("query_id", "split"), "query_id"), "split", "rr", "query_id")


@R.add("overlap_ratio", f"with {ASK}, {DOCS}, p as (select query_id, id, q.tokens qt, d.tokens dt from (select distinct sample_id query_id, unnest(gold_evidence_ids) id from queries) g join (select sample_id query_id, {TOK.format(t='question')} tokens from queries) q using (query_id) join docs d using (id)) select query_id, id, round(len(list_intersect(qt, dt)) / greatest(len(list_distinct(qt)), 1), 9) overlap from p")
def overlap_ratio(spark, d):
    q = table(spark, d, "queries")
    gold = q.select(F.col("sample_id").alias("query_id"), F.explode("gold_evidence_ids").alias("id"), T.token_bag(F.col("question")).alias("qt")).distinct()
    return gold.join(docs(spark, d), "id").select("query_id", "id", F.round(T.overlap(F.col("qt"), F.col("tokens")), 9).alias("overlap"))
