"""Queries on judgments, gates, answers and reports, with the SQL that checks them.

There are no recorded model runs among the tables, so trials are derived from all questions by fixed rules on their lengths; the operators see them as any other run."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import answers as A
from quillspark.operators import judging as J
from quillspark.operators import metrics as M
from quillspark.plans.corpus import sents_sql, squash_sql
from quillspark.plans.retrieval import BM25_SQL, TOP, bm25_best, vectors
from quillspark.operators import rank as K
from quillspark.registry import Registry, table

R = Registry()
G = "coalesce(gold_evidence_ids, []::varchar[])"
TRIALS = f"""tr as (select *, retrieved[1:1] selected, len(gold) > 0 answerable, decision = 'answered' answered, len(list_intersect(retrieved[1:1], gold)) > 0 correct from (
select sample_id as key, split, bucket, question, {G} gold, case length(question) % 3 when 0 then {G} when 1 then {G}[1:1] else []::varchar[] end retrieved,
case when bucket is null then 'blocked' when len({G}) = 0 then case when length(question) % 2 = 0 then 'abstained' else 'answered' end when length(question) % 4 = 0 then 'abstained' else 'answered' end decision,
case when bucket is not null then round((length(question) % 97) / 97.0, 6) end score from queries))"""


def trials(spark, d):
    q, n = table(spark, d, "queries"), F.length("question")
    gold, none = F.coalesce("gold_evidence_ids", F.array().cast("array<string>")), F.array().cast("array<string>")
    t = q.select(F.col("sample_id").alias("key"), "split", "bucket", "question", gold.alias("gold"), F.when(n % 3 == 0, gold).when(n % 3 == 1, F.slice(gold, 1, 1)).otherwise(none).alias("retrieved"),
        F.when(F.col("bucket").isNull(), "blocked").when(F.size(gold) == 0, F.when(n % 2 == 0, "abstained").otherwise("answered")).when(n % 4 == 0, "abstained").otherwise("answered").alias("decision"),
        F.when(F.col("bucket").isNotNull(), F.round((n % 97) / 97.0, 6)).alias("score"))
    t = t.withColumn("selected", F.slice("retrieved", 1, 1))
    return t.withColumn("answerable", F.size("gold") > 0).withColumn("answered", F.col("decision") == "answered").withColumn("correct", F.arrays_overlap("selected", "gold"))


LABELS = "lb as (select query_id, id, max(case when i = 1 then 2 else 1 end) as label from (select sample_id query_id, unnest(gold_evidence_ids) id, generate_subscripts(gold_evidence_ids, 1) i from queries where cast(substr(sample_id, 2) as bigint) % 100 = 0) group by 1, 2)"


def _labels(spark, d):
    q = table(spark, d, "queries").where("cast(substr(sample_id, 2) as bigint) % 100 = 0").select(F.col("sample_id").alias("query_id"), F.posexplode("gold_evidence_ids").alias("i", "id"))
    return q.groupBy("query_id", "id").agg(F.max(F.when(F.col("i") == 0, 2).otherwise(1)).alias("label"))


@R.add("graded_metrics", f"with {BM25_SQL}, rk as (select * from {TOP.format(t='bm', k=20)}), {LABELS}, ng as (select query_id, count(*) filter (where label = 2) n, sum(label / log2(r + 1)) filter (where r <= 5) ideal from (select *, row_number() over (partition by query_id order by label desc, id) r from lb) group by 1), h as (select query_id, min(rank) filter (where label = 2) f, count(*) filter (where label = 2) found, sum(label / log2(rank + 1)) filter (where rank <= 5) dcg from rk join lb using (query_id, id) group by 1) select query_id, coalesce((f <= 3)::int, 0) hit_3, case when f <= 10 then 1 / f else 0.0 end rr, coalesce(found, 0) / nullif(n, 0) recall, round(coalesce(dcg, 0) / nullif(ideal, 0), 6) ndcg from ng left join h using (query_id)")
def graded_metrics(spark, d):
    return J.graded(bm25_best(spark, d, 20), _labels(spark, d)).select("query_id", "hit_3", "rr", "recall", F.round("ndcg", 6).alias("ndcg"))


TAUS = [float("-inf"), 0.1, 0.25, 0.5, 0.9]


def _curve_sql(answered: str) -> str:
    return f"with {TRIALS}, t as (select unnest(['-inf'::double, 0.1::double, 0.25::double, 0.5::double, 0.9::double]) tau), j as (select tau, answerable, correct, {answered} answered, coalesce(score, '-inf'::double) < tau blocked from tr, t) select tau, sum(blocked::int)::bigint blocked, sum((not blocked and answered)::int)::bigint answered, sum((not blocked and answered and answerable and correct)::int)::bigint useful, sum((not blocked and answered and not answerable)::int)::bigint false_answers, sum((answerable and (blocked or not answered))::int)::bigint over_refusals from j group by 1"


@R.add("gate_curve", _curve_sql("answered"))
def gate_curve(spark, d):
    return J.gated(trials(spark, d), spark.createDataFrame([(t,) for t in TAUS], "tau double"))


@R.add("score_only_curve", _curve_sql("true"))
def score_only_curve(spark, d):
    return J.score_only(trials(spark, d), spark.createDataFrame([(t,) for t in TAUS], "tau double"))


@R.add("budget_threshold", f"with {TRIALS}, s as (select coalesce(score, '-inf'::double) s, row_number() over (order by coalesce(score, '-inf'::double)) r, count(*) over () n from tr where answerable) select case when max(case when r = a + 1 then s end) > max(case when r = a then s end) then (max(case when r = a then s end) + max(case when r = a + 1 then s end)) / 2 else max(case when r = a then s end) end tau from s, (select floor(0.2 * count(*)) a from tr where answerable)")
def budget_threshold(spark, d):
    return J.budget_tau(trials(spark, d), 0.2)


@R.add("youden_threshold", f"with {TRIALS}, t as (select distinct coalesce(score, '-inf'::double) tau from tr union select '-inf'::double), j as (select tau, sum((answerable and correct and coalesce(score, '-inf'::double) >= tau)::int) / sum(answerable::int) - sum((not answerable and coalesce(score, '-inf'::double) >= tau)::int) / sum((not answerable)::int) u from tr, t group by 1) select tau, round(u, 9) utility from j order by round(u, 12) desc, tau limit 1")
def youden_threshold(spark, d):
    return J.youden_tau(trials(spark, d)).select("tau", F.round("utility", 9).alias("utility"))


@R.add("alpha_grid", f"with {TRIALS}, g as (select a, avg(a * coalesce(score, 0) + (1 - a) * correct::int) m, avg(correct::int) k from tr, (select unnest([0.0::double, 0.2::double, 0.4::double, 0.6::double]) a) where split = 'dev' group by a) select a alpha, round(m, 6) mrr from g order by round(m, 12) desc, a limit 1")
def alpha_grid(spark, d):
    """The weight with the best mean on dev, ties to the smaller one."""
    t = trials(spark, d).where("split = 'dev'")
    g = t.select(F.explode(F.array(*[F.lit(float(a)) for a in (0, 0.2, 0.4, 0.6)])).alias("alpha"), F.coalesce("score", F.lit(0.0)).alias("s"), F.col("correct").cast("int").alias("c"))
    grid = g.groupBy("alpha").agg(F.avg(F.col("alpha") * F.col("s") + (1 - F.col("alpha")) * F.col("c")).alias("mrr"))
    return J.best_setting(grid, ["mrr"], "alpha").select("alpha", F.round("mrr", 6).alias("mrr"))


@R.add("depth_grid", f"with {TRIALS}, g as (select k depth, avg((len(list_intersect(gold[1:k], retrieved)) > 0)::int) hit, avg(len(list_intersect(gold[1:k], retrieved)) / k) mrr from tr, (select unnest([1, 2, 3]) k) group by 1) select depth, round(hit, 6) hit, round(mrr, 6) mrr from g order by round(hit, 12) desc, round(mrr, 12) desc, depth limit 1")
def depth_grid(spark, d):
    t = trials(spark, d).select("gold", "retrieved", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("depth"))
    n = F.size(F.array_intersect(F.slice("gold", F.lit(1), F.col("depth")), F.col("retrieved")))
    grid = t.groupBy("depth").agg(F.avg((n > 0).cast("int")).alias("hit"), F.avg(n / F.col("depth")).alias("mrr"))
    return J.best_setting(grid, ["hit", "mrr"], "depth").select("depth", F.round("hit", 6).alias("hit"), F.round("mrr", 6).alias("mrr"))


@R.add("scaling_sets", "with g as (select distinct c.source_id doc from (select unnest(gold_evidence_ids) id from queries where split = 'check') q join chunks c on c.chunk_id = q.id), a as (select distinct source_id doc from chunks), r as (select size, seed, doc, (g.doc is null)::int o, row_number() over (partition by size, seed order by (g.doc is null)::int, sha1(seed || ':' || doc), doc) n from a left join g using (doc), (select unnest([100, 300]) size), (select unnest([0, 1]) seed)) select size, seed, doc from r where n <= size or o = 0")
def scaling_sets(spark, d):
    c = table(spark, d, "chunks")
    gold = table(spark, d, "queries").where("split = 'check'").select(F.explode("gold_evidence_ids").alias("chunk_id")).join(c.select("chunk_id", F.col("source_id").alias("doc")), "chunk_id")
    return J.distractors(c.select(F.col("source_id").alias("doc")), gold, [100, 300], 2)


@R.add("system_matrix", f"with {TRIALS}, l as (select split, decision, unnest([{{'m': 'score', 'v': score}}, {{'m': 'correct', 'v': correct::int::double}}]) x from tr) select split, x.m measure, round(avg(x.v) filter (where decision = 'answered'), 6) answered, round(avg(x.v) filter (where decision = 'abstained'), 6) abstained from l group by 1, 2")
def system_matrix(spark, d):
    t = trials(spark, d).withColumn("correct", F.col("correct").cast("int"))
    return J.matrix(t, "split", "decision", ["answered", "abstained"], ["score", "correct"]).select("split", "measure", F.round("answered", 6).alias("answered"), F.round("abstained", 6).alias("abstained"))


POOL = f"po as (select query_id, doc, (i - 1)::int pos, sentence from (select sample_id query_id, id doc, unnest(s) sentence, generate_subscripts(s, 1) i from (select sample_id, id, {sents_sql('text')} s from (select sample_id, unnest(gold_evidence_ids) id from queries) q join chunks on chunk_id = id where text is not null)))"


def _pool(spark, d):
    g = table(spark, d, "queries").select(F.col("sample_id").alias("query_id"), F.explode("gold_evidence_ids").alias("doc"))
    c = table(spark, d, "chunks").where("text is not null").select(F.col("chunk_id").alias("doc"), "text")
    return g.join(c, "doc").select("query_id", "doc", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@R.add("pooled_sentences", f"with {POOL} select query_id, doc, pos from (select *, row_number() over (partition by query_id, {squash_sql('sentence')} order by doc, pos) n from po) where n = 1")
def pooled_sentences(spark, d):
    return J.pooled_sentences(_pool(spark, d)).select("query_id", "doc", "pos")


BATCH = "list_reduce(x, lambda a, p: case when a.held > 0 and a.held + p.n > 400 then {'b': a.b + 1, 'held': p.n, 'o': list_append(a.o, {'d': p.d, 'b': a.b + 1})} else {'b': a.b, 'held': a.held + p.n, 'o': list_append(a.o, {'d': p.d, 'b': a.b})} end, {'b': 0, 'held': 0::bigint, 'o': []::struct(d varchar, b int)[]})"


@R.add("judgment_batches", f"with g as (select query_id, list({{'d': doc, 'n': n}} order by doc) x from (select sample_id query_id, id doc, (length(text) + 30)::bigint n from (select distinct sample_id, unnest(gold_evidence_ids) id from queries) join chunks on chunk_id = id where text is not null) group by 1) select query_id, r.d doc, r.b batch from (select query_id, unnest(({BATCH}).o) r from g)")
def judgment_batches(spark, d):
    g = table(spark, d, "queries").select(F.col("sample_id").alias("query_id"), F.explode("gold_evidence_ids").alias("doc")).distinct()
    c = table(spark, d, "chunks").where("text is not null").select(F.col("chunk_id").alias("doc"), F.length("text").alias("n"))
    return J.batches(g.join(c, "doc"), "query_id", "doc", "n", 400)


RAW = "rw as (select sample_id, gold, case length(question) % 4 when 0 then to_json({'relevant': gold})::varchar when 1 then to_json({'relevant': gold[1:1], 'partial': gold[2:]})::varchar when 2 then to_json({'relevant': list_append(gold, 'x')})::varchar else to_json({'relevant': gold, 'other': 1})::varchar end raw from (select sample_id, question, list_sort(list_distinct(gold_evidence_ids)) gold from queries))"


@R.add("parsed_labels", f"with {RAW}, o as (select sample_id, case when contains(raw, '\"other\"') or contains(raw, '\"x\"') then null else raw end raw from rw) select sample_id, raw is not null valid, coalesce(len(coalesce(json_extract_string(raw, '$.relevant[*]'), [])) , 0)::int relevant, coalesce(len(coalesce(json_extract_string(raw, '$.partial[*]'), [])), 0)::int partial from o")
def parsed_labels(spark, d):
    g = F.array_sort(F.array_distinct("gold_evidence_ids"))
    n = F.length("question") % 4
    q = table(spark, d, "queries").select("sample_id", g.alias("gold"), n.alias("n"))
    raw = F.when(F.col("n") == 0, F.to_json(F.struct(F.col("gold").alias("relevant")))).when(F.col("n") == 1, F.to_json(F.struct(F.slice("gold", 1, 1).alias("relevant"), F.filter("gold", lambda x, i: i > 0).alias("partial")))).when(F.col("n") == 2, F.to_json(F.struct(F.array_append("gold", F.lit("x")).alias("relevant")))).otherwise(F.to_json(F.struct(F.col("gold").alias("relevant"), F.lit(1).alias("other"))))
    p = q.withColumn("p", J.parsed_labels(raw, F.col("gold")))
    size = lambda name: F.coalesce(F.size(F.filter("p", lambda x: x["label"] == name)), F.lit(0))
    return p.select("sample_id", F.col("p").isNotNull().alias("valid"), F.when(F.col("p").isNull(), 0).otherwise(size("relevant")).alias("relevant"), F.when(F.col("p").isNull(), 0).otherwise(size("partial")).alias("partial"))


JUDGED = f"{POOL}, js as (select query_id, split_part(doc, ':', 1) d, sentence, (length(sentence) % 3)::int as label from po)"


@R.add("projected_labels", f"with {JUDGED}, s as (select query_id, d, {squash_sql('sentence')} s, label from js where {squash_sql('sentence')} <> '') select query_id, chunk_id, max(case when contains(c, s) or contains(s, c) then label else 0 end) as label from (select chunk_id, source_id d, {squash_sql('text')} c from chunks where text is not null) join s using (d) group by 1, 2")
def projected_labels(spark, d):
    s = _pool(spark, d).select("query_id", F.substring_index("doc", ":", 1).alias("doc"), "sentence", (F.length("sentence") % 3).alias("label"))
    return J.projected(table(spark, d, "chunks").select("chunk_id", F.col("source_id").alias("doc"), "text"), s)


@R.add("answerable_queries", f"with {POOL} select query_id, bool_or(length(sentence) % 3 = 2) answerable, not bool_or(length(sentence) % 3 = 2) and bool_or(length(sentence) % 3 = 1) partial_only from po group by 1")
def answerable_queries(spark, d):
    return J.answerable(_pool(spark, d).select("query_id", (F.length("sentence") % 3).alias("label")))


@R.add("repeatability", f"with {TRIALS}, x as (select bucket query_id, decision, array_to_string(list_sort(selected), ',') s from tr where bucket is not null), g as (select query_id, count(distinct decision) d, count(distinct s) s from x group by 1) select count(*) queries, sum((d = 1)::int)::bigint same_decision, sum((s = 1)::int)::bigint same_selection from g")
def repeatability(spark, d):
    return J.repeatability(trials(spark, d).where("bucket is not null").select(F.col("bucket").alias("query_id"), "decision", "selected"))


@R.add("gained_lost", f"with {TRIALS}, j as (select split, correct a, answered and answerable b from tr) select split, sum((not a and b)::int)::bigint gained, sum((a and not b)::int)::bigint lost, sum((a and b)::int)::bigint \"both\" from j group by rollup (split)")
def gained_lost(spark, d):
    t = trials(spark, d)
    return J.gained_lost(t.select("key", "split", F.col("correct").alias("ok")), t.select("key", (F.col("answered") & F.col("answerable")).alias("ok")), ["split"])


VERDICTS = "vd as (select sample_id as key, split, case length(question) % 3 when 0 then 'entailed' when 1 then 'partial' else 'refuted' end verdict, len(gold_evidence_ids) extracts from queries)"


def _verdicts(spark, d):
    n = F.length("question") % 3
    return table(spark, d, "queries").select(F.col("sample_id").alias("key"), "split", F.when(n == 0, "entailed").when(n == 1, "partial").otherwise("refuted").alias("verdict"), F.size("gold_evidence_ids").alias("extracts"))


@R.add("faithfulness", f"with {VERDICTS} select split, count(*) statements, round(avg((verdict = 'entailed')::int), 6) faithful, round(avg((verdict = 'partial')::int), 6) partial_share from vd group by 1")
def faithfulness(spark, d):
    return J.faithfulness(_verdicts(spark, d), "split").select("split", "statements", F.round("faithful", 6).alias("faithful"), F.round("partial_share", 6).alias("partial_share"))


@R.add("displayed_answers", f"with {VERDICTS} select key, (verdict in ('entailed', 'partial'))::int::bigint shown, case when verdict in ('entailed', 'partial') then 'generated' when extracts > 0 then 'extractive' else 'refused' end as mode from vd")
def displayed_answers(spark, d):
    return J.displayed(_verdicts(spark, d))


@R.add("answer_relevancy", "select a.label, count(*) n, round(avg(list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])))), 6) relevancy from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 group by 1")
def answer_relevancy(spark, d):
    v = vectors(spark, d)
    p = v.select("label", F.col("vector").alias("a"), (F.col("id") + 1).alias("id")).join(v.select("id", F.col("vector").alias("b")), "id")
    return J.mean_cosine(p, "label", "a", "b").select("label", "n", F.round("relevancy", 6).alias("relevancy"))


@R.add("entailment_items", "with s as (select sample_id as key, gold_evidence_ids c from queries) select key, 'all' kind, 0 item, array_to_string(c, ',') citation from s where len(c) > 0 union all select key, 'faith', 0, '' from s union all select key, 'alone', (i - 1)::int, x from (select key, unnest(c) x, generate_subscripts(c, 1) i from s where len(c) > 1)")
def entailment_items(spark, d):
    q = table(spark, d, "queries").select(F.col("sample_id").alias("key"), F.lit("").alias("statement"), F.col("gold_evidence_ids").alias("citations"))
    return J.entailment_items(q)


@R.add("cited_answer_issues", f"with q as (select sample_id, gold_evidence_ids[1] id, question claim from queries), j as (select sample_id, claim, text src, case length(claim) % 3 when 0 then left(text, 30) when 1 then left(text, 5) else claim end quote from q left join chunks on chunk_id = id) select sample_id, case when src is null then 'missing_citation' when length({squash_sql('quote')}) < 8 then 'short_quote' when not contains({squash_sql('src')}, {squash_sql('quote')}) then 'not_verbatim' when regexp_matches(claim, '诊断|diagnos') then 'forbidden' when len(list_filter(regexp_extract_all(claim, '\\d+(?:\\.\\d+)?'), lambda x: not contains(quote, x))) > 0 then 'number_unsupported' end issue from j")
def cited_answer_issues(spark, d):
    q = table(spark, d, "queries").select("sample_id", F.try_element_at("gold_evidence_ids", F.lit(1)).alias("id"), F.col("question").alias("claim"))
    j = q.join(table(spark, d, "chunks").select(F.col("chunk_id").alias("id"), F.col("text").alias("src")), "id", "left")
    n = F.length("claim") % 3
    quote = F.when(n == 0, F.left("src", F.lit(30))).when(n == 1, F.left("src", F.lit(5))).otherwise(F.col("claim"))
    return j.select("sample_id", J.cited_answer_issue(quote, F.col("src"), F.col("claim"), "诊断|diagnos").alias("issue"))


@R.add("extractive_answers", "select sample_id as key, bool_and(coalesce(case when length(question) % 2 = 0 then text else left(text, 20) end = text, false)) and count(*) <= 3 and count(distinct id) = count(*) valid from (select sample_id, question, unnest(gold_evidence_ids) id from queries) left join chunks on chunk_id = id group by 1")
def extractive_answers(spark, d):
    c = table(spark, d, "chunks").select(F.col("chunk_id").alias("id"), "text")
    q = table(spark, d, "queries").select(F.col("sample_id").alias("key"), "question", F.explode("gold_evidence_ids").alias("id")).join(c, "id", "left")
    claims = q.select("key", "id", F.when(F.length("question") % 2 == 0, F.col("text")).otherwise(F.left("text", F.lit(20))).alias("text"))
    return J.extractive(claims, c)


@R.add("complete_verdicts", "select source_id, list_sort(list(n)) = range(0, count(*)) complete from (select source_id, cast(split_part(chunk_id, ':', 4) as bigint) n from chunks) group by 1")
def complete_verdicts(spark, d):
    c = table(spark, d, "chunks").select("source_id", F.split_part("chunk_id", F.lit(":"), F.lit(4)).cast("int").alias("n"))
    return c.groupBy("source_id").agg(F.collect_list("n").alias("ids")).select("source_id", J.complete_ids(F.col("ids")).alias("complete"))


FAIL = f"case when len(gold) = 0 and decision = 'abstained' then null when len(gold) = 0 and decision = 'answered' then '{J.FALSE_ANSWER}' when len(gold) = 0 then '{J.REVIEW}' when decision = 'answered' and correct then null when decision = 'answered' then '{J.NOISE}' when len(list_filter(gold, lambda x: not list_contains(retrieved, x))) > 0 then '{J.MISSED}' when decision = 'abstained' then '{J.REFUSED}' else '{J.REVIEW}' end"


@R.add("failure_labels", f"with {TRIALS} select split, failure, count(*) n, count(distinct key) queries from (select split, key, {FAIL} failure from tr) group by 1, 2")
def failure_labels(spark, d):
    t = trials(spark, d).select("key", "split", J.failure(F.col("gold"), F.col("retrieved"), F.col("decision"), F.col("selected")).alias("failure"))
    return t.groupBy("split", "failure").agg(F.count("*").alias("n"), F.countDistinct("key").alias("queries"))


@R.add("regression_cases", f"with {TRIALS} select key, failure, array_to_string(list_sort(list_distinct(list_intersect(gold, retrieved))), ',') found from (select *, {FAIL} failure from tr) where failure is not null")
def regression_cases(spark, d):
    t = trials(spark, d).withColumn("failure", J.failure(F.col("gold"), F.col("retrieved"), F.col("decision"), F.col("selected"))).where("failure is not null")
    return t.select("key", "failure", F.array_join(F.array_sort(F.array_intersect("gold", "retrieved")), ",").alias("found"))


LIMITS = [(None, "false_answers", 0.0, 20.0), ("dev", "useful", 50.0, 1e9), ("none", "useful", 1.0, 1e9)]


@R.add("regression_gate", f"with {TRIALS}, r as (select split as \"condition\", 'false_answers' measure, sum((answered and not answerable)::int)::double as value from tr group by 1 union all select split, 'useful', sum((answered and answerable and correct)::int)::double from tr group by 1), l as (select * from (values (null, 'false_answers', 0.0::double, 20.0::double), ('dev', 'useful', 50.0::double, 1e9::double), ('none', 'useful', 1.0::double, 1e9::double)) t(c, measure, low, high)) select \"condition\", measure, value, low, high from r join l using (measure) where (c is null or c = \"condition\") and (value < low or value > high) union all select c, measure, null, low, high from l where c is not null and c not in (select \"condition\" from r)")
def regression_gate(spark, d):
    t = trials(spark, d).groupBy(F.col("split").alias("condition")).agg(F.count_if(F.col("answered") & ~F.col("answerable")).cast("double").alias("false_answers"), F.count_if(F.col("answered") & F.col("answerable") & F.col("correct")).cast("double").alias("useful"))
    r = t.select("condition", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in ("false_answers", "useful")])).alias("x")).select("condition", "x.*")
    return J.violations(r, spark.createDataFrame(LIMITS, "condition string, measure string, low double, high double"))


@R.add("filter_outcomes", "with f as (select sample_id, expected_filters['topic'] e, case when length(question) % 3 > 0 then expected_filters['topic'] when length(question) % 2 = 0 then 'x' end p, length(question) % 7 > 0 ok from queries_authored) select case when e is null and p is null then null when e is not null and not ok then 'gold_unresolvable' when p is null then 'missing' when p is not distinct from e then 'match' else 'mismatch' end outcome, count(*) n from f group by 1")
def filter_outcomes(spark, d):
    q, n = table(spark, d, "queries_authored"), F.length("question")
    e = F.try_element_at("expected_filters", F.lit("topic"))
    f = q.select(e.alias("e"), F.when(n % 3 > 0, e).when(n % 2 == 0, "x").alias("p"), (n % 7 > 0).alias("ok"))
    return f.select(J.filter_outcome(F.col("e"), F.col("p"), F.col("ok")).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


@R.add("replay_differences", f"with {TRIALS}, a as (select key, decision from tr), b as (select key, case when length(question) % 50 = 0 then 'changed' else decision end decision from tr) select key, decision, 'a' side from (select * from a except all select * from b) union all select key, decision, 'b' from (select * from b except all select * from a)")
def replay_differences(spark, d):
    t = trials(spark, d)
    a = t.select("key", "decision", F.lit(1).alias("elapsed_ms"))
    return J.replay_diff(a, t.select("key", F.when(F.length("question") % 50 == 0, "changed").otherwise(F.col("decision")).alias("decision"), F.lit(2).alias("elapsed_ms")), ["elapsed_ms"])


@R.add("supported_claims", f"with {TRIALS} select key, len(gold)::int n from tr where len(gold) > 0 and len(list_filter(gold, lambda x: not list_contains(retrieved, x))) = 0")
def supported_claims(spark, d):
    t = trials(spark, d)
    return J.supported_claims(t.select("key", F.col("question").alias("claim"), F.col("gold").alias("citations")), t.select("key", F.col("retrieved").alias("ids"))).select("key", F.size("citations").alias("n"))


@R.add("check_detection", f"with {TRIALS} select bucket category, answered corrupted, count(*) n, sum(correct::int)::bigint caught, round(sum(correct::int) / count(*), 6) rate from tr group by 1, 2")
def check_detection(spark, d):
    t = trials(spark, d).select(F.col("bucket").alias("category"), F.col("answered").alias("corrupted"), F.col("correct").alias("flagged"))
    return J.detection(t).withColumn("rate", F.round("rate", 6))


@R.add("usage_totals", "select user_id, sum(cast(props->>'k' as bigint))::bigint prompt, sum(event_id)::bigint total from events group by 1")
def usage_totals(spark, d):
    raw = F.concat(F.lit('{"input_tokens": '), F.get_json_object("props", "$.k"), F.lit(', "completion_tokens": 1, "total_tokens": '), F.col("event_id").cast("string"), F.lit("}"))
    e = table(spark, d, "events").select("user_id", J.usage(raw).alias("u"))
    return e.groupBy("user_id").agg(F.sum("u.prompt").alias("prompt"), F.sum("u.total").alias("total"))


@R.add("fenced_answers", "select event_id, props as body from events")
def fenced_answers(spark, d):
    e = table(spark, d, "events")
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit(" "), "props"))
    return e.select("event_id", J.fenced_json(raw).alias("body"))


@R.add("first_observations", "select user_id, event_id, case when row_number() over (partition by user_id, event_type order by event_id) = 1 then left(props, 5) end shown from events")
def first_observations(spark, d):
    return J.first_seen(table(spark, d, "events"), "user_id", "event_id", "event_type", "props", 5).select("user_id", "event_id", "shown")


@R.add("last_labels", "select user_id, event_type, arg_max(value, event_id) as label from events group by 1, 2")
def last_labels(spark, d):
    return J.last_labels(table(spark, d, "events"), "user_id", "event_id", "event_type", "value").select("user_id", "event_type", F.col("value").alias("label"))


@R.add("changed_numbers", f"select sample_id, case when regexp_extract(question, '[0-9]{{1,9}}') = '' then question else regexp_extract(question, '(?s)^[^0-9]*') || (2 * cast(regexp_extract(question, '[0-9]{{1,9}}') as bigint) + 1)::varchar || regexp_replace(question, '^[^0-9]*[0-9]{{1,9}}', '') end question from queries")
def changed_numbers(spark, d):
    return table(spark, d, "queries").select("sample_id", A.change_number(F.col("question")).alias("question"))


@R.add("sign_tests", f"with {TRIALS}, c as (select split, sum((correct and not answered)::int) a, sum((answered and not correct)::int) b from tr group by 1) select split, a::bigint wins, b::bigint losses, round(least(1.0, case when a + b = 0 then 1.0 else 2 * (select sum(exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - (a + b) * ln(2))) from range(0, least(a, b)::bigint + 1) t(i)) end), 6) p_value from c")
def sign_tests(spark, d):
    t = trials(spark, d).groupBy("split").agg(F.count_if(F.col("correct") & ~F.col("answered")).alias("wins"), F.count_if(F.col("answered") & ~F.col("correct")).alias("losses"))
    return t.select("split", "wins", "losses", F.round(M.sign_test(F.col("wins"), F.col("losses")), 6).alias("p_value"))


@R.add("bootstrap_poisson")
def bootstrap_poisson(spark, d):
    return M.bootstrap_poisson(trials(spark, d).withColumn("v", F.col("correct").cast("double")), "split", "v", "key")


@R.add("curve_picks", f"with {TRIALS}, g as (select score s, count(*) c from tr where score is not null group by 1), r as (select s, row_number() over (order by s desc) - 1 i, count(*) over () n from g) select s threshold from r where i in (select floor(j * (n - 1) / 11)::bigint from range(0, 12) t(j))")
def curve_picks(spark, d):
    t = trials(spark, d).where("score is not null")
    return M.curve_picks(M.risk_coverage(t, "score", "correct"), "threshold").select("threshold")
