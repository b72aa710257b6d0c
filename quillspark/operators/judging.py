"""Evaluation beyond rankings: graded relevance, gates and thresholds, grids, label handling, answer and citation checks, reports, gates against regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import metrics as M

LABELS = ("relevant", "partial")
MANY = "array<string>"


def graded(ranking: DataFrame, labels: DataFrame, depth: int = 20) -> DataFrame:
    """One row a judged query: hit@3, reciprocal rank within 10 and recall within `depth` of relevant rows (label 2), nDCG@5 with linear gains of labels 0, 1, 2."""
    good = labels.where("label = 2").groupBy("query_id").agg(F.count("*").alias("n"))
    hit = ranking.where(F.col("rank") <= depth).join(labels.where("label = 2").select("query_id", "id"), ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("first"), F.count("*").alias("found"))
    base = M.graded(ranking, labels, 5).join(good, "query_id", "left").join(hit, "query_id", "left")
    return base.select("query_id", F.coalesce((F.col("first") <= 3).cast("int"), F.lit(0)).alias("hit_3"), F.when(F.col("first") <= 10, 1 / F.col("first")).otherwise(0.0).alias("rr"), M.ratio(F.coalesce("found", F.lit(0)), F.col("n")).alias("recall"), "ndcg")


def gated(items: DataFrame, taus: DataFrame) -> DataFrame:
    """(tau, blocked, answered, useful, false_answers, over_refusals) of items (score, answerable, answered, correct): a row is blocked where its score is below tau, so tau itself answers; a null score is below all.

    Items are counted a score first, and the thresholds (tau) are rows among the scores, so the counts at or above each come from one running sum."""
    low, high = -1e308, 1e308
    bounded = lambda c: F.greatest(F.least(c, F.lit(high)), F.lit(low))
    kinds = _kinds()
    g = items.groupBy(bounded(F.coalesce("score", F.lit(low))).alias("v")).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in kinds.items()], F.count_if("answerable").alias("due")).withColumn("t", F.lit(0))
    names = ["n", *kinds, "due"]
    t = taus.select(bounded(F.col("tau")).alias("v"), *[F.lit(0).cast("bigint").alias(k) for k in names], F.lit(1).alias("t"))
    r = M.running(g.unionByName(t).groupBy("v").agg(*[F.sum(k).alias(k) for k in names], F.max("t").alias("t")), "v", names).where("t = 1")
    kept = {k: F.col(f"{k}_all") - F.col(f"{k}_to") + F.col(k) for k in names}
    tau = F.when(F.col("v") == low, float("-inf")).when(F.col("v") == high, float("inf")).otherwise(F.col("v"))
    right = kept["useful"] + kept["off"]
    return r.select(tau.alias("tau"), (F.col("n_all") - kept["n"]).alias("blocked"), (right + kept["false_answers"]).alias("answered"), kept["useful"].alias("useful"), kept["false_answers"].alias("false_answers"), (F.col("due_all") - right).alias("over_refusals"))


def _kinds() -> dict[str, Column]:
    a, d, c = F.col("answerable"), F.col("answered"), F.col("correct")
    return {"useful": a & d & c, "off": a & d & ~c, "false_answers": ~a & d}


def score_only(items: DataFrame, taus: DataFrame) -> DataFrame:
    """The same curve where every row at or above tau is answered."""
    return gated(items.withColumn("answered", F.lit(True)), taus)


def budget_tau(items: DataFrame, budget: float) -> DataFrame:
    """(tau): the largest threshold that blocks at most floor(budget n) of the answerable items: the middle between the scores around that rank, or the score itself in a tie."""
    s = items.where("answerable").select(F.coalesce("score", F.lit(float("-inf"))).alias("s")).groupBy("s").agg(F.count("*").alias("c"))
    r = M.running(s, "s", ["c"]).withColumn("allowed", F.floor(F.lit(budget) * F.col("c_all")))
    low = F.max(F.when((F.col("c_to") - F.col("c") < F.col("allowed")), F.col("s")))
    high = F.min(F.when(F.col("c_to") > F.col("allowed"), F.col("s")))
    return r.agg(F.max("allowed").alias("a"), F.max("c_all").alias("n"), low.alias("low"), high.alias("high")).select(F.when(F.col("a") <= 0, float("-inf")).when(F.col("a") >= F.col("n"), float("inf")).when(F.col("high") > F.col("low"), (F.col("low") + F.col("high")) / 2).otherwise(F.col("low")).alias("tau"))


def youden_tau(items: DataFrame) -> DataFrame:
    """(tau, utility): of minus infinity and all scores the smallest threshold with the largest useful minus false rate, answering from the score alone."""
    i = items.withColumn("s", F.coalesce("score", F.lit(float("-inf"))))
    g = i.groupBy("s").agg(F.count_if(F.col("answerable") & F.col("correct")).alias("u"), F.count_if(~F.col("answerable")).alias("f"), F.count_if("answerable").alias("d"))
    low = items.sparkSession.range(1).select(F.lit(float("-inf")).alias("s"), *[F.lit(0).cast("bigint").alias(k) for k in "ufd"])
    g = g.unionByName(low).groupBy("s").agg(*[F.sum(k).alias(k) for k in "ufd"])
    r = M.running(g.withColumn("o", F.when(F.col("s") == float("-inf"), -1e308).otherwise(F.col("s"))), "o", ["u", "f", "d"])
    rate = F.coalesce(M.ratio(F.col("u_all") - F.col("u_to") + F.col("u"), F.col("d_all")), F.lit(0.0)) - F.coalesce(M.ratio(F.col("f_all") - F.col("f_to") + F.col("f"), F.col("f_all")), F.lit(0.0))
    return r.select(F.col("s").alias("tau"), rate.alias("utility")).orderBy(F.round("utility", 12).desc(), "tau").limit(1)


def best_setting(grid: DataFrame, measures: list[str], smaller: str) -> DataFrame:
    """The row with the largest measures, compared in order; ties go to the smaller setting."""
    return grid.orderBy(*[F.round(m, 12).desc() for m in measures], smaller).limit(1)


def distractors(docs: DataFrame, gold: DataFrame, sizes: list[int], seeds: int, key: str = "doc") -> DataFrame:
    """(size, seed, doc): for each size and seed the gold documents and others by hash up to that number of documents."""
    runs = F.explode(F.array(*[F.struct(F.lit(s).alias("size"), F.lit(r).alias("seed")) for s in sizes for r in range(seeds)])).alias("r")
    d = docs.select(key).distinct().join(gold.select(key).distinct().withColumn("g", F.lit(0)), key, "left").select(key, F.coalesce("g", F.lit(1)).alias("g"), runs).select(key, "g", "r.size", "r.seed")
    h = F.sha1(F.concat_ws(":", F.col("seed").cast("string"), F.col(key).cast("string")))
    w = Window.partitionBy("size", "seed").orderBy("g", h, key)
    return d.withColumn("n", F.row_number().over(w)).where((F.col("n") <= F.col("size")) | (F.col("g") == 0)).select("size", "seed", key)


def matrix(df: DataFrame, by: str, system: str, systems: list[str], measures: list[str]) -> DataFrame:
    """(by, measure, one column a system): mean measures of many systems side by side."""
    long = df.select(by, system, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in measures])).alias("x")).select(by, system, "x.measure", "x.v")
    return long.groupBy(by, "measure").pivot(system, systems).agg(F.avg("v"))


def pooled_sentences(pool: DataFrame) -> DataFrame:
    """(query_id, doc, pos, sentence, hash): distinct sentences of the pool (query_id, doc, pos, sentence), each at its first place."""
    s = pool.withColumn("hash", F.sha2(T.squash(F.col("sentence")), 256))
    w = Window.partitionBy("query_id", "hash").orderBy("doc", "pos")
    return s.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def batches(pool: DataFrame, by: str, order: str, size: str, limit: int, extra: int = 30) -> DataFrame:
    """Rows with a batch number: passages in order go into a batch while its sizes, each plus `extra`, stay within the limit; a passage is never cut. A fold over the passages of one query."""
    kind = dict(pool.dtypes)[order]
    x = pool.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), (F.col(size) + extra).cast("bigint").alias("n")))).alias("x"))
    init = F.struct(F.lit(0).alias("b"), F.lit(0).cast("bigint").alias("held"), F.array().cast(f"array<struct<o:{kind},b:int>>").alias("out"))

    def step(a, p):
        new = (a["held"] > 0) & (a["held"] + p["n"] > limit)
        b = a["b"] + new.cast("int")
        return F.struct(b.alias("b"), F.when(new, p["n"]).otherwise(a["held"] + p["n"]).alias("held"), F.array_append(a["out"], F.struct(p["o"].alias("o"), b.alias("b"))).alias("out"))

    return x.select(by, F.explode(F.aggregate("x", init, step, lambda a: a["out"])).alias("r")).select(by, F.col("r.o").alias(order), F.col("r.b").alias("batch"))


def parsed_labels(c: Column, valid: Column) -> Column:
    """Labels of ids from a JSON object of lists (relevant, partial) as array<struct<id,label>>; null for anything else: other keys, unknown or repeated ids, no object."""
    parsed = F.from_json(c, "relevant array<string>, partial array<string>")
    keys = F.json_object_keys(c)
    none = F.array().cast(MANY)
    ids = F.concat(F.coalesce(parsed["relevant"], none), F.coalesce(parsed["partial"], none))
    ok = keys.isNotNull() & (F.size(F.array_except(keys, F.array(*[F.lit(x) for x in LABELS]))) == 0) & (F.size(F.array_except(ids, valid)) == 0) & (F.size(F.array_distinct(ids)) == F.size(ids))
    out = F.concat(*[F.transform(F.coalesce(parsed[x], none), _labelled(x)) for x in LABELS])
    return F.when(ok, out)


def _labelled(label: str):
    return lambda i: F.struct(i.alias("id"), F.lit(label).alias("label"))


def projected(chunks: DataFrame, sentences: DataFrame) -> DataFrame:
    """(query_id, chunk_id, label): the highest label (0, 1, 2) among the judged sentences of a chunk's document that contain it or that it contains, white space aside; 0 without one.

    chunks: (chunk_id, doc, text), sentences: (query_id, doc, sentence, label)."""
    c = chunks.where("text is not null").select("chunk_id", "doc", T.squash(F.col("text")).alias("c"))
    s = sentences.select("query_id", "doc", T.squash(F.col("sentence")).alias("s"), "label").where("s <> ''")
    meets = F.contains("c", F.col("s")) | F.contains("s", F.col("c"))
    return c.join(s, "doc").groupBy("query_id", "chunk_id").agg(F.max(F.when(meets, F.col("label")).otherwise(0)).alias("label"))


def answerable(labels: DataFrame) -> DataFrame:
    """(query_id, answerable, partial_only): whether any row is relevant, or only partly so."""
    return labels.groupBy("query_id").agg(F.bool_or(F.col("label") == 2).alias("answerable"), (~F.bool_or(F.col("label") == 2) & F.bool_or(F.col("label") == 1)).alias("partial_only"))


def repeatability(trials: DataFrame) -> DataFrame:
    """(queries, same_decision, same_selection) over trials (query_id, decision, selected)."""
    q = trials.groupBy("query_id").agg(F.countDistinct("decision").alias("d"), F.count_distinct(F.array_join(F.array_sort("selected"), ",")).alias("s"))
    return q.agg(F.count("*").alias("queries"), F.count_if(F.col("d") == 1).alias("same_decision"), F.count_if(F.col("s") == 1).alias("same_selection"))


def gained_lost(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(by, gained, lost, both): rows (key, ok, by) of two systems compared; also over all groups (null)."""
    j = a.join(b.select("key", F.col("ok").alias("ok_b")), "key")
    return j.rollup(*by).agg(F.count_if(~F.col("ok") & F.col("ok_b")).alias("gained"), F.count_if(F.col("ok") & ~F.col("ok_b")).alias("lost"), F.count_if(F.col("ok") & F.col("ok_b")).alias("both"))


def faithfulness(verdicts: DataFrame, by: str) -> DataFrame:
    """(by, statements, faithful, partial_share): share of statements that are entailed, and that are entailed in part."""
    v = F.col("verdict")
    return verdicts.groupBy(by).agg(F.count("*").alias("statements"), F.avg((v == "entailed").cast("int")).alias("faithful"), F.avg((v == "partial").cast("int")).alias("partial_share"))


def mean_cosine(pairs: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """(by, n, relevancy): mean cosine of two vector columns."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)

    cos = dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-12))
    return pairs.groupBy(by).agg(F.count("*").alias("n"), F.avg(cos).alias("relevancy"))


def entailment_items(statements: DataFrame) -> DataFrame:
    """(key, kind, item, citation): what is to be judged of statements (key, statement, citations): all citations together, each alone where there are several, the statement against its whole evidence."""
    n = F.size("citations")
    every = F.array(F.struct(F.lit("all").alias("kind"), F.lit(0).alias("item"), F.array_join("citations", ",").alias("citation")), F.struct(F.lit("faith").alias("kind"), F.lit(0).alias("item"), F.lit("").alias("citation")))
    alone = F.transform("citations", lambda c, i: F.struct(F.lit("alone").alias("kind"), i.alias("item"), c.alias("citation")))
    items = F.when(n > 1, F.concat(every, alone)).when(n == 1, every).otherwise(F.slice(every, 2, 1))
    return statements.select("key", F.explode(items).alias("x")).select("key", "x.*")


def cited_answer_issue(quote: Column, source: Column, claim: Column, forbidden: str, least: int = 8) -> Column:
    """The first rule a cited statement breaks: missing_citation, short_quote, not_verbatim, forbidden, number_unsupported; null where it holds. White space doesn't count."""
    q = T.squash(quote)
    numbers = F.regexp_extract_all(claim, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    return F.when(source.isNull(), "missing_citation").when(F.length(q) < least, "short_quote").when(~F.contains(T.squash(source), q), "not_verbatim").when(claim.rlike(forbidden), "forbidden").when(~F.forall(numbers, lambda x: F.contains(quote, x)), "number_unsupported")


def extractive(claims: DataFrame, chunks: DataFrame, most: int = 3) -> DataFrame:
    """(key, valid): whether all claims (key, id, text) of an answer are whole chunks, different ones, and at most `most`."""
    j = claims.join(chunks.select("id", F.col("text").alias("_own")), "id", "left")
    return j.groupBy("key").agg((F.bool_and(F.coalesce(F.col("text") == F.col("_own"), F.lit(False))) & (F.count("*") <= most) & (F.countDistinct("id") == F.count("*"))).alias("valid"))


def complete_ids(ids: Column) -> Column:
    """Whether the ids are 0 .. n-1, each once."""
    return F.array_sort(ids) == F.when(F.size(ids) > 0, F.sequence(F.lit(0), F.size(ids) - 1)).otherwise(F.array().cast("array<int>"))


def displayed(verdicts: DataFrame) -> DataFrame:
    """(key, shown, mode): statements shown are those entailed or partly so; an answer with none falls back to extracts where it has any, else it is refused."""
    g = verdicts.groupBy("key").agg(F.count_if(F.col("verdict").isin("entailed", "partial")).alias("shown"), F.max("extracts").alias("e"))
    return g.select("key", "shown", F.when(F.col("shown") > 0, "generated").when(F.col("e") > 0, "extractive").otherwise("refused").alias("mode"))


# The labels of failures.
FALSE_ANSWER, NOISE, MISSED, REFUSED, REVIEW = "应拒答而作答", "检索噪声", "检索未命中", "过度拒答", "review"


def failure(gold: Column, retrieved: Column, decision: Column, selected: Column) -> Column:
    """Why an answer fails, by the first cause in the order of the pipeline; null where it doesn't. Blocked answers with all evidence at hand go to review."""
    none = F.array().cast(MANY)
    has, right = F.size(gold) > 0, F.arrays_overlap(F.coalesce(selected, none), gold)
    missing = F.size(F.array_except(gold, F.coalesce(retrieved, none))) > 0
    out = F.when(~has & (decision == "abstained"), None).when(~has & (decision == "answered"), FALSE_ANSWER).when(~has, REVIEW)
    return out.when((decision == "answered") & right, None).when(decision == "answered", NOISE).when(missing, MISSED).when(decision == "abstained", REFUSED).otherwise(REVIEW)


def violations(report: DataFrame, limits: DataFrame) -> DataFrame:
    """(condition, measure, value, low, high): report rows (condition, measure, value) outside their limits (condition or null for all, measure, low, high), and limits whose condition the report lacks (value null)."""
    j = report.join(limits.withColumnRenamed("condition", "_c"), "measure").where(F.col("_c").isNull() | (F.col("_c") == F.col("condition")))
    out = j.where((F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))).select("condition", "measure", "value", "low", "high")
    lost = limits.where("condition is not null").join(report, ["condition", "measure"], "left_anti").select("condition", "measure", F.lit(None).cast("double").alias("value"), "low", "high")
    return out.unionByName(lost)


def filter_outcome(expected: Column, predicted: Column, resolvable: Column) -> Column:
    """match, mismatch, missing or gold_unresolvable of a predicted filter value beside the expected one; null where neither is set."""
    return F.when(expected.isNull() & predicted.isNull(), None).when(expected.isNotNull() & ~resolvable, "gold_unresolvable").when(predicted.isNull(), "missing").when(predicted.eqNullSafe(expected), "match").otherwise("mismatch")


def replay_diff(a: DataFrame, b: DataFrame, ignore: list[str]) -> DataFrame:
    """Rows that only one of two runs has, columns of timing left out, with the side."""
    cols = [c for c in a.columns if c not in ignore]
    x, y = a.select(*cols), b.select(*cols)
    return x.exceptAll(y).withColumn("side", F.lit("a")).unionByName(y.exceptAll(x).withColumn("side", F.lit("b")))


def supported_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims (key, claim, citations) whose citations aren't empty and all in the evidence (key, ids)."""
    return claims.join(evidence, "key").where((F.size("citations") > 0) & (F.size(F.array_except("citations", "ids")) == 0)).select("key", "claim", "citations")


def detection(checks: DataFrame) -> DataFrame:
    """(category, n, caught, rate): of checks (category, corrupted, flagged) the share of corrupted rows flagged, and of clean ones rejected."""
    return checks.groupBy("category", "corrupted").agg(F.count("*").alias("n"), F.count_if("flagged").alias("caught")).withColumn("rate", M.ratio(F.col("caught"), F.col("n")))


def usage(c: Column) -> Column:
    """Token usage under its several names as struct<prompt,completion,total>; the total is the sum where it is missing."""
    m = F.from_json(c, "map<string,bigint>")
    p = F.coalesce(m["prompt_tokens"], m["input_tokens"])
    q = F.coalesce(m["completion_tokens"], m["output_tokens"])
    return F.struct(p.alias("prompt"), q.alias("completion"), F.coalesce(m["total_tokens"], p + q).alias("total"))


def fenced_json(c: Column) -> Column:
    """The JSON text of an answer that may stand in a code fence."""
    inner = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.trim(F.when(inner != "", inner).otherwise(c))


def first_seen(observations: DataFrame, by: str, order: str, key: str, text: str, cut: int = 400) -> DataFrame:
    """Observations with their text, cut, only where the key comes up first."""
    w = Window.partitionBy(by, key).orderBy(order)
    return observations.withColumn("shown", F.when(F.row_number().over(w) == 1, F.left(F.col(text), F.lit(cut))))


def last_labels(labels: DataFrame, by: str, order: str, key: str, label: str) -> DataFrame:
    """(by, key, label): the last label of each key."""
    return labels.groupBy(by, key).agg(F.max_by(label, order).alias(label))
