"""The retrieval pipeline around the rankers: merging, reranking, metadata filters with relaxation, query variants, selection, frozen evidence."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import rank as K
from quillspark.session import staged

KEYS = ("topic", "section_type", "source_type", "period")
SENT = 20_000  # rows of needles or pieces sent to every task at most
SENT_CHARS = 4_000_000  # and characters in them
KEYWORDS = 500  # keywords that every name is compared with at most; beyond, they meet by their first characters
RELAX = ("section_type", "topic", "source_type", "period")


def merged(lists: list[DataFrame], pool: int = 3, k: int = K.RRF_K) -> DataFrame:
    """(query_id, id, rank): the `pool` best of several rankings by reciprocal rank; ties go to what appears first, by list and rank."""
    f = K.rrf(lists, k)
    w = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "first.src", "first.r")
    return f.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= pool).select("query_id", "id", "rank", "score")


def once(hits: DataFrame) -> DataFrame:
    """Hits (query_id, id, rank) with the first of each id only."""
    w = Window.partitionBy("query_id", "id").orderBy("rank")
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def rerank(hits: DataFrame, scores: DataFrame, top_n: int) -> DataFrame:
    """(query_id, id, score, rank): distinct hits by their pair score (query_id, id, score), ties by id; a hit without a score fails the query."""
    s = scores.select("query_id", "id", F.col("score").alias("_s"))
    j = once(hits).select("query_id", "id").join(s, ["query_id", "id"], "left")
    checked = j.withColumn("score", F.coalesce("_s", F.raise_error(F.concat(F.lit("no score of "), F.col("id").cast("string"))).cast("double"))).drop("_s")
    return K.top(checked, top_n)


def memoised(pairs: DataFrame, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every row of (query_id, id) with its score; each distinct pair is scored once."""
    return pairs.join(scorer(pairs.select("query_id", "id").distinct()), ["query_id", "id"])


def pipeline(candidates: DataFrame, scores: DataFrame, vectors: DataFrame | None, top_k: int, weight: float = 0.7) -> DataFrame:
    """(query_id, id, rank): candidates reranked, a pool of twice top_k diversified where vectors are given, top_k left."""
    pool = rerank(candidates, scores, top_k if vectors is None else 2 * top_k)
    return pool.select("query_id", "id", "rank") if vectors is None else K.mmr(pool.select("query_id", "id", "score"), vectors, top_k, weight)


def validated(filters: DataFrame, enums: dict[str, list[str]], periods: DataFrame, topics: DataFrame) -> DataFrame:
    """(query_id, key, value, reason) of filters (query_id, key, value): reason is null for those that hold; "latest" becomes the last period.

    periods: (period); topics: (value) of the topics that resolve to a document."""
    last = periods.agg(F.max("period").alias("last"))
    f = filters.crossJoin(F.broadcast(last)).withColumn("v", F.trim("value"))
    f = f.withColumn("v", F.when((F.col("key") == "period") & (F.col("v") == "latest"), F.col("last")).otherwise(F.col("v")))
    f = f.join(periods.select(F.col("period").alias("v"), F.lit(True).alias("p")).distinct(), "v", "left").join(topics.select(F.col("value").alias("v"), F.lit(True).alias("t")).distinct(), "v", "left")
    reason = F.when(~F.col("key").isin(*KEYS), "unknown_key").when(F.coalesce(F.trim("value"), F.lit("")) == "", "invalid_value")
    for key, values in enums.items():
        reason = reason.when((F.col("key") == key) & ~F.col("v").isin(*values), "not_in_enum")
    reason = reason.when((F.col("key") == "period") & (F.trim("value") == "latest") & F.col("last").isNull(), "no_period_in_corpus").when((F.col("key") == "period") & F.col("p").isNull(), "not_in_corpus").when((F.col("key") == "topic") & F.col("t").isNull(), "unknown_topic")
    return f.select("query_id", "key", F.when(reason.isNull(), F.col("v")).otherwise(F.col("value")).alias("value"), reason.alias("reason"))


def _sendable(df: DataFrame, text: str, rows: int) -> bool:
    """Whether df has at most so many rows, and SENT_CHARS characters of text in them: a few long texts fill the driver as many rows do."""
    got = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("chars")).first()
    return got.n <= rows and (got.chars or 0) <= SENT_CHARS


def contained(needles: DataFrame, hays: DataFrame, needle: str, hay: str) -> DataFrame:
    """Distinct (needle, hay) where the hay contains the needle of at least two characters: an equi-join on the needle's first two characters, then the check.

    Needles or pieces of hays are sent to the tasks where they are few and short, and the other side stays where it is read."""
    n = staged(needles.select(F.col(needle).alias("needle")).where("length(needle) >= 2").distinct().withColumn("g", F.left("needle", F.lit(2))), "needles")
    h = staged(hays.select(F.col(hay).alias("hay")).where("length(hay) >= 2").distinct(), "hays")
    cut = h.select("hay", F.explode(F.array_distinct(F.regexp_extract_all("hay", F.lit("(?s)(?=(..))"), F.lit(1)))).alias("g"))
    n, cut = (F.broadcast(x) if _sendable(x, text, SENT) else x for x, text in ((n, "needle"), (cut, "hay")))
    return cut.join(n, "g").where(F.contains("hay", F.col("needle"))).select("needle", "hay")


def resolved_topics(values: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(value, doc): documents a topic value stands for. A keyword matches a name that contains it, or one of at least three characters that it contains.

    values: (value) normalised; names: (doc, name); aliases: (alias, target): a value that contains an alias gets its target as a further keyword.
    Few keywords are sent to the names, which are read once and not shuffled; more than KEYWORDS meet them by pieces."""
    v = values.select("value").where("length(value) >= 2").distinct()
    more = v.join(F.broadcast(aliases), F.contains("value", F.col("alias"))).where("length(alias) >= 2").select("value", F.col("target").alias("keyword"))
    keys = staged(v.select("value", F.col("value").alias("keyword")).unionByName(more).where("length(keyword) >= 2").distinct(), "keywords")
    if _sendable(keys, "keyword", KEYWORDS):
        met = F.contains("name", F.col("keyword")) | ((F.length("name") >= 3) & F.contains("keyword", F.col("name")))
        return names.join(F.broadcast(keys), met).select("value", "doc").distinct()
    names = staged(names.distinct(), "names")
    inside = contained(keys, names, "keyword", "name").select(F.col("needle").alias("keyword"), F.col("hay").alias("name"))
    around = contained(names.where("length(name) >= 3"), keys, "name", "keyword").select(F.col("hay").alias("keyword"), F.col("needle").alias("name"))
    return keys.join(inside.unionByName(around).distinct(), "keyword").join(names, "name").select("value", "doc").distinct()


def allowed(index: DataFrame, filters: DataFrame, keys: tuple[str, ...] = ("section_type", "source_type", "period")) -> DataFrame:
    """(query_id, id) of the index rows that meet all conditions of a query; filters: (query_id, one column a key, null where free).

    An equi-join for each set of keys that occurs; queries without any condition are free and not listed."""
    out = None
    for n in range(1, len(keys) + 1):
        for used in combinations(keys, n):
            free = [k for k in keys if k not in used]
            f = filters
            for k in used:
                f = f.where(F.col(k).isNotNull())
            for k in free:
                f = f.where(F.col(k).isNull())
            one = index.select("id", *used).join(f.select("query_id", *used), list(used)).select("query_id", "id")
            out = one if out is None else out.unionByName(one)
    return out


def relaxation(results: DataFrame, least: int) -> DataFrame:
    """(query_id, level, results, chosen) of (query_id, level, n): attempts up to the first level with enough results, else to the last."""
    w = Window.partitionBy("query_id")
    enough = F.min(F.when(F.col("n") >= least, F.col("level"))).over(w)
    stop = F.coalesce(enough, F.max("level").over(w))
    return results.withColumn("stop", stop).where(F.col("level") <= F.col("stop")).select("query_id", "level", F.col("n").alias("results"), (F.col("level") == F.col("stop")).alias("chosen"))


def history_query(turns: DataFrame, by: str, order: str, question: str, last: int = 3) -> DataFrame:
    """(by, order, latest, joined): each turn's question alone and after those of the `last` turns before it."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-last, 0)
    return turns.select(by, order, F.col(question).alias("latest"), F.array_join(F.collect_list(question).over(w), " ").alias("joined"))


def accepted_rewrite(rewrite: Column, seen: Column, limit: int = 120) -> Column:
    """Whether a rewrite is usable: not empty, one line, at most `limit` characters, no number that wasn't seen."""
    numbers = F.regexp_extract_all(rewrite, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    return F.coalesce((F.trim(rewrite) != "") & (F.length(rewrite) <= limit) & ~F.contains(rewrite, F.lit("\n")) & F.forall(numbers, lambda x: F.contains(seen, x)), F.lit(False))


def selection(observed: Column, incorrect: Column, chosen: Column, sufficient: Column) -> Column:
    """Evidence kept of the observed ids: the chosen ones if any are named, without those labelled incorrect; none where it doesn't suffice."""
    none = F.array().cast("array<string>")
    base = F.when(F.size(F.coalesce(chosen, none)) > 0, F.filter(chosen, lambda x: F.array_contains(observed, x))).otherwise(observed)
    return F.when(sufficient, F.array_except(base, F.coalesce(incorrect, none))).otherwise(none)


def fallback(observed: Column, incorrect: Column, first: Column) -> Column:
    """What is kept without a selection: observed ids that aren't labelled incorrect, and the first hits, in order."""
    return F.array_distinct(F.concat(F.array_except(observed, incorrect), first))


def frozen(evidence: DataFrame, queries: DataFrame, corpus_hash: str, config_hash: str) -> DataFrame:
    """(query_id, bundle_id, n): a content address of each query's evidence (query_id, rank, id, text): the hash of a canonical JSON of query, corpus, settings and ordered ids with text hashes."""
    e = evidence.select("query_id", "rank", F.struct(F.sha2("text", 256).alias("chunk_hash"), F.col("id").alias("chunk_id")).alias("e"))
    e = e.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "e"))), lambda x: x["e"]).alias("evidence"))
    seed = F.to_json(F.struct(F.lit(corpus_hash).alias("corpus_hash"), F.col("evidence"), F.col("query"), F.lit(config_hash).alias("retrieval_config_hash")))
    return queries.join(e, "query_id").select("query_id", F.concat(F.lit("eb_"), F.left(F.sha2(seed, 256), F.lit(24))).alias("bundle_id"), F.size("evidence").alias("n"))


def fingerprint(chunks: DataFrame, by: str, key: str, text: str) -> DataFrame:
    """(by, fingerprint): the first 16 hex digits of the hash of the JSON list of [id, text] in id order."""
    pairs = F.array_sort(F.collect_list(F.array(F.col(key), F.coalesce(F.col(text), F.lit("")))))
    return chunks.groupBy(by).agg(F.left(F.sha2(F.to_json(pairs), 256), F.lit(16)).alias("fingerprint"))


def lookups(store: DataFrame) -> DataFrame:
    """(status, docs, rows): documents and versions of a store by status."""
    return store.groupBy("status").agg(F.countDistinct("doc").alias("docs"), F.count("*").alias("rows"))


def by_hash(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """Versions with a wanted content hash, retired ones included."""
    return store.join(wanted.select("content_hash").distinct(), "content_hash", "left_semi")


def cache_log(requests: DataFrame, key: str, time: str, ttl_s: int) -> DataFrame:
    """Requests with whether a cache of unlimited size and a time to live would have served them: an entry lives from its filling on, hits don't prolong it.

    A fold over the requests of one key in order of time."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    kind = "array<struct<t:bigint,hit:boolean>>"
    init = F.struct(F.lit(None).cast("bigint").alias("filled"), F.array().cast(kind).alias("o"))

    def step(a, t):
        hit = F.coalesce(t - a["filled"] < ttl_s * 1_000_000, F.lit(False))
        return F.struct(F.when(hit, a["filled"]).otherwise(t).alias("filled"), F.array_append(a["o"], F.struct(t.alias("t"), hit.alias("hit"))).alias("o"))

    return requests.groupBy(key).agg(F.array_sort(F.collect_list(at)).alias("x")).select(key, F.explode(F.aggregate("x", init, step, lambda a: a["o"])).alias("r")).select(key, F.col("r.t").alias("at_us"), F.col("r.hit").alias("hit"))
