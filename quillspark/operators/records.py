"""Records around the corpus and the event log: transitions, leases, traces, audits, maps between corpora, gold sets, leakage gates, paragraph duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import dedup as D
from quillspark.session import staged

# --- event log ---


def checked_transitions(events: DataFrame, relation: DataFrame, terminal: list[str], by: str = "case_id", order: str = "id") -> DataFrame:
    """Transitions (from_status, to_status, trigger_subject) with their verdict: repeat (the state itself), terminal (out of a final state), unknown (not in the relation), illegal (from another state than the one held), ok.

    relation: (from_status, trigger_subject, to_status), a few rows, null from_status for the start."""
    w = Window.partitionBy(by).orderBy(order)
    e = events.where("to_status is not null").withColumn("held", F.lag("to_status").over(w))
    r = relation.select(F.col("from_status").alias("_f"), F.col("trigger_subject").alias("_s"), F.col("to_status").alias("_t")).distinct().withColumn("known", F.lit(True))
    j = e.join(F.broadcast(r), F.col("from_status").eqNullSafe(F.col("_f")) & F.col("trigger_subject").eqNullSafe(F.col("_s")) & (F.col("to_status") == F.col("_t")), "left")
    verdict = F.when(F.col("from_status") == F.col("to_status"), "repeat").when(F.col("from_status").isin(terminal), "terminal").when(F.col("known").isNull(), "unknown").when(~F.col("from_status").eqNullSafe(F.col("held")), "illegal").otherwise("ok")
    return j.withColumn("verdict", verdict).drop("_f", "_s", "_t", "known")


def successors(relation: DataFrame) -> DataFrame:
    """(from_status, to_status): distinct states one step away, whoever triggers it."""
    return relation.where("from_status is not null").select("from_status", "to_status").distinct()


def reachable(relation: DataFrame, depth: int = 16) -> DataFrame:
    """(from_status, to_status, steps): all states that can be reached, with the fewest steps, up to `depth`; each round is a staged table of at most states squared rows."""
    one = staged(successors(relation), "one-step")
    out = front = staged(one.withColumn("steps", F.lit(1)), "reached")
    for n in range(2, depth + 1):
        nxt = front.select("from_status", F.col("to_status").alias("_v")).join(one.select(F.col("from_status").alias("_v"), "to_status"), "_v").select("from_status", "to_status").distinct()
        front = staged(nxt.join(out, ["from_status", "to_status"], "left_anti").withColumn("steps", F.lit(n)), "reached")
        if not front.limit(1).count():
            break
        out = out.unionByName(front)
    return out


def leases(tasks: DataFrame, until: str, now: Column) -> DataFrame:
    """Tasks with whether their lease has expired (strictly before now) and may be reclaimed (at the latest now)."""
    return tasks.withColumn("expired", F.coalesce(F.col(until) < now, F.lit(False))).withColumn("reclaimable", F.coalesce(F.col(until) <= now, F.lit(False)))


def desynchronised(tasks: DataFrame, cases: DataFrame) -> DataFrame:
    """Tasks (task_id, case_id) with a valid lease whose case points at another task or none."""
    return tasks.where("valid").join(cases.select("case_id", F.col("active_task_id").alias("task_id")), ["case_id", "task_id"], "left_anti")


def observed(events: DataFrame, by: str) -> DataFrame:
    """(by, latency_ms, calls, tokens): sums over an event log; a sum without any value stays null, which is not 0."""
    d = F.from_json("detail", "latency_ms bigint, total_tokens bigint")
    return events.select(by, "event_type", d["latency_ms"].alias("l"), d["total_tokens"].alias("t")).groupBy(by).agg(F.sum("l").alias("latency_ms"), F.count_if(F.col("event_type") == "provider_call").alias("calls"), F.sum("t").alias("tokens"))


def enriched(events: DataFrame, artifacts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Events with the last artifact of their (case_id, stage, attempt), the start reckoned back from their latency, and the text of their error code.

    artifacts: (case_id, stage, attempt, artifact_id, value); catalogue: (code, message), a few rows."""
    last = artifacts.groupBy("case_id", "stage", "attempt").agg(F.max(F.struct("artifact_id", "value")).alias("a"))
    j = events.join(last, ["case_id", "stage", "attempt"], "left").join(F.broadcast(catalogue), "code", "left")
    start = F.timestamp_micros(F.unix_micros(F.col("created_at").cast("timestamp")) - F.col("latency_ms") * 1000)
    return j.withColumn("artifact", F.col("a.value")).withColumn("started_at", start).drop("a")


def attempts_of(calls: DataFrame, by: str, order: str, status: str) -> DataFrame:
    """(by, attempts, retries, outcome): provider attempts in order: succeeded, or the last kind of failure."""
    g = calls.groupBy(by).agg(F.count("*").alias("attempts"), F.max_by(status, order).alias("last"))
    return g.select(by, "attempts", (F.col("attempts") - 1).alias("retries"), F.when(F.col("last") == "ok", "succeeded").otherwise(F.concat(F.lit("failed:"), "last")).alias("outcome"))


def versions(reports: DataFrame, by: str, order: str) -> DataFrame:
    """Reports with their version: how many of their case came before, plus one."""
    return reports.withColumn("version", F.row_number().over(Window.partitionBy(by).orderBy(order)))


def audited(cases: DataFrame, events: DataFrame, closing: str) -> DataFrame:
    """(case_id, issue): closed cases without exactly one closing event, open ones with any, and states reached twice."""
    closed = events.where(F.col("to_status").rlike(closing)).groupBy("case_id").agg(F.count("*").alias("n"))
    c = cases.select("case_id", F.col("status").rlike(closing).alias("closed")).join(closed, "case_id", "left").fillna(0, ["n"])
    ends = c.select("case_id", F.when(F.col("closed") & (F.col("n") != 1), "closing_events").when(~F.col("closed") & (F.col("n") > 0), "closed_again").alias("issue")).where("issue is not null")
    twice = events.where("to_status is not null").groupBy("case_id", "to_status").count().where("count > 1").select("case_id", F.concat(F.lit("repeated:"), "to_status").alias("issue"))
    return ends.unionByName(twice)


def citation_rows(verdicts: DataFrame, claims: DataFrame, verifier: str, revision: str) -> DataFrame:
    """(key, claim_id, claim, chunk_id, verdict, verified_by): a row a citation that was judged."""
    v = verdicts.select("key", F.explode("verdicts").alias("v")).select("key", "v.*")
    return v.join(claims, ["key", "claim_id"]).select("key", "claim_id", "claim", "chunk_id", "verdict", F.concat_ws("@", F.lit(verifier), F.lit(revision)).alias("verified_by"))


# --- corpora ---


def url_map(old: DataFrame, new: DataFrame, aliases: DataFrame) -> DataFrame:
    """(old_doc, new_doc): documents of two corpora by URL, in lower case without scheme, www, query and last slash; aliases (url, target) stand for another URL."""
    def bare(c):
        return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"^https?://(www\.)?", ""), r"[?#].*$|/+$", "")

    o = old.select(F.col("doc").alias("old_doc"), bare(F.col("url")).alias("u"))
    a = F.broadcast(aliases.select(bare(F.col("url")).alias("u"), bare(F.col("target")).alias("_to")).distinct())
    n = new.select(F.col("doc").alias("new_doc"), bare(F.col("url")).alias("u")).groupBy("u").agg(F.min("new_doc").alias("new_doc"))
    return o.join(a, "u", "left").withColumn("u", F.coalesce("_to", "u")).join(n, "u").select("old_doc", "new_doc").distinct()


def extension(pages: DataFrame, known: DataFrame, blocked: str, least: int, size: int) -> DataFrame:
    """(slug, rank): new pages (slug, url, title, excerpts) by the SHA-256 of their slug, without known URLs, blocked titles and pages of too few excerpts; the first `size`, which is the feature."""
    p = pages.where((F.col("excerpts") >= least) & ~F.col("title").rlike(blocked)).join(known.select("url").distinct(), "url", "left_anti")
    h = p.select("slug", F.sha2("slug", 256).alias("h")).distinct().orderBy("h", "slug").limit(size)
    return h.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("h", "slug"))).select("slug", "rank")


def with_twins(gold: DataFrame, chunks: DataFrame, extra: DataFrame) -> DataFrame:
    """(query_id, id): gold ids, all chunks of the same text (white space aside), and reviewed extras."""
    t = chunks.where("text is not null").select("id", F.xxhash64(T.squash(F.col("text"))).alias("h"), F.sha2(T.squash(F.col("text")), 256).alias("s"))
    twins = gold.join(t, "id").select("query_id", "h", "s").distinct().join(t.select("h", "s", "id"), ["h", "s"]).select("query_id", "id")
    return gold.select("query_id", "id").unionByName(twins).unionByName(extra.select("query_id", "id")).distinct()


def never_gold(chunks: DataFrame, gold: DataFrame) -> DataFrame:
    """(id, place): chunks that are gold nowhere, in the order of a hash of their id."""
    c = chunks.select("id").join(gold.select("id").distinct(), "id", "left_anti")
    return c.select("id", F.sha1("id").alias("place"))


def check_sheet(hits: DataFrame, terms: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, id, found_by): the best hits of a query and the chunks that hold its term (query_id, term); terms meet chunks by an equi-join on the term's first two characters."""
    t = terms.where("length(term) >= 2").withColumn("g", F.left("term", F.lit(2)))
    c = chunks.where("text is not null").select("id", "text", F.explode(F.array_distinct(T.windows(F.col("text"), 2))).alias("g"))
    held = c.join(t, "g").where(F.contains("text", F.col("term"))).select("query_id", "id", F.lit("term").alias("m"))
    every = hits.select("query_id", "id", F.lit("hit").alias("m")).unionByName(held).distinct()
    return every.groupBy("query_id", "id").agg(F.array_join(F.array_sort(F.collect_list("m")), ",").alias("found_by"))


def unified(origins: list[tuple[str, DataFrame]], intents: dict[str, str], default: str) -> DataFrame:
    """Queries of several origins under one schema: the intent by the bucket where it has none, else the default."""
    m = F.create_map(*[F.lit(x) for kv in intents.items() for x in kv])
    out = None
    for name, df in origins:
        df = df.withColumn("origin", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.withColumn("intent", F.coalesce(F.col("intent"), F.try_element_at(m, F.col("bucket")), F.lit(default)))


def mapped_excerpts(excerpts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(excerpt_id, how, ids): for each excerpt (excerpt_id, doc, text) of a document the chunks (doc, seq, id, text) that hold it: exact (the shortest that contains it, the earliest of those), span (those it runs over in the text put together), failed. White space doesn't count."""
    e = excerpts.select("excerpt_id", "doc", T.squash(F.col("text")).alias("e"))
    c = chunks.where("text is not null").select("doc", "seq", "id", T.squash(F.col("text")).alias("c"))
    j = e.join(c, "doc")
    exact = j.where(F.contains("c", F.col("e")) & (F.col("e") != "")).groupBy("excerpt_id").agg(F.min(F.struct(F.length("c"), F.col("seq"), F.col("id"))).alias("m")).select("excerpt_id", F.array("m.id").alias("exact"))
    w = Window.partitionBy("doc").orderBy("seq")
    spans = c.withColumn("end", F.sum(F.length("c")).over(w)).withColumn("begin", F.col("end") - F.length("c") + 1)
    whole = c.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "c"))), lambda x: x["c"]), "").alias("all"))
    at = e.join(exact, "excerpt_id", "left_anti").join(whole, "doc").select("excerpt_id", "doc", F.instr("all", F.col("e")).alias("at"), F.length("e").alias("n")).where("at > 0 and n > 0")
    span = at.join(spans, "doc").where("begin < at + n and end >= at").groupBy("excerpt_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"]).alias("span"))
    r = e.select("excerpt_id").join(exact, "excerpt_id", "left").join(span, "excerpt_id", "left")
    return r.select("excerpt_id", F.when(F.col("exact").isNotNull(), "exact").when(F.col("span").isNotNull(), "span").otherwise("failed").alias("how"), F.coalesce("exact", "span", F.array().cast("array<string>")).alias("ids"))


# --- leakage ---


def at_path(c: Column, path: str) -> Column:
    """The text at a dotted path of a JSON document; null where there is none."""
    return F.get_json_object(c, "$." + path)


def flattened(docs: DataFrame, doc: str, title: str, items: str, rows: str) -> DataFrame:
    """(doc, part, text): title, items and joined table rows of documents as texts, empty ones left out."""
    parts = F.concat(F.array(F.struct(F.lit("title").alias("part"), F.col(title).alias("text"))), F.transform(items, lambda x: F.struct(F.lit("item").alias("part"), x.alias("text"))), F.transform(rows, lambda r: F.struct(F.lit("row").alias("part"), F.array_join(r, "｜").alias("text"))))
    return docs.select(doc, F.explode(parts).alias("p")).select(doc, "p.*").where("coalesce(text, '') <> ''")


def leaked_ids(fields: DataFrame, samples: DataFrame) -> DataFrame:
    """(id, field, sample_id): fields (id, field, value) that equal a sample id or hold it as a word; ids are met by an equi-join on the words of the value."""
    words = fields.select("id", "field", F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(r"([A-Za-z0-9_:.-]+)"), F.lit(1)))).alias("sample_id"))
    return words.join(samples.select("sample_id").distinct(), "sample_id").select("id", "field", "sample_id").distinct()


def leaked_answers(fields: DataFrame, answers: DataFrame, least: int = 5) -> DataFrame:
    """(id, sample_id): fields that contain an answer of more than `least` characters; answers meet fields by the hash of the first characters, which every containing text has as a window."""
    a = answers.where(F.length("answer") > least).select("sample_id", "answer", F.left("answer", F.lit(least + 1)).alias("g"))
    f = fields.where("value is not null").select("id", "value")
    hit = f.select("id", F.explode(F.array_distinct(T.windows(F.col("value"), least + 1))).alias("g")).join(a, "g").select("id", "sample_id", "answer").distinct()
    return hit.join(f, "id").where(F.contains("value", F.col("answer"))).select("id", "sample_id").distinct()


# --- duplicates ---


def paragraph_duplicates(paragraphs: DataFrame, threshold: float = D.THRESHOLD, least: int = 30) -> DataFrame:
    """(doc, para, kept_doc): paragraphs (doc, para, text, rank) of at least `least` characters that are near-duplicates of a kept one of another document; documents of lower rank come first.

    Equal paragraphs are one class: its first one stands for it."""
    p = paragraphs.where(F.length("text") >= least).withColumn("key", F.concat_ws("\u0001", F.lpad(F.col("rank").cast("string"), 4, "0"), "doc", "para"))
    pairs = D.similar_pairs(p, "key", threshold=threshold)
    doc = lambda c: F.split_part(c, F.lit("\u0001"), F.lit(2))
    hashed = p.select("key", F.xxhash64(T.squash(F.col("text"))).alias("s"))
    # (s, rep, n) of the classes of equal paragraphs; a class of one is looked at again only if its paragraph is dropped
    reps = hashed.groupBy("s").agg(F.min("key").alias("rep"), F.count("*").alias("n"))
    other = pairs.where(doc("a") != doc("b"))
    kept = D.decided(reps.select(F.col("rep").alias("id"), F.col("rep").alias("ord")), other, "ord")
    lost = D.small(kept.where("id <> kept_as").select(F.col("id").alias("rep"), "kept_as"), D.SENT)
    open_ = staged(reps.join(lost, "rep", "left").where("n > 1 or kept_as is not null").select("s", F.coalesce("kept_as", "rep").alias("kept_as")), "open-classes")
    host = hashed.join(D.small(open_, D.SENT), "s").where(F.col("key") != F.col("kept_as"))
    return host.where(doc("key") != doc("kept_as")).select(doc("key").alias("doc"), F.split_part("key", F.lit("\u0001"), F.lit(3)).alias("para"), doc("kept_as").alias("kept_doc"))
