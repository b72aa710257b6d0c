"""Queries on sources, sinks and streams, with the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.registry import Registry, table
from quillspark.session import shared_dir
from quillspark.sources import readers as I
from quillspark.streaming import log as L

R = Registry()


def _place(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@R.add("jsonl_roundtrip", "select sample_id, question, gold_evidence_ids[1] first_gold from queries")
def jsonl_roundtrip(spark, d):
    q = table(spark, d, "queries").select("sample_id", "question", "gold_evidence_ids")
    at = _place(spark, "jsonl")
    I.write_jsonl(q, at)
    return I.read_jsonl(spark, at, q.schema).select("sample_id", "question", F.try_element_at("gold_evidence_ids", F.lit(1)).alias("first_gold"))


@R.add("csv_table_rows", "select concat_ws('；', 'n_nationkey：' || n_nationkey, 'n_name：' || n_name, 'n_regionkey：' || n_regionkey) as text from nation")
def csv_table_rows(spark, d):
    at = _place(spark, "csv")
    table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").write.option("header", True).csv(at)
    return I.csv_rows(spark, at).select("text")


@R.add("manifest_scan", "with f as (select document_id, max(accessed_at) a from sources group by 1) select s.document_id doc_id, coalesce(s.accessed_at, f.a) accessed_at from (select distinct document_id, accessed_at from sources where usage = 'demo_only') s join f using (document_id)")
def manifest_scan(spark, d):
    s = table(spark, d, "sources").select(F.col("document_id").alias("doc_id"), "accessed_at", "usage")
    rows = s.select("doc_id", "accessed_at", (F.col("usage") == "demo_only").alias("include")).distinct()
    return I.manifest(rows, s).select("doc_id", "accessed_at")


@R.add("decode_bytes", "select chunk_id path, text, case k when 1 then 'gb18030' else 'utf-8' end encoding, case k when 0 then 'declared' else 'detected' end source from (select chunk_id, text, case when regexp_matches(text, '[^\\x00-\\x7F]') and instr(text, '�') = 0 then abs(length(text)) % 3 else 2 end k from chunks where text is not null) where k <> 1 or regexp_matches(text, '^[\\x00-\\x7F一-龥、。，！？；：（）“”《》·…—]+$')")
def decode_bytes(spark, d):
    """Texts written with a declared UTF-8, as GB 18030 (those it can tell by its frequent rows) and as plain UTF-8, decoded again."""
    t = table(spark, d, "chunks").where("text is not null").select(F.col("chunk_id").alias("path"), "text")
    odd = F.col("text").rlike(r"[^\x00-\x7F]") & ~F.contains("text", F.lit("\ufffd"))
    t = t.withColumn("k", F.when(odd, F.length("text") % 3).otherwise(2)).where((F.col("k") != 1) | F.col("text").rlike(r"\A[\x00-\x7F一-龥、。，！？；：（）“”《》·…—]+\z"))

    def write(batches):
        for b in batches:
            b["content"] = [x.encode("gb18030" if k == 1 else "utf-8") for x, k in zip(b["text"], b["k"], strict=True)]
            yield b[["path", "content", "declared"]]

    raw = t.withColumn("declared", F.when(F.col("k") == 0, "utf8")).mapInPandas(write, "path string, content binary, declared string")
    return I.decoded(raw, declared="declared")


def _pages(spark, d):
    """Chunk texts as pages: their lines are paragraphs, lists and bold lines inside a content container, with furniture around it."""
    esc = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    body = F.array_join(F.transform(F.split(esc, "\n", -1), lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("<p>"), x)).when(i % 3 == 1, F.concat(F.lit("<ul><li>"), x, F.lit("</li></ul>"))).otherwise(F.concat(F.lit("<h3>"), x, F.lit("</h3>")))), "")
    html = F.concat(F.lit("<html><title>t</title><nav>menu</nav><div class='share-bar'>share</div><main id='body-text'><div class='ad'>x</div>"), body, F.lit("</main><p>after</p></html>"))
    return table(spark, d, "chunks").where("text is not null").select("chunk_id", html.alias("html"))


RULES = I.PageRules(content_ids=frozenset({"body-text"}), skip_classes=frozenset({"ad", "share"}))
LINES_SQL = "select chunk_id, i, trim(regexp_replace(l, '[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')) l from (select chunk_id, unnest(string_split(text, chr(10))) l, generate_subscripts(string_split(text, chr(10)), 1) - 1 i from chunks where text is not null)"


@R.add("html_elements", f"select chunk_id, kind, count(*) n, sum(length(l))::bigint chars from (select chunk_id, l, case i % 3 when 0 then 'paragraph' when 1 then 'list' else 'heading' end kind from ({LINES_SQL}) where l <> '') group by 1, 2")
def html_elements(spark, d):
    e = I.html_elements(_pages(spark, d), "chunk_id", rules=RULES)
    return e.groupBy("chunk_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@R.add("html_text", f"select chunk_id, string_agg(l, chr(10) order by i) as text from ({LINES_SQL}) where l <> '' group by 1")
def html_text(spark, d):
    return I.html_text(_pages(spark, d), "chunk_id", rules=RULES)


@R.add("mediawiki_pages", "select document_id, title, '<p>' || coalesce(publisher, '') || '</p>' html from sources where title is not null")
def mediawiki_pages(spark, d):
    html = F.concat(F.lit("<p>"), F.coalesce("publisher", F.lit("")), F.lit("</p>"))
    s = table(spark, d, "sources").where("title is not null")
    body = F.when(F.length("document_id") % 2 == 0, F.to_json(F.struct(F.struct("title", F.create_map(F.lit("*"), html).alias("text")).alias("parse")))).otherwise(F.to_json(F.struct(F.struct("title", html.alias("text")).alias("parse"))))
    return I.mediawiki_html(s.select("document_id", body.alias("body")), "document_id")


@R.add("corpus_report", f"select kind, count(distinct chunk_id) documents, count(*) elements, sum(length(l))::bigint chars from (select chunk_id, l, case i % 3 when 0 then 'paragraph' when 1 then 'list' else 'heading' end kind from ({LINES_SQL}) where l <> '') group by 1")
def corpus_report(spark, d):
    at = _place(spark, "corpus")
    I.write_corpus(I.html_elements(_pages(spark, d), "chunk_id", rules=RULES), "chunk_id", at)
    return spark.read.schema("kind string, documents bigint, elements bigint, chars bigint").json(f"{at}/report")


@R.add("trace_summary", "select last, count(*) cases, sum(n)::bigint events from (select case_id, count(*) n, arg_max(to_status, id) last from case_event_log where event_type = 'state_transition' group by 1) group by 1")
def trace_summary(spark, d):
    at = _place(spark, "traces")
    I.write_traces(table(spark, d, "case_event_log").where("event_type = 'state_transition'"), "case_id", "id", at)
    return spark.read.schema("last string, cases bigint, events bigint").json(f"{at}/summary")


@R.add("manifest_file", "select n_nationkey, n_name from nation")
def manifest_file(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name").agg(F.concat(F.lit("\ufeff"), F.to_json(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))))).alias("value"))
    at = _place(spark, "manifest")
    n.write.text(at)
    return I.manifest_file(spark, at, "struct<n_nationkey:bigint,n_name:string>")


@R.add("strict_jsonl", "select count(*) n from queries")
def strict_jsonl(spark, d):
    at = _place(spark, "strict")
    I.write_jsonl(table(spark, d, "queries").select("sample_id", "question"), at)
    return I.checked_jsonl(spark, at).agg(F.count("*").alias("n"))


@R.add("csv_summary", "select '表格共 ' || count(*) || ' 行，列：n_nationkey、n_name、n_regionkey' as text from nation")
def csv_summary(spark, d):
    return I.table_summary(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@R.add("vector_store", "select label, count(*) n from embeddings group by 1")
def vector_store(spark, d):
    """Vectors kept under the hash of their corpus: written once, read again."""
    v = table(spark, d, "embeddings")
    h = v.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.sum(F.hash("vec_id")).cast("string"), F.lit(d)), 256)).first()[0]
    return spark.read.parquet(I.hash_store(v, h, "r1")).groupBy("label").agg(F.count("*").alias("n"))


@R.add("request_keys", "select sample_id, sha256(question || '#' || length(split)) as key from queries")
def request_keys(spark, d):
    return I.request_keys(table(spark, d, "queries").withColumn("t", F.length("split")), "question", "t").select("sample_id", "key")


@R.add("replay_answers", "select sample_id as key, case when cast(substr(sample_id, 2) as bigint) % 2 = 0 then 'own:' else 'base:' end || split body from queries")
def replay_answers(spark, d):
    q = table(spark, d, "queries").select(F.col("sample_id").alias("key"), "split")
    own = q.where("cast(substr(key, 2) as bigint) % 2 = 0").select("key", F.concat(F.lit("own:"), "split").alias("body"))
    return I.replayed(q.select("key"), own, q.select("key", F.concat(F.lit("base:"), "split").alias("body")))


@R.add("unchanged_skip", "select document_id doc_id from (select document_id, count(*) n from sources group by 1) where n > 1")
def unchanged_skip(spark, d):
    s = table(spark, d, "sources").groupBy(F.col("document_id").alias("doc_id")).agg(F.count("*").alias("n")).withColumn("sha256", F.sha2(F.col("n").cast("string"), 256))
    return I.unfetched(s, s.where("n = 1").select("doc_id", "sha256")).select("doc_id")


@R.add("stream_event_counts", "select event_type, count(*) n from events group by 1")
def stream_event_counts(spark, d):
    return L.drain(L.tail(spark, d, "events").select("event_id", "event_type")).groupBy("event_type").agg(F.count("*").alias("n"))


@R.add("stream_dedup", "select count(*) n from (select distinct case_id, event_type, from_status, to_status, trigger_subject, trigger_entity, detail, created_at from case_event_log)")
def stream_dedup(spark, d):
    key = ["case_id", "event_type", "from_status", "to_status", "trigger_subject", "trigger_entity", "detail", "created_at"]
    return L.drain(L.deduplicated(L.tail(spark, d, "case_event_log"), key, "created_at", "2 days")).agg(F.count("*").alias("n"))


@R.add("stream_windows", "select event_type, epoch(time_bucket(interval 1 day, ts))::bigint day_s, count(*) n from events group by 1, 2")
def stream_windows(spark, d):
    out = L.drain(L.windowed(L.tail(spark, d, "events"), "ts", "event_type", "1 day", "0 seconds"), "complete")
    return out.select("event_type", F.unix_seconds("start").alias("day_s"), "n")


@R.add("stream_case_fold", "select case_id, arg_max(to_status, id) status, count(distinct (event_type, from_status, to_status, trigger_subject, trigger_entity, detail, created_at)) steps from case_event_log where to_status is not null group by 1")
def stream_case_fold(spark, d):
    out = L.drain(L.folded(L.tail(spark, d, "case_event_log")), "update")
    return out.groupBy("case_id").agg(F.max(F.struct("steps", "status")).alias("m")).select("case_id", F.col("m.status").alias("status"), F.col("m.steps").alias("steps"))
