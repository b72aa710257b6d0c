"""Queries on corpus texts, chunks, duplicates and the store, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import chunking as C
from quillspark.operators import dedup as D
from quillspark.operators import store as S
from quillspark.operators import text as X
from quillspark.registry import Registry, table
from quillspark.session import spread

R = Registry()
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def squash_sql(t: str) -> str:
    return f"regexp_replace({t}, '{WS}+', '', 'g')"


def trim_sql(t: str) -> str:
    return f"regexp_replace({t}, '^{WS}+|{WS}+$', '', 'g')"


@R.add("squash_text", f"select chunk_id, {squash_sql('text')} squashed from chunks")
def squash_text(spark, d):
    return table(spark, d, "chunks").select("chunk_id", T.squash(F.col("text")).alias("squashed"))


NORM = f"regexp_replace(regexp_replace(translate(text, '{T.WIDE}', '{T.PLAIN}'), '\\r\\n|\\r', chr(10), 'g'), '[ \\t\\x{{3000}}\\x{{A0}}]+', ' ', 'g')"


@R.add("normalize_text", f"select chunk_id, {trim_sql(NORM)} normalized from chunks")
def normalize_text(spark, d):
    return table(spark, d, "chunks").select("chunk_id", T.normalize(F.col("text")).alias("normalized"))


@R.add("tokenize_cjk", "select term, count(*) n, count(distinct id) docs from (select id, unnest(tokens) term from (select chunk_id id, flatten(list_transform(regexp_extract_all(lower(text), '[㐀-鿿]+|[a-z0-9]+'), lambda p: case when regexp_full_match(p, '[㐀-鿿]{2,}') then list_transform(range(1, length(p)), lambda i: substring(p, i, 2)) else [p] end)) tokens from chunks where text is not null)) group by term")
def tokenize_cjk(spark, d):
    t = spread(table(spark, d, "chunks").where("text is not null").select("chunk_id", "text")).select("chunk_id", F.explode(T.token_bag(F.col("text"))).alias("term"))
    per = t.groupBy("term", "chunk_id").count()
    return per.groupBy("term").agg(F.sum("count").alias("n"), F.count("*").alias("docs"))


@R.add("tokenize_ws", "select doc_id, len(list_filter(regexp_split_to_array(lower(text), '" + WS + "+'), lambda x: x <> '')) tokens from documents where text is not null")
def tokenize_ws(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(T.tokens_whitespace(F.col("text"))).cast("bigint").alias("tokens"))


@R.add("sentence_split", f"select chunk_id, len(s) n, s[1] first_sentence from (select chunk_id, list_filter(list_transform(regexp_extract_all(text, '[^。！？；]*[。！？；][”’」』）)]*|[^。！？；]+'), lambda x: {trim_sql('x')}), lambda x: x <> '') s from chunks where text is not null)")
def sentence_split(spark, d):
    s = table(spark, d, "chunks").where("text is not null").select("chunk_id", T.sentences(F.col("text")).alias("s"))
    return s.select("chunk_id", F.size("s").cast("bigint").alias("n"), F.try_element_at("s", F.lit(1)).alias("first_sentence"))


@R.add("clause_split", "select chunk_id, len(regexp_extract_all(text, '[^，、：]*[，、：]|[^，、：]+')) n from chunks where text is not null")
def clause_split(spark, d):
    return table(spark, d, "chunks").where("text is not null").select("chunk_id", F.size(T.clauses(F.col("text"))).cast("bigint").alias("n"))


@R.add("ascii_ratio", f"select chunk_id, round(case when length(s) = 0 then 0.0 else length(regexp_replace(s, '[^\\x00-\\x7F]', '', 'g')) / length(s) end, 9) ratio from (select chunk_id, {squash_sql('text')} s from chunks where text is not null)")
def ascii_ratio(spark, d):
    return table(spark, d, "chunks").where("text is not null").select("chunk_id", F.round(T.ascii_ratio(F.col("text")), 9).alias("ratio"))


@R.add("section_types", "select coalesce(section_type, 'none') section_type, count(*) n from (select case when s similar to '.*(传播|感染途径|传染途径).*' then 'transmission' when s similar to '.*(症状|临床表现|体征).*' then 'symptoms' when s similar to '.*(预防|疫苗).*' then 'prevention' when s similar to '.*(治疗|诊疗|处理).*' then 'treatment' when s similar to '.*(流行|发病|负担|统计|概况|问题的范围).*' then 'epidemiology' when s similar to '.*(要点|重要事实).*' then 'key_facts' when s similar to '.*(概述|简介|是什么).*' or s = '定义' or s similar to '.{0,6}的定义' then 'definition' end section_type from (select metadata.section s from chunks)) group by 1")
def section_types(spark, d):
    return table(spark, d, "chunks").select(F.coalesce(T.section_type(F.col("metadata.section")), F.lit("none")).alias("section_type")).groupBy("section_type").agg(F.count("*").alias("n"))


LEVEL = """case when line = '' or length(line) > 60 or regexp_matches(line, '\\s\\d{1,4}$') then 0
when regexp_matches(line, '^第[一二三四五六七八九十百\\d]+[章节篇部分]') then 1 when regexp_matches(line, '^[一二三四五六七八九十]+、\\S') then 1
when regexp_matches(line, '^（[一二三四五六七八九十]+）\\s*\\S') then 2 when regexp_matches(line, '^\\([一二三四五六七八九十]+\\)\\s*\\S') then 2
when regexp_matches(line, '^\\d{1,2}\\.\\d+(\\.\\d+)*[、\\s]+[^\\d\\s]') then case when body then 0 else 3 end when regexp_matches(line, '^\\d{1,2}[、.．]\\s*[^\\d.．\\s]') then case when body then 0 else 3 end
when regexp_matches(line, '^（\\d{1,2}）\\S') or regexp_matches(line, '^\\(\\d{1,2}\\)\\S') then case when body then 0 else 4 end else 0 end"""
HEADED = f"h as (select key, line_no, line, {LEVEL} as lvl from (select *, length(regexp_replace(line, '^[0-9.．、（）()\\s]+', '')) > 25 or regexp_matches(line, '[。；;]$') body from ln))"


@R.add("heading_levels", f"with ln as (select chunk_id as key, unnest(string_split(text, chr(10))) line, 0 line_no from chunks where text is not null), {HEADED} select lvl as level, count(*) n from h group by 1")
def heading_levels(spark, d):
    return X.lines(table(spark, d, "chunks"), "chunk_id").withColumn("level", T.heading_level(F.col("line"))).groupBy("level").agg(F.count("*").alias("n"))


# RE2 has no look-behind: the character before a number is captured and put back, twice for numbers that share it
REDACTED = "regexp_replace(regexp_replace(text, '(?i)\\bBearer\\s+[A-Za-z0-9._~+/=-]+', 'Bearer [REDACTED]', 'g'), '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b', '[REDACTED]', 'g')"
for _p in ("(^|[^0-9])(?:\\+?86[- ]?)?1[3-9][0-9]{9}($|[^0-9])", "(^|[^0-9])[0-9]{17}[0-9Xx]($|[^0-9])"):
    for _ in range(2):
        REDACTED = f"regexp_replace({REDACTED}, '{_p}', '\\1[REDACTED]\\2', 'g')"


@R.add("redact_text", f"select doc_id, {REDACTED} as text from documents")
def redact_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.redact(F.col("text")).alias("text"))


@R.add("lexicon_terms", "select distinct term from (select trim(unnest(regexp_split_to_array(regexp_replace(title, '（[^）]*）|\\([^)]*\\)', '', 'g'), '[、，,和与]'))) term from documents where title is not null) where length(term) between 2 and 12 and regexp_matches(term, '[㐀-鿿]')")
def lexicon_terms(spark, d):
    return X.lexicon(table(spark, d, "documents").where("title is not null"), "title")


@R.add("repeated_headers", "select source_id, line from (select distinct source_id, chunk_id, trim(unnest(string_split(text, chr(10)))) line from chunks where text is not null) where line <> '' group by 1, 2 having count(*) >= 3")
def repeated_headers(spark, d):
    return X.repeated_headers(table(spark, d, "chunks"), "source_id", "chunk_id")


@R.add("quality_report", f"select source, count(*) n, sum((metadata.title = source_id)::int)::bigint title_equals_id, sum((coalesce(metadata.accessed_at, '') = '')::int)::bigint accessed_missing, sum((instr(coalesce(text, ''), chr(13)) > 0)::int)::bigint cr, sum((length(coalesce(text, '')) >= 20 and length(regexp_replace({squash_sql('text')}, '[^\\x00-\\x7F]', '', 'g')) / nullif(length({squash_sql('text')}), 0) >= 0.8)::int)::bigint ascii_dominant, sum((length(coalesce(text, '')) < 15)::int)::bigint short, sum(length(coalesce(text, '')))::bigint chars from chunks group by source")
def quality_report(spark, d):
    c = table(spark, d, "chunks").select("source", "source_id", "text", F.col("metadata.title").alias("title"), F.col("metadata.accessed_at").alias("accessed_at"))
    return X.quality_report(c, "source").select("source", "n", F.coalesce("title_equals_id", F.lit(0)).alias("title_equals_id"), "accessed_missing", "cr", F.coalesce("ascii_dominant", F.lit(0)).alias("ascii_dominant"), "short", "chars")


@R.add("leakage_hits", "select d.doc_id text_id, h.item_id question_id from documents d join heldout_items h on contains(d.text, h.text) where length(h.text) > 50 and length(d.text) > 50")
def leakage_hits(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return X.contained_questions(texts, table(spark, d, "heldout_items").select(F.col("item_id").alias("question_id"), F.col("text").alias("question")))


@R.add("exact_duplicates", f"select min(doc_id) rep, count(*) n from documents where text is not null group by {squash_sql('text')} having count(*) > 1")
def exact_duplicates(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", T.squash(F.col("text")).alias("s"))
    return t.groupBy("s").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("rep", "n")


@R.add("shingles", f"select doc_id, case when length(s) = 0 then 0 when length(s) <= 5 then 1 else (select count(distinct substring(s, i, 5)) from range(1, length(s) - 3) t(i)) end n from (select doc_id, {squash_sql('text')} s from documents where text is not null)")
def shingles(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(T.shingles(F.col("text"))).cast("bigint").alias("n"))


@R.add("jaccard_pairs", f"with r as (select min(chunk_id) id, {squash_sql('text')} s from chunks where text is not null and {squash_sql('text')} <> '' group by 2), g as (select id, unnest(case when length(s) <= 5 then [s] else list_distinct(list_transform(range(1, length(s) - 3), lambda i: substring(s, i, 5))) end) g from r), n as (select id, count(*) n from g group by 1), c as (select a.id a, b.id b, count(*) c from g a join g b on a.g = b.g and a.id < b.id group by 1, 2) select a, b, round(c / (x.n + y.n - c), 6) similarity from c join n x on a = x.id join n y on b = y.id where c / (x.n + y.n - c) >= 0.85")
def jaccard_pairs(spark, d):
    return D.similar_pairs(table(spark, d, "chunks"), "chunk_id").select("a", "b", F.round("similarity", 6).alias("similarity"))


@R.add("document_dedup")
def document_dedup(spark, d):
    """Every document with the kept one that it is a copy or near-duplicate of (itself where it is kept), visited in order of evidence level, number of elements (most first) and id. Chunks stand in for documents, their lines for elements."""
    docs = table(spark, d, "chunks").where("text is not null and chunk_id is not null")
    lines = F.size(F.split("text", "\n", -1))
    order = F.concat_ws("|", F.coalesce("evidence_level", F.lit("level_9")), F.lpad((F.lit(999_999) - lines).cast("string"), 6, "0"))
    # the place in the order is part of the key, so the first of a class of equal texts stands for it
    docs = docs.select(F.struct(order.alias("ord"), F.col("chunk_id").alias("id")).alias("key"), "text")
    rows = docs.select(F.col("key").alias("id"), F.xxhash64(T.squash(F.col("text"))).alias("s"))
    return D.greedy_rows(rows, D.similar_pairs(docs, "key")).select("id.id", F.col("kept_as.id").alias("kept_as"))


@R.add("overlap_chunks", "select chunk_id, source_id, concat(coalesce(right(lag(text) over (partition by source_id order by chunk_id), 76), ''), text) chunk from chunks where text is not null")
def overlap_chunks(spark, d):
    return C.with_overlap(table(spark, d, "chunks").where("text is not null").select("chunk_id", "source_id", "text"), "source_id", "chunk_id", "text").select("chunk_id", "source_id", "chunk")


@R.add("chunk_stats", "select metadata.content_kind kind, count(*) n, sum(length(text))::bigint chars, min(length(text)) shortest, max(length(text)) longest, round(avg(length(text)), 1) mean from chunks group by 1")
def chunk_stats(spark, d):
    return C.stats(table(spark, d, "chunks").select(F.col("metadata.content_kind").alias("kind"), "text"), "kind", "text")


def sents_sql(t: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({t}, '[^。！？；]*[。！？；][”’」』）)]*|[^。！？；]+'), lambda x: {trim_sql('x')}), lambda x: x <> '')"


# greedy groups within a limit, as a fold: groups closed so far, the open one
FILL = "list_reduce({p}, lambda a, x: case when a.held <> '' and length(a.held) + length(x) > {n} then {{'done': list_append(a.done, a.held), 'held': x}} else {{'done': a.done, 'held': a.held || x}} end, {{'done': []::varchar[], 'held': ''}})"


def filled_sql(parts: str, limit: int) -> str:
    return f"list_filter(list_append(({FILL.format(p=parts, n=limit)}).done, ({FILL.format(p=parts, n=limit)}).held), lambda x: x <> '')"


SLICED = "list_transform(range(0, (length({t}) + 511) // 512), lambda i: substring({t}, i * 512 + 1, 512))"
SPLIT_SQL = f"""
with s as (select doc_id, unnest(ss) sent, generate_subscripts(ss, 1) i, len(ss) n, text from (select doc_id, text, case when length(text) <= 512 then [text] else {sents_sql('text')} end ss from documents where text <> '')),
lone as (select doc_id, case when n = 1 then text else sent end sent, i from s),
parts as (select doc_id, i, 0 j, sent part, length(sent) <= 512 fits from lone where length(sent) <= 512 union all
  select doc_id, i, generate_subscripts(c, 1) j, unnest(c) part, false from (select doc_id, i, case when len(p) < 2 then {SLICED.format(t='sent')} else flatten(list_transform({filled_sql('p', 512)}, lambda x: {SLICED.format(t='x')})) end c from (select doc_id, i, sent, regexp_extract_all(sent, '[^，、：]*[，、：][”’」』）)]*|[^，、：]+') p from lone where length(sent) > 512))),
runs as (select *, i - sum(fits::int) over (partition by doc_id order by i, j) isle from parts),
packed as (select doc_id, min(i) i, 0 j, unnest({filled_sql('list(part order by i)', 512)}) part from runs where fits group by doc_id, isle)
select doc_id, count(*) n, sum(length(part))::bigint chars, max(length(part)) longest, min(length(part)) shortest from (select doc_id, part from packed union all select doc_id, part from parts where not fits) group by 1
"""


@R.add("recursive_chunks", SPLIT_SQL)
def recursive_chunks(spark, d):
    c = C.recursive_chunks(table(spark, d, "documents"), "doc_id")
    size = F.length("chunk")
    return c.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(size).alias("chars"), F.max(size).alias("longest"), F.min(size).alias("shortest"))


CONTROL_SQL = "(?i)^(?:Skip to main content|阅读时间|打印|分享|分享本页|实况报道|\\d{4}年\\d{1,2}月\\d{1,2}日|\\d{4}年\\d{1,2}月|[ivxlcdm]{1,8}|\\d{1,4})$|^世卫组织\\s*/\\s*媒体中心|^媒体中心\\s*/"
LAST = "length(regexp_extract(substring(a.rest, 1, 110), '(?s)^.*[，、：,；;]'))"
CUT = f"case when {LAST} > 36 then {LAST} else 110 end"
LONG = f"list_reduce(range(0, length(sent) // 37 + 1), lambda a, i: case when length(a.rest) <= 110 then a else {{{{'done': list_append(a.done, substring(a.rest, 1, {CUT})), 'rest': substring(a.rest, {CUT} + 1)}}}} end, {{{{'done': []::varchar[], 'rest': sent}}}})".replace("{{", "{").replace("}}", "}")
PAIRS = "list_reduce(x, lambda a, p: case when length(p) <= a.room then {'done': list_append(a.done[:-2], a.done[-1] || p), 'room': -1} else {'done': list_append(a.done, p), 'room': 110 - length(p)} end, {'done': []::varchar[], 'room': -1})"
MERGED = "list_reduce(x, lambda a, p: case when len(a) > 0 and length(p) < 15 and length(a[-1]) < 110 and length(a[-1]) + length(p) <= 130 then list_append(a[:-2], a[-1] || p) else list_append(a, p) end, []::varchar[])"
CHILD_SQL = f"""
with s as (select doc_id, unnest(ss) sent, generate_subscripts(ss, 1) i from (select doc_id, {sents_sql('text')} ss from documents where text is not null)),
u as (select doc_id, i, sent, length(sent) <= 110 fits from s), runs as (select *, i - sum(fits::int) over (partition by doc_id order by i) isle from u),
g as (select doc_id, i, ({PAIRS}).done d from (select doc_id, min(i) i, list(sent order by i) x from runs where fits group by doc_id, isle) union all
  select doc_id, i, list_append(l.done, l.rest) from (select doc_id, i, {LONG} l from runs where not fits)),
m as (select doc_id, {MERGED} c from (select doc_id, flatten(list(list_filter(d, lambda y: y <> '') order by i)) x from g group by doc_id))
select doc_id, i - 1 seq, chunk from (select doc_id, unnest(c) chunk, generate_subscripts(c, 1) i from (select doc_id, list_filter(c, lambda y: not regexp_matches(trim(y), '{CONTROL_SQL}')) c from m))
"""


@R.add("child_chunks", CHILD_SQL)
def child_chunks(spark, d):
    return C.child_chunks(table(spark, d, "documents"), "doc_id")


PARAS = f"p as (select doc_id, i, {trim_sql('t')} t from (select doc_id, unnest(string_split(text, chr(10))) t, generate_subscripts(string_split(text, chr(10)), 1) i from documents where text is not null))"


@R.add("parent_chunks", f"with {PARAS} select doc_id, t chunk, count(*) n from p where t <> '' and length(t) <= 600 and not regexp_matches(t, '{CONTROL_SQL}') group by 1, 2")
def parent_chunks(spark, d):
    """Parents that are whole paragraphs; those cut from longer ones are checked by brute force in the tests."""
    lines = X.lines(table(spark, d, "documents"), "doc_id").select("doc_id", T.strip(F.col("line")).alias("chunk")).where("length(chunk) <= 600").distinct()
    p = C.parent_child(table(spark, d, "documents"), "doc_id").where("role = 'parent'").groupBy("doc_id", "chunk").agg(F.count("*").alias("n"))
    return p.join(lines, ["doc_id", "chunk"], "left_semi")


@R.add("parent_child_chunks")
def parent_child_chunks(spark, d):
    return C.parent_child(table(spark, d, "documents"), "doc_id")


def line_elements(spark, d):
    """Documents with their lines as elements: numbered headings open sections, lines with an item mark are lists, the rest are paragraphs."""
    ln = X.lines(table(spark, d, "documents"), "doc_id").withColumn("level", T.heading_level(F.col("line")))
    w = X.Window.partitionBy("doc_id").orderBy("line_no")
    ln = ln.withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(w).cast("int"))
    none = F.array().cast("array<string>")
    item = F.col("line").rlike(r"^(?:[-•·] |\d{1,2}\. )")
    e = F.struct("line_no", "section", F.when(F.col("level") > 0, "heading").when(item, "list").otherwise("paragraph").alias("kind"), F.col("line").alias("text"), F.when(item, F.array("line")).otherwise(none).alias("items"), none.alias("header"), F.array().cast("array<array<string>>").alias("rows"))
    return ln.groupBy("doc_id").agg(F.array_sort(F.collect_list(e)).alias("elements"))


UNITS = f"with ln as (select doc_id as key, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) line_no from documents where text is not null), {HEADED}"


@R.add("element_units", UNITS + f" select key doc_id, kind, count(*) n, sum(length(t))::bigint chars from (select key, {trim_sql('line')} t, case when regexp_matches(line, '^(?:[-•·] |\\d{{1,2}}\\. )') then 'list' else 'paragraph' end kind from h where lvl = 0) where t <> '' and not regexp_matches(t, '{CONTROL_SQL}') group by 1, 2")
def element_units(spark, d):
    u = C.element_units(line_elements(spark, d), "doc_id")
    return u.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@R.add("element_chunks", UNITS + f", t as (select key, sum((lvl > 0)::int) over (partition by key order by line_no) section, lvl, {trim_sql('line')} t from h) select key doc_id, section::int section, {squash_sql(chr(34) + 'joined' + chr(34))} squashed from (select key, section, string_agg(t, '' order by line_no) joined from (select *, row_number() over () line_no from t) where lvl = 0 and t <> '' and not regexp_matches(t, '{CONTROL_SQL}') group by 1, 2)")
def element_chunks(spark, d):
    """Chunks of documents put together again, overlaps cut: nothing of a section is lost or doubled."""
    c = C.element_chunks(line_elements(spark, d), "doc_id")
    w = X.Window.partitionBy("doc_id", "section").orderBy("seq")
    before, text = F.lag("chunk").over(w), F.col("chunk")
    lap = F.when(F.col("seq") > 0, F.right(before, F.lit(C.OVERLAP)))
    own = c.withColumn("lap", lap).withColumn("own", F.when(F.col("lap").isNotNull() & (F.length("lap") > 0) & F.startswith(text, F.col("lap")) & (F.length("lap") >= C.OVERLAP), F.substr(text, F.length("lap") + 1)).otherwise(text))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "own"))), lambda x: x["own"])
    return own.groupBy("doc_id", "section").agg(T.squash(F.array_join(parts, "")).alias("squashed"))


@R.add("element_families")
def element_families(spark, d):
    return C.element_families(line_elements(spark, d), "doc_id")


@R.add("section_type_paths", "select chunk_id, metadata.section s, case when metadata.section similar to '.*(传播|感染途径|传染途径).*' then 'transmission' when metadata.section similar to '.*(症状|临床表现|体征).*' then 'symptoms' else 'other' end deepest from chunks")
def section_type_paths(spark, d):
    """The section type by path, deepest heading first: a path of a fixed title and the section."""
    path = F.array(F.lit("预防"), F.coalesce("metadata.section", F.lit("-")))
    got = T.section_type_of_path(path)
    return table(spark, d, "chunks").select("chunk_id", F.col("metadata.section").alias("s"), F.when(got.isin("transmission", "symptoms"), got).otherwise("other").alias("deepest"))


HASHES = "select source_id doc, count(*) chunks, sha256(string_agg(h, '' order by chunk_id)) content_hash from (select source_id, chunk_id, sha256(coalesce(text, '')) h from chunks) group by source_id"


def _hashes(spark, d):
    return S.document_hashes(table(spark, d, "chunks").select(F.col("source_id").alias("doc"), F.col("chunk_id").alias("id"), "text"))


@R.add("content_hashes", HASHES)
def content_hashes(spark, d):
    return _hashes(spark, d)


OLD = f"old as (select doc, content_hash from ({HASHES}) where chunks < 4), new as (select doc, case when chunks = 2 then content_hash || 'x' else content_hash end content_hash from ({HASHES}) where chunks > 1)"


def _versions(spark, d):
    """Two versions of the corpus: documents of few chunks, and those of several with the ones of two chunks changed."""
    h = _hashes(spark, d)
    return h.where("chunks < 4").select("doc", "content_hash"), h.where("chunks > 1").select("doc", F.when(F.col("chunks") == 2, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")).alias("content_hash"))


@R.add("corpus_diff", f"with {OLD} select doc, case when o.content_hash is null then 'added' when n.content_hash is null then 'removed' when o.content_hash = n.content_hash then 'unchanged' else 'changed' end status from old o full join new n using (doc)")
def corpus_diff(spark, d):
    return S.corpus_diff(*_versions(spark, d))


@R.add("scd2_upsert", f"with {OLD}, j as (select coalesce(o.doc, n.doc) doc, o.content_hash oh, n.content_hash nh from old o full join new n on o.doc = n.doc) select doc, oh content_hash, 1 as version, case when nh is null or nh <> oh then 'retired' else 'active' end status from j where oh is not null union all select doc, nh, case when oh is null then 1 else 2 end, 'active' from j where nh is not null and (oh is null or oh <> nh)")
def scd2_upsert(spark, d):
    old, new = _versions(spark, d)
    return S.sync(old.select("doc", "content_hash", F.lit(1).alias("version"), F.lit("active").alias("status")), new)


@R.add("dangling_gold", "select sample_id, id from (select sample_id, unnest(gold_evidence_ids) id from queries) where id not in (select chunk_id from chunks)")
def dangling_gold(spark, d):
    gold = table(spark, d, "queries").select("sample_id", F.explode("gold_evidence_ids").alias("id"))
    return gold.join(table(spark, d, "chunks").select(F.col("chunk_id").alias("id")), "id", "left_anti").select("sample_id", "id")


@R.add("latest_sources", "select document_id, max(accessed_at) accessed_at from sources group by document_id")
def latest_sources(spark, d):
    return S.latest(table(spark, d, "sources").select("document_id", "accessed_at", "title"), ["document_id"], ["accessed_at"]).select("document_id", "accessed_at")


@R.add("metadata_backfill", "with p as (select document_id source_id, max(nullif(trim(published_at), '')) published_at from sources group by 1) select chunk_id, coalesce(case when coalesce(trim(metadata.published_at), '') <> '' then metadata.published_at end, p.published_at) published_at, coalesce(trim(metadata.published_at), '') = '' and p.published_at is not null filled from chunks left join p using (source_id)")
def metadata_backfill(spark, d):
    p = table(spark, d, "sources").groupBy(F.col("document_id").alias("source_id")).agg(F.max(F.nullif(F.trim("published_at"), F.lit(""))).alias("p"))
    c = table(spark, d, "chunks").select("chunk_id", "source_id", F.col("metadata.published_at").alias("o")).join(p, "source_id", "left")
    empty = F.coalesce(F.trim("o"), F.lit("")) == ""
    return c.select("chunk_id", F.coalesce(F.when(~empty, F.col("o")), F.col("p")).alias("published_at"), (empty & F.col("p").isNotNull()).alias("filled"))


@R.add("metadata_filter", "select chunk_id from chunks where metadata.content_kind = 'pdf_text' and evidence_level = 'level_1_guideline' and lower(metadata.language) in ('zh', 'zh-cn')")
def metadata_filter(spark, d):
    return table(spark, d, "chunks").where("metadata.content_kind = 'pdf_text' and evidence_level = 'level_1_guideline' and lower(metadata.language) in ('zh', 'zh-cn')").select("chunk_id")


@R.add("verbatim_check", f"select c.source_id, count(*) n, sum(contains({squash_sql('c.text')}, {squash_sql('p.text')})::int)::bigint contained from chunks c join chunks p on c.source_id = p.source_id and c.chunk_id < p.chunk_id where c.text is not null and p.text is not null group by 1")
def verbatim_check(spark, d):
    c = table(spark, d, "chunks").where("text is not null").select("source_id", "chunk_id", T.squash(F.col("text")).alias("s"))
    j = c.join(c.select("source_id", F.col("chunk_id").alias("other"), F.col("s").alias("t")), "source_id").where("chunk_id < other")
    return j.groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(F.contains("s", F.col("t"))).alias("contained"))
