"""Queries on the cleaning of lines and pages, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import cleaning as L
from quillspark.operators import text as X
from quillspark.plans.corpus import HEADED, LEVEL, NORM, squash_sql, trim_sql
from quillspark.registry import Registry, table

R = Registry()
TYPES = [*L.RULES, "other"]
KIND = "case doc_id % 6 " + " ".join(f"when {i} then '{t}'" for i, t in enumerate(TYPES)) + " end"
LINES = "ln as (select doc_id as key, doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 line_no from documents where text is not null)"


def _lines(spark, d):
    return X.lines(table(spark, d, "documents"), "doc_id")


def _kind():
    out = F.lit("other")
    for i, t in enumerate(TYPES[:-1]):
        out = F.when(F.col("doc_id") % 6 == i, t).otherwise(out)
    return out


def _clean_sql(rules: dict) -> str:
    norm = trim_sql(NORM.replace("text", "line"))
    gone = " or ".join(f"regexp_matches(n, '{p if p.startswith('^') or p.startswith('(?i)^') else '^' + p}')" for p in [*rules["control"], *([L.PAGE_NUMBER] if rules["numbers"] else [])]) or "false"
    out = "n"
    for p in [*rules["links"], *rules["noise"]]:
        out = trim_sql(f"regexp_replace({out}, '{p}', '', 'g')")
    out = f"regexp_replace({out}, '\\s*[(（\\[]\\d{{1,3}}[)）\\]](\\s*[,，.。；;]|$)', '\\1', 'g')"
    out = f"regexp_replace({out}, '([一-鿿])\\s*\\[\\d{{1,2}}(-\\d{{1,2}})?\\]', '\\1', 'g')"
    return f"(select case when {gone} then '' else {trim_sql(out)} end from (select {norm} n))"


CLEAN = f"with {LINES}, c as (select doc_id, line_no, case {KIND} " + " ".join(f"when '{k}' then {_clean_sql(r)}" for k, r in L.RULES.items()) + f" else {_clean_sql(L.DEFAULT)} end line from ln) select doc_id, line_no, line from c where line <> ''"


@R.add("clean_lines", CLEAN)
def clean_lines(spark, d):
    return L.clean_lines(_lines(spark, d).withColumn("kind", _kind()), "kind").select("doc_id", "line_no", "line")


@R.add("reference_sections", f"select chunk_id, metadata.section section from chunks where not (lower(trim(coalesce(metadata.section, ''))) in ('预防', '症状') or lower(trim(coalesce(metadata.section, ''))) in ({', '.join(repr(t) for t in L.REFERENCE_TITLES)}))")
def reference_sections(spark, d):
    """Sections titled as reference lists dropped; two titles of the corpus stand in for such."""
    c = table(spark, d, "chunks").select("chunk_id", F.col("metadata.section").alias("section"))
    title = F.when(F.col("section").isin("预防", "症状"), "参考文献").otherwise(F.col("section"))
    return L.without_reference_sections(c.withColumn("t", title).withColumn("kind", F.lit("wikipedia")), "t", "kind").select("chunk_id", "section")


REF = f"(regexp_matches(t, '{L.REF_START}') and regexp_matches(array_to_string(regexp_split_to_array(t, '\\s+')[1:12], ' '), '{L.REF_HINT}|\\d{{4}}\\s*年'))"


@R.add("reference_runs", f"with {LINES}, f as (select *, {REF} or line like '%No.%' flag from (select *, {trim_sql('line')} t from ln)), i as (select *, row_number() over (partition by doc_id order by line_no) - sum(flag::int) over (partition by doc_id order by line_no) isle from f), n as (select *, sum(flag::int) over (partition by doc_id, isle) n from i) select doc_id, line_no from n where not (flag and n >= 2)")
def reference_runs(spark, d):
    """Runs of two or more reference-like lines dropped; lines with a numbered item count as such too."""
    flag = L.reference_line(F.col("line")) | F.contains("line", F.lit("No."))
    return L.without_runs(_lines(spark, d), ["doc_id"], "line_no", flag, 2).select("doc_id", "line_no")


@R.add("noise_lines", f"select doc_id, len(list_filter(string_split(text, chr(10)), lambda x: not regexp_matches(x, '(?:JavaScript)|(?:Fig\\. \\d)|(?:见《)')))  kept from documents where text is not null")
def noise_lines(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.size(L.without_noise(F.split("text", "\n", -1), ["JavaScript", r"Fig\. \d", "见《"])).cast("bigint").alias("kept"))


@R.add("page_furniture", f"with p as (select distinct source_id, chunk_id, {trim_sql('line')} line from (select source_id, chunk_id, unnest(string_split(text, chr(10))) line from chunks where text is not null)), d as (select source_id from p group by 1 having count(distinct chunk_id) >= 3) select source_id, line from p where source_id in (select source_id from d) group by 1, 2 having count(*) >= 3 or regexp_matches(line, '{L.FURNITURE}')")
def page_furniture(spark, d):
    """Headers, footers and page numbers; the chunks of a document stand in for its pages."""
    c = table(spark, d, "chunks").where("text is not null").select("source_id", "chunk_id", F.explode(F.split("text", "\n", -1)).alias("line")).withColumn("line", T.strip(F.col("line")))
    return L.furniture(c, "source_id", "chunk_id", "line")


@R.add("scanned_pages", "select chunk_id, length(coalesce(text, '')) < 20 scanned from chunks")
def scanned_pages(spark, d):
    return L.scanned(table(spark, d, "chunks").select("chunk_id", "text"), "text").select("chunk_id", "scanned")


@R.add("contents_runs", f"with {LINES}, f as (select *, length(line) <= 60 and (regexp_matches(line, '\\s\\d{{1,4}}$') or regexp_matches(line, '：|: ')) flag from ln), i as (select *, row_number() over (partition by doc_id order by line_no) - sum(flag::int) over (partition by doc_id order by line_no) isle from f), n as (select *, sum(flag::int) over (partition by doc_id, isle) n from i) select doc_id, line_no from n where not (flag and n >= 3)")
def contents_runs(spark, d):
    """Runs of three or more contents lines dropped; short lines with a colon count as such too, since the texts have no contents lists."""
    flag = T.contents_line(F.col("line")) | ((F.length("line") <= 60) & F.col("line").rlike("：|: "))
    return L.without_runs(_lines(spark, d), ["doc_id"], "line_no", flag, 3).select("doc_id", "line_no")


SECTIONED = f"with {LINES}, {HEADED}, s as (select key doc_id, line_no, lvl, line, sum((lvl > 0 or line_no % 5 = 0)::int) over (partition by key order by line_no) section, last_value(case when lvl > 0 or line_no % 5 = 0 then line end ignore nulls) over (partition by key order by line_no) title from h)"


@R.add("line_sections", SECTIONED + " select doc_id, line_no, section::bigint section, coalesce(title, '') title from s where not (lvl > 0 or line_no % 5 = 0)")
def line_sections(spark, d):
    """Body lines under their last heading; every fifth line stands in for a heading beside the numbered ones."""
    level = F.greatest(T.heading_level(F.col("line")), (F.col("line_no") % 5 == 0).cast("int"))
    return L.assigned(_lines(spark, d).withColumn("level", level), "doc_id", "line_no", "level", "line").select("doc_id", "line_no", "section", "title")


JOINS = f"""with {LINES}, p as (select *, lag(line) over (partition by doc_id order by line_no) prev, length(regexp_replace(line, '^[0-9.．、（）()\\s]+', '')) > 25 or regexp_matches(line, '[。；;]$') body, false pbody from ln),
l as (select *, {LEVEL} lc from p), m as (select doc_id, line_no, line cur, prev, lc, length(regexp_replace(prev, '^[0-9.．、（）()\\s]+', '')) > 25 or regexp_matches(prev, '[。；;]$') body, prev line from l),
q as (select doc_id, line_no, cur, prev, lc, coalesce({LEVEL}, 0) lp from m)
select doc_id, line_no, coalesce(prev <> '' and right(prev, 1) not in ({', '.join(repr(c) for c in L.STOPS)}) and ((regexp_matches(prev, '{L.BARE}') and not regexp_matches(cur, '{L.BARE}') and not regexp_matches(cur, '{L.LIST_START}')) or (not regexp_matches(cur, '{L.LIST_START}') and lc = 0 and lp = 0)), false) joins from q"""


@R.add("broken_lines", JOINS)
def broken_lines(spark, d):
    return L.broken_joins(_lines(spark, d), ["doc_id"], "line_no", "line").select("doc_id", "line_no", "joins")


@R.add("merged_lines", f"select doc_id, {squash_sql('text')} squashed from documents where text is not null")
def merged_lines(spark, d):
    """Broken lines put together again: nothing but white space changes."""
    m = L.merged_lines(_lines(spark, d), "doc_id", "line_no", "line")
    return m.groupBy("doc_id").agg(T.squash(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "")).alias("squashed"))


@R.add("full_text", "select document_id, string_agg(x, chr(10) order by k, i) as text, count(*) parts from (select document_id, 0 k, 0 i, title x from (select distinct document_id, title from sources) union all select source_id, 1, row_number() over (partition by source_id order by chunk_id), text from chunks) where coalesce(x, '') <> '' group by 1")
def full_text(spark, d):
    """Titles and texts of a document in order, empty ones left out."""
    t = table(spark, d, "sources").select("document_id", "title").distinct().select("document_id", F.lit(0).alias("k"), F.lit("").alias("o"), F.col("title").alias("x"))
    c = table(spark, d, "chunks").select(F.col("source_id").alias("document_id"), F.lit(1).alias("k"), F.col("chunk_id").alias("o"), F.col("text").alias("x"))
    every = t.unionByName(c).where("coalesce(x, '') <> ''")
    return every.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "o", "x"))), lambda x: x["x"]), "\n").alias("text"), F.count("*").alias("parts"))


DATE = r"(\d{4})[-年](\d{1,2})[-月](\d{1,2})日?"


@R.add("page_dates", f"select doc_id, case when regexp_extract(published_at, '{DATE}', 1) <> '' then regexp_extract(published_at, '{DATE}', 1) || '-' || lpad(regexp_extract(published_at, '{DATE}', 2), 2, '0') || '-' || lpad(regexp_extract(published_at, '{DATE}', 3), 2, '0') end date, trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')) title from documents")
def page_dates(spark, d):
    html = F.concat(F.lit("<head><TITLE lang='x'>\n "), F.coalesce("title", F.lit("")), F.lit(" </TITLE></head>"))
    return table(spark, d, "documents").select("doc_id", L.iso_date(F.col("published_at"), DATE).alias("date"), L.html_title(html).alias("title"))


@R.add("personal_data", "select chunk_id, regexp_matches(text, '" + "|".join(L.PERSONAL) + "') personal from chunks where text is not null")
def personal_data(spark, d):
    return table(spark, d, "chunks").where("text is not null").select("chunk_id", L.personal(F.col("text")).alias("personal"))


TERMS = ["复查", "就诊", "asthma"]
NEG = "|".join(L.NEGATIONS)


@R.add("guarded_terms", f"select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '({NEG})(复查|就诊)', '\\1\u0001\\2', 'g'), '\u0001(复查|就诊)', '\u0002\\1', 'g'), '(^|[^\u0002])(复查|就诊)', '\\1***', 'g'), '(^|[^\u0002])(复查|就诊)', '\\1***', 'g'), '\u0002', '', 'g') masked from documents where text is not null and not regexp_matches(text, '(?i)asthma') and not regexp_matches(text, '(复查|就诊)(复查|就诊)')")
def guarded_terms(spark, d):
    """Terms masked where no negation stands right before them."""
    docs = table(spark, d, "documents").where("text is not null").where(~F.col("text").rlike("(?i)asthma") & ~F.col("text").rlike("(复查|就诊)(复查|就诊)"))
    return docs.select("doc_id", L.masked(F.col("text"), L.term_spans(F.col("text"), TERMS)).alias("masked"))


RULES = [("urgent", ["现在|正在|突然", "胸痛|胸闷|昏迷"]), ("dosage", ["药", "多少|几片"]), ("decision", ["要不要|能不能"])]


@R.add("first_rule", "select sample_id, case when regexp_matches(question, '现在|正在|突然') and regexp_matches(question, '胸痛|胸闷|昏迷') then 'urgent' when regexp_matches(question, '药') and regexp_matches(question, '多少|几片') then 'dosage' when regexp_matches(question, '要不要|能不能') then 'decision' end rule from queries")
def first_rule(spark, d):
    return table(spark, d, "queries").select("sample_id", L.first_rule(F.col("question"), RULES).alias("rule"))


def _bare_sql(t: str) -> str:
    return f"lower(regexp_replace({t}, '[\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}《》“”\"''·、，,：:\\x{{200e}}\\x{{200f}}\\-–—/]+', '', 'g'))"


NAMES = f"(select list_sort(list_distinct(list_filter(list_transform(list_concat([regexp_replace(v, '{L.BRACKET}', '', 'g')], regexp_extract_all(v, '{L.BRACKET}', 1)), lambda x: {_bare_sql('x')}), lambda x: length(x) >= 2))) from (select regexp_replace(t, '{L.VERSION}', '', 'g') v))"


@R.add("title_names", f"select document_id, array_to_string({NAMES}, '|') as \"names\" from (select distinct document_id, title || '（' || coalesce(section, '试行') || '）' t from sources where title is not null)")
def title_names(spark, d):
    s = table(spark, d, "sources").where("title is not null").select("document_id", F.concat("title", F.lit("（"), F.coalesce("section", F.lit("试行")), F.lit("）")).alias("t")).distinct()
    return s.select("document_id", F.array_join(L.title_names(F.col("t")), "|").alias("names"))


@R.add("excerpt_windows", f"with {LINES}, w as (select doc_id, line_no, unnest([{{'k': 0, 'x': line}}, {{'k': 1, 'x': line || lead(line) over (partition by doc_id order by line_no)}}]) u from ln), f as (select doc_id, line_no, u.k k, u.x excerpt from w where length(u.x) between 40 and 160), r as (select *, row_number() over (partition by doc_id order by line_no, k) - 1 i, count(*) over (partition by doc_id) n from f) select doc_id, line_no, excerpt from r where i in (select floor(j * (n / least(n, 3)))::bigint from range(0, least(n, 3)) t(j))")
def excerpt_windows(spark, d):
    return L.excerpts(_lines(spark, d), "doc_id", "line_no", "line", 40, 160, 3)


@R.add("slug_ids", "select document_id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9一-鿿]+', '-', 'g'), '^-+|-+$', '', 'g') || ':rc:' || row_number() over (partition by document_id order by accessed_at nulls first, chunk_ids) id from sources where title is not null")
def slug_ids(spark, d):
    w = X.Window.partitionBy("document_id").orderBy("accessed_at", "chunk_ids")
    return table(spark, d, "sources").where("title is not null").select("document_id", F.concat_ws(":", L.slug(F.col("title")), F.lit("rc"), F.row_number().over(w).cast("string")).alias("id"))


@R.add("section_tree", f"with {LINES}, t as (select doc_id, line_no, line_no % 3 + 1 lvl, left(line, 10) title from ln) select a.doc_id, a.line_no, a.title || '' title, coalesce((select string_agg(b.title, '>' order by b.line_no) from t b where b.doc_id = a.doc_id and b.line_no <= a.line_no and not exists (select 1 from t c where c.doc_id = a.doc_id and c.line_no > b.line_no and c.line_no <= a.line_no and c.lvl <= b.lvl)), '') path from t a")
def section_tree(spark, d):
    """Paths of enclosing headings; every line stands in for a heading of level 1 to 3."""
    from quillspark.operators.answers import section_paths

    t = _lines(spark, d).select("doc_id", "line_no", (F.col("line_no") % 3 + 1).alias("level"), F.left("line", F.lit(10)).alias("title"))
    return section_paths(t, "doc_id", "line_no", "level", "title").select("doc_id", "line_no", "title", F.array_join("path", ">").alias("path"))


@R.add("line_sizes", "select l_orderkey, quantile_cont(l_quantity, 0.5) size from lineitem group by 1")
def line_sizes(spark, d):
    """Medians of word sizes near a line; the items of an order stand in for its words."""
    w = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.lit(1.0).alias("top"), F.col("l_quantity").cast("double").alias("size"))).alias("w"))
    return w.select("l_orderkey", L.line_size(F.col("w"), F.lit(2.0)).alias("size"))


@R.add("masked_maps", "select sample_id, '{question=' || question || ', api_key=[REDACTED]}' as m from queries_authored where bucket is not null and not regexp_matches(question, '1[3-9]\\d{9}|@|Bearer')")
def masked_maps(spark, d):
    q = table(spark, d, "queries_authored").where("bucket is not null").where(~F.col("question").rlike(r"1[3-9]\d{9}|@|Bearer"))
    m = T.redact_map(F.create_map(F.lit("question"), F.col("question"), F.lit("api_key"), F.col("bucket")))
    return q.select("sample_id", F.concat(F.lit("{question="), m["question"], F.lit(", api_key="), m["api_key"], F.lit("}")).alias("m"))


@R.add("query_form", f"select sample_id, trim(regexp_replace(regexp_replace(question, '(?:问题|年龄|Question|Age)\\s*[:：]|未提供', ' ', 'g'), '\\s+', ' ', 'g')) q from queries")
def query_form(spark, d):
    return table(spark, d, "queries").select("sample_id", T.query_form(F.col("question"), ["问题", "年龄", "Question", "Age"], "未提供").alias("q"))
