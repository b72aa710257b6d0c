"""Queries of the training-data operators and the SQL that DuckDB can check them with."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.llm import p01_canonical, p02_overlap, p03_encoding, p04_sentences, p05_page_body, p06_near_duplicates, p07_site_lines, p08_packing, p09_leakage, p10_residue
from quillspark.registry import Registry, table

R = Registry()


def _reduced_sql(t: str) -> str:
    """Letters and digits in lower case, full-width forms as plain ones: what NFKC does to the characters of these tables."""
    wide = "".join(chr(0xFF01 + i) for i in range(94)).replace("'", "''")
    plain = "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")
    return f"regexp_replace(lower(translate(nfc_normalize({t}), '{wide}', '{plain}')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def _windows_sql(t: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, length({t}) - {n - 2}), lambda i: substring({t}, i, {n})))"


P2_SQL = f"""
with q as (select sample_id, split, {_reduced_sql('question')} r from queries where split is not null and question is not null),
g as (select sample_id, split = 'train' train, unnest({_windows_sql('r', 3)}) g from q where length(r) >= 3), n as (select sample_id, count(*) n from g group by 1),
c as (select a.sample_id a, b.sample_id b, count(*) c from g a join g b on a.g = b.g and a.train and not b.train group by 1, 2)
select least(a, b) sample_a, greatest(a, b) sample_b from c join n x on a = x.sample_id join n y on b = y.sample_id where c / (x.n + y.n - c) >= 0.7 - 1e-12 and a <> b
"""
P6_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1c}-\x{1f}\x{0b}]"
P6_SQL = f"""
with r as (select chunk_id, source_id, regexp_replace(text, '{P6_SPACE}+', '', 'g') s from chunks where text is not null),
g as (select chunk_id, unnest({_windows_sql('s', 5)}) g from r where length(s) >= 5), n as (select chunk_id, count(*) n from g group by 1),
c as (select a.chunk_id a, b.chunk_id b, count(*) c from g a join g b on a.g = b.g and a.chunk_id < b.chunk_id group by 1, 2)
select a chunk_a, b chunk_b from c join n x on a = x.chunk_id join n y on b = y.chunk_id join r p on a = p.chunk_id join r q on b = q.chunk_id where c / (x.n + y.n - c) >= 0.8 - 1e-12 and p.source_id is distinct from q.source_id
"""
P9_SQL = f"""
with i as (select item_id, unnest({_windows_sql('r', 50)}) w from (select item_id, {_reduced_sql('text')} r from heldout_items where text is not null) where length(r) >= 50),
d as (select doc_id, unnest({_windows_sql('r', 50)}) w from (select doc_id, {_reduced_sql('text')} r from documents where text is not null) where length(r) >= 50)
select distinct doc_id, item_id from d join i using (w)
"""


@R.add("p1_found")
def p1_found(spark, d):
    c = p01_canonical.lookalike_pairs(table(spark, d, "chunks"), "chunk_id", "text").select(F.lit("chunks").alias("table_name"), "key_a", "key_b")
    q = p01_canonical.lookalike_pairs(table(spark, d, "queries_authored"), "sample_id", "question")
    return c.unionByName(q.select(F.lit("queries_authored").alias("table_name"), "key_a", "key_b"))


@R.add("p1_canonical")
def p1_canonical(spark, d):
    c = p01_canonical.canonical_texts(table(spark, d, "chunks"), "chunk_id", "text").withColumn("table_name", F.lit("chunks"))
    q = p01_canonical.canonical_texts(table(spark, d, "queries_authored"), "sample_id", "question").withColumn("table_name", F.lit("queries_authored"))
    return c.unionByName(q)


@R.add("p3_found")
def p3_found(spark, d):
    return p03_encoding.found(table(spark, d, "chunks"))


@R.add("p3_restored")
def p3_restored(spark, d):
    return p03_encoding.restored_texts(table(spark, d, "chunks"))


@R.add("p4_found")
def p4_found(spark, d):
    return p04_sentences.found(table(spark, d, "chunks"))


@R.add("p4_sentences")
def p4_sentences(spark, d):
    return p04_sentences.units(table(spark, d, "chunks"), texts=True)


@R.add("p2_found", P2_SQL)
def p2_found(spark, d):
    return p02_overlap.found(table(spark, d, "queries"))


@R.add("p2_report")
def p2_report(spark, d):
    return p02_overlap.report(table(spark, d, "queries"))


@R.add("p5_found")
def p5_found(spark, d):
    return p05_page_body.found(table(spark, d, "chunks"))


@R.add("p5_bodies")
def p5_bodies(spark, d):
    return p05_page_body.bodies(table(spark, d, "chunks"))


@R.add("p6_found", P6_SQL)
def p6_found(spark, d):
    return p06_near_duplicates.found(table(spark, d, "chunks"))


@R.add("p6_groups")
def p6_groups(spark, d):
    return p06_near_duplicates.groups(table(spark, d, "chunks"))


P7_SQL = r"""
with lines as (
  select chunk_id, source, source_id, i - 1 as line_no,
         lower(regexp_replace(l, '[\s\p{Nd}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1c}-\x{1f}\x{0b}]', '', 'g')) as form
  from (select chunk_id, source, source_id, unnest(string_split(text, chr(10))) as l,
               generate_subscripts(string_split(text, chr(10)), 1) as i from chunks where text is not null)),
often as (select source, form from lines where form <> '' group by 1, 2 having count(distinct source_id) >= 6)
select distinct chunk_id, line_no from lines join often using (source, form)
"""


@R.add("p7_found", P7_SQL)
def p7_found(spark, d):
    return p07_site_lines.repeated_lines(table(spark, d, "chunks"))


P7_CLEAN_SQL = f"""
with cut as ({P7_SQL}), l as (select chunk_id, i - 1 line_no, line from (select chunk_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i from chunks where text is not null)),
k as (select chunk_id, string_agg(line, chr(10) order by line_no) t from l anti join cut using (chunk_id, line_no) group by 1), n as (select chunk_id, count(*)::int n from cut group by 1)
select chunk_id, case when text is not null then coalesce(t, '') end as text, coalesce(n, 0) removed from chunks left join k using (chunk_id) left join n using (chunk_id)
"""


@R.add("p7_clean", P7_CLEAN_SQL)
def p7_clean(spark, d):
    return p07_site_lines.without_repeated_lines(table(spark, d, "chunks"))


def _capacities(spark, d):
    rows = table(spark, d, "pack_capacities").select("capacity_name", "capacity_tokens").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1,000 permitted capacities")
    return [(r.capacity_name, r.capacity_tokens) for r in rows]


@R.add("p8_packed")
def p8_packed(spark, d):
    return p08_packing.packed(table(spark, d, "documents"), [(n, [c]) for n, c in _capacities(spark, d)])


@R.add("p8_joint")
def p8_joint(spark, d):
    return p08_packing.packed(table(spark, d, "documents"), [("joint", [c for _, c in _capacities(spark, d)])])


@R.add("p9_found", P9_SQL)
def p9_found(spark, d):
    return p09_leakage.leaks(table(spark, d, "documents"), table(spark, d, "heldout_items"))


@R.add("p9_spans")
def p9_spans(spark, d):
    return p09_leakage.leaks(table(spark, d, "documents"), table(spark, d, "heldout_items"), spans=True)


@R.add("p10_found")
def p10_found(spark, d):
    return p10_residue.found(table(spark, d, "documents"))


@R.add("p10_spans")
def p10_spans(spark, d):
    return p10_residue.residue_spans(table(spark, d, "documents"))


def queries():
    return dict(R.queries)


def oracle_sql():
    return dict(R.sql)
