"""Cleaning of page and document lines: rules by source type, reference lists, page furniture, broken lines, contents runs, sections."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.text import runs

# For each source type the patterns of control lines (from their start), link residue and inline noise, whether page numbers go, whether reference sections go, and from how many on runs of reference lines go.
_FACT = ["^打印本页?$", "^分享(本页|到)?$", "^收藏本页$", "^字号[:：].*$", "^阅读时间.*$", "^返回顶部$", "^Skip to main content$", "^实况报道$", r"^\d{4}年\d{1,2}月\d{1,2}日$"]
_LINKS = ["相关链接[:：]?.*$", "更多信息[见请].*$", "点击[这此]处.*$"]
_OFFICE = ["^打印.*$", "^分享到.*$", "^字号[:：].*$", "^来源[:：].*$", "^发布时间[:：].*$", "^分享本页.*$"]
RULES = {
    "who_factsheet": {"control": _FACT, "links": _LINKS, "noise": [], "numbers": False, "sections": True, "run": 2},
    "who_publication": {"control": _FACT, "links": _LINKS, "noise": [], "numbers": True, "sections": True, "run": 3},
    "nhc_document": {"control": _OFFICE, "links": [], "noise": [], "numbers": False, "sections": True, "run": 0},
    "epidemic_report": {"control": _OFFICE, "links": [], "noise": [], "numbers": False, "sections": True, "run": 0},
    "wikipedia": {"control": [r"^\[编辑\]$", "^编辑$", "^本条目.*$", "^此条目.*$"], "links": ["^跳到导航.*$", "^跳到搜索.*$", r"\[编辑\]"], "noise": [r"\[\d{1,3}\]"], "numbers": False, "sections": True, "run": 0},
}
DEFAULT = {"control": [], "links": [], "noise": [], "numbers": False, "sections": False, "run": 0}
# Page numbers, reference marks, titles of reference sections, reference lines and what hints at one.
PAGE_NUMBER = r"(?i)^(?:[ivxlcdm]{1,8}|\d{1,4}|第\s*\d{1,4}\s*页(?:[-—–]?\s*共\s*\d{1,4}\s*页)?)$"
MARKER, RAISED = r"\s*[(（\[]\d{1,3}[)）\]](?=\s*[,，.。；;]|$)", r"(?<=[一-鿿])\s*\[\d{1,2}(-\d{1,2})?\]"
REFERENCE_TITLES = ["参考文献", "参考资料", "参考文献列表", "外部链接", "延伸阅读", "注释", "references", "bibliography", "external links", "further reading", "notes"]
REF_START = r"^(?:\d{1,3}[.、．]|[(（]\d{1,3}[)）])\s*\S"
REF_HINT = r"(?i)\d{4}\s*年|https?://|www\.|ISBN\s*\d|doi\s*[:.]|et\s+al\.|Lancet|BMJ|Geneva|Washington|MMWR|PLoS|Cochrane"
HEAD_WORDS = 12
FURNITURE = r"^(第\s*\d+\s*页(共\s*\d+\s*页)?|[-—–]?\s*\d+\s*[-—–]?)$"
STOPS = "。！？；：.!?;:"
LIST_START = r"^([一二三四五六七八九十]+、|（[一二三四五六七八九十\d]+）|\([一二三四五六七八九十\d]+\)|\d+[、.．]|[•·●○▪-]\s)"
BARE = r"^(\d+\.\d+(\.\d+)*|[一二三四五六七八九十]+、|（[一二三四五六七八九十]+）|\([一二三四五六七八九十]+\)|第[一二三四五六七八九十\d]+[章节])$"
SCANNED = 20


NEVER = "(?!)"


def rule_table(spark) -> DataFrame:
    """(kind, gone, cut1..cutN): the rules as a table, one row a source type and one for all others (kind null)."""
    most = max(len(r["links"]) + len(r["noise"]) for r in RULES.values())
    rows = []
    for kind, r in [*RULES.items(), (None, DEFAULT)]:
        gone = [*r["control"], *([PAGE_NUMBER] if r["numbers"] else [])]
        cuts = [*r["links"], *r["noise"]]
        rows.append((kind, "|".join(f"(?:{p})" for p in gone) or NEVER, *cuts, *[NEVER] * (most - len(cuts))))
    return spark.createDataFrame(rows, "kind string, gone string, " + ", ".join(f"cut{i} string" for i in range(most)))


def clean_lines(lines: DataFrame, source_type: str, line: str = "line") -> DataFrame:
    """Lines cleaned by the rules of their source type (unknown ones by the default), those emptied dropped.

    Control lines and page numbers go whole, then link residue, noise and reference marks. The rules are a broadcast table of a few rows, so the plan has one pass whatever their number."""
    rules = rule_table(lines.sparkSession)
    known = F.col(source_type).isin(*RULES)
    j = lines.withColumn("_kind", F.when(known, F.col(source_type))).withColumn(line, T.normalize(F.col(line)))
    j = j.join(F.broadcast(rules.withColumnRenamed("kind", "_rule")), F.col("_kind").eqNullSafe(F.col("_rule")))
    cuts = [c for c in rules.columns if c.startswith("cut")]
    out = F.when(F.regexp_like(line, F.col("gone")), "").otherwise(F.col(line))
    for c in cuts:
        out = T.strip(F.regexp_replace(out, F.col(c), F.lit("")))
    out = T.strip(F.regexp_replace(F.regexp_replace(out, MARKER, ""), RAISED, ""))
    return j.withColumn(line, out).where(F.col(line) != "").select(*lines.columns)


def reference_line(line: Column) -> Column:
    """Whether a line looks like an entry of a reference list: numbered, with a hint in its first words."""
    words = F.split(T.strip(line), r"(?U)\s+")
    return T.strip(line).rlike(REF_START) & F.array_join(F.slice(words, 1, HEAD_WORDS), " ").rlike(REF_HINT)


def without_runs(lines: DataFrame, by: list[str], order: str, flag: Column, least: int) -> DataFrame:
    """Lines without runs of at least `least` neighbouring flagged ones; shorter runs stay."""
    marked = lines.withColumn("_flag", flag)
    return runs(marked, by, order, "_flag", least).where("not in_run").drop("_flag", "in_run")


def without_reference_sections(sections: DataFrame, title: str, source_type: str) -> DataFrame:
    """Sections without those titled as reference lists, for the source types whose rules say so."""
    ruled = [k for k, r in RULES.items() if r["sections"]]
    drop = F.lower(F.trim(F.coalesce(F.col(title), F.lit("")))).isin(REFERENCE_TITLES) & F.col(source_type).isin(ruled)
    return sections.where(~F.coalesce(drop, F.lit(False)))


def without_noise(items: Column, patterns: list[str]) -> Column:
    """The elements of an array in which none of the patterns is found anywhere."""
    return F.filter(items, lambda x: ~x.rlike("|".join(f"(?:{p})" for p in patterns)))


def furniture(lines: DataFrame, doc: str, page: str, line: str, least: int = 3) -> DataFrame:
    """(doc, line): lines on at least `least` pages, or page numbers, in documents of at least as many pages."""
    long = lines.groupBy(doc).agg(F.countDistinct(page).alias("_pages")).where(F.col("_pages") >= least).select(doc)
    each = lines.select(doc, page, line).distinct().groupBy(doc, line).agg(F.count("*").alias("_n"))
    return each.where((F.col("_n") >= least) | F.col(line).rlike(FURNITURE)).join(long, doc, "left_semi").select(doc, line)


def scanned(pages: DataFrame, text: str) -> DataFrame:
    """Pages with whether they have too few characters to hold text."""
    return pages.withColumn("scanned", F.length(F.coalesce(F.col(text), F.lit(""))) < SCANNED)


def median(values: Column) -> Column:
    """The median of an array, the mean of the middle two where it is even."""
    v = F.array_sort(values)
    n = F.size(v)
    low, high = F.element_at(v, F.floor((n + 1) / 2).cast("int")), F.element_at(v, F.floor(n / 2).cast("int") + 1)
    return F.when(n > 0, (low + high) / 2)


def line_size(words: Column, top: Column, near: float = 3.0) -> Column:
    """Type size of a line: the median size of the words (array of {top, size}) within `near` points of its top."""
    return median(F.transform(F.filter(words, lambda w: F.abs(w["top"] - top) <= near), lambda w: w["size"]))


def broken_joins(lines: DataFrame, by: list[str], order: str, line: str) -> DataFrame:
    """Adds whether a line continues the one before: that one ends without a stop and is no heading, and this one opens no list or heading; a bare number takes the line after it.

    Whether a line continues depends on its neighbour's own text alone, except that a line which continues a bare number is a whole heading; it is taken as that."""
    w = Window.partitionBy(*by).orderBy(order)
    prev, cur = F.lag(line).over(w), F.col(line)
    bare = prev.rlike(BARE) & ~F.right(prev, F.lit(1)).isin(*STOPS) & ~cur.rlike(BARE) & ~cur.rlike(LIST_START)
    plain = ~F.right(prev, F.lit(1)).isin(*STOPS) & ~cur.rlike(LIST_START) & (T.heading_level(cur) == 0) & (T.heading_level(prev) == 0)
    return lines.withColumn("_prev", prev).withColumn("joins", F.coalesce((prev != "") & (bare | plain), F.lit(False))).drop("_prev")


def merged_lines(lines: DataFrame, by: str, order: str, line: str) -> DataFrame:
    """(by, seq, line): broken lines put together again, with a blank after an ASCII letter or digit (any ASCII character after a bare number).

    A sequential fold, since what a line is joined to is the text built so far; pages are bounded, so each is folded within its row."""
    kind = dict(lines.dtypes)[by]
    import re

    bare, starts = re.compile(BARE), re.compile(LIST_START)
    patterns = [(re.compile(p), n) for p, n in T.HEADINGS]
    toc, lead = re.compile(T.CONTENTS), re.compile(r"^[\d.．、（）()\s]+")

    def level(s: str) -> int:
        if not s or len(s) > T.HEADING_MAX or toc.search(s):
            return 0
        n = next((n for p, n in patterns if p.match(s)), 0)
        return 0 if n >= 3 and (len(lead.sub("", s)) > 25 or s[-1] in "。；;") else n

    def glue(a: str, b: str) -> str | None:
        """The joined text, or None where b stands alone."""
        if not a:
            return None
        last = a[-1]
        if bare.match(a) and last not in STOPS and not bare.match(b) and not starts.match(b):
            return a + (" " if last.isascii() else "") + b
        if last in STOPS or starts.match(b) or level(b) or level(a):
            return None
        return a + (" " if last.isascii() and last.isalnum() else "") + b

    def run(batches):
        for b in batches:
            rows = []
            for k, xs in zip(b[by], b["x"], strict=True):
                out: list[str] = []
                for x in xs:
                    joined = glue(out[-1], x) if out else None
                    out[len(out) - (joined is not None) :] = [x if joined is None else joined]
                rows += [(k, i, t) for i, t in enumerate(out)]
            yield pd.DataFrame(rows, columns=[by, "seq", "line"])

    held = lines.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]).alias("x"))
    return held.mapInPandas(run, f"{by} {kind}, seq bigint, line string")


def assigned(lines: DataFrame, by: str, order: str, level: str, line: str) -> DataFrame:
    """Body lines with the number and title of the last heading before them in their document (0 and an empty title before the first)."""
    w = Window.partitionBy(by).orderBy(order)
    head = F.col(level) > 0
    out = lines.withColumn("section", F.sum(head.cast("int")).over(w)).withColumn("title", F.coalesce(F.last(F.when(head, F.col(line)), ignorenulls=True).over(w), F.lit("")))
    return out.where(~head)


def iso_date(text: Column, pattern: str) -> Column:
    """YYYY-MM-DD of the first match of a pattern with groups for year, month and day; null without one."""
    y, m, d = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    return F.when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


def html_title(html: Column) -> Column:
    return T.strip(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"(?U)\s+", " "))


# Telephone, identity, mail and record number patterns of the predicate, which has no boundaries.
PERSONAL = [r"1[3-9]\d{9}", r"\d{17}[\dXx]", r"[\w.+-]+@[\w-]+\.[\w.]+", r"(病历号|住院号|门诊号|患者编号)[:：]?\s*\w+"]


def personal(c: Column) -> Column:
    """Whether a text holds something that looks personal."""
    return c.rlike("|".join(PERSONAL))


# What before a term negates it.
NEGATIONS = ["尚未", "暂未", "还未", "并未", "从未", "没有", "无法", "不能", "难以", "无需", "排除", "未", "不", "非"]


def _free_span(n: int):
    """A step over the stretches between occurrences of a term of n characters: its span is kept where no negation ends the stretch."""

    def step(a, x):
        at = a["p"] + F.length(x)
        free = ~x.rlike("(?:" + "|".join(NEGATIONS) + ")$")
        return F.struct((at + n).alias("p"), F.when(free, F.array_append(a["o"], F.struct(at.alias("s"), (at + n).alias("e")))).otherwise(a["o"]).alias("o"))

    return step


def term_spans(text: Column, terms: list[str]) -> Column:
    """Spans {s, e} (0-based, end exclusive) of guarded terms: words of ASCII letters at word boundaries in any case, others where no negation stands right before; overlapping spans are merged."""
    found = F.array().cast("array<struct<s:int,e:int>>")
    for t in terms:
        if t.isascii():
            cut = F.split(text, rf"(?i)\b{t}\b", -1)
            at = F.aggregate(F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(0))), F.struct(F.lit(0).alias("p"), F.array().cast("array<struct<s:int,e:int>>").alias("o")), lambda a, x: F.struct((a["p"] + F.length(x) + len(t)).alias("p"), F.array_append(a["o"], F.struct((a["p"] + F.length(x)).alias("s"), (a["p"] + F.length(x) + len(t)).alias("e"))).alias("o")), lambda a: a["o"])
        else:
            cut = F.split(text, t, -1)
            init = F.struct(F.lit(0).alias("p"), F.array().cast("array<struct<s:int,e:int>>").alias("o"))

            at = F.aggregate(F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(0))), init, _free_span(len(t)), lambda a: a["o"])
        found = F.concat(found, at)
    ordered = F.array_sort(found)
    none = F.array().cast("array<struct<s:int,e:int>>")

    def merge(a, x):
        last = F.element_at(a, -1)
        return F.when((F.size(a) > 0) & (x["s"] <= F.try_element_at(a, F.lit(-1))["e"]), F.array_append(F.slice(a, 1, F.size(a) - 1), F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e")))).otherwise(F.array_append(a, x))

    return F.aggregate(ordered, none, merge)


def masked(text: Column, spans: Column) -> Column:
    """The text with *** in place of each span."""
    init = F.struct(F.lit(0).alias("p"), F.lit("").alias("o"))
    return F.aggregate(spans, init, lambda a, x: F.struct(x["e"].alias("p"), F.concat(a["o"], F.substr(text, a["p"] + 1, x["s"] - a["p"]), F.lit("***")).alias("o")), lambda a: F.concat(a["o"], F.substr(text, a["p"] + 1)))


# Version brackets and noise of titles.
VERSION, BRACKET, TITLE_NOISE = r"[（(][^）)]*(?:版|试行|附件|含)[^）)]*[）)]", r"[（(]([^）)]*)[）)]", "[\\s《》“”\"'·、，,：:‎‏\\-–—/]+"


def bare_name(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, TITLE_NOISE, ""))


def title_names(title: Column) -> Column:
    """The names a title gives: outside its brackets and inside each, without version brackets and noise, of at least two characters."""
    t = F.regexp_replace(title, VERSION, "")
    names = F.concat(F.array(F.regexp_replace(t, BRACKET, "")), F.regexp_extract_all(t, F.lit(BRACKET), F.lit(1)))
    return F.array_sort(F.array_distinct(F.filter(F.transform(names, bare_name), lambda x: F.length(x) >= 2)))


def excerpts(lines: DataFrame, by: str, order: str, line: str, low: int, high: int, picks: int) -> DataFrame:
    """(by, order, excerpt): windows of one or two neighbouring lines with a length in [low, high], `picks` of them evenly spaced over each document."""
    w = Window.partitionBy(by).orderBy(order)
    two = F.concat(F.col(line), F.lead(line).over(w))
    each = lines.withColumn("x", F.array(F.col(line), two)).select(by, F.col(order), F.posexplode("x").alias("k", "excerpt")).where(F.length("excerpt").between(low, high))
    r = Window.partitionBy(by).orderBy(order, "k")
    n = F.count("*").over(Window.partitionBy(by))
    ranked = each.withColumn("i", F.row_number().over(r) - 1).withColumn("n", n)
    wanted = F.transform(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(picks)) - 1), lambda i: F.floor(i * (F.col("n") / F.least(F.col("n"), F.lit(picks)))))
    return ranked.where(F.array_contains(wanted, F.col("i").cast("bigint"))).select(by, order, "excerpt")


def slug(c: Column) -> Column:
    """Lower-case letters, digits and Han characters, other runs as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9一-鿿]+", "-"), "^-+|-+$", "")


def first_rule(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The name of the first rule whose patterns are all found; null without one."""
    out = F.lit(None).cast("string")
    for name, patterns in reversed(rules):
        hit = F.lit(True)
        for p in patterns:
            hit = hit & text.rlike(p)
        out = F.when(hit, name).otherwise(out)
    return out
