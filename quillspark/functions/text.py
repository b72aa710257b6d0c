"""Column functions on texts. All stay in the JVM; defaults equal the conventions of the corpus pipeline."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ　"
PLAIN = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz "


def squash(c: Column) -> Column:
    """The text without any white space."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def strip(c: Column) -> Column:
    """White space cut at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize(c: Column) -> Column:
    """Full-width letters, digits and blanks to half width; one kind of line end; runs of blanks to one; trimmed. Full-width punctuation stays."""
    c = F.regexp_replace(F.translate(c, WIDE, PLAIN), "\r\n|\r", "\n")
    return F.regexp_replace(F.regexp_replace(c, "[ \t　 ]+", " "), r"(?U)^\s+|\s+$", "")


def tokens_whitespace(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda x: x != "")


def tokens_bigram(c: Column) -> Column:
    """Lower case; runs of Han characters as adjacent pairs (single ones alone), runs of a-z and 0-9 whole."""
    parts = F.regexp_extract_all(F.lower(c), F.lit("([㐀-鿿]+|[a-z0-9]+)"), F.lit(1))
    pairs = F.transform(parts, lambda p: F.when(p.rlike("^[㐀-鿿]{2,}$"), F.transform(F.sequence(F.lit(1), F.length(p) - 1), lambda i: F.substring(p, i, F.lit(2)))).otherwise(F.array(p)))
    return F.flatten(pairs)


def token_bag(c: Column) -> Column:
    """The tokens of `tokens_bigram` in no particular order: three scans without a lambda, for counting and set operations."""
    def every(pattern):
        return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(1))

    return F.concat(every("(?=([㐀-鿿]{2}))"), every("(?<![㐀-鿿])([㐀-鿿])(?![㐀-鿿])"), every("([a-z0-9]+)"))


def sentences(c: Column, ends: str = "。！？；") -> Column:
    """Pieces up to and with an end mark and its closers, trimmed, empty ones dropped."""
    parts = F.regexp_extract_all(c, F.lit(f"([^{ends}]*[{ends}][”’」』）)]*|[^{ends}]+)"), F.lit(1))
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def clauses(c: Column) -> Column:
    """Pieces up to and with a comma-like mark, untrimmed."""
    return F.regexp_extract_all(c, F.lit("([^，、：]*[，、：]|[^，、：]+)"), F.lit(1))


def let(value: Column, use) -> Column:
    """use(value) with the value computed once: lambdas would otherwise compute an outer expression again for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def windows(c: Column, n: int) -> Column:
    """All n-character substrings in order (the whole text if it is shorter), in time linear in the text."""
    def cut(chars):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(chars) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(chars, i, F.lit(n)), ""))

    return let(F.split(c, ""), cut)


def shingles(c: Column, n: int = 5) -> Column:
    """The set of n-character substrings of the squashed text; a text of at most n characters is its own only one."""
    empty = F.array().cast("array<string>")
    return let(squash(c), lambda s: F.when(F.length(s) == 0, empty).otherwise(F.array_distinct(windows(s, n))))


def ascii_ratio(c: Column) -> Column:
    s = squash(c)
    return F.when(F.length(s) == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(s, r"[^\x00-\x7F]", "")) / F.length(s))


# Numbering patterns of headings and their levels, the first that fits wins.
HEADINGS = (
    (r"^第[一二三四五六七八九十百\d]+[章节篇部分]", 1), (r"^[一二三四五六七八九十]+、\S", 1), (r"^（[一二三四五六七八九十]+）\s*\S", 2), (r"^\([一二三四五六七八九十]+\)\s*\S", 2),
    (r"^\d{1,2}\.\d+(\.\d+)*[、\s]+[^\d\s]", 3), (r"^\d{1,2}[、.．]\s*[^\d.．\s]", 3), (r"^（\d{1,2}）\S", 4), (r"^\(\d{1,2}\)\S", 4),
)
# Fixed value: a contents line ends with a blank and a page number.
CONTENTS = r"\s\d{1,4}$"
HEADING_MAX = 60


def contents_line(line: Column) -> Column:
    return (F.length(line) <= HEADING_MAX) & line.rlike(CONTENTS)


def heading_level(line: Column, size: Column | None = None, body_size: Column | None = None) -> Column:
    """0 for body and contents lines, else the level that the numbering of the line gives, or 2 for a short line in larger type than the body."""
    rest = F.length(F.regexp_replace(line, r"^[0-9.．、（）()\s]+", ""))
    body = (rest > 25) | line.rlike("[。；;]$")
    level = F.lit(0)
    if size is not None:
        level = F.when((size > 0) & (body_size > 0) & (size >= body_size * 1.15) & (F.length(line) <= 30), 2).otherwise(level)
    for pattern, n in reversed(HEADINGS):
        hit = F.when(body, 0).otherwise(n) if n >= 3 else F.lit(n)
        level = F.when(line.rlike(pattern), hit).otherwise(level)
    return F.when((line == "") | (F.length(line) > HEADING_MAX) | line.rlike(CONTENTS), 0).otherwise(level)


# What is masked, in this order.
REDACTIONS = (
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]"), (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[REDACTED]"),
    (r"(?<!\d)(?:\+?86[- ]?)?1[3-9]\d{9}(?!\d)", "[REDACTED]"), (r"(?<!\d)\d{17}[\dXx](?!\d)", "[REDACTED]"),
)
# Parts of names whose values are masked whole.
SENSITIVE = "authorization|api_?key|token|secret|password|cookie|phone|id_?card|email"


def redact(c: Column) -> Column:
    """Bearer tokens, e-mail addresses, mainland phone and identity numbers masked, in this order."""
    for pattern, mask in REDACTIONS:
        c = F.regexp_replace(c, pattern, mask)
    return c


def redact_map(c: Column) -> Column:
    """Values of a map masked: whole under a sensitive key, else as texts."""
    return F.transform_values(c, lambda k, v: F.when(F.lower(k).rlike(SENSITIVE), F.lit("[REDACTED]")).otherwise(redact(v)))


# Section types by keyword, the first that fits wins.
SECTION_RULES = (
    ("transmission", "传播|感染途径|传染途径"), ("symptoms", "症状|临床表现|体征"), ("prevention", "预防|疫苗"), ("treatment", "治疗|诊疗|处理"),
    ("epidemiology", "流行|发病|负担|统计|概况|问题的范围"), ("key_facts", "要点|重要事实"), ("definition", "概述|简介|是什么|^定义$|^.{0,6}的定义$"),
)


def section_type(c: Column) -> Column:
    c = F.trim(c)
    out = F.lit(None).cast("string")
    for name, rule in reversed(SECTION_RULES):
        out = F.when(c.rlike(rule), name).otherwise(out)
    return out


def section_type_of_path(path: Column) -> Column:
    """The section type of the deepest heading of a path (array from the top) that has one."""
    return F.try_element_at(F.filter(F.transform(F.reverse(path), section_type), lambda x: x.isNotNull()), F.lit(1))


def overlap(question: Column, text: Column) -> Column:
    """Share of the question's distinct tokens that the text has."""
    q = F.array_distinct(question)
    return F.size(F.array_intersect(q, text)) / F.greatest(F.size(q), F.lit(1))


def query_form(c: Column, labels: list[str], placeholder: str) -> Column:
    """A question on one line: labels with their colon and the placeholder for missing values become blanks, runs of white space one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "(?:" + "|".join(labels) + r")\s*[:：]|" + placeholder, " "), r"\s+", " "))
