"""Chunking: recursive splits, sentence pairs as children, parents, overlaps; per text or over the elements of a document.

Groups of neighbouring parts are folds over their lengths that number the groups; texts are joined once, by number."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_CHARS, OVERLAP, CHILD_MAX, CHILD_MERGE, CHILD_MIN, PARENT_MAX = 512, 76, 110, 130, 15, 600
ENDS, COMMAS, SOFT = "。！？；", "，、：", "，、：,；;"
_CLOSERS = "”’」』）)"
# Page controls and dates that stand alone on a line.
CONTROL = r"(?i)^(?:Skip to main content|阅读时间|打印|分享|分享本页|实况报道|\d{4}年\d{1,2}月\d{1,2}日|\d{4}年\d{1,2}月|[ivxlcdm]{1,8}|\d{1,4})$|^世卫组织\s*/\s*媒体中心|^媒体中心\s*/"
_CONTROL = re.compile(CONTROL)


def pieces(text: str, marks: str) -> list[str]:
    """Substrings that end with a mark and its closers; together they are the text."""
    return re.findall(f"[^{marks}]*[{marks}][{_CLOSERS}]*|[^{marks}]+", text)


def sentences(text: str, ends: str = ENDS) -> list[str]:
    return [s for p in pieces(text, ends) if (s := p.strip())]


def _joined(parts: list[str], numbers: Iterable[int]) -> list[str]:
    return ["".join(p for p, _ in g) for _, g in groupby(zip(parts, numbers, strict=True), key=lambda x: x[1])]


def _numbers(parts: list[str], start: tuple, step: Callable[[tuple, int], tuple]) -> list[int]:
    """Group numbers of the parts: the first field of a state folded over their lengths."""
    return [s[0] for s in accumulate((len(p) for p in parts), step, initial=start)][1:]


def filled(parts: list[str], limit: int) -> list[int]:
    """Numbers of groups that take parts while they fit; a part above the limit is a group of its own."""
    return _numbers(parts, (-1, limit + 1), lambda s, n: (s[0], s[1] + n) if s[1] + n <= limit else (s[0] + 1, n))


def paired(parts: list[str], limit: int) -> list[int]:
    """Numbers of groups of one or two parts within the limit; the second field is the room beside a lone first part, -1 where nothing joins."""
    return _numbers(parts, (-1, -1), lambda s, n: (s[0], -1) if n <= s[1] else (s[0] + 1, limit - n))


def absorbed(parts: list[str], least: int, limit: int, merge: int) -> list[int]:
    """Numbers of groups in which parts under `least` join the group to their left, if that is under `limit` and both stay within `merge`."""

    def step(s: tuple, n: int) -> tuple:
        joins = 0 <= s[1] < min(limit, merge - n + 1) and n < least
        return (s[0], s[1] + n) if joins else (s[0] + 1, n)

    return _numbers(parts, (-1, -1), step)


def split(text: str, limit: int = MAX_CHARS, levels: tuple[str, ...] = (ENDS, COMMAS)) -> list[str]:
    """The text if it fits; else its sentences filled into groups, those too long cut at commas, and what has none into slices.

    Groups never reach across a part that is cut further."""
    if len(text) <= limit:
        return [text] if text else []
    if not levels:
        return [text[i : i + limit] for i in range(0, len(text), limit)]
    parts = sentences(text, levels[0]) if levels[0] == ENDS else pieces(text, levels[0])
    if len(parts) < 2:
        return split(text, limit, levels[1:])
    out: list[str] = []
    for fits, run in groupby(parts, key=lambda p: len(p) <= limit):
        run = list(run)
        out += _joined(run, filled(run, limit)) if fits else [c for p in run for c in split(p, limit, levels[1:])]
    return out


def cut_long(text: str, limit: int) -> list[str]:
    """Slices of at most `limit` characters that end at the last soft mark, or at the limit where that lies in the first third."""
    out = []
    while len(text) > limit:
        at = max(text.rfind(c, 0, limit) for c in SOFT) + 1
        at = at if at > limit // 3 else limit
        out.append(text[:at])
        text = text[at:]
    return [*out, text] if text else out


def children(parts: list[str], limit: int = CHILD_MAX, merge: int = CHILD_MERGE, least: int = CHILD_MIN) -> list[str]:
    """One or two sentences each; sentences above the limit are cut and stay unpaired, short ones join to the left, controls are dropped."""
    out: list[str] = []
    for fits, run in groupby(parts, key=lambda p: len(p) <= limit):
        run = list(run)
        out += _joined(run, paired(run, limit)) if fits else [c for p in run for c in cut_long(p, limit)]
    return [c for c in _joined(out, absorbed(out, least, limit, merge)) if not _CONTROL.search(c.strip())]


def parents(text: str, limit: int = PARENT_MAX) -> list[tuple[str, list[str]]]:
    """(parent text, its sentences): the paragraph, or one above the limit in groups of sentences, sentences above it in slices."""
    own = sentences(text)
    if len(text) <= limit:
        return [(text, own)]
    out: list[tuple[str, list[str]]] = []
    for fits, run in groupby(own, key=lambda p: len(p) <= limit):
        run = list(run)
        if fits:
            groups = [[p for p, _ in g] for _, g in groupby(zip(run, filled(run, limit), strict=True), key=lambda x: x[1])]
            out += [("".join(g), g) for g in groups]
        else:
            out += [(c, [c]) for p in run for c in cut_long(p, limit)]
    return out


def overlapped(chunks: list[str], size: int = OVERLAP) -> list[str]:
    """Each chunk after the first preceded by the last characters of the one before."""
    return [(chunks[i - 1][-size:] if i else "") + c for i, c in enumerate(chunks)]


def row_text(header: list[str], row: list[str]) -> str:
    """A table row as name：cell；..., blank cells skipped, missing names 列N."""
    named = ((header[i].strip() if i < len(header) and header[i] and header[i].strip() else f"列{i + 1}", (c or "").strip()) for i, c in enumerate(row))
    return "；".join(f"{n}：{c}" for n, c in named if c)


def units(element) -> list[tuple[str, str]]:
    """(kind, text) of one element {kind, text, items, header, rows}: a paragraph, the items of a list, the rows of a table or its summary; controls and blanks are dropped."""
    kind, text = element["kind"], (element["text"] or "").strip()
    if kind == "list":
        return [("list", s) for i in element["items"] if i and (s := i.strip()) and not _CONTROL.search(s)]
    if kind == "table":
        rows = [("table_row", t) for r in element["rows"] if (t := row_text(list(element["header"]), list(r)))]
        return rows or ([("table", text)] if text and not len(element["rows"]) else [])
    return [("paragraph", text)] if kind == "paragraph" and text and not _CONTROL.search(text) else []


def document_chunks(elements, limit: int = MAX_CHARS) -> list[tuple[int, int, str, str]]:
    """(section, seq, content_kind, text) of a document's elements in order: neighbouring texts of a section share chunks with overlap, table rows and summaries stand alone, a text above the limit is split on its own."""
    out: list[tuple[int, int, str, str]] = []
    for section, own in groupby(elements, key=lambda e: e["section"]):
        made: list[tuple[str, str]] = []
        stream = [(("table" if k.startswith("table") else "text") if len(t) <= limit else "long", k, t) for e in own for k, t in units(e)]
        for kind, run in groupby(stream, key=lambda x: x[0]):
            run = list(run)
            if kind == "text":
                texts = [t for *_, t in run]
                made += [("text", t) for t in _joined(texts, filled(texts, limit))]
                continue
            for _, k, t in run:
                tabular = {"table_row": "table_row", "table": "table_summary"}.get(k)
                cut = split(t, limit)
                made += [(tabular or "text", c) for c in (cut if tabular else overlapped(cut))]
        out += [(int(section), i, k, t) for i, (k, t) in enumerate(made)]
    return out


def table_summary(element) -> str:
    """How many rows a table has and its column names."""
    names = "、".join(h for h in element["header"] if h)
    return f"表格共 {len(element['rows'])} 行" + (f"，列：{names}" if names else "")


def document_families(elements) -> list[tuple[int, str, int, int, str, str]]:
    """(section, role, parent_seq, seq, content_kind, text): parents with their children; paragraphs, lists filled into parents, tables with a summary as parent and a child a row."""
    out: list[tuple[int, str, int, int, str, str]] = []
    for section, own in groupby(elements, key=lambda e: e["section"]):
        n = seq = 0
        for e in own:
            got = units(e)
            if not got:
                continue
            kind, texts = got[0][0], [t for _, t in got]
            if kind == "table_row":
                family = [(table_summary(e), "table_summary", "table_row", texts)]
            elif kind == "table":
                family = [(texts[0], "table_summary", "table_summary", texts)]
            elif kind == "list":
                groups = [[p for p, _ in g] for _, g in groupby(zip(texts, filled(texts, PARENT_MAX), strict=True), key=lambda x: x[1])]
                family = [("".join(g), "list", "list", children(g)) for g in groups]
            else:
                family = [(p, "text", "text", children(s)) for p, s in parents(texts[0])]
            for parent, parent_kind, child_kind, kids in family:
                out.append((int(section), "parent", n, n, parent_kind, parent))
                out += [(int(section), "child", n, seq + i, child_kind, c) for i, c in enumerate(kids)]
                seq += len(kids)
                n += 1
    return out


def _each(df: DataFrame, key: str, value: str, schema: str, cut: Callable) -> DataFrame:
    """cut(value) gives rows of `schema` for every row of df with a value; they come out after the key."""
    kind = dict(df.dtypes)[key]
    names = [key, *(x.split()[0] for x in schema.split(", "))]

    def run(batches):
        for b in batches:
            yield pd.DataFrame([(k, *r) for k, v in zip(b[key], b[value], strict=True) for r in cut(v)], columns=names)

    return df.where(F.col(value).isNotNull()).select(key, value).mapInPandas(run, f"{key} {kind}, {schema}")


def recursive_chunks(df: DataFrame, key: str, text: str = "text", limit: int = MAX_CHARS) -> DataFrame:
    """(key, seq, chunk)."""
    return _each(df, key, text, "seq bigint, chunk string", lambda t: enumerate(split(t, limit)))


def child_chunks(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, seq, chunk)."""
    return _each(df, key, text, "seq bigint, chunk string", lambda t: enumerate(children(sentences(t))))


def parent_child(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, section, role, parent_seq, seq, content_kind, chunk) of texts whose lines are paragraphs."""
    blank = {"items": [], "header": [], "rows": [], "kind": "paragraph", "section": 0}
    return _each(df, key, text, "section int, role string, parent_seq bigint, seq bigint, content_kind string, chunk string", lambda t: document_families([blank | {"text": x} for x in t.split("\n")]))


def element_chunks(docs: DataFrame, key: str, elements: str = "elements") -> DataFrame:
    """(key, section, seq, content_kind, chunk) of documents with an array of elements {section, kind, text, items, header, rows}."""
    return _each(docs, key, elements, "section int, seq bigint, content_kind string, chunk string", document_chunks)


def element_families(docs: DataFrame, key: str, elements: str = "elements") -> DataFrame:
    """(key, section, role, parent_seq, seq, content_kind, chunk) of documents with an array of elements."""
    return _each(docs, key, elements, "section int, role string, parent_seq bigint, seq bigint, content_kind string, chunk string", document_families)


def element_units(docs: DataFrame, key: str, elements: str = "elements") -> DataFrame:
    """(key, section, pos, kind, text): the unit stream of documents."""
    return _each(docs, key, elements, "section int, pos bigint, kind string, text string", lambda es: [(int(e["section"]), i, k, t) for i, e in enumerate(es) for k, t in units(e)])


def with_overlap(chunks: DataFrame, key: str, order: str, text: str, size: int = OVERLAP) -> DataFrame:
    """Each chunk preceded by the last `size` characters of the one before."""
    before = F.lag(text).over(Window.partitionBy(key).orderBy(order))
    return chunks.withColumn("chunk", F.concat(F.coalesce(F.right(before, F.lit(size)), F.lit("")), F.col(text)))


def stats(chunks: DataFrame, by: str, text: str) -> DataFrame:
    size = F.length(text)
    return chunks.groupBy(by).agg(F.count("*").alias("n"), F.sum(size).alias("chars"), F.min(size).alias("shortest"), F.max(size).alias("longest"), F.round(F.avg(size), 1).alias("mean"))
