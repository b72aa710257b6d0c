"""Problem 7: lines repeated across one site's documents.

Content-defined chunking: every text is reduced to its line forms (no white space, no decimal digits, lower case)
and cut into pieces where a rolling hash over the last WINDOW characters ends in zero bits. The newline counts as a
content byte that always cuts, and the window restarts there, so the pieces of a line depend on the line alone; without that, lines shorter than a piece would
share it with their neighbours and could not be told. The pieces of each source are counted by distinct documents, and those that occur in at least `min_docs` of them are repeated. The lines follow from
the places of the pieces: a line that is one piece is repeated where that piece is. A line of several pieces, each of which may be repeated for another line's sake, is repeated where all are and, as a check
that follows, the line as a whole is. A line in min_docs documents has all its pieces in them, so no line is lost.

Hot sources: a piece counts as repeated once min_docs documents are known, so each Arrow batch passes on at most min_docs documents
of a piece; a third of all rows in one source shrinks to a few rows a batch before the shuffle.

Defined results: a null text has no lines; a null source or source_id forms the group of null, as in GROUP BY;
an empty form (a blank or digits-only line) is never repeated; repeated rows of a chunk id are each kept; columns other
than the named ones are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import U64, batch_of, codepoints, h64, mix64, small_batches
from quillspark.session import spread, staged

WINDOW, CUT_MASK, MIN_DOCS = 8, 63, 6
#: Keys that are handed to the Python workers at once (16 MB); beyond it, lines and keys are joined.
KEY_LIMIT = 2_000_000
_DROP = re.compile(r"[^\S\n]+|\d+")


def line_form(line: str) -> str:
    return _DROP.sub("", line).lower()


def _pieces(texts: list[str]) -> tuple[np.ndarray, ...]:
    """(row, line number, piece hash) of every piece of the texts, rolling hashes computed for all at once.

    Empty forms have no piece."""
    forms = [_DROP.sub("", t).lower() for t in texts]
    a = codepoints("\n".join(forms) + "\n").astype(U64)
    n = len(a)
    nl = a == 10
    line = np.cumsum(nl) - nl
    starts = np.flatnonzero(np.concatenate(([True], nl[:-1])))
    at = np.arange(n) - starts[line]
    v = mix64(a)
    roll = np.zeros(n, U64)
    for j in range(WINDOW):
        roll[j:] += v[: n - j] * U64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64))
    cut = nl | ((((roll >> U64(32)) & U64(CUT_MASK)) == 0) & (at >= WINDOW - 1))
    begin = np.flatnonzero(np.concatenate(([True], cut[:-1])))
    length = np.diff(np.append(begin, n))
    off = np.arange(n) - np.repeat(begin, length)
    power = np.cumprod(np.full(int(length.max()), 0xD6E8FEB86659FD93, U64))
    v[nl] = 0
    piece = mix64(np.add.reduceat(v * power[off], begin)) if n else np.zeros(0, U64)
    lines_of_row = np.array([f.count("\n") + 1 for f in forms])
    row_of_line = np.repeat(np.arange(len(forms)), lines_of_row)
    first_line = np.cumsum(lines_of_row) - lines_of_row
    full = ~nl[begin]
    at_line = line[begin][full]
    row = row_of_line[at_line]
    return row, at_line - first_line[row], piece[full]


def _keyed(b: pa.RecordBatch):
    """Texts of the batch with, for each row, hashes of source and document."""
    d = b.to_pydict()
    keep = [i for i, t in enumerate(d["text"]) if t]
    src = np.array([h64(d["source"][i], 1) if d["source"][i] is not None else 7 for i in keep], np.int64).view(U64)
    doc = np.array([h64(d["source_id"][i], 2) if d["source_id"][i] is not None else 7 for i in keep], np.int64)
    return [d["text"][i] for i in keep], [d["chunk_id"][i] for i in keep], src, doc


def _few_docs(key: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, document), at most `least` documents of a key: more don't change whether the key has `least`."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[new], doc[new]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    rank = np.arange(len(key)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(key) else np.zeros(0, int)
    return key[rank < least], doc[rank < least]


_KEY_DOC = pa.schema([("key", pa.int64()), ("doc", pa.int64())])


def _repeated(pairs: DataFrame, least: int) -> DataFrame:
    """Keys with at least `least` documents: one shuffle on the key serves both the distinct and the count."""
    return pairs.repartition("key").dropDuplicates(["key", "doc"]).groupBy("key").count().where(F.col("count") >= least).select("key")


def _columns(chunks: DataFrame) -> DataFrame:
    return spread(chunks.select("chunk_id", "source", "source_id", "text").where("text is not null"))


def repeated_lines(chunks: DataFrame, min_docs: int = MIN_DOCS, key_limit: int = KEY_LIMIT) -> DataFrame:
    """(chunk_id, line_no) of every line whose form occurs in at least min_docs documents of its source."""
    rows = _columns(chunks)

    def piece_docs(batches):
        for b in small_batches(batches):
            texts, _, src, doc = _keyed(b)
            if texts:
                row, _, piece = _pieces(texts)
                key, docs = _few_docs(mix64(piece ^ src[row]).view(np.int64), doc[row], min_docs)
                yield batch_of(_KEY_DOC, {"key": key, "doc": docs})

    pieces = staged(_repeated(rows.mapInArrow(piece_docs, "key bigint, doc bigint"), min_docs), "p7-pieces")
    # only the keys that recur are sent, and only while they are few
    known = np.sort(pieces.toArrow().column(0).to_numpy()) if pieces.count() <= key_limit else None

    out = pa.schema([("chunk_id", pa.string()), ("line_no", pa.int64()), ("key", pa.int64()), ("doc", pa.int64()), ("pieces", pa.int64())])
    more = pa.schema([*out, ("piece", pa.int64())])

    def candidates(batches):
        for b in small_batches(batches):
            texts, ids, src, doc = _keyed(b)
            if not texts:
                continue
            row, no, piece = _pieces(texts)
            if not len(row):
                continue
            key = mix64(piece ^ src[row]).view(np.int64)
            first = np.ones(len(row), bool)
            first[1:] = (row[1:] != row[:-1]) | (no[1:] != no[:-1])
            at = np.flatnonzero(first)
            count = np.diff(np.append(at, len(row)))
            if known is None:
                good = np.ones(len(at), bool)
            else:
                hit = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key if len(known) else np.zeros(len(key), bool)
                good = np.logical_and.reduceat(hit, at)
            split: dict[int, list[str]] = {}
            res = {f.name: [] for f in (more if known is None else out)}
            for k in np.flatnonzero(good):
                r, j = int(row[at[k]]), int(no[at[k]])
                if count[k] > 1 and r not in split:
                    split[r] = texts[r].split("\n")
                whole = 0
                if count[k] > 1:
                    form = h64(line_form(split[r][j]), 3)
                    whole = int(mix64(np.array([form], np.int64).view(U64) ^ src[r : r + 1]).view(np.int64)[0])
                for p in range(count[k] if known is None else 1):
                    res["chunk_id"].append(ids[r])
                    res["line_no"].append(j)
                    res["key"].append(whole)
                    res["doc"].append(int(doc[r]))
                    res["pieces"].append(int(count[k]))
                    if known is None:
                        res["piece"].append(int(key[at[k] + p]))
            yield batch_of(more if known is None else out, res)

    if known is not None:
        lines = staged(rows.mapInArrow(candidates, "chunk_id string, line_no bigint, key bigint, doc bigint, pieces bigint"), "p7-lines")
    else:
        each = rows.mapInArrow(candidates, "chunk_id string, line_no bigint, key bigint, doc bigint, pieces bigint, piece bigint")
        met = each.join(pieces.withColumnRenamed("key", "piece"), "piece", "left_semi")
        met = met.groupBy("chunk_id", "line_no", "key", "doc").agg(F.count("*").alias("n"), F.max("pieces").alias("pieces"))
        lines = staged(met.where("n >= pieces").drop("n"), "p7-lines")

    def few(batches):
        for b in batches:
            key, docs = _few_docs(b.column(0).to_numpy(), b.column(1).to_numpy(), min_docs)
            yield batch_of(_KEY_DOC, {"key": key, "doc": docs})

    several = lines.where("pieces > 1")
    forms = staged(_repeated(several.select("key", "doc").mapInArrow(few, "key bigint, doc bigint"), min_docs), "p7-forms")
    if forms.count() <= key_limit:
        forms = F.broadcast(forms)
    return lines.where("pieces = 1").select("chunk_id", "line_no").union(several.join(forms, "key", "left_semi").select("chunk_id", "line_no")).distinct()


def without_repeated_lines(chunks: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(chunk_id, text, removed): every chunk without its repeated lines; removed counts the lines cut out."""
    cut = repeated_lines(chunks, min_docs).groupBy("chunk_id").agg(F.collect_set("line_no").alias("cut"))
    kept = chunks.select("chunk_id", "text").join(cut, "chunk_id", "left")
    lines = F.filter(F.split("text", "\n", -1), lambda x, i: F.coalesce(~F.array_contains("cut", i.cast("bigint")), F.lit(True)))
    return kept.select("chunk_id", F.when(F.col("text").isNotNull(), F.array_join(lines, "\n")).alias("text"), F.coalesce(F.size("cut"), F.lit(0)).alias("removed"))
