"""Problem 5: page boilerplate mixed with main content.

Host suffix array. The pages of a host are tokenised (words, runs of CJK letters, single marks; every run of digits is
one token, white space none), their token streams are concatenated with a line token between lines and a page token of its
own after each page, and a suffix array with the longest common prefixes of neighbours is built by prefix doubling.
From it come, for each line, runs that recur on distinct pages of the host:

* the whole line, from line token to line token;
* a label: the line's first tokens up to a colon or number ("Related:", "Most read 12"), in a line without end mark;
* a marker: a line that opens with a mark and a blank ("· ", "> ") or a bracket and has no end mark, where that opening recurs;
* cover: every token of the line lies in runs of at least LONG tokens that recur.

A run is boilerplate from RATE of the host's pages (and MIN_PAGES pages) on; what isn't covered is the page's body. Lines and runs are compared whole, whatever their length.

Scale: a host is cut by hash into blocks of about BLOCK pages, each with its own suffix array, so a host with a third of all pages
is many tasks; the page counts of equal runs, of LONG tokens too, are summed over the blocks of a host before anything is decided. To keep the shuffle small, a block
reports the runs of LONG tokens that at least two of its pages hold: a run at the limit is on 10 pages of a block of 2,000 on average, and on fewer than two in one block of 2,000,
where its sum lacks one page.

Defined results: null texts and other kinds of content give no line; a null source is a host of its own; blank lines belong to neither
side and stay; repeated rows of a chunk id are pages of their own, but their lines come out once.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import U64, h64, mix64
from quillspark.session import staged

BLOCK, RATE, MIN_PAGES, LONG, LABEL = 2000, 0.005, 3, 6, 6
_TOKEN = re.compile(r"\d+|[^\W\d_]+|[^\w\s]|_")
_MARKER = re.compile(r"\s*(?:[^\w\s\ufffd]\s|[\[【])")
_END = re.compile(r"[.!?。！？।…][”’»」』）)\]】\"]*\s*$")


def suffix_ranks(ids: np.ndarray, levels: int) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 2 ** k tokens, k = 0 .. levels: the stages of prefix doubling."""
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    out = [rank]
    for k in range(levels):
        nxt = np.zeros(len(ids), np.int64)
        step = 1 << k
        nxt[:-step or None] = rank[step:] + 1 if step < len(ids) else 0
        if step >= len(ids):
            nxt[:] = 0
        values, rank = np.unique(rank * (len(ids) + 2) + nxt, return_inverse=True)
        rank = rank.astype(np.int64)
        out.append(rank)
        if len(values) == len(ids):
            break  # all suffixes differ within these tokens
    return out


def common_prefix(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of suffixes a and b, up to 2 ** len(ranks) - 1 tokens."""
    n = len(ranks[0])
    off = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        i, j = a + off, b + off
        ok = (i < n) & (j < n)
        ok[ok] = ranks[k][i[ok]] == ranks[k][j[ok]]
        off[ok] += 1 << k
    return off


def _pages_of_groups(group: np.ndarray, page: np.ndarray) -> np.ndarray:
    """For each group number the count of its distinct pages."""
    width = int(page.max()) + 1 if len(page) else 1
    return np.bincount(np.unique(group * width + page) // width, minlength=int(group.max()) + 1 if len(group) else 0)


def block_lines(texts: list[str], least: int) -> dict[str, np.ndarray]:
    """For runs of LONG tokens on at least `least` pages, keys with page counts (run, run_n). For all lines of a block of pages: page, line, whole and label keys with the page counts of their runs (at the first line of a run, else 0), marker, cover by those runs, blank, size, and for covered lines the runs with their offsets."""
    words: dict[str, int] = {}
    ids: list[int] = []
    page, no, begin, size, label, marker, ended, blank = [], [], [], [], [], [], [], []
    names, heads = [], []
    sentinel = -2
    for p, t in enumerate(texts):
        for n, line in enumerate(t.split("\n")):
            toks = ["0" if x.isdecimal() else x for x in _TOKEN.findall(line)]
            begin.append(len(ids))
            ids.append(-1)
            ids += [words.setdefault(x, len(words)) for x in toks]
            page.append(p)
            no.append(n)
            size.append(len(toks))
            blank.append(not toks)
            end = bool(_END.search(line))
            ended.append(end)
            q = 0
            mark = bool(toks) and not end and bool(_MARKER.match(line))
            if not end and not mark:
                for k, x in enumerate(toks[: LABEL + 1]):
                    if k and (x in ":：" or x == "0"):
                        q = k + 1
                        break
            label.append(q)
            marker.append(mark)
            names.append(" ".join(toks))
            heads.append(" ".join(toks[:q]))
        ids.append(-1)
        ids.append(sentinel)
        sentinel -= 1
    a = np.array(ids)
    page, no, begin, size, label = (np.array(x, np.int64) for x in (page, no, begin, size, label))
    marker, ended, blank = (np.array(x, bool) for x in (marker, ended, blank))
    levels = max(1, int(np.ceil(np.log2(max(2, size.max() + 2)))))
    ranks = suffix_ranks(a, levels)

    order = np.argsort(ranks[-1][begin], kind="stable")
    s = begin[order]
    lcp = np.concatenate(([0], common_prefix(ranks, s[:-1], s[1:]))) if len(s) else np.zeros(0, np.int64)

    def runs(need: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(page count at the first line of each run, run's first line) for runs of lines that share `need` tokens."""
        sel = np.flatnonzero(on[order])
        count, head = np.zeros(len(begin), np.int64), np.arange(len(begin))
        if not len(sel):
            return count, head
        lines = order[sel]
        # between chosen neighbours the common prefix is the least over the suffixes in between
        seg = np.minimum.reduceat(lcp, sel) if sel[0] == 0 else np.minimum.reduceat(lcp, np.concatenate(([0], sel)))[1:]
        if len(sel) > 1:
            idx = np.stack([sel[:-1] + 1, sel[1:] + 1], 1).ravel()
            low = np.minimum.reduceat(np.append(lcp, 0), idx)[::2]
        else:
            low = np.zeros(0, np.int64)
        new = np.concatenate(([True], (low < need[lines][1:]) | (need[lines][1:] != need[lines][:-1])))
        group = np.cumsum(new) - 1
        n = _pages_of_groups(group, page[lines])
        firsts = lines[new]
        count[firsts] = n
        head[lines] = firsts[group]
        return count, head

    cap = (1 << len(ranks)) - 1
    whole_n, whole_head = runs(np.minimum(size + 2, cap), ~blank)
    label_n, label_head = runs(np.where(label > 0, label + 1, np.where(marker, 2, 0)), (label > 0) | marker)

    # cover: positions inside runs of LONG tokens that recur on enough pages
    page_of = np.repeat(np.arange(len(texts)), np.diff(np.append(begin[np.flatnonzero(np.concatenate(([True], page[1:] != page[:-1])))], len(a))))
    cover = np.zeros(len(a), bool)
    runs_at = run = run_n = np.zeros(0, np.int64)
    hashes = np.zeros(len(a), np.int64)
    if len(ranks) > 2:
        g4 = ranks[2]
        key = g4 * (int(g4.max()) + 1) + np.append(g4[LONG - 4 :], np.zeros(LONG - 4, np.int64))
        group = np.unique(key, return_inverse=True)[1]
        pages_of = _pages_of_groups(group, page_of)
        hot = (pages_of >= least)[group]
        hot[max(0, len(a) - LONG) :] = False
        word = np.array([h64(w, 3) for w in words] + [0, 1], np.int64).view(U64)[np.where(a >= 0, a, len(words) + (a < -1))]
        mixed = np.zeros(len(a), U64)
        for j in range(LONG):
            mixed[: len(a) - j] += word[j:] * U64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64))
        hashes = mix64(mixed).view(np.int64)
        edge = np.zeros(len(a) + 1, np.int64)
        at = np.flatnonzero(hot)
        np.add.at(edge, at, 1)
        np.add.at(edge, np.minimum(at + LONG, len(a)), -1)
        cover = np.cumsum(edge[:-1]) > 0
        runs_at = at
        first_of = np.unique(group[at], return_index=True)
        run, run_n = hashes[at[first_of[1]]], pages_of[first_of[0]]
    open_ = np.concatenate(([0], np.cumsum(~cover)))
    covered = (open_[begin + 1 + size] == open_[begin + 1]) & ~blank

    lo, hi = np.searchsorted(runs_at, begin + 2 - LONG), np.searchsorted(runs_at, begin + 1 + size)
    offs = [(runs_at[x:y] - b).tolist() if c else None for x, y, b, c in zip(lo, hi, begin + 1, covered.tolist(), strict=True)]
    held = [hashes[runs_at[x:y]].tolist() if c else None for x, y, c in zip(lo, hi, covered.tolist(), strict=True)]

    def keyed(count, head, text, seed):
        memo: dict[int, int] = {}
        return np.array([memo[h] if h in memo else memo.setdefault(h, h64(text[h], seed)) for h in head.tolist()], np.int64)

    first = [x.split(" ", 1)[0] for x in names]
    lab = [h or f for h, f in zip(heads, first, strict=True)]
    return {"page": page, "line_no": no, "whole": keyed(whole_n, whole_head, names, 1), "whole_n": whole_n, "label": keyed(label_n, label_head, lab, 2), "label_n": label_n, "labelled": ((label > 0) | marker) & ~blank, "covered": covered, "blank": blank, "size": size, "offs": offs, "held": held, "run": run, "run_n": run_n}


def page_lines(chunks: DataFrame, block: int = BLOCK) -> DataFrame:
    """(chunk_id, line_no, furniture) of every line of every web page."""
    pages = chunks.where("metadata.content_kind = 'web_page' and text is not null").select("chunk_id", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("host"), "text")
    hosts = staged(pages.groupBy("host").agg(F.count("*").alias("pages")), "p5-hosts")
    dealt = pages.join(hosts, "host").withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.ceil(F.col("pages") / block)))

    def work(key, pdf):
        n, alone = len(pdf), int(pdf["pages"].iloc[0]) <= block
        got = block_lines(pdf["text"].tolist(), max(MIN_PAGES, int(np.ceil(RATE * n))) if alone else 2)
        page, run, run_n = got["page"], got.pop("run"), got.pop("run_n")
        pages = int(pdf["pages"].iloc[0])
        if alone:
            got["offs"] = got["held"] = [None] * len(page)
        out = pd.DataFrame({"host": key[0], "block": key[1], "pages": pages, "chunk_id": pdf["chunk_id"].to_numpy()[page], **got})
        if alone or not len(run):
            return out
        none = pd.DataFrame({"host": key[0], "block": key[1], "pages": pages, "chunk_id": None, "page": -1, "line_no": -1, "whole": run, "whole_n": run_n, "label": 0, "label_n": 0, "labelled": False, "covered": False, "blank": True, "size": 0, "offs": None, "held": None})
        return pd.concat([out, none], ignore_index=True)

    kinds = "host string, block bigint, pages bigint, chunk_id string, page bigint, line_no bigint, whole bigint, whole_n bigint, label bigint, label_n bigint, labelled boolean, covered boolean, blank boolean, size bigint, offs array<int>, held array<bigint>"
    every = staged(dealt.groupBy("host", "block").applyInPandas(work, kinds), "p5-lines")
    lines = every.where("line_no >= 0")
    keys = lines.select("host", "pages", F.explode(F.array(F.struct(F.col("whole").alias("key"), F.col("whole_n").alias("n")), F.struct(F.col("label").alias("key"), F.col("label_n").alias("n")))).alias("k")).where("k.n > 0")
    least = F.greatest(F.lit(MIN_PAGES), F.ceil(F.col("pages") * RATE))
    often = staged(keys.groupBy("host", "pages", F.col("k.key").alias("key")).agg(F.sum("k.n").alias("n")).where(F.col("n") >= least).select("host", "key"), "p5-runs")
    # cover in hosts of several blocks: the runs of LONG tokens that are frequent in the host, line by line
    hot = every.where("line_no < 0").groupBy("host", "pages", F.col("whole").alias("run")).agg(F.sum("whole_n").alias("n")).where(F.col("n") >= least).select("host", "run")
    place = ["host", "block", "page", "line_no"]
    met = lines.where("held is not null").select(*place, "size", F.explode(F.arrays_zip("offs", "held")).alias("r")).select(*place, "size", F.col("r.offs").alias("off"), F.col("r.held").alias("run")).join(hot, ["host", "run"])
    spans = met.groupBy(*place, "size").agg(F.array_sort(F.collect_set("off")).alias("o"))
    closed = F.forall(F.sequence(F.lit(1), F.size("o")), lambda i: (i == 1) | (F.element_at("o", i) - F.element_at("o", F.greatest(i - 1, F.lit(1))) <= LONG))
    whole = spans.where((F.element_at("o", 1) <= 0) & (F.element_at("o", -1) + LONG >= F.col("size")) & closed).select(*place, F.lit(True).alias("c"))
    a = lines.join(often.select("host", F.col("key").alias("whole"), F.lit(True).alias("w")), ["host", "whole"], "left")
    b = a.join(often.select("host", F.col("key").alias("label"), F.lit(True).alias("l")), ["host", "label"], "left").join(staged(whole, "p5-cover"), place, "left")
    hit = ~F.col("blank") & (F.coalesce("w", F.lit(False)) | (F.col("labelled") & F.coalesce("l", F.lit(False))) | F.when(F.col("held").isNull(), F.col("covered")).otherwise(F.coalesce("c", F.lit(False))))
    return b.select("chunk_id", "line_no", hit.alias("furniture"))


def found(chunks: DataFrame) -> DataFrame:
    """(chunk_id, line_no) of every line that isn't part of the article."""
    return page_lines(chunks).where("furniture").select("chunk_id", "line_no").distinct()


def bodies(chunks: DataFrame) -> DataFrame:
    """(chunk_id, text): every web page with the lines of its main body only."""
    cut = found(chunks).groupBy("chunk_id").agg(F.collect_set("line_no").alias("cut"))
    pages = chunks.where("metadata.content_kind = 'web_page' and text is not null").select("chunk_id", "text").join(cut, "chunk_id", "left")
    lines = F.filter(F.split("text", "\n", -1), lambda x, i: F.coalesce(~F.array_contains("cut", i.cast("bigint")), F.lit(True)))
    return pages.select("chunk_id", F.array_join(lines, "\n").alias("text"))
