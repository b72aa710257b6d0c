"""Problem 4: sentence boundaries across languages and scripts.

Document-centred disambiguation. Whether the full stop after a token ends a sentence is decided from unambiguous
occurrences: a stop before a small letter, digit or comma can't end one, a stop at the end of a line does. The
evidence of the document counts first; where it has none, that of the whole corpus decides (one pass counts tokens
before stops, and capitalised words at unambiguous starts and inside sentences, i.e. proper names). Abbreviations
that can end a sentence (etc., usw., a.m.) do so before a word that the evidence knows as a sentence start.
Script rules: 。！？ end without a blank, the danda ends Devanagari sentences, Thai units are parted by blanks that don't touch a digit,
quotations, dash-led speech and brackets hold their marks, an ellipsis ends nothing, a line break always ends a unit.

Order of evidence: unambiguous occurrences in the document, then those in the corpus, then the short lists below, which act only where both are silent.
The corpus evidence counts every token; shares of it count from SOME occurrences on, repeated small letters after a stop before. What is handed to all tasks leaves out the tokens that decide as an unknown one would, and holds at most
the MAX_EVIDENCE rows with the most occurrences; where there are more, the others are joined to the texts that ask for them.

Defined results: null and blank texts have no unit; repeated rows of a chunk id give their units once (found) or with
their text (sentences); invisible characters are skipped in decisions but counted in positions.
"""

from __future__ import annotations

import re
from collections import ChainMap, Counter
from copy import copy

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import batch_of
from quillspark.llm.p01_canonical import LOOKALIKES
from quillspark.session import spread, staged

MAX_EVIDENCE = 300_000
# Prior knowledge for corpora too small to show it. Titles and short forms that never end a sentence.
NEVER = frozenset("dr prof mr mrs ms st sr sra dra mme m no nr fig vs cf sec vol art pág núm ca bzw env approx aprox p s e z d i.e e.g डॉ".split())
# Short forms that can end one.
MIXED = frozenset("etc usw al ff a.m p.m u.s uu".split())

_HIDDEN = re.compile("[­​-‏⁠-⁤﻿]")
_FOLD = {ord(k): v for k, v in LOOKALIKES.items()}
_FOLD |= {0xFF01 + i: chr(0x21 + i) for i in range(94) if chr(0x21 + i).isalnum()}
_FOLD |= {0x1D7CE + i: str(i % 10) for i in range(50)}
_FOLD |= dict.fromkeys([0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, 9], " ")
_ODD = re.compile("[^ -~¡-ɏ一-鿿ऀ-ॿ฀-๿぀-ヿ。-！，、：；？“”‘’（）「」《》【】…—–„‚«»‹›]|[ ]")
_MARK = re.compile(r"[.!?。！？।॥｡．]+")
_CUTS = frozenset(",;:!?(（“„«‘「\"。！？，、：；”’»)）")
# Occurrences from which shares count; below it only repeated small letters do.
SOME = 10
_OPEN = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")", "《": "》", "【": "】", "‘": "’", "[": "]"}
_CLOSE = frozenset("”“»」』）)》】’]\"")
_QUOTES = frozenset("“„«「『‘")
_THAI = re.compile(r"[฀-๿]")
_THAI_CUT = re.compile(r"(?<=[^\d\s])[^\S\n]+(?=[^\d\s])")
_CAP = re.compile(r"(?:^|(?<=[\s“„«(¿¡—]))[A-ZÀ-ÖØ-Þ][^\W\d_]*")
_INNER = re.compile(r"[a-zß-ÿ]+[A-ZÀ-Þ]")
_STOP = re.compile(r"(?P<t>[^\s.,;:!?(（“„«‘\"。！？，、：；]+(?:\.[^\s.,;:!?(（“„«‘\"。！？，、：；]+)*)\.(?=(?P<n>[^\S\n]+\S|\n|\Z|,))")


def token_of(left: str) -> str:
    """The token that ends the string, its inner full stops included, in lower case."""
    i = len(left)
    while i and left[i - 1] not in _CUTS and not left[i - 1].isspace():
        i -= 1
    token = left[i:].rsplit("..", 1)[-1].lstrip(".")
    return "" if token.endswith(".") else token.lower()


def evidence(text: str, stops: Counter, words: Counter) -> None:
    """Adds the unambiguous occurrences of a text: (token, kind) with kind low, eol or cap, and (word, start or mid)."""
    for m in _STOP.finditer(text):
        n = m["n"]
        c = n[-1:]
        small = c.islower() and not _INNER.match(text, m.end("n") - 1)
        kind = "eol" if n in ("", "\n") else "low" if n == "," or small or c.isdigit() else "cap"
        stops[m["t"].lower(), kind] += 1
    for m in _CAP.finditer(text):
        s = m.start()
        if s == 0 or text[s - 1] == "\n":
            words[m[0], "start"] += 1
        elif text[s - 1] == " " and s > 1:
            p = text[s - 2]
            if p in "!?":
                words[m[0], "start"] += 1
            elif p.isalnum() or p == ",":
                words[m[0], "mid"] += 1


def corpus_kind(low: int, eol: int, cap: int) -> str:
    """What occurrences in the corpus say of a full stop after a token: never ends a sentence, mixed, or a word, which is also the answer for unknown ones."""
    n = low + eol + cap
    if n < SOME:
        return "mixed" if low >= 2 and not eol else "word"
    return "never" if eol * 200 < n else "mixed" if low * 20 > n else "word"


class Evidence:
    """Decides on full stops from the counts of a document, then of the corpus, then from prior knowledge."""

    def __init__(self, stops: dict[str, tuple[int, int, int]], words: dict[str, tuple[int, int]]):
        self.kinds = {t: corpus_kind(*c) for t, c in stops.items()}
        self.enders = {t: True for t, (low, eol, cap) in stops.items() if eol * 20 >= low + eol + cap}
        self.words = words

    @staticmethod
    def of(rows) -> Evidence:
        """From rows of `corpus_evidence`."""
        return Evidence({r["token"]: (r["x"], r["y"], r["z"]) for r in rows if r["what"] == 0}, {r["token"]: (r["x"], r["y"]) for r in rows if r["what"] == 1})

    def beside(self, rows) -> Evidence:
        """This evidence and that of further rows."""
        if not rows:
            return self
        more, out = Evidence.of(rows), copy(self)
        out.kinds, out.enders, out.words = (ChainMap(a, b) for a, b in ((more.kinds, self.kinds), (more.enders, self.enders), (more.words, self.words)))
        return out

    def kind(self, token: str, own: Counter) -> str:
        """never, mixed or word: document, then corpus, then lists."""
        known = self.kinds.get(token) or ("never" if token in NEVER else "mixed" if token in MIXED else None)
        low, eol = own[token, "low"], own[token, "eol"]
        if low and eol:
            return "mixed"
        if low:
            return "never" if known == "never" else "mixed"
        if eol >= 2:
            return "word"
        if eol and known == "never":
            return "mixed"
        return known or "word"

    def starts(self, word: str, token: str, own: Counter) -> bool:
        """Whether a word after a short form opens a sentence; after one that often ends lines only a clear proper name doesn't."""
        s, m = own[word, "start"], own[word, "mid"]
        if not s + m:
            s, m = self.words.get(word, (1, 0))
        return m <= (20 if token in self.enders else 3) * s


def _protected(line: str) -> list[tuple[int, int]]:
    """(start, end) of the outermost quotations and brackets that are closed in the line, end exclusive."""
    spans, stack = [], []
    last: dict[str, int] = {}
    for i, c in enumerate(line):
        if stack and c in _OPEN[line[stack[-1]]]:
            s = stack.pop()
            if not stack:
                spans.append((s, i + 1))
        elif c in _OPEN and (last[c] if c in last else last.setdefault(c, max(line.rfind(x) for x in _OPEN[c]))) > i:
            stack.append(i)
        elif c in _CLOSE and len(stack) > 1:
            for k in range(len(stack) - 1, -1, -1):
                if c in _OPEN[line[stack[k]]]:
                    s = stack[k]
                    del stack[k:]
                    if not stack:
                        spans.append((s, i + 1))
                    break
    return spans


def line_ends(line: str, ev: Evidence, own: Counter) -> list[int]:
    """End offsets (exclusive) of the units of one line without line breaks, folded and without invisible characters."""
    stop = len(line.rstrip())
    if not stop:
        return []
    if _THAI.search(line):
        body = line[:stop]
        lead = len(body) - len(body.lstrip())
        return [m.start() for m in _THAI_CUT.finditer(body, lead)] + [stop]
    ends: list[int] = []
    spans = _protected(line)
    begin = len(line) - len(line.lstrip())
    at = 0
    k = 0
    while (m := _MARK.search(line, at)) is not None:
        i, j = m.span()
        at = j
        while k < len(spans) and spans[k][1] <= i:
            k += 1
        closed = None
        if k < len(spans) and spans[k][0] <= i:
            s, e = spans[k]
            if j < e - 1 and line[j : e].strip() not in _CLOSE and any(c not in _CLOSE and not c.isspace() for c in line[j : e]):
                continue  # a mark inside
            closed, at, j = line[s], e, e
        while j < stop and line[j] in "”»」』）)》】’]" and closed is None:
            j += 1
        at = max(at, j)
        if j >= stop:
            break
        speech = line[begin] in "—–"
        if speech and (d := next((x for x in range(begin + 1, stop) if line[x] in "—–" and line[x - 1] == " "), -1)) > i:
            continue
        mark, nxt = m[0], line[j]
        rest = line[j:stop].lstrip()
        first = rest[:1]
        if first.islower() and _INNER.match(rest):
            first = first.upper()
        if closed in _QUOTES:
            if nxt in "，、,;；：:—–":
                continue
            if mark[-1] in "。｡":
                if closed in "「『" and "぀" <= nxt <= "ゟ":
                    continue
            elif not nxt.isspace():
                continue  # 说：“……！”随后……
            elif first.islower():
                continue
        elif mark[0] in ".．" and set(mark) <= {".", "．"}:
            if len(mark) > 1 or not nxt.isspace():
                continue  # an ellipsis, a decimal, an inner stop
            if first.islower() or first in ",;:":
                continue
            token = token_of(line[:i])
            if closed is None:
                if token.isdigit():
                    if len(token) <= 2:
                        continue  # an ordinal or the number of a list line
                elif len(token) == 1 and token.isalpha():
                    continue
                else:
                    kind = ev.kind(token, own)
                    if kind == "never" or kind == "mixed" and first.isdigit():
                        continue
                    if kind == "mixed" and first.isupper() and not ev.starts(re.match(r"\w+", rest)[0], token, own):
                        continue
        elif mark[0] in "!?" and (not nxt.isspace() or first.islower() or first in ",;:—–" and not first == "—"):
            continue
        ends.append(j)
        begin = j + len(line[j:stop]) - len(line[j:stop].lstrip())
    ends.append(stop)
    return ends


def _folded(text: str) -> tuple[str, list[int] | None]:
    """The text as decisions see it, and the places of its characters where invisible ones were left out."""
    if not _ODD.search(text):
        return text, None
    if _HIDDEN.search(text):
        at = [i for i, c in enumerate(text) if not _HIDDEN.match(c)]
        return "".join(text[i] for i in at).translate(_FOLD), at
    return text.translate(_FOLD), None


def asked(text: str) -> set[tuple[int, str]]:
    """(0, token) and (1, word) of all evidence that the units of a text may ask for."""
    out = set()
    for line in _folded(text)[0].split("\n"):
        stop = len(line.rstrip())
        for m in _MARK.finditer(line):
            if m[0] not in (".", "．"):
                continue
            j = m.end()
            while j < stop and line[j] in "”»」』）)》】’]":
                j += 1
            if j < stop and line[j].isspace():
                out.add((0, token_of(line[: m.start()])))
                if w := re.match(r"\w+", line[j:stop].lstrip()):
                    out.add((1, w[0]))
    return out


def unit_ends(text: str, ev: Evidence) -> list[int]:
    """1-based positions of the last character of each unit of the text."""
    folded, at = _folded(text)
    own: Counter = Counter()
    if "." in folded:
        evidence(folded, own, own)
    out, off = [], 0
    for line in folded.split("\n"):
        for e in line_ends(line, ev, own):
            out.append((at[off + e - 1] if at else off + e - 1) + 1)
        off += len(line) + 1
    return out


def corpus_evidence(chunks: DataFrame) -> tuple[Evidence, DataFrame | None]:
    """Counts over all texts of the table: the MAX_EVIDENCE most frequent, and the table of all where there are more."""
    schema = pa.schema([("what", pa.int32()), ("token", pa.string()), ("x", pa.int64()), ("y", pa.int64()), ("z", pa.int64())])

    def rows(stops, words):
        t: dict = {}
        for (w, k), n in stops.items():
            t.setdefault((0, w), [0, 0, 0])[("low", "eol", "cap").index(k)] += n
        for (w, k), n in words.items():
            t.setdefault((1, w), [0, 0, 0])[("start", "mid").index(k)] += n
        return batch_of(schema, {"what": [k[0] for k in t], "token": [k[1] for k in t], "x": [v[0] for v in t.values()], "y": [v[1] for v in t.values()], "z": [v[2] for v in t.values()]})

    def count(batches):
        stops, words = Counter(), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if "." in t:
                    evidence(t, stops, words)
            if len(words) + len(stops) > 200_000:
                yield rows(stops, words)
                stops, words = Counter(), Counter()
        yield rows(stops, words)

    counted = spread(chunks.select("text").where("text is not null")).mapInArrow(count, "what int, token string, x bigint, y bigint, z bigint")
    total = counted.groupBy("what", "token").agg(*[F.sum(c).alias(c) for c in "xyz"]).withColumn("n", F.col("x") + F.col("y") + F.coalesce("z", F.lit(0)))
    # tokens that decide as unknown ones do can be left out: words outside the lists, and words that open sentences
    listed = F.col("token").isin(*sorted(NEVER | MIXED))
    few = (F.col("n") < SOME) & (F.col("x") >= 2) & (F.col("y") == 0)
    kept = (F.col("what") == 0) & (listed | few | (F.col("n") >= SOME) & ((F.col("y") * 200 < F.col("n")) | (F.col("x") * 20 > F.col("n"))))
    total = staged(total.where(kept | (F.col("what") == 1) & (F.col("n") >= SOME) & (F.col("y") > 3 * F.col("x"))), "p4-evidence")
    got = total.orderBy(F.desc("n"), "what", "token").limit(MAX_EVIDENCE).collect()
    return Evidence.of(got), total if total.count() > MAX_EVIDENCE else None


def _with_rest(rows: DataFrame, held, total: DataFrame) -> DataFrame:
    """(chunk_id, text, more): the rows with the evidence they may ask for beyond the one held; texts of equal hash share theirs."""
    schema = pa.schema([("row", pa.int64()), ("what", pa.int32()), ("token", pa.string())])
    marked = rows.withColumn("row", F.xxhash64("text"))

    def ask(batches):
        ev = held.value
        for b in batches:
            got = [(r, w, t) for r, x in zip(*b.to_pydict().values(), strict=True) if "." in x or "．" in x for w, t in asked(x) if t not in (ev.words if w else ev.kinds)]
            yield batch_of(schema, {f.name: [g[j] for g in got] for j, f in enumerate(schema)})

    wants = marked.select("row", "text").mapInArrow(ask, "row bigint, what int, token string").distinct()
    more = wants.join(total, ["what", "token"]).groupBy("row").agg(F.collect_list(F.struct("what", "token", "x", "y", "z")).alias("more"))
    return marked.join(more, "row", "left").select("chunk_id", "text", "more")


def units(chunks: DataFrame, rows: DataFrame | None = None, texts: bool = False) -> DataFrame:
    """(chunk_id, end_pos), with texts also (seq, sentence), of `rows` (default: all chunks) under the evidence of all chunks."""
    evidence_of, total = corpus_evidence(chunks)
    held = chunks.sparkSession.sparkContext.broadcast(evidence_of)
    schema = pa.schema([("chunk_id", pa.string()), ("end_pos", pa.int64()), *([("seq", pa.int64()), ("sentence", pa.string())] * texts)])
    kinds = "chunk_id string, end_pos bigint" + ", seq bigint, sentence string" * texts

    def cut(batches):
        ev = held.value
        for b in batches:
            out = {f.name: [] for f in schema}
            for i, t, *more in zip(*b.to_pydict().values(), strict=True):
                ends = unit_ends(t, ev.beside(more[0]) if more else ev)
                out["chunk_id"] += [i] * len(ends)
                out["end_pos"] += ends
                if texts:
                    out["seq"] += range(len(ends))
                    out["sentence"] += [t[a:e].strip() for a, e in zip([0, *ends], ends, strict=False)]
            yield batch_of(schema, out)

    given = spread((chunks if rows is None else rows).select("chunk_id", "text").where("text is not null"))
    return (given if total is None else _with_rest(given, held, total)).mapInArrow(cut, kinds)


def found(chunks: DataFrame) -> DataFrame:
    """(chunk_id, end_pos) of every unit of the chunks of kind verbatim_short_excerpt."""
    return units(chunks, chunks.where("metadata.content_kind = 'verbatim_short_excerpt'")).distinct()
