"""Problem 9: evaluation texts leaking into training text.

Texts are reduced to NFKC, lower case, letters and digits. A run of RUN characters that document and item share holds
at least one whole aligned block of RUN // 2 characters of the item, so one Aho-Corasick automaton over the aligned blocks of
all items, scanned once over each text, meets every such run; each hit is extended to the left and right and kept from
RUN characters on. Offsets are mapped back to the stored text.

The automaton goes to the tasks only while the items' blocks are at most `block_limit`; beyond it the items are cut
by hash into shards under that bound and the corpus is scanned once a shard. Nothing else than blocks of evaluation
items ever reaches the driver.

Defined results: null texts and null keys of items match nothing; items shorter than the run can't leak; repeated documents and
copies under other ids are each reported; repeated item rows count once.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import batch_of
from quillspark.session import spread, staged

RUN = 50
#: Blocks of one automaton: 200,000 blocks of 25 characters need at most about 300 MB in a worker.
BLOCK_LIMIT = 200_000
_OTHER = re.compile(r"[\W_]+")


def reduced(text: str) -> str:
    """NFKC, lower case, letters and digits (categories L* and N*) only."""
    return _OTHER.sub("", unicodedata.normalize("NFKC", text).lower())


def offsets(text: str) -> tuple[str, list[int]]:
    """The reduced text and, for each of its characters, the offset in text of the sequence it comes from."""
    out, at, i = [], [], 0
    while i < len(text):
        j = i + 1
        while j < len(text) and (unicodedata.combining(text[j]) or unicodedata.category(text[j])[0] == "M" or "ᅠ" <= text[j] <= "ᇿ" or text[j] in "ﾞﾟ"):
            j += 1
        r = reduced(text[i:j])
        out.append(r)
        at.extend([i] * len(r))
        i = j
    return "".join(out), at


def item_blocks(items: DataFrame, run: int = RUN) -> DataFrame:
    """(item_id, text) with the reduced text of each distinct item that is long enough."""
    schema = pa.schema([("item_id", pa.int64()), ("text", pa.string())])

    def red(batches):
        for b in batches:
            got = [(i, r) for i, t in zip(*b.to_pydict().values(), strict=True) if i is not None and t and len(r := reduced(t)) >= run]
            yield batch_of(schema, {"item_id": [i for i, _ in got], "text": [r for _, r in got]})

    return items.select("item_id", "text").mapInArrow(red, "item_id bigint, text string").distinct()


def _automaton(items: list[tuple[int, str]], block: int):
    import ahocorasick

    where: dict[str, list] = {}
    for k, (_, t) in enumerate(items):
        for s in range(0, len(t) - block + 1, block):
            where.setdefault(t[s : s + block], []).append((k, s))
    a = ahocorasick.Automaton()
    for w, v in where.items():
        a.add_word(w, v)
    a.make_automaton()
    return a if where else None


def shared_runs(text: str, auto, items: list[tuple[int, str]], block: int, run: int) -> list[tuple[int, int, int]]:
    """(item index, start, end) in the reduced text of every maximal shared run of at least `run` characters."""
    found: dict[tuple[int, int], int] = {}
    done: dict[tuple[int, int], int] = {}
    for end, hits in auto.iter(text):
        b = end - block + 1
        for k, s in hits:
            diagonal = (k, b - s)
            if done.get(diagonal, -1) > end:
                continue
            t = items[k][1]
            lo, p = b, s
            while lo and p and text[lo - 1] == t[p - 1]:
                lo, p = lo - 1, p - 1
            hi, q = end + 1, s + block
            while hi < len(text) and q < len(t) and text[hi] == t[q]:
                hi, q = hi + 1, q + 1
            done[diagonal] = hi
            if hi - lo >= run:
                found[(k, lo)] = hi
    return [(k, lo, hi) for (k, lo), hi in found.items()]


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, block_limit: int = BLOCK_LIMIT, spans: bool = False) -> DataFrame:
    """(doc_id, item_id) of every document that shares a run with an item; with spans, also start_pos, end_pos (0-based, end exclusive, in the stored text) of each run."""
    spark, block = documents.sparkSession, run // 2
    red = staged(item_blocks(items, run), "p9-items")
    n = red.agg(F.sum(F.floor(F.length("text") / block)).alias("n")).first().n or 0
    shards = max(1, -(-int(n) // (block_limit // 2)))
    kinds = "doc_id bigint, item_id bigint" + ", start_pos bigint, end_pos bigint" * spans
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *([("start_pos", pa.int64()), ("end_pos", pa.int64())] * spans)])

    def scan(held):
        def over(batches):
            own = held.value
            auto = _automaton(own, block)
            for b in batches:
                rows = []
                for d, t in zip(*b.to_pydict().values(), strict=True):
                    if auto is None or not t or len(t) * 18 < run or len(r := reduced(t)) < run:
                        continue
                    got = shared_runs(r, auto, own, block, run)
                    if not got:
                        continue
                    if not spans:
                        rows += [(d, i) for i in {own[k][0] for k, _, _ in got}]
                        continue
                    r2, at = offsets(t)
                    if r2 != r:  # sequences that compose across the cuts: search again in the text that has offsets
                        got = shared_runs(r2, auto, own, block, run)
                    rows += [(d, own[k][0], at[lo], at[hi] if hi < len(at) else len(t)) for k, lo, hi in got]
                yield batch_of(schema, {f.name: [x[j] for x in rows] for j, f in enumerate(schema)})

        return over

    docs = spread(documents.select("doc_id", "text").where("text is not null"))
    parts = []
    for s in range(shards):
        own = [(r.item_id, r.text) for r in red.where(F.pmod(F.hash("item_id"), F.lit(shards)) == s).collect()]
        parts.append(docs.mapInArrow(scan(spark.sparkContext.broadcast(own)), kinds))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
