"""Problem 1: visually identical text with different characters.

The canonical form keeps everything a reader sees and nothing else: NFC; full-width and half-width letters, digits and
kana, mathematical letters and digits, ligatures, CJK radicals and compatibility ideographs as their plain characters;
every blank as a space, every kind of line end as a line feed; invisible format characters removed; Cyrillic and Greek letters that look like Latin ones as those.
Letter case, raised, lowered and circled digits, and full-width punctuation stay as they are: they look different.

Method: quick-check properties. A character is stable if it isn't mapped, has combining class 0 and can't compose with
the character before it (NFC_QC = Yes). Runs of unstable characters with the one stable character before them, which is all the context
a composition can need, are normalised and spliced into the unchanged text. Stable texts pass with one scan.

Pairs: texts are keyed by hashes of canonical and stored form; only keys with two different stored forms go on. Equal
stored texts are one class: representatives are paired, each further copy with one representative of another class.

Defined results: null texts and null keys have no partner; empty texts are texts; repeated rows of a key count once.
"""

from __future__ import annotations

import unicodedata as ud
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import batch_of, h64
from quillspark.session import spread, staged

# Letters of other scripts drawn like Latin letters.
LOOKALIKES = dict(
    zip(
        "асеорхуіѕјԁһԛԝґѵӏАВЕЅМНОРСТХІЈКԌԚԜҮνοιρυχϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ",
        "aceopxyisjdhqwrvlABESMHOPCTXIJKGQWYvoipuxcjABEZHIKMNOPTYXCJ",
        strict=True,
    )
)
LOOKALIKES.pop("ґ")
_INVISIBLE = [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x206A), *range(0xFE00, 0xFE10), 0xFEFF, *range(0xE0000, 0xE0080), *range(0xE0100, 0xE01F0)]
# Blanks that Unicode doesn't class as such: Hangul fillers and the empty Braille cell. Line ends; a carriage return before a line feed goes first.
_BLANK, _LINE_END = frozenset("\u115f\u1160\u2800\u3164\uffa0"), frozenset("\x0b\x0c\r\x85\u2028\u2029")
_PLAIN_TAGS = ("<wide>", "<narrow>", "<font>", "<noBreak>")
_LAST = 0x30000


def _mapped(c: str) -> str | None:
    """What a single character becomes before NFC, or None if it stays."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c in _LINE_END:
        return "\n"
    if ud.category(c) == "Zs" or c == "\t" or c in _BLANK:
        return " " if c != " " else None
    d = ud.decomposition(c)
    tag = d.split(" ", 1)[0]
    n = ord(c)
    if tag in _PLAIN_TAGS or tag == "<compat>" and (0xFB00 <= n <= 0xFB06 or 0x2E80 <= n <= 0x2FDF or n == 0xB5):
        plain = ud.normalize("NFKC", c)
        if tag == "<wide>" and not plain.isalnum():
            return None
        return plain
    if d and tag[0] != "<":
        full = ud.normalize("NFD", c)
        if full[0] in LOOKALIKES:
            return LOOKALIKES[full[0]] + full[1:]
    return None


@cache
def _tables() -> tuple[dict[int, str], frozenset[str]]:
    """The mapping and the set of unstable characters."""
    table: dict[int, str] = {c: "" for c in _INVISIBLE}
    unstable = set(_INVISIBLE)
    for n in range(9, _LAST):
        c = chr(n)
        if 0xD800 <= n < 0xE000 or n in table:
            continue
        if (m := _mapped(c)) is not None:
            table[n] = m
            unstable.add(n)
        elif ud.combining(c) or not ud.is_normalized("NFC", c):
            unstable.add(n)
        d = ud.decomposition(c)
        if d and d[0] != "<" and " " in d:
            unstable.add(int(d.split()[1], 16))
    unstable.update(range(0x1161, 0x1176), range(0x11A8, 0x11C3))
    return table, frozenset(map(chr, unstable))


_SEEN: dict[str, str] = {}
_PLAIN = frozenset("\t\r\x0b\x0c")


def _segment(s: str) -> str:
    if (r := _SEEN.get(s)) is None:
        r = ud.normalize("NFC", s.translate(_tables()[0]))
        if len(_SEEN) < 200_000 and len(s) < 40:
            _SEEN[s] = r
    return r


def canonical(text: str) -> str:
    """The one form of all texts that look like this one."""
    if "\r\n" in text:
        text = text.replace("\r\n", "\n")
    if text.isascii() and _PLAIN.isdisjoint(text):
        return text
    unstable = _tables()[1]
    if unstable.isdisjoint(text):
        return text
    out, done, n = [], 0, len(text)
    at = [i for i, c in enumerate(text) if c in unstable]
    k = 0
    while k < len(at):
        begin = max(at[k] - 1, done)
        end = at[k] + 1
        while (k := k + 1) < len(at) and at[k] <= end:
            end = at[k] + 1
        out += (text[done:begin], _segment(text[begin:end]))
        done = end
    out.append(text[done:n])
    return "".join(out)


def canonical_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, canonical) for every row; null stays null."""
    schema = pa.schema([("key", pa.string()), ("canonical", pa.string())])

    def make(batches):
        for b in batches:
            k, t = b.to_pydict().values()
            yield batch_of(schema, {"key": k, "canonical": [None if x is None else canonical(x) for x in t]})

    return df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInArrow(make, "key string, canonical string")


def _keys(df: DataFrame, key: str, text: str) -> DataFrame:
    schema = pa.schema([("key", pa.string()), ("look", pa.int64()), ("look2", pa.int64()), ("raw", pa.int64())])

    def make(batches):
        for b in batches:
            k, t = b.to_pydict().values()
            c = [canonical(x) for x in t]
            yield batch_of(schema, {"key": k, "look": [h64(x) for x in c], "look2": [h64(x, 9) for x in c], "raw": [h64(x, 5) for x in t]})

    rows = spread(df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))).where("key is not null and text is not null")
    return rows.mapInArrow(make, "key string, look bigint, look2 bigint, raw bigint")


def lookalike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key_a, key_b), the smaller first: records whose texts look the same but aren't equal."""
    look = ["look", "look2"]
    rows = staged(_keys(df, key, text), "p1-keys")
    several = rows.groupBy(*look).agg(F.min("raw").alias("a"), F.max("raw").alias("b")).where("a <> b").select(*look)
    rows = staged(rows.join(several, look, "left_semi"), "p1-several")
    reps = rows.groupBy(*look, "raw").agg(F.min("key").alias("rep"))
    other = reps.select(*look, F.col("raw").alias("raw2"), F.col("rep").alias("rep2"))
    across = reps.join(other, look).where("rep < rep2").select(F.col("rep").alias("a"), F.col("rep2").alias("b"))
    first = reps.groupBy(*look).agg(F.min(F.struct("rep", "raw")).alias("r1"))
    second = reps.join(first, look).where("raw <> r1.raw").groupBy(*look).agg(F.first("r1").alias("r1"), F.min("rep").alias("r2"))
    copies = rows.join(reps, [*look, "raw"]).where("key <> rep").join(second, look)
    copies = copies.select(F.col("key").alias("a"), F.when(F.col("raw") == F.col("r1.raw"), F.col("r2")).otherwise(F.col("r1.rep")).alias("b"))
    both = across.union(copies).where("a <> b")
    return both.select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).distinct()
