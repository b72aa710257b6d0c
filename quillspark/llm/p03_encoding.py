"""Problem 3: garbled text from wrong character encoding.

The distinct clean words of the corpus are counted: words of spaced scripts that hold a character beyond ASCII (digits as
one class), and pairs of neighbouring characters for scripts without spaces and for Greek, Cyrillic, Hebrew, Arabic and Devanagari. For every encoding chain (written in one
encoding, read in another, once or twice) the garbled form of every distinct word is generated. Garbled pairs
are keyed by their first three characters (two where there are no more). The tokens of a document, its words and the windows of
two and three characters beyond ASCII, are hash-joined against this table. A garbled form counts where its own characters show it
(`plain_sign`: a letter of a UTF-8 lead byte before the sign of a continuation byte, or several signs of which some are no letters), however frequent it is; any other
form counts while it is at most RATIO as frequent in the corpus as the word it comes from, so that clean words that look like garbled ones stay.
A chunk is affected with one garbled word, or with two windows at different places (one, if it holds a replacement or C1 control character).

Restoring: a garbled word is replaced by its verified original; a stretch of windows is re-encoded by the chain that most of its
windows name and kept only if garbling the result gives the stretch again.

Scale: counts are aggregated a batch before the shuffle; tokens that no form can equal are left out by a bitmap of at most 32 MB; the table of the forms that occur is distributed to the workers as sorted hashes while it has at most
TABLE_LIMIT entries (96 MB; a sixth of them where words go along for restoring), and is joined with the exploded tokens beyond that.

Defined results: null and empty texts are never affected; repeated rows of a chunk id come out once; text lost to
replacement characters is found, and stays as it is.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import U64, batch_of, codepoints, h64, mix64
from quillspark.session import spread, staged

RATIO, TABLE_LIMIT, MAX_BITS = 0.25, 12_000_000, 28

# Encodings a text may have been written in, and those it may have been read in.
WRITTEN = ("utf-8", "gb18030", "big5", "cp932", "euc_jp", "cp1252")
READ = ("utf-8", "latin-1", "cp1252", "cp1251", "cp437", "mac_roman", "gb18030", "big5", "cp932", "koi8_r")
CHAINS = [((w, r),) for w in WRITTEN for r in READ if w != r and (w, r) != ("cp1252", "latin-1")]
CHAINS += [(("utf-8", r), ("utf-8", r)) for r in ("cp1252", "latin-1")]

_WORD = re.compile(r"\S*[^\x00-\x7f\s]\S*")
_EDGE = re.compile(r"^[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+|[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+$")
_DIGITS = re.compile(r"\d+")
_LOST = re.compile("[\x80-\x84\x86-\x9f�]")
_ALPHA = re.compile(r"[A-Za-z0-9]")
# Signs of a UTF-8 text read in one byte a character: a lead byte, then a continuation byte, without those that stand after letters in clean text.
_LEAD = re.compile("[Â-ô](?:[\x80-\x9f¢-¦¨-ª¬-¯±-´µ¶¸-º¼-¾]|[‚ƒ„†‡ˆ‰Š‹ŒŽ•˜™š›œžŸ€](?![a-zà-ÿ]))")
_FULL = 0xFFFFFFFFFFFFFFFF


def _read(raw: bytes, enc: str) -> str:
    """Decoding as a careless reader does it: undefined bytes of single-byte code pages become the control character of that value, others the replacement character."""
    if enc in ("cp1252", "cp1251", "cp437"):
        return raw.decode(enc, "surrogateescape").translate(_LOW)
    return raw.decode(enc, "replace")


_LOW = {0xDC00 + i: i for i in range(128, 256)}


def garbled(text: str, chain: tuple) -> str | None:
    """What the chain makes of a text, or None where it can't be written so or stays as it is."""
    out = text
    for written, read in chain:
        try:
            raw = out.encode(written)
        except UnicodeEncodeError:
            return None
        out = _read(raw, read)
    return None if out == text or out.isascii() else out


def restored(text: str, chain: tuple) -> str | None:
    """The text before the chain, if garbling it again gives the text."""
    out = text
    try:
        for written, read in reversed(chain):
            raw = b"".join(bytes([ord(c)]) if 0x80 <= ord(c) < 0xA0 and read.startswith("cp") else c.encode(read) for c in out)
            out = raw.decode(written)
    except (UnicodeError, ValueError):
        return None
    return out if garbled(out, chain) == text else None


def words_of(text: str) -> list[str]:
    """Words that hold ASCII letters or digits and a character beyond ASCII, or a single such character; digits as one class, ASCII marks at the edges cut."""
    out = []
    for w in _WORD.findall(text):
        w = _EDGE.sub("", w)
        if w and (_ALPHA.search(w) or len(w) == 1 and not w.isalpha()):
            out.append(_DIGITS.sub("0", w))
    return out


def _windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the windows of three and of two characters beyond ASCII."""
    a = codepoints(text)
    n = len(a)
    if n < 2:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    hi = a > 127
    v = a.astype(U64)
    two = np.flatnonzero(hi[:-1] & hi[1:])
    three = np.flatnonzero(hi[:-2] & hi[1:-1] & hi[2:])
    k2 = (v[two] << U64(21)) | v[two + 1]
    k3 = (((v[three] << U64(21)) | v[three + 1]) << U64(21)) | v[three + 2]
    return np.concatenate((mix64(k3 + U64(1 << 63)), mix64(k2))), np.concatenate((three, two))


def _window_key(s: str) -> int:
    """The key of a window of two or three characters, as in `_windows`."""
    x = (ord(s[0]) << 21) | ord(s[1])
    if len(s) >= 3:
        x = (((x << 21) | ord(s[2])) + (1 << 63)) & _FULL
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _FULL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _FULL
    return x ^ (x >> 31)


def _word_key(w: str) -> int:
    return (h64(w, 11) + (1 << 63)) & _FULL


_NO_SPACES = re.compile(r"[⺀-鿿฀-๿가-힣]")
_CLEAN_PAIR = re.compile(r"[\u0370-\u03ff\u0400-\u04ff\u0590-\u05ff\u0600-\u06ff\u0900-\u097f⺀-鿿぀-ヿ぀-鿿가-힣฀-๿、。，！？：；（）“”‘’「」《》…—·]{2}")


def corpus_words(chunks: DataFrame) -> DataFrame:
    """(kind, word, n): kind 0 words, kind 1 pairs of characters, with their occurrences in the corpus."""
    schema = pa.schema([("kind", pa.int32()), ("word", pa.string()), ("n", pa.int64())])

    def count(batches):
        for b in batches:
            texts = [t for t in b.column(0).to_pylist() if not t.isascii()]
            words = Counter()
            for t in texts:
                words.update(words_of(t))
            words = Counter({w: n for w, n in words.items() if not (_NO_SPACES.search(w) or _LOST.search(w) or _LEAD.search(w))})
            a = codepoints("\n".join(texts)).astype(np.int64)
            hi = a > 127
            at = np.flatnonzero(hi[:-1] & hi[1:])
            pair, n = np.unique((a[at] << 21) | a[at + 1], return_counts=True)
            pairs = [chr(p >> 21) + chr(p & 0x1FFFFF) for p in pair.tolist()]
            keep = [k for k, p in enumerate(pairs) if _CLEAN_PAIR.fullmatch(p)]
            yield batch_of(schema, {"kind": [0] * len(words) + [1] * len(keep), "word": [*words, *(pairs[k] for k in keep)], "n": [*words.values(), *n[keep].tolist()]})

    return spread(chunks.select("text").where("text is not null")).mapInArrow(count, "kind int, word string, n bigint").groupBy("kind", "word").agg(F.sum("n").alias("n"))


def plain_sign(form: str) -> bool:
    """Whether the characters of a form alone show that it is garbled."""
    if _LEAD.search(form):
        return True
    high = [c for c in form if c > "\x7f"]
    return len(high) >= 3 and any(c.isalpha() and c < "ɐ" for c in high) and any(not c.isalnum() and c not in _COMMON for c in high)


_COMMON = frozenset("«»°·¡¿§–—‘’“”…„‚‹›、。，！？：；（）《》「」")


def garbled_forms(words: DataFrame) -> DataFrame:
    """(key, kind, word, chain, n): the garbled forms of all words under all chains; a form of several words keeps the most frequent one."""
    schema = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("word", pa.string()), ("chain", pa.int32()), ("n", pa.int64())])

    def make(batches):
        for b in batches:
            cols = {f.name: [] for f in schema}
            for kind, w, n in zip(*b.to_pydict().values(), strict=True):
                for c, chain in enumerate(CHAINS):
                    g = garbled(w, chain)
                    if g is None or any(x.isspace() for x in g):
                        continue
                    if kind == 1:
                        if len(g) < 2 or any(x < "\x80" for x in g[:3]):
                            continue
                        key = _window_key(g)
                    else:
                        g = _DIGITS.sub("0", _EDGE.sub("", g))
                        if not g or g.isascii() or len(g) > 1 and not _ALPHA.search(g):
                            continue
                        key = _word_key(g)
                    for f, x in zip(cols, (key - (1 << 64) if key >> 63 else key, kind, w, c, n), strict=True):
                        cols[f].append(x)
            yield batch_of(schema, cols)

    # few rows with much work each
    cores = words.sparkSession.sparkContext.defaultParallelism
    forms = words.repartition(4 * cores).mapInArrow(make, "key bigint, kind int, word string, chain int, n bigint")
    return forms.groupBy("key").agg(F.max(F.struct("n", "kind", "word", "chain")).alias("f")).select("key", "f.kind", "f.word", "f.chain", "f.n")


def _token_keys(text: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(keys, places, words): window keys with places, then word keys with place -1."""
    k, at = _windows(text)
    words = words_of(text)
    return np.concatenate((k, np.array([_word_key(w) for w in words], U64))), np.concatenate((at, np.full(len(words), -1))), words


def _form_of(kind: int, word: str, chain: int) -> str:
    g = garbled(word, CHAINS[chain])
    return g[:3] if kind == 1 else _DIGITS.sub("0", _EDGE.sub("", g))


def key_bitmap(forms: DataFrame) -> tuple[np.ndarray, int]:
    """(words of 64 bits, number b of bits of a key that count): which leading b bits the keys have; b grows with the table up to MAX_BITS, so at most 32 MB."""
    bits = int(min(MAX_BITS, max(16, np.ceil(np.log2(16 * max(1, forms.count()))))))
    slot = F.shiftrightunsigned("key", 64 - bits)
    got = forms.groupBy(F.shiftrightunsigned(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - bits}) & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), U64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(U64)
    return out, bits


def table_of(chunks: DataFrame) -> DataFrame:
    """(key, kind, word, chain): the garbled forms that occur in the corpus and show it, or are rare beside their originals."""
    forms = staged(garbled_forms(corpus_words(chunks)), "p3-forms")
    schema = pa.schema([("key", pa.int64()), ("seen", pa.int64())])
    sent = chunks.sparkSession.sparkContext.broadcast(key_bitmap(forms))

    def count(batches):
        bitmap, bits = sent.value
        for b in batches:
            got: list[np.ndarray] = []
            for t in b.column(0).to_pylist():
                if t.isascii():
                    continue
                k = _token_keys(t)[0]
                slot = k >> U64(64 - bits)
                got.append(k[(bitmap[(slot >> U64(6)).astype(np.int64)] >> (slot & U64(63))) & U64(1) == 1])
            k, n = np.unique(np.concatenate(got) if got else np.zeros(0, U64), return_counts=True)
            yield batch_of(schema, {"key": k.view(np.int64), "seen": n})

    seen = spread(chunks.select("text").where("text is not null")).mapInArrow(count, "key bigint, seen bigint").groupBy("key").agg(F.sum("seen").alias("seen"))
    met = forms.join(seen, "key")
    kept = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("word", pa.string()), ("chain", pa.int32())])

    def judge(batches):
        for b in batches:
            d = b.to_pydict()
            ok = [i for i, (k, w, c, n, s) in enumerate(zip(d["kind"], d["word"], d["chain"], d["n"], d["seen"], strict=True)) if s <= n * RATIO or plain_sign(_form_of(k, w, c))]
            yield batch_of(kept, {f.name: [d[f.name][i] for i in ok] for f in kept})

    return staged(met.select("key", "kind", "word", "chain", "n", "seen").mapInArrow(judge, "key bigint, kind int, word string, chain int"), "p3-table")


def _hits(text: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    k, at, words = _token_keys(text)
    i = np.minimum(np.searchsorted(table, k), len(table) - 1)
    ok = np.flatnonzero(table[i] == k)
    return i[ok], at[ok], ok - (len(k) - len(words)), words


def affected(text: str, places: np.ndarray) -> bool:
    if not len(places):
        return False
    return bool((places < 0).any()) or len(np.unique(places)) >= 2 or bool(_LOST.search(text))


def _run(chunks: DataFrame, restore: bool) -> DataFrame:
    table = table_of(chunks)
    rows = spread(chunks.select("chunk_id", "text").where("text is not null"))
    kinds = "chunk_id string, text string" if restore else "chunk_id string"
    schema = pa.schema([("chunk_id", pa.string()), *([("text", pa.string())] * restore)])
    if table.count() > (TABLE_LIMIT // 6 if restore else TABLE_LIMIT):
        return _joined(rows, table, restore)
    got = table.toArrow().sort_by("key")
    keys = got.column("key").to_numpy().view(U64)
    order = np.argsort(keys, kind="stable")
    extra = (got.column("word").to_pylist(), got.column("chain").to_pylist(), got.column("kind").to_pylist()) if restore else ((), (), ())
    sent = chunks.sparkSession.sparkContext.broadcast((keys[order], order, *extra))

    def scan(batches):
        sorted_keys, where, words, chains, _ = sent.value
        for b in batches:
            ids, texts = [], []
            for c, t in zip(*b.to_pydict().values(), strict=True):
                if t.isascii() or not len(sorted_keys):
                    continue
                i, at, word_no, own = _hits(t, sorted_keys)
                if not affected(t, at):
                    continue
                ids.append(c)
                if restore:
                    texts.append(_restore(t, where[i], at, word_no, own, words, chains))
            yield batch_of(schema, {"chunk_id": ids, "text": texts} if restore else {"chunk_id": ids})

    return rows.mapInArrow(scan, kinds)


def _joined(rows: DataFrame, table: DataFrame, restore: bool) -> DataFrame:
    """The rows of `_run` by a join of exploded tokens, for tables too large to be sent; rows are told apart by chunk id and text."""
    schema = pa.schema([("chunk_id", pa.string()), ("row", pa.int64()), ("key", pa.int64()), ("pos", pa.int64()), ("place", pa.int64()), ("lost", pa.bool_())])
    marked = rows.select("chunk_id", "text", F.xxhash64("text").alias("row"))

    def tokens(batches):
        for b in batches:
            for c, t, r in zip(*b.to_pydict().values(), strict=True):
                if not t.isascii():
                    k, at, _ = _token_keys(t)
                    n = len(k)
                    yield batch_of(schema, {"chunk_id": [c] * n, "row": [r] * n, "key": k.view(np.int64), "pos": np.arange(n), "place": at, "lost": [bool(_LOST.search(t))] * n})

    hits = marked.distinct().mapInArrow(tokens, "chunk_id string, row bigint, key bigint, pos bigint, place bigint, lost boolean")
    low = [F.min("place").alias("low"), F.max("place").alias("high"), F.max("lost").alias("lost")]
    if not restore:
        return hits.join(table.select("key"), "key", "left_semi").groupBy("chunk_id", "row").agg(*low).where("low < 0 or low < high or lost").select("chunk_id")
    met = F.sort_array(F.collect_list(F.struct("pos", "place", "word", "chain"))).alias("met")
    per = hits.join(table.select("key", "word", "chain"), "key").groupBy("chunk_id", "row").agg(*low, met).where("low < 0 or low < high or lost").select(F.col("chunk_id").alias("id"), F.col("row").alias("of"), "met")
    named = marked.join(per, marked.chunk_id.eqNullSafe(per.id) & (marked.row == per.of)).select("chunk_id", "text", "met")
    made = pa.schema([("chunk_id", pa.string()), ("text", pa.string())])

    def put_back(batches):
        for b in batches:
            ids, texts = [], []
            for c, t, met in zip(*b.to_pydict().values(), strict=True):
                own = words_of(t)
                pos, at = np.array([m["pos"] for m in met]), np.array([m["place"] for m in met])
                first = len(_windows(t)[0])
                ids.append(c)
                texts.append(_restore(t, np.arange(len(met)), at, pos - first, own, [m["word"] for m in met], [m["chain"] for m in met]))
            yield batch_of(made, {"chunk_id": ids, "text": texts})

    return named.mapInArrow(put_back, "chunk_id string, text string")


_STRETCH = re.compile("[^\x00-\x7f�]+(?:[\x20-\x7e]{1,3}[^\x00-\x7f�]+)*")


def _restore(text: str, entry, places, word_no, own, words, chains) -> str:
    """The text with its garbled words and stretches put back where that is verified."""
    swap = {own[w]: words[e] for e, p, w in zip(entry.tolist(), places.tolist(), word_no.tolist(), strict=True) if p < 0 and "�" not in own[w]}
    spots = [(p, chains[e]) for e, p in zip(entry.tolist(), places.tolist(), strict=True) if p >= 0]

    def stretch(m):
        votes = Counter(c for p, c in spots if m.start() <= p < m.end())
        for c, _ in votes.most_common():
            if (r := restored(m[0], CHAINS[c])) is not None:
                return r
        return m[0]

    out = _STRETCH.sub(stretch, text) if spots else text

    def word(m):
        w = m[0]
        core = _EDGE.sub("", w)
        key = _DIGITS.sub("0", core)
        if key not in swap:
            return w
        digits = iter(_DIGITS.findall(core))
        return w.replace(core, re.sub("0", lambda _: next(digits, "0"), swap[key]), 1)

    return _WORD.sub(word, out) if swap else out


def found(chunks: DataFrame) -> DataFrame:
    """(chunk_id) of the chunks with a stretch that was decoded with a wrong encoding."""
    return _run(chunks, False).distinct()


def restored_texts(chunks: DataFrame) -> DataFrame:
    """(chunk_id, text) of the affected chunks, restored where possible."""
    return _run(chunks, True)
