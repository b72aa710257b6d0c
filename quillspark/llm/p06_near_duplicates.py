"""Problem 6: near-duplicate records with small edits.

Gray-order hierarchical index over fingerprints. A text without white space is the set of its distinct 5-character
substrings. SLOTS minima of the set (one permutation in SLOTS bins, empty bins filled from others by a second hash) are
the fingerprint; the lowest bit of each minimum gives a bit string whose Hamming distance between two texts of
similarity s is binomial around SLOTS (1 - s) / 2.

* Upper nodes: MASKS masks of WIDTH slots each; records whose fingerprints share a masked pattern lie in one node.
* In a node, records are sorted by the Gray rank of their bit strings and cut into blocks of neighbours. A block is
  summarised by the bits all its members share; two blocks are compared by the differences on the bits that both share,
  summed level by level (BLOCK ** 2 members, BLOCK members, single records), and a whole group is dropped as soon
  as the sum passes MAX_BITS.
* Surviving pairs of different texts are verified exactly on the sets, so precision is 1. A pair at similarity 0.8
  is lost with probability (1 - 0.8 ** WIDTH) ** MASKS = 0.2 % plus P(Binomial(64, 0.1) > 16) < 0.1 %; above 0.8 it is less.

Hot nodes: a node of more than NODE records is cut into salted parts and every pair of parts is one task, so no task
holds an unbounded group and no record is skipped. Equal texts are collapsed first (classes); a copy is linked
to its class's representative and to the partners of the representative, so copies aren't expanded into all pairs.

Defined results: null texts and texts under five characters (after removal of white space) have no partner; pairs within one
source_id are left out, a null source_id differs from any other; repeated rows of a chunk id count once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import U64, batch_of, codepoints, h64, mix64, small_batches
from quillspark.session import release, spread, staged

SHINGLE, THRESHOLD = 5, 0.8
SLOTS, WIDTH, MASKS, MAX_BITS = 64, 4, 12, 16
NODE, BLOCK = 4096, 16
_SPACE = re.compile(r"\s+")


def squashed(text: str) -> str:
    return _SPACE.sub("", text)


def _shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of all 5-character substrings of the texts, each of at least 5 characters."""
    a = mix64(codepoints("".join(texts)))
    n = np.array([len(t) for t in texts])
    h = np.zeros(len(a) - SHINGLE + 1, U64)
    for j in range(SHINGLE):
        h += a[j : j + len(h)] * U64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64))
    row = np.repeat(np.arange(len(texts)), n)
    ends = np.cumsum(n)
    ok = np.ones(len(a), bool)
    for j in range(1, SHINGLE):
        ok[ends - j] = False
    keep = np.flatnonzero(ok)
    return mix64(h[keep]), row[keep]


def fingerprints(texts: list[str]) -> np.ndarray:
    """SLOTS minima for each text of at least 5 characters; an empty bin takes over another bin's minimum, chosen by a hash that depends on bin and attempt alone."""
    h, row = _shingle_hashes(texts)
    full = U64(0xFFFFFFFFFFFFFFFF)
    low = np.full(len(texts) * SLOTS, full, U64)
    at = row * SLOTS + (h >> U64(58)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    at, v = at[order], (h << U64(6))[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    low[at[first]] = np.minimum.reduceat(v, first)
    low = low.reshape(-1, SLOTS)
    empty = low == full
    rows = np.flatnonzero(empty.any(axis=1))
    own = empty[rows]
    out = low[rows]
    left, attempt = own.copy(), 0
    while left.any():
        donor = (mix64(np.arange(SLOTS, dtype=U64) + U64(SLOTS * (attempt + 1))) % U64(SLOTS)).astype(np.int64)
        take = left & ~own[:, donor]
        out[take] = mix64(low[rows][:, donor] + U64(attempt + 1))[take]
        left &= ~take
        attempt += 1
    low[rows] = out
    return low


def masked_patterns(low: np.ndarray) -> np.ndarray:
    """For each record the MASKS node keys: a hash of mask number and the slots under the mask."""
    keys = np.empty((len(low), MASKS), U64)
    for m in range(MASKS):
        k = np.full(len(low), m + 1, U64)
        for j in range(WIDTH):
            k = mix64(k * U64(0x9E3779B97F4A7C15) + low[:, m * WIDTH + j])
        keys[:, m] = k
    return keys


def bit_strings(low: np.ndarray) -> np.ndarray:
    bits = (mix64(low) & U64(1)) << np.arange(SLOTS, dtype=U64)
    return np.bitwise_or.reduce(bits, axis=1)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The position of each bit string in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> U64(s)
    return x


def gray_order(bits: np.ndarray) -> np.ndarray:
    """The Gray rank as a signed number of the same order."""
    return (gray_rank(bits) ^ U64(1 << 63)).view(np.int64)


def bits_of(rank: np.ndarray) -> np.ndarray:
    """The bit strings of signed Gray ranks."""
    r = rank.view(U64) ^ U64(1 << 63)
    return r ^ (r >> U64(1))


def _shared(bits: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(mask of the bits all members share, their values) of each group of `size` neighbours."""
    at = np.arange(0, len(bits), size)
    every, some = np.bitwise_and.reduceat(bits, at), np.bitwise_or.reduceat(bits, at)
    return ~(every ^ some), every


def node_pairs(a: np.ndarray, b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the bit strings within MAX_BITS, within a (i < j) or between a and b, both in Gray order."""
    within = b is None
    b = a if within else b
    if len(a) * len(b) <= 4 * BLOCK * BLOCK:
        i, j = (x.ravel() for x in np.indices((len(a), len(b))))
    else:
        i = j = np.zeros(1, np.int64)
        sizes = []
        s = BLOCK
        while s < max(len(a), len(b)):
            sizes.append(s)
            s *= BLOCK
        prev = None
        for s in [*reversed(sizes), 1]:
            if prev is None:
                i, j = (x.ravel() for x in np.indices((-(-len(a) // s), -(-len(b) // s))))
            else:
                f = prev // s
                i = (i[:, None] * f + np.arange(f)).repeat(f, axis=1).ravel()
                j = np.tile(j[:, None] * f + np.arange(f), (1, f)).ravel()
                ok = (i * s < len(a)) & (j * s < len(b))
                i, j = i[ok], j[ok]
            if within:
                i, j = (x[i <= j] for x in (i, j))
            if s > 1:
                ma, va = _shared(a, s)
                mb, vb = _shared(b, s)
                ok = np.bitwise_count((va[i] ^ vb[j]) & ma[i] & mb[j]) <= MAX_BITS
                i, j = i[ok], j[ok]
            prev = s
    ok = np.bitwise_count(a[i] ^ b[j]) <= MAX_BITS
    if within:
        ok &= i < j
    return i[ok], j[ok]


def _classes(chunks: DataFrame) -> DataFrame:
    """(chunk_id, source_id, cls, rank, keys): a row a chunk with its class (hash of the squashed text) and fingerprint, its bits as Gray rank."""
    schema = pa.schema([("chunk_id", pa.string()), ("source_id", pa.string()), ("cls", pa.int64()), ("rank", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def make(batches):
        for b in small_batches(batches, 1000):
            d = b.to_pydict()
            texts = [squashed(t) if t else "" for t in d["text"]]
            keep = [i for i, t in enumerate(texts) if len(t) >= SHINGLE and d["chunk_id"][i] is not None]
            if not keep:
                continue
            low = fingerprints([texts[i] for i in keep])
            keys = masked_patterns(low).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1) * MASKS, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([d["chunk_id"][i] for i in keep]), pa.array([d["source_id"][i] for i in keep], pa.string()), pa.array([h64(texts[i]) for i in keep]), pa.array(gray_order(bit_strings(low))), lists], schema=schema)

    rows = spread(chunks.select("chunk_id", "source_id", "text").where("text is not null"))
    return rows.mapInArrow(make, "chunk_id string, source_id string, cls bigint, rank bigint, keys array<bigint>")


def _node_pairs_of(part: DataFrame) -> DataFrame:
    """(x, y) of all pairs in the nodes of a table sorted by (node, side, rank); within a node both sides or, where side is 0 throughout, one."""
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def one(cls, bits, side):
        if len(cls) < 2:
            return None
        if side[-1] == 0:
            i, j = node_pairs(bits)
            x, y = cls[i], cls[j]
        else:
            k = int(np.searchsorted(side, 1))
            if not 0 < k < len(cls):
                return None
            i, j = node_pairs(bits[:k], bits[k:])
            x, y = cls[:k][i], cls[k:][j]
        return np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]

    def scan(batches):
        held: list[np.ndarray] = []
        for b in batches:
            now = [b.column(k).to_numpy() for k in range(4)]
            if held:
                now = [np.concatenate((h, n)) for h, n in zip(held, now, strict=True)]
            node = now[0]
            edge = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if len(node) else np.zeros(0, int)
            if not len(edge):
                continue
            xs, ys = [], []
            ends = np.append(edge[1:], len(node))
            for s, e in zip(edge[:-1], ends[:-1], strict=True):
                if e - s > 1 and (got := one(now[2][s:e], bits_of(now[3][s:e]), now[1][s:e])):
                    xs.append(got[0])
                    ys.append(got[1])
            held = [n[edge[-1] :] for n in now]
            if xs:
                yield batch_of(schema, {"x": np.concatenate(xs), "y": np.concatenate(ys)})
        if held and (got := one(held[2], bits_of(held[3]), held[1])):
            yield batch_of(schema, {"x": got[0], "y": got[1]})

    return part.mapInArrow(scan, "x bigint, y bigint")


def candidate_pairs(records: DataFrame, node: int = NODE) -> DataFrame:
    """Distinct class pairs (x < y) that share an upper node and lie within MAX_BITS; records: (cls, rank, keys), one row a class."""
    placed = records.select("cls", "rank", F.explode("keys").alias("node"))
    sizes = placed.groupBy("node").count().where("count > 1")
    hot = staged(sizes.where(F.col("count") > node), "p6-hot")
    many = hot.limit(1).count() > 0
    plain = placed.join(hot.select("node"), "node", "left_anti") if many else placed
    parts = [_node_pairs_of(plain.select("node", F.lit(0).alias("side"), "cls", "rank").repartition("node").sortWithinPartitions("node", "rank"))]
    if many:
        cut = placed.join(hot, "node").withColumn("n", F.ceil(F.col("count") / node).cast("int")).withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("n")).cast("int"))
        # every pair of parts (lo <= hi) of a hot node is a node of its own; a record goes to each pair that holds its part
        pairs = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
        pairs = pairs.select(F.xxhash64("node", lo, hi).alias("node"), F.when(F.col("mine") > F.col("other"), 1).otherwise(0).alias("side"), "cls", "rank")
        parts.append(_node_pairs_of(pairs.repartition("node").sortWithinPartitions("node", "side", "rank")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.distinct()


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(x, y, similarity) of the pairs at or above the threshold; texts: (cls, text) of the classes in pairs.

    The pairs of x stand next to its text after one shuffle, so a pair moves the text of y alone, and the set of x is made once."""
    far = pairs.join(texts.select(F.col("cls").alias("y"), F.col("text").alias("t")), "y").select("x", "y", "t")
    near = texts.join(pairs.select(F.col("x").alias("cls")).distinct(), "cls", "left_semi").select(F.col("cls").alias("x"), F.lit(None).cast("bigint").alias("y"), F.col("text").alias("t"))
    dealt = near.unionByName(far).repartition("x").sortWithinPartitions("x", F.col("y").asc_nulls_first())
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("similarity", pa.float64())])

    def grams(t: str) -> set[str]:
        t = squashed(t)
        return {t[i : i + SHINGLE] for i in range(len(t) - SHINGLE + 1)}

    def check(batches):
        own: set[str] = set()
        for b in small_batches(batches, 2000):
            kept = []
            for x, y, t in zip(*b.to_pydict().values(), strict=True):
                if y is None:
                    own = grams(t)
                    continue
                # a text has at most as many substrings as characters
                if len(t) < threshold * len(own):
                    continue
                v = grams(t)
                if min(len(own), len(v)) < threshold * max(len(own), len(v)) - 1e-9:
                    continue
                both = len(own & v)
                if (alike := both / (len(own) + len(v) - both)) >= threshold - 1e-12:
                    kept.append((x, y, alike))
            yield batch_of(schema, {f.name: [k[j] for k in kept] for j, f in enumerate(schema)})

    return dealt.mapInArrow(check, "x bigint, y bigint, similarity double")


def class_links(chunks: DataFrame, threshold: float = THRESHOLD, node: int = NODE) -> tuple[DataFrame, DataFrame]:
    """Members (chunk_id, source_id, cls, rep) and links (x, y, similarity) between classes of equal squashed texts."""
    made = staged(_classes(chunks), "p6-fingerprints")
    records = made.groupBy("cls").agg(F.min(F.struct("chunk_id", "rank", "keys")).alias("r")).select("cls", F.col("r.chunk_id").alias("rep"), F.col("r.rank").alias("rank"), F.col("r.keys").alias("keys"))
    pairs = staged(candidate_pairs(records.select("cls", "rank", "keys"), node), "p6-candidates")
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("cls")).distinct()
    ids = wanted.join(made.groupBy("cls").agg(F.min("chunk_id").alias("chunk_id")), "cls")
    texts = chunks.where("text is not null").select("chunk_id", "text").join(ids, "chunk_id").groupBy("cls").agg(F.min("text").alias("text"))
    links = staged(_verified(pairs, texts, threshold), "p6-links")
    members = made.select("chunk_id", "source_id", "cls").distinct()
    return members, links


def found(chunks: DataFrame, threshold: float = THRESHOLD, node: int = NODE) -> DataFrame:
    """(chunk_a, chunk_b), the smaller id first: linked chunks of different source_id.

    Between two classes the representatives are linked, each copy to the other representative; within a class each copy to the representative."""
    members, links = class_links(chunks, threshold, node)
    linked = links.select(F.explode(F.array("x", "y")).alias("cls")).distinct()
    copies = members.groupBy("cls").agg(F.count("*").alias("n"), F.min(F.struct("chunk_id", "source_id")).alias("rep"))
    reps = copies.join(linked, "cls", "left").where("n > 1").union(copies.join(linked, "cls").where("n = 1")).select("cls", "n", "rep")
    m = members.join(reps, "cls")
    m = staged(m.select("cls", "chunk_id", "source_id", F.col("rep.chunk_id").alias("rep"), F.col("rep.source_id").alias("rep_source")), "p6-members")
    own = m.where("chunk_id <> rep").select(F.col("rep").alias("a"), F.col("rep_source").alias("sa"), F.col("chunk_id").alias("b"), F.col("source_id").alias("sb"))
    both = links.select(F.col("x").alias("p"), F.col("y").alias("q")).union(links.select("y", "x"))
    r = m.where("chunk_id = rep").select(F.col("cls").alias("q"), F.col("rep").alias("b"), F.col("source_id").alias("sb"))
    across = both.join(m.select(F.col("cls").alias("p"), F.col("chunk_id").alias("a"), F.col("source_id").alias("sa")), "p").join(r, "q").select("a", "sa", "b", "sb")
    every = own.union(across).where("not coalesce(sa = sb, false) and a <> b")
    return every.select(F.least("a", "b").alias("chunk_a"), F.greatest("a", "b").alias("chunk_b")).distinct()


def groups(chunks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(chunk_id, group_id, links): every chunk with a text, the smallest chunk id that is reachable over links (any source_id), and the number of linked classes.

    Labels are spread by alternating large-star and small-star steps on the class graph, each step a bounded shuffle written to the shared folder."""
    members, links = class_links(chunks, threshold)
    rep = staged(members.groupBy("cls").agg(F.min("chunk_id").alias("rep")), "p6-reps")
    named = links.join(rep.select(F.col("cls").alias("x"), F.col("rep").alias("u")), "x").join(rep.select(F.col("cls").alias("y"), F.col("rep").alias("v")), "y").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    degree = named.select("u").union(named.select("v")).groupBy("u").agg(F.count("*").alias("links")).withColumnRenamed("u", "rep")
    edges = staged(named.distinct(), "p6-edges")
    while True:
        near = edges.union(edges.select("v", "u"))
        low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = staged(near.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct(), "p6-large")
        low2 = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = staged(small, "p6-edges")
        if after.exceptAll(edges).limit(1).count() == 0 and edges.exceptAll(after).limit(1).count() == 0:
            break
        release(edges, large)
        edges = after
    label = rep.join(edges.groupBy(F.col("u").alias("rep")).agg(F.min("v").alias("low")), "rep", "left").join(degree, "rep", "left").select("cls", F.coalesce("low", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return members.select("chunk_id", "cls").join(label, "cls").select("chunk_id", "group_id", "links").distinct()
