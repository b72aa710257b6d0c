"""Exact and near-duplicate operators of the corpus pipeline."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.rank import small
from quillspark.session import release, spread, staged

PERMS, BANDS, TURNS, PARITIES, THRESHOLD = 128, 32, 8, 6, 0.85
SENT = 50_000  # rows with an id sent to every task at most


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def small_batches(batches, rows: int = 2000):
    for t in batches:
        for i in range(0, t.num_rows, rows):
            yield t.slice(i, rows)


def first_of_equal(df: DataFrame, key: list, order: list) -> DataFrame:
    """The first row (in the given order) of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def _windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the 5-character substrings of squashed texts, one after the other, and where each text begins; a text of at most 5 characters is its own only one."""
    size = np.array([max(5, len(x)) for x in texts])
    c = np.full(size.sum() + 4, 0x1FFFFF, np.uint64)  # no character: fills short texts
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    for i, x in zip(at.tolist(), texts):
        c[i : i + len(x)] = codepoints(x)
    n = len(c) - 4
    a = c[:n] | c[1 : n + 1] << np.uint64(21) | c[2 : n + 2] << np.uint64(42)
    h = mix64(a + mix64(c[3 : n + 3] | c[4 : n + 4] << np.uint64(21)))
    keep = np.ones(n, bool)
    for k in range(1, 5):
        keep[at + size - k] = False
    return h[keep], np.concatenate([[0], np.cumsum(size - 4)[:-1]])


def _shingles(text: str) -> np.ndarray:
    return np.unique(_windows([text])[0])


def _permutations(turn: int) -> tuple:
    """The permutations and bands of one of TURNS turns."""
    rng = np.random.default_rng(1)
    mult = rng.integers(0, 1 << 63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, PERMS, dtype=np.uint64)
    fold = rng.integers(0, 1 << 63, (BANDS, PERMS // BANDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    p, b = slice(turn * PERMS // TURNS, (turn + 1) * PERMS // TURNS), slice(turn * BANDS // TURNS, (turn + 1) * BANDS // TURNS)
    return mult[p], add[p], fold[b], np.arange(BANDS, dtype=np.uint64)[b]


def _keyed(turn: int):
    mult, add, fold, at = _permutations(turn)

    def run(batches):
        for t in small_batches(batches, 200):
            # copies within a batch are one text
            h, first = np.unique(t.column("h").to_numpy(zero_copy_only=False), return_index=True)
            words, begin = _windows(t.column("s").take(pa.array(first)).to_pylist())
            for x in np.split(words, begin[1:]):  # views: each text's words are sorted in place
                x.sort()
            row = np.repeat(np.arange(len(h)), np.diff(np.append(begin, len(words))))
            once = np.concatenate([[True], (words[1:] != words[:-1]) | (row[1:] != row[:-1])])
            words, row = words[once], row[once]
            n = np.bincount(row, minlength=len(h)).astype(np.int32)
            begin = np.concatenate([[0], np.cumsum(n)[:-1]])
            buckets = row * (64 * PARITIES) + (words % np.uint64(64 * PARITIES)).astype(np.int64)
            odd = np.packbits((np.bincount(buckets, minlength=len(h) * 64 * PARITIES) & 1).astype(np.uint8).reshape(len(h), -1), axis=1).view(np.int64)
            low = np.stack([np.minimum.reduceat((words * m + d) >> np.uint64(1), begin) for m, d in zip(mult, add)], axis=1)
            keys = mix64((low.reshape(len(h), *fold.shape) * fold).sum(axis=2) ^ at).view(np.int64)
            k = keys.shape[1]
            yield pa.RecordBatch.from_pydict({"band": keys.ravel(), "h": np.repeat(h, k), "n": np.repeat(n, k)} | {f"p{i}": np.repeat(odd[:, i], k) for i in range(PARITIES)})

    return run


def _partners(threshold: float):
    """Pairs of texts of one band whose sizes and parities allow the threshold, from rows that hold every band as a whole; a partition is a few MB of numbers.

    Two sets differ in at least as many members as their parities (whether a bucket of hashes holds an odd number of members) do, so no pair is lost."""
    columns = ["band", "h", "n", *(f"p{i}" for i in range(PARITIES))]
    apart = (1 - threshold) / (1 + threshold)

    def run(batches):
        held = [np.array(t.column(c).to_numpy(zero_copy_only=False)) for t in batches for c in columns]
        if not held:
            return
        band, h, n, *odd = (np.concatenate(held[i :: len(columns)]) for i in range(len(columns)))
        order = np.lexsort((h, n, band))
        order = order[np.concatenate([[True], (np.diff(band[order]) != 0) | (np.diff(h[order]) != 0)])]
        band, h, n, odd = band[order], h[order], n[order], [p[order] for p in odd]
        # rows of a band stand by size: each meets those after it, a step further every round, until all are too large
        left, step = np.arange(len(h)), 1
        while len(left):
            left = left[left + step < len(h)]
            right = left + step
            ok = (band[left] == band[right]) & (n[left] >= threshold * n[right] - 1e-9)
            left, right = left[ok], right[ok]
            differ = sum(np.bitwise_count((p[left] ^ p[right]).view(np.uint64)).astype(np.int64) for p in odd)
            near = differ <= apart * (n[left] + n[right]) + 1e-6
            a, b = h[left[near]], h[right[near]]
            for i in range(0, len(a), 100_000):
                x, y = a[i : i + 100_000], b[i : i + 100_000]
                yield pa.RecordBatch.from_pydict({"x": np.minimum(x, y), "y": np.maximum(x, y)})
            step += 1

    return run


def _checked(threshold: float):
    def run(batches):
        held: dict[int, np.ndarray] = {}

        def words(key: int, text: str) -> np.ndarray:
            if key not in held:
                if len(held) >= 2000:
                    held.clear()
                held[key] = _shingles(text)
            return held[key]

        for t in small_batches(batches):
            sim = []
            for x, y, s, o in zip(*(t.column(c).to_pylist() for c in ("x", "y", "s", "o"))):
                u, v = words(x, s), words(y, o)
                both = len(np.intersect1d(u, v, assume_unique=True)) if min(len(u), len(v)) >= threshold * max(len(u), len(v)) - 1e-9 else 0
                sim.append(both / (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([t.column("i"), t.column("j"), pa.array(sim, pa.float64())], ["i", "j", "similarity"])

    return run


def similar_pairs(df: DataFrame, key: str, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity) of rows whose 5-character shingle sets reach the threshold: MinHash bands, then the exact value.

    Equal texts are one class; pairs are between class representatives (see `classes`). 32 bands of 4 values miss a pair at 0.85 with probability 1e-10.
    A row of the bands' shuffle is a key, a text's hash, its size and 384 parities, which rule out most pairs that share a band by chance. The bands come in TURNS turns, each with the texts read again, so the disk holds one turn's rows; only texts of candidate pairs are moved."""
    s = spread(df.select(F.col(key).alias("id"), T.squash(F.col(text)).alias("s")).where(F.length("s") > 0)).select("id", F.xxhash64("s").alias("h"), "s")
    found = []
    for turn in range(TURNS):
        keyed = s.select("h", "s").mapInArrow(_keyed(turn), "band bigint, h bigint, n int, " + ", ".join(f"p{i} bigint" for i in range(PARITIES))).repartition("band")
        found.append(staged(keyed.mapInArrow(_partners(threshold), "x bigint, y bigint").distinct(), "candidates"))
    pairs = staged(reduce(DataFrame.union, found).distinct(), "candidates")
    release(*found)
    asked = small(staged(pairs.select(F.explode(F.array("x", "y")).alias("h")).distinct(), "asked"))
    reps = staged(s.join(asked, "h", "left_semi").groupBy("h").agg(F.min("id").alias("id"), F.first("s").alias("s")), "asked-texts")
    full = pairs.join(reps.select(F.col("h").alias("x"), F.col("id").alias("i"), "s"), "x").join(reps.select(F.col("h").alias("y"), F.col("id").alias("j"), F.col("s").alias("o")), "y")
    kind = df.schema[key].dataType.simpleString()
    sim = full.select("x", "y", "i", "j", "s", "o").mapInArrow(_checked(threshold), f"i {kind}, j {kind}, similarity double").where(F.col("similarity") >= threshold)
    return sim.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "similarity")


def classes(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, rep): every row with the representative of its class of equal squashed texts."""
    s = df.where(F.col(text).isNotNull()).select(key, F.xxhash64(T.squash(F.col(text))).alias("s"))
    return s.join(s.groupBy("s").agg(F.min(key).alias("rep")), "s").select(key, "rep")


def decided(ids: DataFrame, pairs: DataFrame, order: str) -> DataFrame:
    """(id, kept_as) of the ids that pairs hold: rows visited by `order`; one similar to an already kept row is dropped in its favour, not transitively.

    Every round decides all rows whose earlier neighbours are decided, so the work is a few joins and no component is gathered. What is staged grows with the pairs, not with the ids."""
    once = staged(pairs.select("a", "b"), "greedy-pairs")  # the pairs are made once, not for either direction
    both = once.union(once.select("b", "a"))
    met = small(staged(both.select(F.col("a").alias("id")).distinct(), "greedy-met"), SENT)
    known = staged(ids.select("id", order).join(met, "id", "left_semi"), "greedy-ids")
    edges = staged(both.join(known.select(F.col("id").alias("a"), F.col(order).alias("oa")), "a").join(known.select(F.col("id").alias("b"), F.col(order).alias("ob")), "b").where("ob < oa or (ob = oa and b < a)"), "greedy-edges")
    open_ = staged(edges.select(F.col("a").alias("id")).distinct(), "greedy-open")
    kept = staged(known.select("id").join(open_, "id", "left_anti").withColumn("kept_as", F.col("id")), "greedy-kept")
    while open_.limit(1).count():
        e = edges.join(open_.select(F.col("id").alias("a")), "a", "left_semi").join(kept.select(F.col("id").alias("b"), "kept_as"), "b", "left")
        state = e.groupBy("a").agg(F.min(F.when(F.col("kept_as") == F.col("b"), F.struct("ob", "b"))).alias("host"), F.min(F.when(F.col("kept_as").isNull(), F.struct("ob", "b"))).alias("wait"))
        done = staged(state.where("wait is null or host < wait").select(F.col("a").alias("id"), F.coalesce("host.b", "a").alias("kept_as")), "greedy-done")
        before = kept, open_
        kept = staged(kept.unionByName(done), "greedy-kept")
        open_ = staged(open_.join(done, "id", "left_anti"), "greedy-open")
        release(done, *before)
    release(once, edges, known, open_)
    return kept


def greedy_keep(ids: DataFrame, pairs: DataFrame, order: str) -> DataFrame:
    """(id, kept_as) of all ids, see `decided`; an id without a pair is kept as itself and passes through."""
    kept = decided(ids, pairs, order)
    free = ids.select("id").join(small(kept.select("id"), SENT), "id", "left_anti").withColumn("kept_as", F.col("id"))
    return free.unionByName(kept)


def greedy_rows(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, kept_as) of all rows (id, s), visited by id, see `decided`; rows of one s are copies, and pairs are between the first ids of each s.

    Copies have the same neighbours, so at most the first of them is kept, and the others go where it goes. Only ids are shuffled; what is dropped for another class is staged alone."""
    first = rows.groupBy("s").agg(F.min("id").alias("id"))
    kept = decided(first.select("id", F.col("id").alias("ord")), pairs, "ord")
    dropped = small(kept.where("kept_as != id").select(F.col("id").alias("first"), "kept_as"), SENT)
    every = rows.select("id", F.min("id").over(Window.partitionBy("s")).alias("first"))
    return every.join(dropped, "first", "left").select("id", F.coalesce("kept_as", "first").alias("kept_as"))


def sample_recall(pairs: DataFrame, truth: pd.DataFrame) -> float:
    """Share of the true (a, b) pairs that `pairs` has."""
    got = pairs.sparkSession.createDataFrame(truth).join(pairs, ["a", "b"], "left_semi").count()
    return got / max(1, len(truth))
