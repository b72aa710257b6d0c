"""Problem 2: the same or near-same questions in evaluation and training splits.

Questions are reduced to NFKC, lower case, letters and digits; equal ones become one record with members. Evaluation
records are cut by hash into shards of at most SHARD records. For each shard an Aho-Corasick automaton holds, of
every record, its passages (distinct 3-character substrings) that are rarest in the shard: |A| - ceil(t |A|) + d of
them, d = max(2, DEPTH |A|). A partner of Jaccard similarity t or more has at least ceil(t |A|) grams of A, so at least min(d, ceil(t |A|))
of these patterns: no partner is missed, and as d grows with the record, a text that shares but a common phrase or two is no candidate.
All training texts are scanned against each shard; the exact similarity of the candidates decides, and the matched intervals of
an evaluation record are merged into its coverage (the share of its characters).

Scale: work is (shard x slice of training texts); a slice is a bounded group of a shuffle, so a lost executor
costs its slices only, and nothing is collected. Copies are collapsed before the join; `found` expands them, because TESTDATA.md
states the result by samples. `report` counts members without expanding.

Defined results: null questions and questions under three characters after reduction have no partner; a null split is
neither train nor evaluation; a null source is reported as null; repeated sample ids give one row.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import batch_of, h64
from quillspark.llm.p09_leakage import reduced
from quillspark.session import spread, staged

THRESHOLD, DEPTH, SHARD, SLICE = 0.7, 0.15, 20_000, 25_000


def grams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


def reduced_questions(queries: DataFrame) -> DataFrame:
    """(sample_id, split, source, norm, key) of every question with at least one gram."""
    schema = pa.schema([("sample_id", pa.string()), ("split", pa.string()), ("source", pa.string()), ("norm", pa.string()), ("key", pa.int64())])

    def red(batches):
        for b in batches:
            rows = [(i, s, o, r, h64(r)) for i, s, o, q in zip(*b.to_pydict().values(), strict=True) if i is not None and s is not None and q and len(r := reduced(q)) >= 3]
            yield batch_of(schema, {f.name: [x[j] for x in rows] for j, f in enumerate(schema)})

    return spread(queries.select("sample_id", "split", "source", "question")).mapInArrow(red, "sample_id string, split string, source string, norm string, key bigint")


def _covered(text: str, other: set[str]) -> float:
    """Share of the text's characters in its intervals that match passages of the other text, intervals merged."""
    n, end = 0, 0
    for i in range(len(text) - 2):
        if text[i : i + 3] in other:
            n += i + 3 - max(i, end)
            end = i + 3
    return n / len(text)


def _scan(shard: pd.DataFrame, texts: pd.DataFrame, threshold: float, depth: float):
    """(evaluation key, training key, similarity, coverage) of all pairs in one shard and slice."""
    import ahocorasick

    sets = [grams(t) for t in shard["norm"]]
    df = Counter(g for s in sets for g in s)
    needed, post = [], {}
    for k, s in enumerate(sets):
        most = math.ceil(threshold * len(s) - 1e-9)
        need = min(most, max(2, math.ceil(depth * len(s))))
        for g in sorted(s, key=lambda g: (df[g], g))[: len(s) - most + need]:
            post.setdefault(g, []).append(k)
        needed.append(need)
    auto = ahocorasick.Automaton()
    for g, ks in post.items():
        auto.add_word(g, (g, np.array(ks, np.int32)))
    auto.make_automaton()
    needed_of = np.array(needed)
    keys, norms = shard["key"].to_numpy(), shard["norm"].tolist()
    for key, text in zip(texts["t_key"].to_numpy(), texts["t_norm"], strict=True):
        met = dict(hit for _, hit in auto.iter(text))
        if not met:
            continue
        ids = np.flatnonzero(np.bincount(np.concatenate(list(met.values())), minlength=len(sets)) >= needed_of)
        if not len(ids):
            continue
        other = grams(text)
        for k in ids.tolist():
            own = sets[k]
            both = len(own & other)
            alike = both / (len(own) + len(other) - both)
            if alike >= threshold - 1e-12:
                yield int(keys[k]), int(key), alike, _covered(norms[k], other)


def record_pairs(norm: DataFrame, threshold: float = THRESHOLD, depth: float = DEPTH, shard: int = SHARD, part: int = SLICE) -> DataFrame:
    """(eval_key, train_key, similarity, coverage) between distinct reduced texts."""
    side = norm.withColumn("train", F.col("split") == "train").select("key", "norm", "train").distinct()
    evals, trains = side.where("not train").select("key", "norm"), side.where("train").select("key", "norm")
    n_eval, n_train = (r := side.groupBy().agg(F.count_if(~F.col("train")).alias("e"), F.count_if("train").alias("t")).first()).e, r.t
    shards, parts = max(1, -(-n_eval // shard)), max(1, -(-n_train // part))
    e = evals.select("*", F.pmod(F.hash("key"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    # own names on this side: both sides come from one table, and Spark would take equal columns for each other
    t = trains.select(F.col("key").alias("t_key"), F.col("norm").alias("t_norm"), F.pmod(F.hash("key"), F.lit(parts)).alias("t_part"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("t_shard"))

    def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = list(_scan(a, b, threshold, depth)) if len(a) and len(b) else []
        return pd.DataFrame(rows, columns=["eval_key", "train_key", "similarity", "coverage"])

    return e.groupBy("shard", "part").cogroup(t.groupBy("t_shard", "t_part")).applyInPandas(both, "eval_key bigint, train_key bigint, similarity double, coverage double")


def overlaps(queries: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """The reduced questions and the pairs of their records, both staged."""
    norm = staged(reduced_questions(queries), "p2-norm")
    return norm, staged(record_pairs(norm, threshold), "p2-pairs")


def found(queries: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(sample_a, sample_b), the smaller id first: every train question with every similar one of another split."""
    norm, pairs = overlaps(queries, threshold)
    ev = norm.where("split <> 'train'").select(F.col("key").alias("eval_key"), F.col("sample_id").alias("e"))
    tr = norm.where("split = 'train'").select(F.col("key").alias("train_key"), F.col("sample_id").alias("t"))
    both = pairs.select("eval_key", "train_key").join(ev, "eval_key").join(tr, "train_key")
    return both.select(F.least("e", "t").alias("sample_a"), F.greatest("e", "t").alias("sample_b")).where("sample_a <> sample_b").distinct()


def report(queries: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per evaluation split and source: questions, overlapping ones, exact ones (after reduction) and mean best coverage of the overlapping."""
    norm, pairs = overlaps(queries, threshold)
    best = pairs.groupBy(F.col("eval_key").alias("key")).agg(F.max("similarity").alias("s"), F.max("coverage").alias("c"))
    of = queries.where("split is not null and split <> 'train' and question is not null").select("sample_id", "split", "source")
    hit = norm.where("split <> 'train'").join(best, "key").groupBy("sample_id").agg(F.max("s").alias("s"), F.max("c").alias("c"))
    return of.join(hit, "sample_id", "left").groupBy("split", "source").agg(F.count("*").alias("questions"), F.count("s").alias("overlapping"), F.count_if(F.col("s") >= 1 - 1e-12).alias("exact"), F.avg("c").alias("mean_coverage"))
