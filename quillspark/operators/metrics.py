"""Evaluation: ranking metrics, intervals, tests, curves, agreement. Empty denominators give null."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def per_query(ranking: DataFrame, qrels: DataFrame, hits: tuple = (1, 3, 5), depth: int = 10) -> DataFrame:
    """One row a query of qrels: hit@k, recall@depth, precision@depth, reciprocal rank, average precision, nDCG at depth; binary relevance."""
    gold = qrels.select("query_id", "id").distinct()
    n = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    hit = ranking.where(F.col("rank") <= depth).join(gold, ["query_id", "id"]).select("query_id", "rank")
    seen = hit.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    agg = seen.groupBy("query_id").agg(
        *[F.max((F.col("rank") <= k).cast("int")).alias(f"hit_{k}") for k in hits], F.count("*").alias("found"), F.min("rank").alias("first"),
        F.sum(F.col("k") / F.col("rank")).alias("ap"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_gold", F.lit(depth))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return n.join(agg, "query_id", "left").select(
        "query_id", *[F.coalesce(f"hit_{k}", F.lit(0)).alias(f"hit_{k}") for k in hits], (F.coalesce("found", F.lit(0)) / F.col("n_gold")).alias("recall"), (F.coalesce("found", F.lit(0)) / depth).alias("precision"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), F.coalesce(F.col("ap") / F.col("n_gold"), F.lit(0.0)).alias("ap"), F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"),
    )


def graded(ranking: DataFrame, labels: DataFrame, depth: int = 5) -> DataFrame:
    """(query_id, ndcg) with linear gains of (query_id, id, label)."""
    got = ranking.where(F.col("rank") <= depth).join(labels, ["query_id", "id"]).groupBy("query_id").agg(F.sum(F.col("label") / F.log2(F.col("rank") + 1)).alias("dcg"))
    w = Window.partitionBy("query_id").orderBy(F.desc("label"), "id")
    best = labels.withColumn("r", F.row_number().over(w)).where(F.col("r") <= depth).groupBy("query_id").agg(F.sum(F.col("label") / F.log2(F.col("r") + 1)).alias("ideal"))
    return best.join(got, "query_id", "left").select("query_id", ratio(F.coalesce("dcg", F.lit(0.0)), F.col("ideal")).alias("ndcg"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, null for n = 0, within [0, 1]."""
    p, d = hits / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)), F.when(n > 0, F.least(F.lit(1.0), mid + half))


def random_hit(n: Column, gold: Column, k: int) -> Column:
    """Chance that k of n rows drawn at random hold one of the gold rows."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda a, i: a * F.greatest(n - gold - i, F.lit(0)) / F.greatest(n - i, F.lit(1)))
    return F.when(n <= k, F.when(gold > 0, 1.0).otherwise(0.0)).otherwise(1 - miss)


def sign_test(wins: Column, losses: Column) -> Column:
    """Exact two-sided p value of a fair coin."""
    n, k = wins + losses, F.least(wins, losses)
    init = F.struct(F.lit(1.0).alias("c"), F.lit(0.0).alias("s"))
    tail = F.aggregate(F.sequence(F.lit(0), k), init, lambda a, i: F.struct((a["c"] * (n - i) / (i + 1)).alias("c"), (a["s"] + a["c"]).alias("s")), lambda a: a["s"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), n)))


def running(df: DataFrame, order: str, values: list[str], parts: int = 64) -> DataFrame:
    """df (one row an order value) with for each value the sum over all rows up to its own as <value>_to and of all rows as <value>_all, without one task for all rows.

    Rows are dealt into ranges by approximate quantiles; sums run inside a range, and the few sums of the ranges before are added."""
    cuts = df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.001) if parts > 1 else []
    cuts = sorted(set(cuts))
    part = F.lit(0)
    for i, c in enumerate(cuts):
        part = F.when(F.col(order) > c, i + 1).otherwise(part)
    dealt = df.withColumn("_part", part)
    w = Window.partitionBy("_part").orderBy(order)
    sums = dealt.groupBy("_part").agg(*[F.sum(v).alias(v) for v in values])
    few = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    before = sums.select("_part", *[F.coalesce(F.sum(v).over(few), F.lit(0)).alias(f"_{v}") for v in values], *[F.sum(v).over(every).alias(f"{v}_all") for v in values])
    out = dealt.join(F.broadcast(before), "_part")
    return out.select(*df.columns, *[(F.sum(v).over(w) + F.col(f"_{v}")).alias(f"{v}_to") for v in values], *[f"{v}_all" for v in values])


def auroc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """(auroc): Mann-Whitney by rank sums, ties one half; scores are aggregated before they are ranked."""
    g = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    g = running(g, "s", ["n"])
    return g.agg(ratio(F.sum(F.col("p") * (F.col("n_to") - F.col("n") / 2)), F.sum("p") * F.sum("n")).alias("auroc"))


def paired(df: DataFrame, a: str, b: str) -> DataFrame:
    """Means, difference, wins, losses, ties (within 1e-12) and sign test of two columns of one row a sample."""
    d = F.col(a) - F.col(b)
    r = df.agg(F.count("*").alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.count_if(d > 1e-12).alias("wins"), F.count_if(d < -1e-12).alias("losses"))
    return r.select("n", "mean_a", "mean_b", (F.col("mean_a") - F.col("mean_b")).alias("diff"), "wins", "losses", (F.col("n") - F.col("wins") - F.col("losses")).alias("ties"), sign_test(F.col("wins"), F.col("losses")).alias("p_value"))


def risk_coverage(df: DataFrame, score: str, correct: str) -> DataFrame:
    """(n, coverage, risk, threshold) as rows are answered from the best score down, one row a distinct score."""
    g = df.groupBy(F.col(score).alias("threshold")).agg(F.count("*").alias("c"), F.count_if(~F.col(correct)).alias("w"))
    g = running(g, "threshold", ["c", "w"])
    n, wrong = F.col("c_all") - F.col("c_to") + F.col("c"), F.col("w_all") - F.col("w_to") + F.col("w")
    return g.select("threshold", n.alias("n"), (n / F.col("c_all")).alias("coverage"), (wrong / n).alias("risk"))


def curve_picks(curve: DataFrame, order: str, picks: int = 12) -> DataFrame:
    """Rows of a curve at `picks` evenly spaced indices from its first to its last row by `order`, best first."""
    ranked = running(curve.withColumn("_one", F.lit(1)), order, ["_one"])
    at = F.col("_one_all") - F.col("_one_to")
    wanted = F.array(*[F.floor(F.lit(i) * (F.col("_one_all") - 1) / (picks - 1)) for i in range(picks)])
    return ranked.where(F.array_contains(wanted, at)).select(*curve.columns)


def select_threshold(df: DataFrame, score: str, correct: str) -> DataFrame:
    """(threshold, useful, false_answers): of 0 and the midpoints of neighbouring distinct scores the first with the largest useful - false; a row is answered above it."""
    d = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(correct)).alias("u"), F.count_if(~F.col(correct)).alias("f"))
    zero = d.sparkSession.range(1).select(F.lit(0.0).alias("s"), F.lit(0).cast("bigint").alias("u"), F.lit(0).cast("bigint").alias("f"))
    d = d.unionByName(zero).groupBy("s").agg(F.sum("u").alias("u"), F.sum("f").alias("f"))
    r = running(d.withColumn("i", F.lit(1)), "s", ["u", "f", "i"])
    after = r.select((F.col("i_to") - 1).alias("i_to"), F.col("s").alias("next"))
    cut = r.join(after, "i_to").select(((F.col("s") + F.col("next")) / 2).alias("threshold"), (F.col("u_all") - F.col("u_to")).alias("useful"), (F.col("f_all") - F.col("f_to")).alias("false_answers"))
    at0 = df.agg(F.lit(0.0).alias("threshold"), F.count_if((F.col(score) > 0) & F.col(correct)).alias("useful"), F.count_if((F.col(score) > 0) & ~F.col(correct)).alias("false_answers"))
    return cut.unionByName(at0).orderBy((F.col("useful") - F.col("false_answers")).desc(), "threshold").limit(1)


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, observed, expected, kappa) of two label columns; null where chance agreement is complete."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")).agg(F.count("*").alias("c"))
    side = both.select(F.col("x").alias("v"), F.col("c").alias("l"), F.lit(0).alias("r")).unionAll(both.select("y", F.lit(0), "c")).groupBy("v").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    e = side.agg((F.sum(F.col("l").cast("double") * F.col("r")) / F.pow(F.sum("l"), F.lit(2))).alias("expected"))
    o = both.agg(F.sum("c").alias("n"), (F.sum(F.when(F.col("x") == F.col("y"), F.col("c")).otherwise(0)) / F.sum("c")).alias("observed"))
    return o.crossJoin(e).select("n", "observed", "expected", F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))).alias("kappa"))


def _draws(n: int, times: int, seed: int):
    """`times` arrays of n draws below n, as Python's Random(seed).randrange(n) gives them one after the other: the leading bits of its 32-bit words, words that aren't below n passed over."""
    _, (*key, at), _ = random.Random(seed).getstate()
    words = np.random.MT19937()
    words.state = {"bit_generator": "MT19937", "state": {"key": np.array(key, np.uint32), "pos": at}}
    held, have, shift = [], 0, np.uint64(32 - n.bit_length())
    for _ in range(times):
        while have < n:
            r = words.random_raw(max(n, 1 << 14)) >> shift
            held.append(r[r < n].astype(np.int64))
            have += len(held[-1])
        every = np.concatenate(held)
        yield every[:n]
        held, have = [every[n:]], len(every) - n


def bootstrap_mean(df: DataFrame, by: str, value: str, order: str, resamples: int = 2000, seed: int = 0) -> DataFrame:
    """(by, mean, low, high): percentile interval of resampled means with Python's generator (one randrange a draw), values in the order of `order`; one group a task, whose draws are made a resample at a time."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order, kind="stable")[value].to_numpy(float)
        n = len(v)
        means = sorted(sum(v[at].tolist()) / n for at in _draws(n, resamples, seed))
        return pd.DataFrame({by: [pdf[by].iloc[0]], "mean": [sum(v.tolist()) / n], "low": [means[int(0.025 * resamples)]], "high": [means[int(0.975 * resamples) - 1]]})

    kind = dict(df.dtypes)[by]
    return df.select(*dict.fromkeys([by, value, order])).where(F.col(value).isNotNull()).groupBy(by).applyInPandas(one, f"{by} {kind}, mean double, low double, high double")


def bootstrap_poisson(df: DataFrame, by: str, value: str, key: str, resamples: int = 500) -> DataFrame:
    """(by, mean, low, high) for groups of any size: each row has a Poisson(1) weight in every resample, from a hash of its key; tasks add up weighted sums, so a shuffle carries `resamples` rows a group and task."""
    kind = dict(df.dtypes)[by]
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])

    def add(batches):
        for b in batches:
            h = b["h"].to_numpy().astype(np.uint64)[:, None] + np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            w = np.searchsorted(steps, (h >> np.uint64(11)) / float(1 << 53)).astype(float)
            for g, at in b.groupby(by, dropna=False).indices.items():
                v = b[value].to_numpy()[at]
                yield pd.DataFrame({by: g, "r": np.arange(resamples), "w": w[at].sum(axis=0), "s": v @ w[at]})

    sums = df.where(F.col(value).isNotNull()).select(by, value, F.xxhash64(key).alias("h")).mapInPandas(add, f"{by} {kind}, r int, w double, s double").groupBy(by, "r").agg((F.sum("s") / F.sum("w")).alias("m"))
    bounds = sums.groupBy(by).agg(F.expr("percentile(m, 0.025)").alias("low"), F.expr("percentile(m, 0.975)").alias("high"))
    return df.groupBy(by).agg(F.avg(value).alias("mean")).join(bounds, by).select(by, "mean", "low", "high")


def latency(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, p50, p90, most): nearest-rank percentiles."""
    return df.where(F.col(value).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.expr(f"percentile_disc(0.5) within group (order by {value})").alias("p50"), F.expr(f"percentile_disc(0.9) within group (order by {value})").alias("p90"), F.max(value).alias("most"))


def pool(rankings: list[tuple[str, DataFrame]], depth: int) -> DataFrame:
    """(query_id, id, methods): union of the best `depth` of all systems with the systems that found each."""
    every = None
    for name, r in rankings:
        one = r.where(F.col("rank") <= depth).select("query_id", "id", F.lit(name).alias("m"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("query_id", "id").agg(F.array_join(F.array_sort(F.collect_set("m")), ",").alias("methods"))


def abstention(df: DataFrame, score: str, correct: str, thresholds: list[float]) -> DataFrame:
    """(threshold, answered, useful, false_answers) with strict comparison, one pass for all thresholds."""
    one = df.select(F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), (F.col(score) > t).alias("answered")) for t in thresholds])).alias("t"), F.col(correct).alias("ok"))
    return one.groupBy("t.threshold").agg(F.count_if("t.answered").alias("answered"), F.count_if(F.col("t.answered") & F.col("ok")).alias("useful"), F.count_if(F.col("t.answered") & ~F.col("ok")).alias("false_answers"))
