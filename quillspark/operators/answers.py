"""Measures of answers, citations and routing, and the small operators that prepare evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.metrics import ratio


def outcome(answered: Column, cited: Column, gold: Column) -> Column:
    """correct, wrong, refused, false_answer or correct_refusal of an answer with cited and gold ids; a null decision is invalid."""
    has = F.size(F.coalesce(gold, F.array().cast("array<string>"))) > 0
    return (
        F.when(answered.isNull(), "invalid").when(~answered & has, "refused").when(~answered, "correct_refusal").when(~has, "false_answer")
        .when(F.arrays_overlap(F.coalesce(cited, F.array().cast("array<string>")), gold), "correct").otherwise("wrong")
    )


def answer_f1(df: DataFrame, by: list[str], column: str = "outcome") -> DataFrame:
    """(by, n, precision, recall, f1): precision over given answers, recall over answerable questions; null where undefined."""
    o = F.col(column)
    c = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(o == "correct").alias("c"), F.count_if(o.isin("correct", "wrong", "false_answer")).alias("given"), F.count_if(o.isin("correct", "wrong", "refused")).alias("due"))
    p, r = ratio(F.col("c"), F.col("given")), ratio(F.col("c"), F.col("due"))
    return c.select(*by, "n", p.alias("precision"), r.alias("recall"), F.when((p + r) > 0, 2 * p * r / (p + r)).alias("f1"))


def citation_scores(df: DataFrame, together: str, alone: str) -> DataFrame:
    """Adds citation recall (the statement follows from all its citations) and precision (share of citations that support it on their own, or are needed)."""
    ok = F.filter(F.col(alone), lambda x: x)
    return df.withColumn("citation_recall", F.col(together).cast("int")).withColumn("citation_precision", F.when(F.size(alone) > 0, F.when(F.col(together), F.size(ok) / F.size(alone)).otherwise(F.lit(0.0))))


def context_precision(ranked: DataFrame) -> DataFrame:
    """(query_id, context_precision) of (query_id, rank, relevant): mean of precision at the relevant ranks."""
    w = Window.partitionBy("query_id").orderBy("rank")
    at = ranked.withColumn("p", F.sum(F.col("relevant").cast("int")).over(w) / F.row_number().over(w)).where("relevant")
    return ranked.select("query_id").distinct().join(at.groupBy("query_id").agg(F.avg("p").alias("c")), "query_id", "left").select("query_id", F.coalesce("c", F.lit(0.0)).alias("context_precision"))


def confusion(df: DataFrame, true: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(true).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def stratified(df: DataFrame, key: str, stratum: str, size: int) -> DataFrame:
    """(key, stratum): `size` rows in proportion to the strata (floors, then largest remainders), in each the rows of smallest SHA-1."""
    n = df.groupBy(stratum).agg(F.count("*").alias("c"))
    whole = n.agg(F.sum("c").alias("all"))
    quota = n.crossJoin(F.broadcast(whole)).withColumn("want", F.lit(size) * F.col("c") / F.col("all")).withColumn("base", F.floor("want"))
    left = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy((F.col("want") - F.col("base")).desc(), stratum))
    quota = quota.withColumn("take", F.col("base") + (rank <= size - F.sum("base").over(left)).cast("int"))
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(F.sha1(key), key)))
    return ranked.join(quota.select(stratum, "take"), stratum).where("_r <= take").select(key, stratum)


def hash_order(df: DataFrame, key: str, first: int) -> DataFrame:
    """The first rows by (SHA-1 of the key, key): a sample that needs no generator."""
    return df.orderBy(F.sha1(key), key).limit(first)


def change_number(c: Column) -> Column:
    """The first whole number n of a sentence becomes 2 n + 1."""
    n = F.regexp_extract(c, "([0-9]{1,9})", 1)
    changed = F.concat(F.regexp_extract(c, "^([^0-9]*)", 1), (2 * F.nullif(n, F.lit("")).cast("bigint") + 1).cast("string"), F.regexp_replace(c, "^[^0-9]*[0-9]{1,9}", ""))
    return F.when(n == "", c).otherwise(changed)


def numbers_supported(claim: Column, source: Column) -> Column:
    """Whether every number of the claim stands in the source."""
    return F.forall(F.regexp_extract_all(claim, F.lit("([0-9]+(?:[.][0-9]+)?)"), F.lit(1)), lambda x: F.contains(source, x))


def row_text(header: Column, row: Column) -> Column:
    """A table row as "name：cell；..."; blank cells are skipped, missing names are 列N."""
    named = F.transform(row, lambda x, i: F.when(F.trim(x) == "", F.lit(None).cast("string")).otherwise(F.concat(F.coalesce(F.get(header, i), F.concat(F.lit("列"), (i + 1).cast("string"))), F.lit("："), x)))
    return F.array_join(F.filter(named, lambda x: x.isNotNull()), "；")


def section_paths(df: DataFrame, doc: str, order: str, level: str, title: str) -> DataFrame:
    """Adds path: titles of the enclosing headings, by the nearest earlier heading of each smaller level that no heading of the same or smaller level closes."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = F.struct(F.col(order).alias("o"), F.col(level).alias("l"), F.col(title).alias("t"))
    opened = F.collect_list(own).over(w)
    # from the last heading backwards, each one of a level below all taken so far
    path = F.aggregate(F.reverse(opened), F.struct(F.lit(99).alias("l"), F.array().cast("array<string>").alias("p")), lambda a, x: F.when(x["l"] < a["l"], F.struct(x["l"].alias("l"), F.array_append(a["p"], x["t"]).alias("p"))).otherwise(a), lambda a: F.reverse(a["p"]))
    return df.withColumn("path", path)


def safe_url(c: Column) -> Column:
    return c.rlike(r"^https?://[^/\s]+")


def truncated(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("[TRUNCATED:"), F.length(c).cast("string"), F.lit("]"))).otherwise(c)
