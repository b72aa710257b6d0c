"""Incremental synchronisation of an index store: hashes, differences, history, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def document_hashes(chunks: DataFrame) -> DataFrame:
    """(doc, chunks, content_hash) of (doc, id, text): the hash of the chunk hashes in id order."""
    h = chunks.select("doc", "id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return h.groupBy("doc").agg(F.count("*").alias("chunks"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "h"))), lambda x: x["h"]), ""), 256).alias("content_hash"))


def corpus_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc, status): added, changed, removed or unchanged between two tables of (doc, content_hash)."""
    j = old.select("doc", F.col("content_hash").alias("o")).join(new.select("doc", F.col("content_hash").alias("n")), "doc", "full_outer")
    return j.select("doc", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") == F.col("n"), "unchanged").otherwise("changed").alias("status"))


def sync(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store (doc, content_hash, version, status) after a sync: changed and removed versions retire, added and changed documents get a new active version, history stays."""
    active = store.where("status = 'active'").select("doc", "content_hash")
    diff = corpus_diff(active, new)
    last = store.groupBy("doc").agg(F.max("version").alias("last"))
    old = store.join(diff.withColumnRenamed("status", "d"), "doc", "left").withColumn("status", F.when((F.col("status") == "active") & F.col("d").isin("changed", "removed"), "retired").otherwise(F.col("status"))).drop("d")
    fresh = new.join(diff.where("status in ('added', 'changed')"), "doc", "left_semi").join(last, "doc", "left")
    fresh = fresh.select("doc", "content_hash", (F.coalesce("last", F.lit(0)) + 1).alias("version"), F.lit("active").alias("status"))
    return old.select("doc", "content_hash", "version", "status").unionByName(fresh)


def uncovered(store_ids: DataFrame, corpus_ids: DataFrame) -> DataFrame:
    """Corpus ids that the store lacks."""
    return corpus_ids.select("id").join(store_ids.select("id"), "id", "left_anti").distinct()


def backfill(rows: DataFrame, parsed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows whose empty or null fields are filled from the parsed table; for each field a flag whether it was filled."""
    other = parsed.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    j = rows.join(other, key, "left")
    empty = {f: F.coalesce(F.trim(F.col(f)), F.lit("")) == "" for f in fields}
    return j.select(key, *[F.coalesce(F.when(~empty[f], F.col(f)), F.col(f"_{f}")).alias(f) for f in fields], *[(empty[f] & (F.coalesce(F.trim(F.col(f"_{f}")), F.lit("")) != "")).alias(f"filled_{f}") for f in fields])


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row with the largest order of each key."""
    rest = [c for c in df.columns if c not in key]
    m = df.groupBy(*key).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("m"))
    return m.select(*key, *[F.col("m")[c].alias(c) for c in rest])
