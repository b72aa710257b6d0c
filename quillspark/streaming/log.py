"""Structured Streaming over event logs: tails, deduplicated deliveries, windows, folds of a case's state.

Each function takes a streaming DataFrame and returns one; `drain` runs a stream to the end of what is there and returns the result as a table."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from quillspark.session import shared_dir


def tail(spark: SparkSession, path: str, name: str) -> DataFrame:
    """New rows of the Parquet table as they arrive, be it a folder of files or one file; the checkpoint of the sink is the resume cursor."""
    whole = f"{path}/{name}.parquet"
    schema = spark.read.parquet(whole).schema
    p = spark._jvm.org.apache.hadoop.fs.Path(whole)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return spark.readStream.schema(schema).parquet(whole)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(path)


def deduplicated(stream: DataFrame, key: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def windowed(stream: DataFrame, time: str, by: str, width: str = "1 hour", delay: str = "0 seconds") -> DataFrame:
    """(start, by, n) per tumbling window."""
    s = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return s.groupBy(F.window(time, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def folded(stream: DataFrame, case: str = "case_id", content: list[str] | None = None) -> DataFrame:
    """(case, status, steps) after each micro-batch: a stateful fold that keeps the last state (by id, however late rows arrive) and the number of transitions of a case.

    A transition delivered again (equal in `content`, by default all columns but the id) counts once: the state holds a hash of each transition of the case, which are few."""
    content = content or [c for c in stream.columns if c != "id"]

    def step(key, pdfs, state):
        last, status, seen = state.get if state.exists else (-1, None, [])
        known = set(seen)
        for p in pdfs:
            known.update(p["h"].tolist())
            top = p.loc[p["id"].idxmax()]
            if int(top["id"]) > last:
                last, status = int(top["id"]), top["to_status"]
        state.update((last, status, sorted(known)))
        yield pd.DataFrame({case: [key[0]], "status": [status], "steps": [len(known)]})

    t = stream.where("to_status is not null").select(case, "id", "to_status", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in content]).alias("h"))
    return t.groupBy(case).applyInPandasWithState(step, f"{case} string, status string, steps long", "last long, status string, seen array<long>", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream over all that is there and returns what it gave, from the shared folder."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/out/batch={n}")

    q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{at}/checkpoint").foreachBatch(keep).start()
    q.awaitTermination()
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/out")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{at}/out/*")
