"""Session helpers: local sessions for tests, and staged tables that survive the loss of executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN_DIR: dict[str, str] = {}
_CLEANED: set[str] = set()


def local_session(cores: int | str = 8, shuffle: int = 8) -> SparkSession:
    """A local session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one only where the setting is absent (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    return _OWN_DIR[app]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _delete_all(spark: SparkSession, path: str) -> None:
    try:
        if not spark.sparkContext._jsc.sc().isStopped():
            _delete(spark, path)
    except Exception:  # the session is gone; what is left belongs to whoever cleans the shared folder
        pass


def own_dir(spark: SparkSession) -> str:
    """The folder of this application's staged tables, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/quillspark-{spark.sparkContext.applicationId}"
    if path not in _CLEANED:
        _CLEANED.add(path)
        atexit.register(_delete_all, spark, path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and returns the table, so that its lineage is cut and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # what was shuffled for the table isn't read again: its files go at once, not when the driver happens to collect garbage
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes staged tables that no later query reads, as those of earlier rounds of a loop."""
    for t in tables:
        if path := getattr(t, "_staged", None):
            _delete(t.sparkSession, path)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: tables of one small file would run in one task. Larger inputs pass without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df
