"""The shared folder for tables that a job writes between its steps."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
#: Spark removes the shuffle files of an action when it has ended: what it wrote needs them no more.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that a task hands to Python at a time, where the session has Spark's own number: rows are whole texts here.
BATCH, USUAL, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names; a temporary one only where driver and tasks are one process."""
    found = spark.sparkContext.getConf().get(KEY) or spark.conf.get(KEY, None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError(f"set {KEY} to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set(KEY, found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, which cuts their lineage."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(CLEAN)
    if spark.conf.get(BATCH) == USUAL:
        spark.conf.set(BATCH, ROWS)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for t in tables:
        path = _PATHS.pop(t, None)
        if path:
            jvm = t.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
