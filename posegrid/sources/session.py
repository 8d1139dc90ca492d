"""Settings that a session must have for iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_KEY = "spark.checkpoint.dir"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where driver and tasks are one process."""
    named = spark.sparkContext.getConf().get(_KEY) or spark.conf.get(_KEY, None)
    if not named:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set(_KEY, named)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named
