"""What every module needs from the Spark session."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary folder of this machine where that is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="rillstone-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, computed once and written to the shared folder, so that later jobs neither recompute it nor depend on an executor."""
    shared_dir(df.sparkSession)
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
