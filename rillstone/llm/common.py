"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillstone.session import checkpointed, shared_dir

__all__ = ["checkpointed", "documents", "ranked", "shared_dir", "small", "text_batches"]


BROADCAST_STARTS = 100_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ranked(df: DataFrame, group: str, key: Column, out: str, salts: int = 1024, salt: Column | None = None) -> DataFrame:
    """Adds ``out``, a number from 0 without gaps for each row of a group, in an order that ``key`` fixes.

    A group may hold most of the rows: rows are numbered within (group, salt) and the counts of lower salts are added. The salt is
    a hash of ``key``; a ``salt`` that ascends with ``key``, such as the number of a file, makes the order that of ``key`` itself. Null groups are a group. The starts of the salts are broadcast
    up to ``BROADCAST_STARTS`` rows and joined by shuffle beyond that.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int") if salt is None else salt)
    before = Window.partitionBy(group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy(group, "_salt").agg(F.count("*").alias("_n"))
    starts = starts.select(F.col(group).alias("_g"), F.col("_salt").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(group, "_salt").orderBy(key)
    numbered = salted.withColumn("_row", F.row_number().over(within))
    joined = numbered.join(F.broadcast(starts) if small(starts, BROADCAST_STARTS) else starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_salt") == F.col("_s")))
    return joined.withColumn(out, F.col("_start") + F.col("_row") - 1).drop("_salt", "_g", "_s", "_start", "_row")


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Sends whole texts to Python workers in Arrow batches of so many rows, unless the session has a setting of its own; 10,000 texts at a time would cost each worker hundreds of MB."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most so many rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows
