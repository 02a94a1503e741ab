"""Queries over a batch log made of ``events``, and the SQL they are held against.

Every query publishes a log to a folder of its own and reads it back. 100 events are a batch, committed in ascending order.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.session import shared_dir
from rillstone.sources.log import Batch, Log, Options, local_path
from rillstone.sources.manifest import LogError
from rillstone.streaming.log_stream import register

PER_BATCH = 100
SEGMENT_BYTES = 4096


def _folder(spark: SparkSession) -> str:
    """A new folder that executors and the driver share; the manifest needs a file system that the driver can open."""
    shared = local_path(shared_dir(spark))
    shared.mkdir(parents=True, exist_ok=True)
    return tempfile.mkdtemp(prefix="log-", dir=shared)


def published(spark: SparkSession, sf_dir: str, committed: Callable[[Column], Column] = lambda batch: F.lit(True), sync: bool = False) -> Log:
    """A log of ``events``, staged and committed as a group; batches that ``committed`` refuses stay staged."""
    log = Log.open(spark, _folder(spark), Options(SEGMENT_BYTES, sync))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select((F.floor(F.col("event_id") / PER_BATCH) + 1).alias("batch"), (F.col("event_id") % PER_BATCH).cast("int").alias("ord"), F.encode("props", "utf-8").alias("record"))
    log.commit_group(log.stage(rows), committed(F.col("batch")))
    return log


def _shown(rows: DataFrame) -> DataFrame:
    return rows.withColumn("record", F.decode("record", "utf-8"))


def scan_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(published(spark, sf_dir).scan(4))


def read_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(published(spark, sf_dir).read(3))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(spark, sf_dir).segments_frame()


def uncommitted_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(published(spark, sf_dir, lambda batch: batch % 2 == 0).scan())


def batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(spark, sf_dir).batches().select("seq", "n_records", "n_bytes")


def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log through Structured Streaming, written to Parquet and read."""
    log = published(spark, sf_dir)
    register(spark)
    out = _folder(spark)
    stream = spark.readStream.format("batch_log").option("path", str(log.folder)).option("start", 2).load()
    stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return _shown(spark.read.schema("seq long, ord int, record binary").parquet(f"{out}/rows"))


def stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = published(spark, sf_dir).stat()
    return spark.createDataFrame([(s["segments"], s["batches"], s["first_seq"], s["last_seq"])], "segments long, batches long, first_seq long, last_seq long")


def synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that is flushed before each commit returns, opened anew and read."""
    log = published(spark, sf_dir, sync=True)
    return _shown(Log.open(spark, str(log.folder), Options(SEGMENT_BYTES, sync=True)).scan(2))


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is raised in each case of a wrong call, and by data that was changed after its commit."""
    log = published(spark, sf_dir, lambda batch: batch <= 2)
    last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("event_id")).first()[0] // PER_BATCH + 1
    staged = log.append([b"once"])
    log.commit(staged)
    changed = log.append([b"good"])
    seq = log.commit(changed)
    spark.createDataFrame([(1, 0, bytearray(b"evil"))], "batch long, ord int, record binary").write.mode("overwrite").parquet(changed.path)
    cases = {
        "read uncommitted": lambda: log.read(last + 10),
        "read changed data": lambda: log.read(seq),
        "replay changed data": lambda: log.for_each(seq, lambda batch: None),
        "commit twice": lambda: log.commit(staged),
        "commit unknown": lambda: log.commit(Batch(log.log_id, "elsewhere", 0, 0, 0)),
        "commit to another log": lambda: Log.open(spark, _folder(spark), Options(SEGMENT_BYTES)).commit(log.append([b"a"])),
        "replay from beyond the end": lambda: log.for_each(seq + 1, lambda batch: None),
    }
    found = []
    for case, call in cases.items():
        try:
            call()
            found.append((case, "none"))
        except LogError as e:
            found.append((case, type(e).__name__.removesuffix("Error")))
    return spark.createDataFrame(found, "case string, error string")


QUERIES = {f.__name__: f for f in (scan_from, read_one, segments, uncommitted_hidden, batch_sizes, stream_replay, stat, synced, errors)}

_ROWS = f"SELECT event_id // {PER_BATCH} + 1 AS batch, CAST(event_id % {PER_BATCH} AS INTEGER) AS ord, props AS record FROM events"
_SIZES = f"SELECT batch AS seq, count(*) AS n_records, CAST(sum(octet_length(encode(record))) AS BIGINT) AS n_bytes FROM ({_ROWS}) GROUP BY batch"
_SEGMENTS = f"""
    WITH RECURSIVE sizes AS ({_SIZES}),
    rolled AS (
        SELECT seq, n_bytes AS filled, CAST(0 AS BIGINT) AS segment_id FROM sizes WHERE seq = 1
        UNION ALL
        SELECT s.seq, CASE WHEN r.filled + s.n_bytes <= {SEGMENT_BYTES} THEN r.filled + s.n_bytes ELSE s.n_bytes END,
               r.segment_id + CASE WHEN r.filled + s.n_bytes <= {SEGMENT_BYTES} THEN 0 ELSE 1 END
        FROM rolled r JOIN sizes s ON s.seq = r.seq + 1
    )
    SELECT segment_id, min(seq) AS first_seq, max(seq) AS last_seq FROM rolled GROUP BY segment_id
"""
ORACLE_SQL = {
    "scan_from": f"SELECT batch AS seq, ord, record FROM ({_ROWS}) WHERE batch >= 4",
    "read_one": f"SELECT ord, record FROM ({_ROWS}) WHERE batch = 3",
    "segments": _SEGMENTS,
    "uncommitted_hidden": f"SELECT batch // 2 AS seq, ord, record FROM ({_ROWS}) WHERE batch % 2 = 0",
    "batch_sizes": _SIZES,
    "synced": f"SELECT batch AS seq, ord, record FROM ({_ROWS}) WHERE batch >= 2",
    "errors": """
        SELECT * FROM (VALUES ('read uncommitted', 'NotCommitted'), ('read changed data', 'CorruptSegment'), ('replay changed data', 'CorruptSegment'), ('commit twice', 'UnknownBatch'),
            ('commit unknown', 'UnknownBatch'), ('commit to another log', 'UnknownBatch'), ('replay from beyond the end', 'none')) AS t("case", error)
    """,
    "stream_replay": f"SELECT batch AS seq, ord, record FROM ({_ROWS}) WHERE batch >= 2",
    "stat": f"SELECT count(*) AS segments, (SELECT count(*) FROM ({_SIZES})) AS batches, min(first_seq) AS first_seq, max(last_seq) AS last_seq FROM ({_SEGMENTS})",
}
