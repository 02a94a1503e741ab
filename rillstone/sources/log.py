"""A single-writer, append-only batch log on Spark: stage a batch, commit it, read it, replay from a sequence.

Record data is Parquet that executors write and read, sorted by batch and place; what is committed is decided by the manifest
alone, so staged and abandoned data stays invisible. A commit costs the same however long the log is. A scan that checks sums up the
data with map-side partial sums beside reading it, in the same job: a batch with most of the rows is never gathered. Records are opaque bytes. There is no update, delete, compaction or replication.

``append_all`` and ``commit_all`` keep a handle and an entry for each batch on the driver. ``stage`` and ``commit_group`` are for any number of
batches: Spark counts, numbers and rolls them into segments, and the driver holds the chunks' starts and one chunk's summary.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .manifest import COLUMNS, FIRST_SEQUENCE, FORMAT, Chunk, CorruptSegmentError, Entry, Group, LogError, Manifest, NotCommittedError, UnknownBatchError, read_chunk, sync_tree

DATA = "batch long, ord int, record binary"
DIFFERS = "differs from what was committed"
SPARK_ERRORS = (PySparkException, Py4JJavaError)
#: Payload bytes, records and batches of a chunk, about, and the most chunks of a group.
CHUNK_BYTES, CHUNK_RECORDS, CHUNK_BATCHES, MAX_CHUNKS = 16 << 20, 1_000_000, 20_000, 10_000
#: Entries that a scan broadcasts to pick rows out; more are joined by shuffle.
BROADCAST_ENTRIES = 10_000


@dataclass(frozen=True)
class Options:
    """segment_bytes: payload bytes at which a segment is full; a batch that would exceed it begins the next one, a larger batch gets one of its own. sync: flush data and manifest before a commit returns."""

    segment_bytes: int
    sync: bool = False

    def __post_init__(self):
        if self.segment_bytes <= 0:
            raise ValueError("segment_bytes must be positive")


@dataclass(frozen=True)
class Segment:
    segment_id: int
    first_seq: int
    last_seq: int


@dataclass(frozen=True)
class Batch:
    """A staged batch, or in a scan a committed one with its sequence and records."""

    log_id: str
    path: str
    n_records: int
    n_bytes: int
    checksum: int
    seq: int | None = None
    records: tuple[bytes, ...] = ()
    key: int = 1


@dataclass(frozen=True)
class StagedGroup:
    """Batches staged together, for ``commit_group``."""

    log_id: str
    path: str


def _facts() -> dict:
    """What the manifest keeps of a batch's rows; the checksum is a sum modulo 2**64 of hashes of place and content."""
    sums = {"n": F.count("*"), "size": F.sum(F.octet_length("record")), "sum": F.sum(F.xxhash64("ord", "record").cast("decimal(20,0)"))}
    return sums | {"nulls": F.count_if(F.col("record").isNull() | F.col("ord").isNull())}


def _checksum(total) -> int:
    return int(total) % (1 << 64)


def _rolls(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes before each batch and in all, and for a segment that begins at a batch where the next one does."""
    before = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    fits = np.searchsorted(before, before[:-1] + limit, "right") - 1
    return before, np.maximum(fits, np.arange(1, len(sizes) + 1))


def _summary(chunk: pd.DataFrame, limit: int) -> tuple:
    """n, bytes, and lists of what may come of the chunk: for bytes that the open segment takes of it (first of all: it takes no batch
    at all) the segments that begin, where the last of them does, and its bytes. As many as there are batches in the first ``limit`` bytes, at most."""
    sizes = chunk.sort_values("batch")["n_bytes"].to_numpy(np.int64)
    before, rolls = _rolls(sizes, limit)
    n, rolls = len(sizes), rolls.tolist()
    begun, last = [0] * (n + 1), list(range(n + 1))
    for i in range(n - 1, -1, -1):
        j = rolls[i]
        begun[i], last[i] = 1 + begun[j], i if j == n else last[j]
    taken = np.flatnonzero((before <= limit) & np.append(before[1:] > before[:-1], True))  # the last of those with as many bytes before them
    at = [0, *taken.tolist()]
    return n, int(before[n]), before[at].tolist(), [begun[i] for i in at], [last[i] for i in at], [int(before[n] - before[last[i]]) for i in at]


def _numbered(chunk: pd.DataFrame, limit: int, seq: int, segment: int, fill: int | None, first: int) -> pd.DataFrame:
    """The entries of a chunk, given its first sequence and the segment that is open before it."""
    chunk = chunk.sort_values("batch", ignore_index=True)
    before, rolls = _rolls(chunk["n_bytes"].to_numpy(np.int64), limit)
    n, rolls = len(chunk), rolls.tolist()
    at = 0 if fill is None or fill > limit else int(np.searchsorted(before, limit - fill, "right")) - 1
    begins = []
    while at < n:
        begins.append(at)
        at = rolls[at]
    of = np.searchsorted(begins, np.arange(n), "right") if begins else np.zeros(n, np.int64)
    start = np.array([0, *begins], np.int64)[of]
    chunk["seq"], chunk["segment_id"] = seq + np.arange(n), segment + of
    chunk["segment_bytes"] = before[1:] - before[start] + np.where(of == 0, fill or 0, 0)
    chunk["segment_first"] = np.where(of == 0, first, seq + start)
    return chunk


def local_path(url: str) -> Path:
    """The path of a plain path or a ``file:`` URL; the manifest needs a file system that the driver can open and that can link."""
    parsed = urlparse(url)
    if parsed.scheme not in ("", "file"):
        raise LogError(f"{url}: only file systems that the driver can open can hold a log")
    return Path(parsed.path)


class Log:
    """``Log.open(spark, folder, options)``; one writer at a time."""

    def __init__(self, spark: SparkSession, folder: Path, options: Options):
        self.spark, self.folder, self.options = spark, folder, options
        self.manifest = Manifest(folder / "_commits")
        self.log_id = uuid.uuid4().hex
        self._staged: set[tuple[str, int]] = set()
        self._groups: dict[str, list[str]] = {}  # staged groups, each with the folders of entries that were committed of it
        self._last = self.manifest.last()

    @classmethod
    def open(cls, spark: SparkSession, folder: str, options: Options) -> Log:
        """Opens the log in ``folder``, and creates it if there is none. Batches staged before are no longer known."""
        root = local_path(folder)
        (root / "data").mkdir(parents=True, exist_ok=True)
        head = root / "_log.json"
        if head.exists():
            if json.loads(head.read_text()).get("format") != FORMAT:
                raise LogError(f"{folder} has another format")
        else:
            head.write_text(json.dumps({"format": FORMAT}))
        return cls(spark, root, options)

    # writing

    def append(self, records: Iterable[bytes]) -> Batch:
        """Stages a batch of this order. Records must be bytes; empty ones and empty batches are allowed."""
        rows = []
        for i, r in enumerate(records):
            if not isinstance(r, bytes | bytearray):
                raise TypeError(f"record {i} is {type(r).__name__}, not bytes")
            rows.append((1, i, bytearray(r)))
        if not rows:
            return self._stage(self._new_path(), 1, 0, 0, 0)
        return self.append_all(self.spark.createDataFrame(rows, DATA))[1]

    def _new_path(self) -> Path:
        return self.folder / "data" / uuid.uuid4().hex

    def _stage(self, path: Path, key: int, n: int, size: int, checksum: int) -> Batch:
        self._staged.add((str(path), key))
        return Batch(self.log_id, str(path), n, size, checksum, key=key)

    def append_all(self, rows: DataFrame) -> dict[int, Batch]:
        """Stages one batch for each value of ``batch`` in rows of (batch, ord, record), by one job; the handles by that value.

        The driver holds a handle for each batch. ``ord`` gives the order within a batch. Rows are dealt by ranges of batch and
        ord, so a batch with a large share of the rows is split over several tasks and files, and many small ones share a file.
        """
        target = self._new_path()
        facts = self._write(rows, target).collect()
        if any(f["nulls"] or f["batch"] is None for f in facts):
            raise ValueError("batch, ord and record must not be null")
        return {f["batch"]: self._stage(target, f["batch"], f["n"], f["size"], _checksum(f["sum"])) for f in facts}

    def _write(self, rows: DataFrame, target: Path) -> DataFrame:
        """Writes rows of (batch, ord, record) to ``target``; the facts of each batch, as read back."""
        rows = rows.select(F.col("batch").cast("long"), F.col("ord").cast("int"), F.col("record").cast("binary"))
        rows.repartitionByRange("batch", "ord").sortWithinPartitions("batch", "ord").write.parquet(str(target))
        return self.spark.read.schema(DATA).parquet(str(target)).groupBy("batch").agg(*[c.alias(k) for k, c in _facts().items()])

    def _side(self, path: str, name: str) -> str:
        return str(self.folder / "facts" / Path(path).name / name)

    def stage(self, rows: DataFrame) -> StagedGroup:
        """Stages one batch for each value of ``batch`` as ``append_all`` does, without anything of a batch on the driver."""
        target = self._new_path()
        facts = self._write(rows, target)
        kept = self._side(str(target), "batches")
        checksum = F.pmod("sum", F.lit(str(1 << 64)).cast("decimal(38,0)")).cast("decimal(20,0)")
        facts.select("batch", F.col("n").alias("n_records"), F.col("size").alias("n_bytes"), checksum.alias("checksum"), "nulls").write.parquet(kept)
        if not self.spark.read.parquet(kept).where("nulls > 0 or batch is null").isEmpty():
            raise ValueError("batch, ord and record must not be null")
        self._groups[str(target)] = []
        return StagedGroup(self.log_id, str(target))

    def commit_group(self, group: StagedGroup, where: Column | None = None) -> tuple[int, int] | None:
        """Commits the batches of a group in ascending order of ``batch``, all at once or none, and returns the first and last sequence, or
        None if there is no batch. With ``where``, on the column ``batch``, the others stay staged and may be committed later."""
        if group.log_id != self.log_id or group.path not in self._groups:
            raise UnknownBatchError(group.path)
        facts = self.spark.read.parquet(self._side(group.path, "batches")).drop("nulls")
        for done in self._groups[group.path]:
            facts = facts.join(self.spark.read.parquet(done).select("batch"), "batch", "left_anti")
        facts = facts if where is None else facts.where(where)
        n, size, records = facts.agg(F.count("*"), F.sum("n_bytes"), F.sum("n_records")).first()
        if not n:
            if where is None:
                del self._groups[group.path]
            return None
        chunks = min(MAX_CHUNKS, 1 + max(size // CHUNK_BYTES, records // CHUNK_RECORDS, n // CHUNK_BATCHES))
        name = uuid.uuid4().hex
        dealt = facts.repartitionByRange(chunks, "batch").select(F.spark_partition_id().alias("chunk"), "batch", "n_records", "n_bytes", F.col("checksum").cast("string").alias("checksum"))
        dealt.write.parquet(self._side(group.path, name))
        dealt = self.spark.read.parquet(self._side(group.path, name))
        starts, found = self._starts(dealt)
        target, limit = self.folder / "entries" / name, min(self.options.segment_bytes, 1 << 62)
        columns = "chunk int, batch long, n_records long, n_bytes long, checksum string, seq long, segment_id long, segment_bytes long, segment_first long"
        entries = dealt.groupBy("chunk").applyInPandas(lambda c: _numbered(c, limit, *starts[int(c["chunk"].iloc[0])]), columns)
        entries.withColumn("checksum", F.col("checksum").cast("decimal(20,0)")).write.partitionBy("chunk").parquet(str(target))
        own, path = str(target.relative_to(self.folder)), str(Path(group.path).relative_to(self.folder))
        last = read_chunk(self.folder, own, path, found[-1])[-1]
        if self.options.sync:
            for tree in (Path(group.path), target, self.folder / "_log.json"):
                sync_tree(tree)
        try:
            self.manifest.publish_group(Group(own, path, tuple(found), last), self.options.sync)
        except FileExistsError:
            raise LogError(f"another writer has committed sequence {found[0].first}") from None
        self._last = last
        if where is None:
            del self._groups[group.path]
        else:
            self._groups[group.path].append(str(target))
        return found[0].first, last.seq

    def _starts(self, dealt: DataFrame) -> tuple[dict[int, tuple], list[Chunk]]:
        """For each chunk its first sequence and the segment open before it: id, bytes (None: there is none), first sequence. Summaries come one at a time."""
        limit = min(self.options.segment_bytes, 1 << 62)
        kind = "chunk int, n long, size long, taken array<long>, begun array<long>, last array<long>, fill array<long>"
        lists = lambda c: pd.DataFrame([(int(c["chunk"].iloc[0]), *_summary(c, limit))], columns=["chunk", "n", "size", "taken", "begun", "last", "fill"])
        seq, segment, fill, first = FIRST_SEQUENCE, -1, None, FIRST_SEQUENCE
        if self._last:
            seq, segment, fill, first = self._last.seq + 1, self._last.segment_id, self._last.segment_bytes, self._last.segment_first
        starts, chunks = {}, []
        for s in dealt.groupBy("chunk").applyInPandas(lists, kind).orderBy("chunk").toLocalIterator():
            starts[s["chunk"]] = (seq, segment, fill, first)
            chunks.append(Chunk(s["chunk"], seq, seq + s["n"] - 1))
            at = 0 if fill is None or fill > limit else bisect_right(s["taken"], limit - fill, 1) - 1
            if s["begun"][at]:
                segment, fill, first = segment + s["begun"][at], s["fill"][at], seq + s["last"][at]
            else:
                fill += s["size"]
            seq += s["n"]
        return starts, chunks

    def commit(self, batch: Batch) -> int:
        """Makes a staged batch durable and visible, all of it or nothing, and returns its sequence."""
        return self.commit_all([batch])[0]

    def commit_all(self, batches: Iterable[Batch]) -> list[int]:
        """Commits in this order, all at once or none."""
        batches = list(batches)
        known = [(b.path, b.key) for b in batches]
        twice = len(set(known)) < len(known)
        for b, k in zip(batches, known, strict=True):
            if b.log_id != self.log_id or k not in self._staged or twice:
                raise UnknownBatchError(b.path)
        if not batches:
            return []
        if self.options.sync:
            for path in {b.path for b in batches if b.n_records}:
                sync_tree(Path(path))
            sync_tree(self.folder / "_log.json")
        last, entries = self._last, []
        for b in batches:
            seq = last.seq + 1 if last else FIRST_SEQUENCE
            if last and last.segment_bytes + b.n_bytes <= self.options.segment_bytes:
                segment, size, first = last.segment_id, last.segment_bytes + b.n_bytes, last.segment_first
            else:
                segment, size, first = last.segment_id + 1 if last else 0, b.n_bytes, seq
            last = Entry(seq, segment, str(Path(b.path).relative_to(self.folder)), b.key, b.n_records, b.n_bytes, b.checksum, size, first)
            entries.append(last)
        try:
            self.manifest.publish(entries, self.options.sync)
        except FileExistsError:
            raise LogError(f"another writer has committed sequence {entries[0].seq}") from None
        self._last = last
        self._staged.difference_update(known)
        return [e.seq for e in entries]

    # reading

    def _committed(self, parts: Iterable[list[Entry] | Group] | None = None) -> DataFrame:
        """The manifest, or these parts of it, as Spark reads it."""
        groups, singles = {}, 0
        for part in self.manifest.parts() if parts is None else parts:
            if isinstance(part, Group):
                groups.setdefault(part.path, []).append(str(self.folder / part.entries))
            else:
                singles += 1
        found = self.spark.read.schema(COLUMNS).json(str(self.folder / "_commits" / "*.json")).where("seq is not null") if singles else None
        for path, folders in groups.items():
            for folder in folders:
                rows = self.spark.read.schema(COLUMNS).parquet(folder).withColumn("path", F.lit(path)).drop("chunk")
                found = rows if found is None else found.unionByName(rows)
        return self.spark.createDataFrame([], COLUMNS) if found is None else found

    def _load(self, start: int, end: int, check: bool) -> DataFrame:
        """seq, ord, record of the batches with start <= seq < end. With ``check`` an action on it fails where data is not what was committed."""
        paths, n, only, parts = set(), 0, None, []
        if end == start + 1:
            only = self.manifest.entry(start)
            paths, n = {only.path} if only.n_records else set(), 1
        else:
            for part in self.manifest.parts(start, end):
                full = [e for e in part if e.n_records] if not isinstance(part, Group) else None
                n += len(full) if full is not None else part.chunks[-1].last - part.chunks[0].first + 1
                paths |= {e.path for e in full} if full is not None else {part.path}
                parts.append(part if full is None else [])
        if not paths:
            return self.spark.createDataFrame([], "seq long, ord int, record binary")
        try:
            rows = self.spark.read.schema(DATA).parquet(*sorted(str(self.folder / p) for p in paths))
        except SPARK_ERRORS as e:
            raise CorruptSegmentError(f"data can't be read: {str(e).splitlines()[0][:200]}") from e
        if only:
            batches = self.spark.createDataFrame([(only.seq, only.path, only.batch, only.n_records, only.n_bytes, str(only.checksum))], "seq long, path string, batch long, n_records long, n_bytes long, checksum string")
            rows = rows.where(F.col("batch") == only.batch)  # what Parquet's own statistics can prune
        else:
            batches = self._committed(parts).where((F.col("seq") >= start) & (F.col("seq") < end) & (F.col("n_records") > 0))
        batches = batches.select("seq", "path", "batch", "n_records", "n_bytes", F.col("checksum").cast("decimal(38,0)").alias("checksum"))
        keys = ["path", "batch"]
        if len(paths) == 1:
            keys, batches = ["batch"], batches.drop("path")
        else:
            rows = rows.withColumn("path", F.regexp_extract(F.col("_metadata.file_path"), r"(data/[^/]+)/[^/]*$", 1))
        # Parquet files say little of the size of their rows, so Spark is never left to choose a broadcast: the rows are joined by shuffle or stay where they are
        few = n <= BROADCAST_ENTRIES
        by = lambda x: F.broadcast(x) if few else x.hint("merge")
        if not check:
            return rows.join(by(batches), keys).select("seq", "ord", "record")
        own = rows.join(F.broadcast(batches.select(keys)), keys, "left_semi") if few else rows
        found = own.groupBy(keys).agg(*[c.alias(f"_{k}") for k, c in _facts().items()])
        same = (F.col("_n") == F.col("n_records")) & (F.col("_size") == F.col("n_bytes")) & (F.pmod("_sum", F.lit(str(1 << 64)).cast("decimal(38,0)")) == F.col("checksum"))
        judged = batches.join(found.hint("merge"), keys, "left").select(*keys, "seq", F.coalesce(same, F.lit(False)).alias("_same"))
        error = F.raise_error(F.concat(F.lit("data of sequence "), F.col("seq").cast("string"), F.lit(f" {DIFFERS}"))).cast("int")
        joined = rows.join(by(judged), keys).select("seq", F.when(F.col("_same"), F.col("ord")).otherwise(error).alias("ord"), "record")
        # a batch without any row left is in no join with rows
        return joined.unionByName(judged.where(~F.col("_same")).select("seq", error.alias("ord"), F.lit(None).cast("binary").alias("record")))

    @staticmethod
    def _refused(e: Exception) -> CorruptSegmentError:
        return CorruptSegmentError(next((line.strip()[:300] for line in str(e).splitlines() if DIFFERS in line), f"data can't be read: {str(e).splitlines()[0][:200]}"))

    def read(self, seq: int, check: bool = True) -> DataFrame:
        """ord and record of one committed batch, in order. With ``check`` its data is read and compared at once."""
        rows = self._load(seq, seq + 1, check).select("ord", "record")
        if check:
            try:
                rows.agg(F.count("ord")).collect()
            except SPARK_ERRORS as e:
                raise self._refused(e) from e
        return rows.orderBy("ord")

    def records(self, seq: int) -> list[bytes]:
        """The records of one committed batch."""
        return [bytes(r["record"]) for r in self.read(seq).toLocalIterator()]

    def scan(self, start: int = FIRST_SEQUENCE, check: bool = True) -> DataFrame:
        """seq, ord, record of the batches committed now from ``start`` on, sorted. Empty batches have no rows; see ``batches``.

        With ``check`` an action on it fails if the data is not what was committed; ``for_each`` raises CorruptSegmentError.
        """
        return self._load(start, self._end(start), check).orderBy("seq", "ord")

    def _end(self, start: int) -> int:
        """The sequence after the last one committed now, or ``start`` if that is greater."""
        last = self.manifest.last()
        return max(start, last.seq + 1 if last else FIRST_SEQUENCE)

    def for_each(self, start: int, fn: Callable[[Batch], None]) -> None:
        """Calls ``fn`` for every batch committed now from ``start`` on, in order; an error that it raises ends the scan. One batch is held at a time, and the entries of one chunk."""
        end = self._end(start)

        def checked() -> Iterator:
            try:
                yield from self._load(start, end, True).orderBy("seq", "ord").toLocalIterator()
            except SPARK_ERRORS as e:
                raise self._refused(e) from e

        rows = groupby(checked(), key=lambda r: r["seq"])
        at, own = next(rows, (None, iter(())))
        for e in self.manifest.entries(start, end):
            records: tuple[bytes, ...] = ()
            if at == e.seq:
                records = tuple(bytes(r["record"]) for r in own)
                at, own = next(rows, (None, iter(())))
            fn(Batch(self.log_id, str(self.folder / e.path), e.n_records, e.n_bytes, e.checksum, e.seq, records, e.batch))

    def batches(self) -> DataFrame:
        """seq, segment_id, n_records, n_bytes of every committed batch, empty ones too."""
        return self._committed().select("seq", "segment_id", "n_records", "n_bytes")

    def segments_frame(self) -> DataFrame:
        """segment_id, first_seq, last_seq."""
        return self._committed().groupBy("segment_id").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))

    def segments(self) -> list[Segment]:
        """Segments with their first and last sequence."""
        last = {e.segment_id: e for e in self.manifest.entries()}
        return [Segment(e.segment_id, e.segment_first, e.seq) for e in last.values()]

    def stat(self) -> dict[str, int | None]:
        """From the last entry alone: segments and sequences have no gaps."""
        last = self.manifest.last()
        return {"segments": last.segment_id + 1 if last else 0, "batches": last.seq - FIRST_SEQUENCE + 1 if last else 0, "first_seq": FIRST_SEQUENCE if last else None, "last_seq": last.seq if last else None}
