"""``spark.readStream.format("batch_log")``: replays committed batches and goes on with new ones.

The offset is the next sequence, a partition is a run of batches of about ``PARTITION_BYTES``, or one larger batch; of a
group, a chunk, whose entries the task reads. A
micro-batch may hold several batches, so rows carry ``seq``, and consumers that must not repeat work after a failure keep
the last ``seq`` they have finished. Rows of a batch come in no set order; ``ord`` has it. Number, bytes and checksum of every
batch are compared with what was committed, and its task fails if they differ. Empty batches move the offset and have no rows.
Options: ``path``, ``start`` (the first sequence, 1 by default).
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import xxhash
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from rillstone.sources.log import local_path
from rillstone.sources.manifest import FIRST_SEQUENCE, Chunk, CorruptSegmentError, Entry, Group, Manifest, read_chunk

SCHEMA = "seq bigint, ord int, record binary"
_ARROW = pa.schema([("seq", pa.int64()), ("ord", pa.int32()), ("record", pa.binary())])
PARTITION_BYTES = 16 << 20


class BatchesPartition(InputPartition):
    def __init__(self, folder: str, entries: list[Entry]):
        self.folder, self.entries = folder, entries

    def load(self) -> list[Entry]:
        return self.entries


class ChunkPartition(InputPartition):
    """A chunk of a group; its task reads its entries."""

    def __init__(self, folder: str, group: Group, chunk: Chunk, start: int, end: int | None):
        self.folder, self.where, self.chunk, self.start, self.end = folder, (group.entries, group.path), chunk, start, end

    def load(self) -> list[Entry]:
        return [e for e in read_chunk(Path(self.folder), *self.where, self.chunk) if e.seq >= self.start and (self.end is None or e.seq < self.end)]


def _hashes(ords: list[int], records: list[bytes]) -> np.ndarray:
    """Spark's xxhash64(ord, record) of each."""
    digest = xxhash.xxh64_intdigest
    seeds = {o: digest(o.to_bytes(4, "little", signed=True), 42) for o in set(ords)}
    return np.array([digest(r, seeds[o]) for o, r in zip(ords, records, strict=True)], np.uint64)


def _read(partition: BatchesPartition | ChunkPartition) -> Iterator[pa.RecordBatch]:
    entries = partition.load()
    for path in sorted({e.path for e in entries}):
        own = sorted((e for e in entries if e.path == path), key=lambda e: e.batch)
        keys, seqs = np.array([e.batch for e in own], np.int64), np.array([e.seq for e in own], np.int64)
        found = np.zeros((3, len(own)), np.uint64)  # number, bytes, checksum modulo 2**64
        within = (ds.field("batch") >= int(keys[0])) & (ds.field("batch") <= int(keys[-1]))
        try:
            data = ds.dataset(str(Path(partition.folder, path)), format="parquet", partitioning=None)
            for part in data.scanner(columns=["batch", "ord", "record"], filter=within, batch_size=10_000).to_batches():
                batch = part.column("batch").to_numpy(zero_copy_only=False)
                at = np.searchsorted(keys, batch)
                if not (wanted := keys[at] == batch).all():
                    part, at = part.filter(pa.array(wanted)), at[wanted]
                lengths = pc.binary_length(part.column("record")).to_numpy(zero_copy_only=False).astype(np.uint64)
                for row, add in zip(found, (np.uint64(1), lengths, _hashes(part.column("ord").to_pylist(), part.column("record").to_pylist())), strict=True):
                    np.add.at(row, at, add)
                yield pa.RecordBatch.from_arrays([pa.array(seqs[at]), part.column("ord"), part.column("record")], schema=_ARROW)
        except (OSError, ValueError, KeyError) as e:
            raise CorruptSegmentError(f"data from sequence {entries[0].seq} on can't be read: {e}") from None
        for e, facts in zip(own, found.T.tolist(), strict=True):
            if facts != [e.n_records, e.n_bytes, e.checksum]:
                raise CorruptSegmentError(f"data of sequence {e.seq} differs from what was committed")


def _partitions(folder: Path, start: int, end: int | None) -> list[BatchesPartition | ChunkPartition]:
    out, size = [], 0
    for part in Manifest(folder / "_commits").parts(start, end):
        if isinstance(part, Group):
            out += [ChunkPartition(str(folder), part, c, start, end) for c in part.chunks]
            continue
        for e in part:
            if not e.n_records:
                continue
            if not out or isinstance(out[-1], ChunkPartition) or size + e.n_bytes > PARTITION_BYTES:
                out.append(BatchesPartition(str(folder), []))
                size = 0
            out[-1].entries.append(e)
            size += e.n_bytes
    return out


class LogReader(DataSourceReader):
    def __init__(self, folder: Path, start: int):
        self.folder, self.start = folder, start

    def partitions(self) -> list[BatchesPartition | ChunkPartition]:
        return _partitions(self.folder, self.start, None) or [BatchesPartition("", [])]

    def read(self, partition: BatchesPartition | ChunkPartition) -> Iterator[pa.RecordBatch]:
        yield from _read(partition)


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, folder: Path, start: int):
        self.folder, self.start = folder, start

    def initialOffset(self) -> dict:
        return {"next": self.start}

    def latestOffset(self) -> dict:
        last = Manifest(self.folder / "_commits").last()
        return {"next": max(self.start, last.seq + 1 if last else FIRST_SEQUENCE)}

    def partitions(self, start: dict, end: dict) -> list[BatchesPartition | ChunkPartition]:
        return _partitions(self.folder, start["next"], end["next"])

    def read(self, partition: BatchesPartition | ChunkPartition) -> Iterator[pa.RecordBatch]:
        yield from _read(partition)

    def commit(self, end: dict) -> None:
        """Nothing to do: what is committed stays."""


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "batch_log"

    def schema(self) -> str:
        return SCHEMA

    def _given(self) -> tuple[Path, int]:
        return local_path(self.options["path"]), int(self.options.get("start", FIRST_SEQUENCE))

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(*self._given())

    def streamReader(self, schema: StructType) -> LogStreamReader:
        return LogStreamReader(*self._given())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogSource)
