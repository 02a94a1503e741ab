"""Token ids in shard files, with a minimal perfect hash from document keys to shard offsets.

Documents are range-partitioned by id, so shards hold consecutive ids in order, and every task writes one shard:

    magic | raw ids, little endian | sections of the index | contents (JSON) | length of the contents (8 bytes) | magic

The index has each row's key and its end in the payload, and for the distinct keys a minimal perfect
hash: on each level the keys that have a position of a bit array to themselves get a set bit there, the others go on to
the next level; a key's slot is the number of set bits before its own. Bits are kept in blocks of 512, each behind the number of
set bits before it. Every slot stores the key's fingerprint, by which unknown keys are refused, and its first row.

The manifest has the least and greatest key of every shard; shards do not overlap. ``lookup`` finds the shard there and
then reads a block for each level that it probes, a slot, a row and the ids: a few hundred bytes besides the ids, whatever
the size of shard or corpus (but for the contents, which list some twenty levels).

A task writes under a new name and returns it; the manifest lists one file for each shard. A file that a lost or
repeated task has left is in no manifest. Files go through pyarrow's file systems, so the folder may be any of those.

Defined results: a null text is empty and has the end id only. A null id comes first and has the key -2**63, which is
kept for it. Rows with equal ids stand together in one shard, in the order of their texts; a lookup gives all of them. An empty table
gives no shards. Other columns are not read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, documents, shared_dir, text_batches
from .tokens import encoder

MAGIC = b"IDSHARD1"
END_ID = 2
NULL_KEY = -(1 << 63)
#: Positions of a level's bit array for each key that reaches the level.
SPREAD = 2
MANIFEST = "shard int, path string, n_docs long, n_tokens long, first_key long, last_key long"
ROWS = "shard int, ord long, doc_id long, start_in_shard long, n_tokens long, ids_crc32 long"


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """splitmix64 of 64-bit keys."""
    with np.errstate(over="ignore"):
        x = keys.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _print(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


#: Bits of a block, and the block in a file: the number of set bits before it, and its bits.
BLOCK_BITS = 512
BLOCK = np.dtype([("before", "<u8"), ("bits", "u1", BLOCK_BITS // 8)])


class PerfectHash:
    """Slots 0 to n-1 for n distinct 64-bit keys."""

    def __init__(self, sizes: list[int], blocks: np.ndarray, prints: np.ndarray):
        self.sizes, self.blocks, self.prints = sizes, blocks, prints
        self.flags = np.unpackbits(blocks["bits"].ravel(), bitorder="little")
        self.before = np.concatenate(([0], np.cumsum(self.flags, dtype=np.int64)))

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, levels = keys, [], []
        while len(left):
            size = SPREAD * len(left)
            at = (_mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            sizes.append(size)
            left = left[~alone[at]]
        bits = np.concatenate(levels) if levels else np.zeros(0, bool)
        bits = np.concatenate((bits, np.zeros(-len(bits) % BLOCK_BITS, bool))).reshape(-1, BLOCK_BITS)
        blocks = np.zeros(len(bits), BLOCK)
        blocks["bits"] = np.packbits(bits, axis=1, bitorder="little")
        blocks["before"][1:] = np.cumsum(bits.sum(axis=1))[:-1]
        made = cls(sizes, blocks, np.zeros(len(keys), np.uint32))
        made.prints[made._slots(keys)] = _print(keys)
        return made

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out, todo, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + (_mix(keys[todo], level) % np.uint64(size)).astype(np.int64)
            hit = self.flags[at] == 1
            out[todo[hit]] = self.before[at[hit]]
            todo, base = todo[~hit], base + size
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1 for keys that have none (but for one in 2**32 of them)."""
        keys = np.ascontiguousarray(keys, np.int64)
        slots = self._slots(keys)
        known = slots >= 0
        known[known] = self.prints[slots[known]] == _print(keys[known])
        return np.where(known, slots, -1)


class Shard:
    """Reads one shard file. ``bytes_read`` counts what it has read of it."""

    def __init__(self, path: str):
        store, inner = fs.FileSystem.from_uri(path)
        self.file, self.bytes_read = store.open_input_file(inner), 0
        size = self.file.size()
        tail = self._at(max(size - 16, 0), 16)
        if self._at(0, 8) != MAGIC or tail[8:] != MAGIC:
            raise ValueError(f"{path} is not a whole shard")
        length = int.from_bytes(tail[:8], "little")
        contents = json.loads(self._at(size - 16 - length, length))
        self.width, self.sizes, self.sections, self.n_rows = contents["width"], contents["sizes"], contents["sections"], contents["rows"]

    def _at(self, begin: int, length: int) -> bytes:
        self.bytes_read += length
        return self.file.read_at(length, begin)

    def section(self, name: str, begin: int = 0, count: int | None = None) -> np.ndarray:
        """Entries of a section of the index."""
        at, n, kind = self.sections[name]
        kind = BLOCK if name == "blocks" else np.dtype(kind)
        count = n - begin if count is None else count
        return np.frombuffer(self._at(at + begin * kind.itemsize, count * kind.itemsize), kind)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        return np.frombuffer(self._at(8 + lo * self.width, (hi - lo) * self.width), f"<u{self.width}").astype("<u4")

    def first_row(self, key: int) -> int:
        """The first row of a key, or -1: a probe a level."""
        k, base = np.array([key], np.int64), 0
        for level, size in enumerate(self.sizes):
            block, bit = divmod(base + int(_mix(k, level)[0] % np.uint64(size)), BLOCK_BITS)
            found = self.section("blocks", block, 1)[0]
            bits = np.unpackbits(found["bits"], bitorder="little")
            if bits[bit]:
                slot = int(found["before"]) + int(bits[:bit].sum())
                return int(self.section("first_row", slot, 1)[0]) if self.section("prints", slot, 1)[0] == _print(k)[0] else -1
            base += size
        return -1

    def lookup(self, key: int | None) -> list[np.ndarray]:
        """The ids of every document with this key."""
        k = NULL_KEY if key is None else key
        row, found = self.first_row(k), []
        while 0 <= row < self.n_rows and self.section("keys", row, 1)[0] == k:
            ends = self.section("ends", max(row - 1, 0), 2 if row else 1)
            found.append(self.ids(int(ends[0]) if row else 0, int(ends[-1])))
            row += 1
        return found


def lookup(manifest: DataFrame, key: int | None) -> list[np.ndarray]:
    """The ids of every document with this key, from the one shard that can have it."""
    k = NULL_KEY if key is None else key
    paths = [r["path"] for r in manifest.where((F.col("first_key") <= k) & (F.col("last_key") >= k)).select("path").collect()]
    return [ids for path in paths for ids in Shard(path).lookup(key)]


def write_shards(docs: DataFrame, folder: str, shards: int, end_id: int = END_ID, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes ``docs`` to ``folder`` in ascending id order; returns the manifest (shard, path, n_docs, n_tokens, first_key, last_key)."""
    schema = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, shard = encoder(tokenizer), np.array([end_id], "<u4"), TaskContext.get().partitionId()
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        store, inner = fs.FileSystem.from_uri(folder)
        store.create_dir(inner, recursive=True)
        name_of, out, keys, ends, total = f"{shard:06d}-{uuid.uuid4().hex}.ids", None, [], [], 0
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                if out is None:
                    out = store.open_output_stream(f"{inner}/{name_of}")
                    out.write(MAGIC)
                encoded = enc.encode([t or "" for t in part.column("text").to_pylist()])
                out.write(np.concatenate([x for ids in encoded for x in (ids, end)]).astype(f"<u{width}").tobytes())
                keys.append(part.column("doc_id").fill_null(NULL_KEY).to_numpy(zero_copy_only=False))
                ends.append(total + np.cumsum([len(x) + 1 for x in encoded]))
                total = int(ends[-1][-1])
        if out is None:
            return
        row_keys = np.concatenate(keys).astype(np.int64)
        distinct, first = np.unique(row_keys, return_index=True)
        made, first_row = PerfectHash.build(distinct), np.zeros(len(distinct), np.int64)
        first_row[made.find(distinct)] = first
        at, sections = 8 + total * width, {}
        for name, x, kind in (("keys", row_keys, "<i8"), ("ends", np.concatenate(ends), "<i8"), ("blocks", made.blocks, BLOCK), ("prints", made.prints, "<u4"), ("first_row", first_row, "<i8")):
            raw = x.astype(kind).tobytes()
            sections[name] = [at, len(x), "" if name == "blocks" else kind]
            out.write(raw)
            at += len(raw)
        contents = json.dumps({"width": width, "rows": len(row_keys), "sizes": made.sizes, "sections": sections}).encode()
        out.write(contents + len(contents).to_bytes(8, "little") + MAGIC)
        out.close()
        row = [shard], [f"{folder}/{name_of}"], [len(row_keys)], [total], [int(row_keys[0])], [int(row_keys[-1])]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    text_batches(docs.sparkSession)
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = chosen.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    return checkpointed(ordered.mapInArrow(write, MANIFEST))


def read_shards(manifest: DataFrame) -> DataFrame:
    """A row for each document, read from the files through the index: shard, ord, doc_id, start_in_shard, n_tokens, ids_crc32."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, path in zip(batch["shard"], batch["path"], strict=True):
                shard = Shard(path)
                keys, ends = shard.section("keys"), shard.section("ends")
                made, first_row = PerfectHash(shard.sizes, shard.section("blocks"), shard.section("prints")), shard.section("first_row")
                first = first_row[made.find(keys)]  # rows with equal keys follow the first
                new = np.concatenate(([True], keys[1:] != keys[:-1]))
                row = first + np.arange(len(first)) - np.maximum.accumulate(np.where(new, np.arange(len(first)), 0))
                begins = np.concatenate(([0], ends[:-1]))
                for lo in range(0, len(row), 2000):
                    r = row[lo : lo + 2000]
                    key, begin, end = keys[r], begins[r], ends[r]
                    yield pd.DataFrame({
                        "shard": number, "ord": r, "doc_id": pd.array(np.where(key == NULL_KEY, 0, key), "Int64"), "start_in_shard": begin,
                        "n_tokens": end - begin, "ids_crc32": [zlib.crc32(shard.ids(x, y)) for x, y in zip(begin.tolist(), end.tolist(), strict=True)],
                    }).assign(doc_id=lambda x, key=key: x["doc_id"].mask(key == NULL_KEY))

    # a given number of partitions is not coalesced: about a task for each shard, which is small by its row but not by its file
    return manifest.select("shard", "path").repartitionByRange(max(manifest.count(), 1), "shard").mapInPandas(read, ROWS)


def write_and_read(docs: DataFrame, shards: int | None = None, folder: str | None = None, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The only whole-table step outside the shards is a running sum over the manifest, a row for each shard.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    folder = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder
    manifest = write_shards(docs, folder, shards or int(spark.conf.get("spark.sql.shuffle.partitions")), end_id, tokenizer)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("_before"))
    found = read_shards(manifest).join(F.broadcast(starts), "shard")  # a row for each shard, as many as partitions were asked for
    return found.select("doc_id", (F.col("_before") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read(documents(spark, sf_dir))
