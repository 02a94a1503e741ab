"""Best-fit packing by exact-complement hashing.

Every document becomes ids and an end id; only documents longer than a sequence are cut, all pieces but the first being
full. Packing works on the number of pieces of each length, a table of at most ``capacity`` rows whatever the corpus:
from the longest length down, each piece's gap is filled exactly by one piece, by two or by three whose lengths sum to
it, as many times as the counts allow; what is left is packed by best fit in descending order. An index of the sums of
one, two and three available lengths is built once and follows the counts. The plan says how many sequences have which lengths. A piece finds its place by its number among the pieces of its length.

Documents may come in an order, such as that of a mixture. Then the kinds of sequences in the plan are interleaved evenly, and
each length hands out its pieces in that order, so a prefix of the sequences holds about a prefix of the documents.
Without an order, a hash decides between pieces of a length.

Defined results: null and empty texts are one piece with the end id only. Null and repeated ids keep their rows, as
pieces of their own. An empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, documents, ranked, text_batches
from .tokens import CACHE_ENTRIES, encoder

CAPACITY = 2048
END_ID = 0
#: Of an order: the bits for the place in a file, below those for the file.
FILE_BITS = 33
PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text", cache: int = CACHE_ENTRIES, order: Column | None = None) -> DataFrame:
    """The pieces of every document: doc_id, copy (``order``, a number that tells rows apart), piece, start, length, ids_crc32, and ids if asked for. start counts ids of the same document. ``cache`` is for each worker process, in entries."""

    schema = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    schema = schema.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, cache)
        end = np.array([end_id], "<u4")
        at_once = 1000 if cache >= CACHE_ENTRIES else 250
        for batch in batches:
            for at in range(0, len(batch), at_once):
                part, rows = batch.slice(at, at_once), []
                texts = [t or "" for t in part.column("text").to_pylist()]
                for d, c, ids in zip(part.column("doc_id").to_pylist(), part.column("copy").to_pylist(), enc.encode(texts), strict=True):
                    ids = np.concatenate((ids, end))
                    first = len(ids) % capacity or capacity
                    for k, lo in enumerate([0, *range(first, len(ids), capacity)]):
                        own = ids[lo : first + k * capacity]
                        rows.append((d, c, k, lo, len(own), zlib.crc32(own), *([own.astype(np.int32)] if with_ids else [])))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    text_batches(docs.sparkSession)
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.monotonically_increasing_id() if order is None else order).alias("copy"), F.col(text).alias("text"))
    return chosen.mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


class Sums:
    """Which sums one, two or three of the available pieces have: ``pairs[s]`` and ``triples[s]`` count the combinations of lengths with the sum s.

    A length counts as there once, twice, or three times and more. Each of its three steps down takes its combinations out of the
    tables once, by one addition of arrays, so the index is built and kept up by at most 3 * capacity of them.
    """

    def __init__(self, counts: np.ndarray):
        self.capacity = len(counts) - 1
        self.count = np.zeros_like(counts)
        self.pairs, self.triples = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
        for length in np.flatnonzero(counts).tolist():
            self.set(length, int(counts[length]))

    def set(self, x: int, n: int) -> None:
        """Makes ``n`` pieces of length x available."""
        old, new = min(int(self.count[x]), 3), min(n, 3)
        for level in range(old, new):  # one more
            self._change(x, level + 1, 1)
        for level in range(old, new, -1):  # one less
            self._change(x, level, -1)
        self.count[x] = n

    def _change(self, x: int, level: int, sign: int) -> None:
        """Adds or takes out the combinations that hold x ``level`` times."""
        there = self.count > 0
        there[x] = False
        if level == 1:
            # ``pairs`` without x: those that hold it are not in yet, or go first
            self.pairs[x:] -= there[: self.capacity + 1 - x] * (sign < 0)
            self.triples[x:] += sign * self.pairs[: self.capacity + 1 - x]
            self.pairs[x:] += there[: self.capacity + 1 - x] * (sign > 0)
        elif level == 2 and 2 * x <= self.capacity:
            self.pairs[2 * x] += sign
            self.triples[2 * x :] += sign * there[: self.capacity + 1 - 2 * x]
        elif level == 3 and 3 * x <= self.capacity:
            self.triples[3 * x] += sign

    def pair(self, total: int) -> tuple[int, ...] | None:
        """The two available lengths of this sum of which the longer is longest."""
        if total < 2 or not self.pairs[total]:
            return None
        a = np.arange(1, total // 2 + 1)
        both = (self.count[a] > 0) & (self.count[total - a] > 0) & ((2 * a < total) | (self.count[a] > 1))
        x = int(a[both.argmax()])
        return x, total - x

    def exact(self, total: int) -> tuple[int, ...] | None:
        """One, two or three available lengths of this sum, as few as there are; of triples one with the longest length that fits."""
        if self.count[total]:
            return (total,)
        if found := self.pair(total):
            return found
        if not self.triples[total]:
            return None
        x = np.arange(total - 2, 0, -1)
        for one in x[(self.count[x] > 0) & (self.pairs[total - x] > 0)].tolist():
            n = int(self.count[one])
            self.set(one, n - 1)
            found = self.pair(total - one)
            self.set(one, n)
            if found:
                return one, *found
        raise AssertionError("a counted triple is there")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, number of such sequences); uses every counted piece once."""
    c = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        c[length] += n
    out: list[tuple[list[int], int]] = []
    residual = np.zeros(capacity + 1, np.int64)
    out += [([capacity], int(c[capacity]))] * bool(c[capacity])
    c[capacity] = 0
    index = Sums(c)
    for longest in range(capacity - 1, 0, -1):
        while n := int(index.count[longest]):
            index.set(longest, n - 1)  # the piece whose gap is to be filled
            found = index.exact(capacity - longest)
            index.set(longest, n)
            if found is None:
                residual[longest] = n
                index.set(longest, 0)
                continue
            kinds, uses = np.unique([longest, *found], return_counts=True)
            m = int((index.count[kinds] // uses).min())
            for x, u in zip(kinds.tolist(), uses.tolist(), strict=True):
                index.set(x, int(index.count[x]) - u * m)
            out.append(([longest, *found], m))

    open_: dict[int, list[tuple[list[int], int]]] = {}  # by gap
    for length in range(capacity, 0, -1):
        n = int(residual[length])
        while n:
            gap = min((g for g in open_ if g >= length), default=None)
            if gap is None:
                each = capacity // length
                if full := n // each:
                    open_.setdefault(capacity - each * length, []).append(([length] * each, full))
                if n % each:
                    open_.setdefault(capacity - n % each * length, []).append(([length] * (n % each), 1))
                break
            lengths, m = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
            used = min(n, m)
            if m > used:
                open_.setdefault(gap, []).append((lengths, m - used))
            open_.setdefault(gap - length, []).append(([*lengths, length], used))
            n -= used
    return out + [x for kinds in open_.values() for x in kinds]


def slots(planned: list[tuple[list[int], int]]) -> pd.DataFrame:
    """A row for each place in a planned sequence: the pieces of ``length`` numbered from ``first`` go to sequences from ``sequence`` on, at ``offset``."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for lengths, m in planned:
        offset = 0
        for length in lengths:
            rows.append((length, used.get(length, 0), base, offset))
            used[length] = used.get(length, 0) + m
            offset += length
        base += m
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"]).sort_values(["length", "first"], ignore_index=True)


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a table with ``length`` (1 to capacity), ``copy`` and ``piece``.

    What goes to the driver and back to all tasks is the counts by length and the plan made of them. Each entry of the
    plan uses up one length's count, so both are bounded by the capacity and not by the corpus.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    table = slots(plan(counts, capacity))
    shift = 1 << 44
    keys = table["length"].to_numpy() * shift + table["first"].to_numpy()
    places = pieces.sparkSession.sparkContext.broadcast((keys, table["first"].to_numpy(), table["sequence"].to_numpy(), table["offset"].to_numpy()))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        keys, first, sequence, offset = places.value
        at = np.searchsorted(keys, length.to_numpy() * shift + number.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + number.to_numpy() - first[at], "offset": offset[at]})

    numbered = ranked(pieces, "length", F.struct("copy", "piece"), "_number")
    return numbered.withColumn("_place", place("length", "_number")).select(*pieces.columns, "_place.sequence_id", "_place.offset")


def assign_in_order(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The same where ``copy`` is the order of the documents, its bits above ``FILE_BITS`` being those of a file.

    Sequence j of m of a kind stands at (j + 1/2) / m of the whole; all steps are joins and numberings by shuffle.
    """
    spark = pieces.sparkSession
    planned = plan({r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}, capacity)
    ends = np.cumsum([m for _, m in planned], dtype=np.int64)
    shared = spark.sparkContext.broadcast((ends, np.array([m for _, m in planned], np.int64), [x for x, _ in planned]))

    @F.pandas_udf("kind int, at double, length array<int>")
    def sequence(number: pd.Series) -> pd.DataFrame:
        ends, m, lengths = shared.value
        kind = np.searchsorted(ends, number.to_numpy(), side="right")
        j = number.to_numpy() - (ends - m)[kind]
        return pd.DataFrame({"kind": kind.astype(np.int32), "at": (j + 0.5) / m[kind], "length": [lengths[k] for k in kind]})

    sequence = sequence.asNondeterministic()  # else it is copied below the filters that joins infer, into a Python worker of its own
    all_ = spark.range(int(ends[-1]) if len(ends) else 0).withColumn("_s", sequence("id")).select("id", "_s.*", F.lit(0).alias("_all"))
    all_ = ranked(all_, "_all", F.struct("at", "kind", "id"), "sequence_id", salt=F.floor(F.col("at") * (1 << 16)).cast("int"))
    places = all_.select("sequence_id", F.posexplode("length").alias("_k", "_length"), "length")
    offset = F.aggregate(F.slice("length", 1, F.col("_k")), F.lit(0).cast("long"), lambda a, x: a + x)
    places = places.select("sequence_id", offset.alias("offset"), F.col("_length").cast("long").alias("_length"))
    places = ranked(places, "_length", F.struct("sequence_id", "offset"), "_at", salt=F.shiftright("sequence_id", 16))
    numbered = ranked(pieces, "length", F.struct("copy", "piece"), "_number", salt=F.shiftright("copy", FILE_BITS))
    return numbered.join(places, (F.col("length") == F.col("_length")) & (F.col("_number") == F.col("_at"))).select(*pieces.columns, "sequence_id", "offset")


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = False, cache: int = CACHE_ENTRIES, order: Column | None = None) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for. ``order``: see ``assign_in_order``."""
    pieces = checkpointed(token_pieces(docs, capacity, end_id, tokenizer, with_ids, cache=cache, order=order))
    return (assign if order is None else assign_in_order)(pieces, capacity).drop("copy")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
