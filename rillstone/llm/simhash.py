"""SimHash near-duplicates with covering locality-sensitive hashing.

A document's fingerprint is the bitwise majority of the XXH64 values of its word shingles. Two fingerprints link
if they differ in at most three bits. Covering LSH gives every bit position a non-zero vector of four bits and has one
table for each of the 15 non-zero vectors v: it keeps the positions whose vector has an odd product with v. Three
differing positions span at most three dimensions, so some v is orthogonal to all of them: that table keeps none of
the three, and the pair shares its bucket. No link within the radius is lost.

Defined results: null and empty texts, and texts without words, have fingerprint zero and link like others. Fewer
words than a shingle: the whole sequence is the one shingle. Equal fingerprints always link. Null ids are kept;
they never are a component's id, and a component without any id has null. Repeated rows stay repeated. An empty table
gives an empty one. Other columns, of whatever name, are not read.

Three bits are no similarity of 0.8: ``representatives`` takes the links of the fingerprints as candidates, adds those that ``nearsets`` finds
beyond three bits, and decides each by the shingle sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import nearsets
from .common import checkpointed, documents, text_batches
from .components import connected_components
from .nearsets import shingles

RADIUS = 3
#: Fingerprints of a bucket that one task compares; a larger bucket is split by further covering masks.
BUCKET = 256


def simhash(text: str | None, words: int) -> int:
    """The fingerprint as a signed 64-bit integer."""
    return of_shingles(shingles(text, words))


def of_shingles(values: np.ndarray) -> int:
    """The fingerprint of the shingles' values, repeats included."""
    if not len(values):
        return 0
    bits = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 16):
        part = values[at : at + (1 << 16)]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * bits > len(values), bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, words: int, text: str = "text", out: str = "fingerprint") -> DataFrame:
    @F.pandas_udf(LongType())
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, words) for t in texts], dtype="int64")

    text_batches(docs.sparkSession)
    return docs.withColumn(out, fingerprint(F.col(text)))


@cache
def covering_masks(bits: tuple[int, ...], radius: int = RADIUS) -> tuple[int, ...]:
    """Masks over these bit positions; any ``radius`` or fewer positions are all missing from at least one mask."""
    vectors = (1 << (radius + 1)) - 1
    odd = lambda x: x.bit_count() & 1
    return tuple(sum(1 << b for i, b in enumerate(bits) if odd((1 + i % vectors) & v)) for v in range(1, vectors + 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _children(mask: int) -> list[int]:
    free = tuple(b for b in range(64) if not mask >> b & 1)
    return sorted({mask | m for m in covering_masks(free)} - {mask})


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        us, vs = [], []
        for members in batch["members"]:
            x = np.sort(np.asarray(members, dtype=np.int64))
            near = np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= RADIUS
            left = np.ones(len(x), bool)  # a spanning forest of the links: as many edges as members at most
            for i in range(len(x)):
                if left[i]:
                    todo, left[i] = [i], False
                    while todo:
                        k = todo.pop()
                        new = np.flatnonzero(near[k] & left)
                        left[new] = False
                        us += [x[k]] * len(new)
                        vs += x[new].tolist()
                        todo += new.tolist()
        yield pd.DataFrame({"u": np.array(us, np.int64), "v": np.array(vs, np.int64)})


def links(fingerprints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) between the values of the distinct column ``fp`` that connect all pairs within the radius.

    Buckets of up to ``bucket`` values are compared within; the members of larger ones get longer keys from the masks
    that cover the positions their bucket leaves free, until 2**free <= bucket bounds every bucket. ``bucket`` is 256 at
    least: eight or more free positions have vectors of full rank, so every new key is longer.
    """
    if bucket < BUCKET:
        raise ValueError(f"bucket must be {BUCKET} at least")
    spark = fingerprints.sparkSession
    masks, edges, level = [0], None, 0
    rows = fingerprints.select("fp", F.lit(0).cast("long").alias("mask"))
    while True:
        children = {m: _children(m) for m in masks}
        table = pa.table({"mask": pa.array([_signed(m) for m in children], pa.int64()), "children": pa.array([[_signed(c) for c in cs] for cs in children.values()], pa.list_(pa.int64()))})
        table = spark.createDataFrame(table)  # from a list, it would take Python workers of another kind, which stay beside the others
        rows = rows.join(F.broadcast(table), "mask").select("fp", F.explode("children").alias("mask"))
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))) if level == 0 else rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))).distinct()
        sizes = rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        if level == 0:
            sizes = checkpointed(sizes)
        sized = rows.join(sizes, ["mask", "key"])
        groups = sized.where(F.col("n") <= bucket).groupBy("mask", "key").agg(F.collect_list("fp").alias("members")).select("members")
        found = groups.mapInPandas(_edges, "u long, v long")
        edges = found if edges is None else edges.unionByName(found)
        masks = sorted({c for cs in children.values() for c in cs})
        if all(2 ** (64 - m.bit_count()) <= bucket for m in masks):
            return edges
        large = sizes.where(F.col("n") > bucket)
        if large.isEmpty():
            return edges
        rows = checkpointed(rows.join(large.select("mask", "key"), ["mask", "key"], "left_semi").select("fp", "mask"))
        level += 1


def components(docs: DataFrame, doc_id: str = "doc_id", fingerprint: str = "fingerprint") -> DataFrame:
    """(fp, root, component_id): for every distinct fingerprint its component, and the smallest document id in that."""
    values = checkpointed(docs.groupBy(F.col(fingerprint).alias("fp")).agg(F.min(doc_id).alias("least")))
    roots = connected_components(links(values.select("fp"))).withColumnRenamed("node", "fp")
    rooted = values.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = checkpointed(rooted)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint long, component_id) for every row of ``docs``."""
    marked = checkpointed(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), words).drop("text"))
    return marked.join(components(marked).withColumnRenamed("fp", "fingerprint"), "fingerprint").select("doc_id", "fingerprint", "component_id")


def representatives(docs: DataFrame, words: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of texts whose shingle sets have a Jaccard similarity of 0.8 or more, directly or over others
    (candidates by the links of the fingerprints and by ``nearsets``): that of the smallest id (any id comes before null), then of the least hash of id and text."""
    of_row = F.concat_ws("\x1f", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.coalesce(F.col(text), F.lit("")))
    rows = docs.withColumn("_row", F.unhex(F.substring(F.sha2(of_row, 256), 1, 32)))
    texts = rows.select("_row", F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = checkpointed(nearsets.with_sketch(texts, words, of_shingles).drop("text"))
    linked = links(checkpointed(marked.select("fp").distinct()))
    rooted = marked.select("_row", "doc_id", "digest").join(nearsets.groups(texts, marked, words, linked), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    kept = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_row"))
    return rows.join(kept.select("_row"), "_row", "left_semi").dropDuplicates(["_row"]).drop("_row")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir), words=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
