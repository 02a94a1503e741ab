"""Pairs of texts whose sets of word shingles have a Jaccard similarity of at least 0.8, each checked exactly.

Texts with equal sets are one node. Candidates come from SimHash fingerprints that covering LSH links (given by ``simhash``), and, as few
pairs of 0.8 are within three bits, from MinHash: 32 bands of four values, so a pair of similarity 0.8 has
a bucket in common with a probability of 1 - (1 - 0.8**4)**32 = 1 - 5e-8, more similar pairs with a higher one. Every link is
then decided by the intersection of the two sets of 64-bit shingle hashes; no pair links by its candidate key alone.

What is asked for are components, so pairs that are connected already need no check. The links of the fingerprints, and in each bucket of more
than ``BLOCK`` sets the pairs with the one of least hash, are checked first: a few for each set. What buckets that still hold
several components connect is then compared whole, in blocks of about ``BLOCK`` sets: a set is read once for each block of its unit, no row is made for a pair, and
the members of a unit's largest component are not compared with each other. A unit is what buckets connect, or a bucket where
that is large. So all pairs of a bucket are checked or connected in the end. Of n texts alike to less than 0.8 all pairs are
compared, in n / BLOCK reads of each set, by tasks that hold two blocks.

Texts without words have the empty set, which is like itself only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small, text_batches
from .components import connected_components

BANDS, ROWS = 32, 4
#: Sets and bytes of a block, about, and the blocks beyond which what buckets connect is compared bucket by bucket.
BLOCK, BLOCK_BYTES, BLOCKS = 512, 16 << 20, 64
#: Shingles that the sets of two blocks are compared by at once.
SLAB = 8192
_draws = np.random.default_rng(20).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
_MIXED, _TIMES = _draws[0], 2 * _draws[1] + 1


def shingles(text: str | None, words: int) -> np.ndarray:
    """The XXH64 values of the word shingles, in the order of the text."""
    found = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and the six white-space bytes only
    if not found:
        return np.zeros(0, "<u8")
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], "<u8")


def similar(common: int, a: int, b: int) -> bool:
    """Whether sets of ``a`` and ``b`` members that share ``common`` have a Jaccard similarity of 0.8 at least."""
    return 5 * common >= 4 * (a + b - common)


def bands(values: np.ndarray) -> list[int]:
    """The bucket of a set in each band."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(values), 1024):
        part = values[at : at + 1024, None]
        np.minimum(least, ((part ^ _MIXED) * _TIMES).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) - (1 << 63) for i in range(BANDS)]


def with_sketch(docs: DataFrame, words: int, simhash: Callable[[np.ndarray], int]) -> DataFrame:
    """``docs`` with digest (of the set of shingles), its size, its buckets, and the fingerprint ``simhash`` gives the shingles, repeats included."""

    @F.pandas_udf("digest long, size int, buckets array<long>, fp long")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            values = shingles(t, words)
            x = np.unique(values)
            rows.append((xxhash.xxh64_intdigest(x.tobytes(), 7) - (1 << 63), len(x), bands(x), simhash(values)))
        return pd.DataFrame(rows, columns=["digest", "size", "buckets", "fp"])

    text_batches(docs.sparkSession)
    return docs.withColumn("_sketch", sketch("text")).select(*docs.columns, "_sketch.*")


#: Rows of texts to be compared that are broadcast to pick them out; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def members(docs: DataFrame, chosen: DataFrame, words: int) -> DataFrame:
    """(digest, members), the set as sorted bytes, of each digest in ``chosen`` (digest, _row), from the text of that row of ``docs``."""

    @F.pandas_udf("binary")
    def as_bytes(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingles(t, words)).tobytes() for t in texts], dtype=object)

    picked = docs.select("_row", "text").join(F.broadcast(chosen) if small(chosen, BROADCAST_ROWS) else chosen, "_row")
    return picked.select("digest", as_bytes("text").alias("members")).groupBy("digest").agg(F.first("members").alias("members"))


def _checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep = []
        for a, b in zip(batch["a"], batch["b"], strict=True):
            a, b = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
            keep.append(similar(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)))
        yield batch.loc[np.array(keep, bool), ["u", "v"]]


def common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many members each set of ``a`` shares with each of ``b``."""
    sets = a + b
    lengths = [len(x) for x in sets]
    values = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), lengths)
    order = np.argsort(values, kind="stable")
    values, of = values[order], of[order]
    at = np.cumsum(np.concatenate(([False], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    left = of < len(a)
    n = int(at[-1]) + 1 if len(at) else 0
    both = (np.bincount(at[left], minlength=n) > 0) & (np.bincount(at[~left], minlength=n) > 0)  # shingles of either side
    keep = both[at]
    at, of = (np.cumsum(both) - 1)[at[keep]], of[keep]
    out = np.zeros((len(a), len(b)))
    for lo in range(0, int(both.sum()), SLAB):
        i, j = np.searchsorted(at, (lo, lo + SLAB))
        m = np.zeros((len(sets), SLAB), np.float32)
        m[of[i:j], at[i:j] - lo] = 1
        out += m[: len(a)] @ m[len(a) :].T  # at most SLAB each: exact
    return out.astype(np.int64)


def _compared(block: pd.DataFrame) -> pd.DataFrame:
    """Of the sets of two blocks (or of one, with itself) edges between roots that connect what similar pairs do."""
    sides = [block[block["block"] == k] for k in (block["lo"].iloc[0], block["hi"].iloc[0])]
    sets = [[np.frombuffer(x, "<u8") for x in s["members"]] for s in sides]
    if not sets[0] or not sets[1]:
        return pd.DataFrame({"u": [], "v": []}, dtype="int64")
    sizes, roots = [np.array([len(x) for x in s], np.int64) for s in sets], [s["root"].to_numpy(np.int64) for s in sides]
    shared = common(*sets)
    near = 5 * shared >= 4 * (sizes[0][:, None] + sizes[1][None, :] - shared)
    beyond = np.iinfo(np.int64).max
    a, b = roots
    while True:  # each side takes the least root that it reaches
        b2 = np.minimum(b, np.where(near, a[:, None], beyond).min(axis=0))
        a2 = np.minimum(a, np.where(near, b2[None, :], beyond).min(axis=1))
        if (a2 == a).all() and (b2 == b).all():
            break
        a, b = a2, b2
    edges = pd.DataFrame({"u": np.concatenate(roots), "v": np.concatenate((a, b))})
    return edges[edges["u"] != edges["v"]].drop_duplicates()


def _blocks(left: DataFrame, sets: DataFrame) -> DataFrame:
    """(unit, lo, hi, block, root, members): what ``_compared`` takes, from ``left`` (bucket, digest, size, root) of open buckets."""
    stars = left.groupBy("bucket").agg(F.min("digest").alias("u"))
    clusters = checkpointed(connected_components(left.join(stars, "bucket").select("u", F.col("digest").alias("v"))).toDF("digest", "cluster"))
    large = clusters.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK * BLOCKS).select("cluster", F.lit(True).alias("large"))
    placed = left.join(clusters, "digest").join(large, "cluster", "left")
    unit = F.when(F.col("large"), F.struct(F.lit(True).alias("large"), F.col("bucket").alias("id"))).otherwise(F.struct(F.lit(False).alias("large"), F.col("cluster").alias("id")))
    placed = checkpointed(placed.select(unit.alias("unit"), "digest", "size", "root").distinct())
    of_root = placed.groupBy("unit", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    facts = of_root.groupBy("unit").agg(F.max(F.struct("n", "size", "root")).alias("most"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    number = lambda n, size: F.ceil(F.greatest(n / BLOCK, 8 * size / BLOCK_BYTES)).cast("int")
    facts = facts.where("n > most.n").select("unit", F.col("most.root").alias("main"), number(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("few"), number(F.col("most.n"), F.col("most.size")).alias("many"))
    rows = placed.join(facts, "unit").withColumn("few", F.greatest("few", F.lit(1))).withColumn("many", F.greatest("many", F.lit(1)))
    own, is_main = F.xxhash64("digest", F.lit(1)), F.col("root") == F.col("main")
    rows = rows.withColumn("block", F.when(is_main, F.col("few") + F.pmod(own, F.col("many"))).otherwise(F.pmod(own, F.col("few"))).cast("int"))
    others = F.sequence(F.lit(0), F.when(is_main, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)
    rows = rows.select("unit", "block", "digest", "root", F.explode(others).alias("other"))
    rows = rows.select("unit", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "digest", "root")
    return rows.join(sets, "digest").select("unit", "lo", "hi", "block", "root", "members")


def groups(docs: DataFrame, marked: DataFrame, words: int, linked: DataFrame) -> DataFrame:
    """(digest, root) for the digests of ``marked`` that are candidates: root is the same for all that similar pairs
    connect, directly or over others. ``marked`` is ``docs`` (_row, text) with the sketch and without the text, ``linked`` has edges (u, v) between fingerprints."""
    nodes = checkpointed(marked.groupBy("digest").agg(F.first("buckets").alias("buckets"), F.first("size").alias("size"), F.first("fp").alias("fp")))
    each = nodes.select("digest", "size", F.explode("buckets").alias("bucket"))
    shared = each.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("digest"), "digest", "size")).alias("lead")).where("n > 1")
    left = checkpointed(each.join(shared, "bucket"))
    fit = "5 * least(a.size, b.size) >= 4 * greatest(a.size, b.size) and a.digest <> b.digest"
    node = F.struct("digest", "size")
    of_fp = nodes.groupBy("fp").agg(F.min(node).alias("a"), F.count("*").alias("n"))
    equal = nodes.select("fp", node.alias("b")).join(of_fp.where("n > 1"), "fp").select("a", "b")
    near = linked.where("u <> v").join(of_fp.select(F.col("fp").alias("u"), "a"), "u").join(of_fp.select(F.col("fp").alias("v"), F.col("a").alias("b")), "v").select("a", "b")
    leads = left.where(F.col("n") > BLOCK).select(F.struct("lead.digest", "lead.size").alias("a"), node.alias("b"))
    pairs = equal.unionByName(near).unionByName(leads).where(fit).select(F.least("a.digest", "b.digest").alias("u"), F.greatest("a.digest", "b.digest").alias("v"))
    pairs = checkpointed(pairs.distinct())
    left = left.select("bucket", "digest", "size")
    wanted = left.select("digest").unionByName(pairs.select("u").toDF("digest")).unionByName(pairs.select("v").toDF("digest")).distinct()
    chosen = marked.join(wanted, "digest", "left_semi").groupBy("digest").agg(F.min("_row").alias("_row"))
    sets = checkpointed(members(docs, checkpointed(chosen), words))
    both = pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
    roots = sets.select("digest", F.col("digest").alias("root"))
    roots = _moved(roots, both.select("u", "v", "a", "b").mapInPandas(_checked, "u long, v long"))
    left = left.join(roots, "digest")
    open_ = left.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    left = checkpointed(left.join(open_, "bucket"))
    if left.isEmpty():
        return roots
    return _moved(roots, _blocks(left, sets).groupBy("unit", "lo", "hi").applyInPandas(_compared, "u long, v long"))


def _moved(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``roots`` after edges (u, v) between them."""
    joined = connected_components(edges).toDF("root", "_new")
    return checkpointed(roots.join(joined, "root", "left").select("digest", F.coalesce("_new", "root").alias("root")))
