"""Mixing sources to target weights by Pfair scheduling.

Documents of a source, in an order that a hash of the id fixes, form blocks. With a share w of the slots, block i of a source
(from 0) may take no slot before floor(i / w) and none after ceil((i + 1) / w) - 1; earliest deadline first among the
released blocks gives every slot its source. With shares that add up to one this meets all deadlines, so at every slot
each source has had its share to within less than one block. Weights are taken as they are, as whole
numbers of 2**-128, so there is no rounding that grows with the input.

No document is dropped or repeated: when a source ends, the others go on at the weights that are left, as a new phase,
and the share holds within each. A block has ``BLOCK`` documents, or as many more as keep the schedule to about ``SLOTS`` blocks:
that, and not the corpus, bounds what the driver works out and broadcasts (8 bytes a block), and a block's share of the
corpus stays under 1 / ``SLOTS`` then. The driver's time is that number times the logarithm of the number of sources. More
than ``MAX_SOURCES`` sources are refused.

Defined results: null sources are a source. Sources that ``weights`` does not name get the mean weight of those it
names; zero weights come last. Null and equal ids keep their rows, ordered by text. Without weights, a source's weight is
its number of documents to the power ``alpha``. An empty table gives an empty one. All columns are kept; slot, place
(the number in the mixture, from 0 without gaps) are added; working columns begin with an underscore.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, ranked

BLOCK = 16
SLOTS = 1 << 20
SCALE = 1 << 128
MAX_SOURCES = 10_000


def exact(weights: list[float]) -> list[int]:
    """Positive whole numbers in proportion to the weights that add up to ``SCALE``."""
    if not weights:
        return []
    total = sum(map(Fraction, weights))
    out = [max(1, int(Fraction(w) / total * SCALE)) for w in weights]
    out[out.index(max(out))] += SCALE - sum(out)
    return out


def earliest_deadline_first(parts: list[int], blocks: list[int]) -> np.ndarray:
    """The source of each slot, until all have had all their blocks.

    At the start of a phase all first blocks are released, and their deadlines ascend as the weights descend; so those come from one
    list that all phases share, and a phase costs no more than its slots.
    """
    by_weight = sorted(range(len(parts)), key=lambda i: (-parts[i], i))  # decides between equal deadlines
    parts, left = [parts[i] for i in by_weight], [blocks[i] for i in by_weight]
    out, at = np.empty(sum(left), np.int32), 0
    active = [i for i, n in enumerate(left) if n]
    total = sum(parts[i] for i in active)
    while len(active) > 1:
        base, begun = at, 0
        waiting: list[tuple[int, int, int, int]] = []  # release, deadline, source, block of the phase
        ready: list[tuple[int, int, int]] = []
        while True:
            while waiting and waiting[0][0] <= at - base:
                heapq.heappush(ready, heapq.heappop(waiting)[1:])
            new = (-(-total // parts[active[begun]]), active[begun], 0) if begun < len(active) else None
            if new and (not ready or new < ready[0]):
                begun += 1
                _, i, k = new
            else:
                _, i, k = heapq.heappop(ready)
            out[at], at, left[i] = i, at + 1, left[i] - 1
            if not left[i]:
                break
            heapq.heappush(waiting, ((k + 1) * total // parts[i], -(-(k + 2) * total // parts[i]), i, k + 1))
        active.remove(i)
        total -= parts[i]
    out[at:] = active or -1
    return np.array(by_weight, np.int32)[out]


def schedule(blocks: list[int], weights: list[float]) -> np.ndarray:
    """The source of each slot; sources without a weight follow the others, all at the same rate."""
    out = []
    for own in ([i for i, w in enumerate(weights) if w > 0], [i for i, w in enumerate(weights) if w <= 0]):
        parts = exact([weights[i] if weights[i] > 0 else 1.0 for i in own])
        out.append(np.array(own, np.int32)[earliest_deadline_first(parts, [blocks[i] for i in own])] if own else np.zeros(0, np.int32))
    return np.concatenate(out)


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.7, block: int | None = None, source: str = "source", doc_id: str = "doc_id", text: str | None = None) -> DataFrame:
    """``docs`` with slot and place. ``text`` names a column that orders rows with equal ids."""
    counts = sorted((r[0] is not None, r[0], r[1]) for r in docs.groupBy(F.col(source).cast("string")).count().limit(MAX_SOURCES + 1).collect())
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    names, sizes = [c[1] for c in counts], [c[2] for c in counts]
    if weights is None:
        own = [n**alpha for n in sizes]
    else:
        mean = sum(weights.values()) / max(len(weights), 1) or 1.0
        own = [float(weights.get(x, mean)) for x in names]
    block = block or max(BLOCK, -(-sum(sizes) // SLOTS))
    blocks = np.array([-(-n // block) for n in sizes], np.int64)
    by_source = np.argsort(schedule(blocks.tolist(), own), kind="stable")  # the slots of the first source, then the next one's
    ends = np.cumsum(blocks)

    # a source's last block may be short; places behind its slot move up
    missing = blocks * block - np.array(sizes, np.int64)
    short = by_source[ends - 1] if len(ends) else ends
    order = np.argsort(short)
    moved = np.concatenate(([0], np.cumsum(missing[order])))
    shared = docs.sparkSession.sparkContext.broadcast(({x: i for i, x in enumerate(names)}, ends - blocks, by_source, short[order], moved))

    @F.pandas_udf("slot long, place long")
    def place(sources: pd.Series, number: pd.Series) -> pd.DataFrame:
        index, first, by_source, short, moved = shared.value
        number = number.to_numpy(np.int64)
        codes = np.array([index[None if x is None or x != x else x] for x in sources], np.int64)
        slot = by_source[first[codes] + number // block]
        return pd.DataFrame({"slot": slot, "place": slot * block - moved[np.searchsorted(short, slot, side="left")] + number % block})

    kept = docs.drop("slot", "place")
    order = F.struct(F.col(doc_id), *([F.xxhash64(F.col(text))] if text else []))
    numbered = ranked(kept, source, order, "_mix_number")
    return numbered.withColumn("_mix", place(F.col(source).cast("string"), "_mix_number")).select(*kept.columns, "_mix.slot", "_mix.place")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir).select("doc_id", "source"))
