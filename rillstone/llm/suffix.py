"""Exact substring dedup with suffix sorting by the deep-shallow method.

Every byte goes that is covered by a string of ``LENGTH`` bytes that also starts anywhere else, in the same text or another.

1. Every window of ``LENGTH`` bytes has an anchor, its ``GRAM``-byte string of least hash (the leftmost one); windows with
   the same content have the same anchor at the same place. Neighbouring windows with one anchor form a context: the
   anchor's hash, its offset, and the bytes of these windows. About one byte in 170 is an anchor, and only contexts
   whose anchor hash occurs twice are looked at further.
2. Contexts with equal bytes are a class; they are counted, and all windows of a class that occurs twice repeat.
3. Different contexts of one anchor hash may still share windows. Their suffixes, lined up at the anchor, are sorted
   deep-shallow: multikey quicksort over 8-byte keys down to ``SHALLOW`` bytes, and blind tries for the groups that are
   still equal there. A suffix's parent in its trie has the depth L that it shares with its closest neighbour. If
   L >= LENGTH, the windows from its start up to L - LENGTH further repeat; if not, no window repeats that starts at or
   before the suffix and reaches beyond the L shared bytes. Suffixes are sorted at every ``GRID``-th place and then
   within the stretches that this leaves open, until every window is decided.
4. An anchor hash with more than ``GROUP`` contexts, as at the ends of a passage that very many texts share, goes
   another way: its single windows are counted by a 128-bit hash with map-side partial counts, so no task gathers it.

Texts are handled as UTF-8 bytes, in one task at a time only; what goes through shuffles is hashes, the contexts of
step 3, and the texts once, to cut out their spans. Lists of hashes that let tasks skip what is not asked for are
broadcast up to ``BROADCAST`` entries; beyond that the same selection is a join.

Defined results: null texts are empty; texts under ``LENGTH`` bytes lose nothing. Equal texts are copies of each other,
so those of ``LENGTH`` bytes and more go whole. Null and equal ids keep their rows. An empty table gives an empty one.
Other columns are not read. Hashes that decide equality have 128 bits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, documents, small, text_batches

LENGTH = 400
GRAM = 48
SHALLOW = 32
GRID = 32
GROUP = 4000
BROADCAST = 4_000_000
#: Windows that are handled at once; the low bits that hold a place in the least-hash search.
SEGMENT, PLACE_BITS = 1 << 22, 24

_KEY = ["h", "o", "c1", "c2"]
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def anchors(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each context of a text of LENGTH bytes or more: the anchor's place and hash, and the first and last window."""
    parts = []
    width = LENGTH - GRAM + 1
    low = np.uint64((1 << PLACE_BITS) - 1)
    for begin in range(0, len(b) - LENGTH + 1, SEGMENT):
        x = np.frombuffer(b, np.uint8, min(len(b) - begin, SEGMENT + LENGTH - 1), begin).astype(np.uint64) + np.uint64(1)
        up, down = _power(len(x))
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * down, dtype=np.uint64)))
            h = (sums[GRAM:] - sums[:-GRAM]) * up[: len(x) - GRAM + 1]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(32)
        v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        blocks = np.full(-(-len(v) // width) * width, ~np.uint64(0))
        blocks[: len(v)] = v
        blocks = blocks.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(v) - width + 1
        at = (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)
        new = np.flatnonzero(np.diff(at)) + 1
        first, last = np.concatenate(([0], new)), np.concatenate((new, [n])) - 1
        parts.append((at[first] + begin, h[at[first]].view(np.int64), first + begin, last + begin))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _shared(sorted_values: np.ndarray | None, x: np.ndarray) -> np.ndarray:
    """Which of x are among the sorted values; all, if there is no such list."""
    if sorted_values is None:
        return np.ones(len(x), bool)
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[bytes, int | None, bytes]]:
    for key, doc, t in zip(batch.column("key").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
        if t is not None and len(t) * 4 >= LENGTH and len(b := t.encode("utf-8", "replace")) >= LENGTH:
            yield key, doc, b


def _anchor_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [anchors(b)[1] for _, _, b in _texts(batch)]
        h, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        yield pa.RecordBatch.from_pydict({"h": h, "n": n.astype(np.int64)})


_CONTEXTS = "h long, o int, c1 long, c2 long, r int, n int, starts array<int>, key binary, doc_id long"
_CONTEXT_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.int64()]


def _contexts_of(b: bytes, wanted: np.ndarray | None) -> dict[tuple, list[int]]:
    """The window places of each (h, o, c1, c2, r): r is the last window of the context, counted from its first."""
    at, h, first, last = anchors(b)
    out = defaultdict(list)
    some = np.flatnonzero(_shared(wanted, h))
    for k, a, lo, hi in zip(h[some].tolist(), at[some].tolist(), first[some].tolist(), last[some].tolist(), strict=True):
        c = xxhash.xxh3_128_digest(b[lo : hi + LENGTH])
        out[k, a - lo, int.from_bytes(c[:8], "little", signed=True), int.from_bytes(c[8:], "little", signed=True), hi - lo].append(lo)
    return out


def _blind_trie(data: bytes, begins: list[int], ends: list[int]) -> list[int]:
    """The longest prefix that each suffix shares with another of the group. Inner nodes keep only a depth and children by byte (-1: the end)."""
    root: list | None = None  # node: [depth, {byte: node}] or a leaf: [length, None, members]
    parents = [0] * len(begins)
    for i, (lo, hi) in enumerate(zip(begins, ends, strict=True)):
        n = hi - lo
        if root is None:
            root = [n, None, [i]]
            continue
        node = root
        while node[1] is not None:  # blind descent to any leaf that agrees at the branching bytes
            d = node[0]
            kids = node[1]
            node = kids.get(data[lo + d] if d < n else -1) or next(iter(kids.values()))
        j = node[2][0]
        m = min(n, node[0])
        diff = int.from_bytes(data[lo : lo + m], "big") ^ int.from_bytes(data[begins[j] : begins[j] + m], "big")
        shared = m - (diff.bit_length() + 7) // 8
        mine = data[lo + shared] if shared < n else -1
        above, node = None, root
        while node[1] is not None and node[0] < shared:
            above, node = (node, data[lo + node[0]]), node[1][data[lo + node[0]]]
        if node[1] is not None and node[0] == shared:
            if mine in node[1]:
                node[1][mine][2].append(i)  # both end here
            else:
                node[1][mine] = [n, None, [i]]
        elif node[1] is None and node[0] == n == shared:
            node[2].append(i)
        else:
            k = j  # any leaf below shares the prefix
            theirs = data[begins[k] + shared] if shared < ends[k] - begins[k] else -1
            split = [shared, {theirs: node, mine: [n, None, [i]]}]
            if above is None:
                root = split
            else:
                above[0][1][above[1]] = split
    todo = [(root, 0)]
    while todo:
        node, depth = todo.pop()
        if node[1] is None:
            for i in node[2]:
                parents[i] = node[0] if len(node[2]) > 1 else depth
        else:
            todo += [(x, node[0]) for x in node[1].values()]
    return parents


def shared_prefixes(data: np.ndarray, groups: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each suffix data[begin:end] the longest prefix it shares with another suffix of its group. ``data`` has 8 more bytes at its end."""
    n = len(begins)
    out = np.zeros(n, np.int64)
    raw = data.tobytes()
    eights = np.arange(8)
    # shallow: multikey quicksort, eight bytes as one key; a key ends with its suffix
    rows, part = np.arange(n), groups.astype(np.int64)
    depth = 0
    while depth < SHALLOW and len(rows):
        size = np.minimum(ends[rows] - begins[rows] - depth, 8)
        taken = data[np.minimum((begins[rows] + depth)[:, None] + eights, len(data) - 1)]
        taken = np.where(eights < size[:, None], taken, 0).astype(np.uint8)
        key = np.ascontiguousarray(taken).view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((size, key, part))
        rows, part, key, size, taken = rows[order], part[order], key[order], size[order], taken[order]
        old = np.concatenate(([False], part[1:] == part[:-1]))
        same = old & np.concatenate(([False], (key[1:] == key[:-1]) & (size[1:] == size[:-1])))
        # what neighbours share, for those that this key parts
        common = np.zeros(len(rows), np.int64)
        if len(rows) > 1:
            agree = (taken[1:] == taken[:-1]) & (eights < np.minimum(size[1:], size[:-1])[:, None])
            common[1:] = np.where(old[1:], depth + np.where(agree.all(axis=1), 8, agree.argmin(axis=1)), 0)
        after = np.concatenate((common[1:], [0]))
        np.maximum.at(out, rows, np.maximum(common, after))
        part = np.cumsum(~same) - 1
        sizes = np.bincount(part)
        ended = size < 8  # equal suffixes that end within this key
        keep = (sizes[part] > 1) & ~ended
        equal = (sizes[part] > 1) & ended
        out[rows[equal]] = ends[rows[equal]] - begins[rows[equal]]
        rows, part = rows[keep], part[keep]
        depth += 8
    if len(rows):
        cuts = np.flatnonzero(np.diff(part)) + 1
        for own in np.split(rows, cuts):
            found = _blind_trie(raw, begins[own].tolist(), ends[own].tolist())
            out[own] = np.maximum(out[own], found)
    return out


def decide(contexts: list[tuple[int, int, int, bool, bytes]]) -> list[list[int]]:
    """For contexts (anchor hash, anchor offset, last window, occurs twice, bytes) the repeated windows as flat ranges [first, last, ...].

    Needs all different contexts of each of its anchor hashes.
    """
    data = np.frombuffer(b"".join(c[4] for c in contexts) + bytes(8), np.uint8)
    size = np.array([len(c[4]) for c in contexts], np.int64)
    base = np.concatenate(([0], np.cumsum(size)[:-1]))
    offset = np.array([c[1] for c in contexts], np.int64)
    last = np.array([c[2] for c in contexts], np.int64)
    twice = np.array([c[3] for c in contexts], bool)
    _, group = np.unique(np.array([c[0] for c in contexts], np.int64), return_inverse=True)
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(group.max() + 2))
    state = [np.full(r + 1, 1 if t else -1, np.int8) for r, t in zip(last.tolist(), twice.tolist(), strict=True)]  # -1: open, 0: not repeated, 1: repeated
    asked: dict[int, set[int]] = {}  # places relative to the anchor, by group
    for i in np.flatnonzero(~twice).tolist():
        lo, hi = -offset[i], last[i] - offset[i]
        asked.setdefault(int(group[i]), set()).update(range(int(-(-lo // GRID) * GRID), int(hi // GRID * GRID) + GRID + 1, GRID))
    while asked:
        who, where, sets, number = [], [], [], 0
        for g, places in asked.items():
            members = order[bounds[g] : bounds[g + 1]]
            for t in places:
                at = offset[members] + t
                fits = (at >= 0) & (at < size[members])
                who.append(members[fits])
                where.append(at[fits])
                sets.append(np.full(int(fits.sum()), number))
                number += 1
        who, where, sets = np.concatenate(who), np.concatenate(where), np.concatenate(sets)
        shared = shared_prefixes(data, sets, base[who] + where, base[who] + size[who])
        asked = {}
        for i, r, n in zip(who.tolist(), where.tolist(), shared.tolist(), strict=True):
            if not twice[i]:
                if n >= LENGTH:
                    state[i][r : r + n - LENGTH + 1] = 1
                elif r + n - LENGTH < last[i]:
                    part = state[i][max(r + n - LENGTH + 1, 0) : r + 1]
                    part[part < 0] = 0
        for i in np.unique(who[~twice[who]]).tolist():
            open_ = state[i] < 0
            if open_.any():
                edge = np.flatnonzero(np.diff(np.concatenate(([False], open_, [False]))))
                for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    asked.setdefault(int(group[i]), set()).add((lo + hi - 1) // 2 - int(offset[i]))
    out = []
    for s in state:
        edge = np.flatnonzero(np.diff(np.concatenate(([0], s == 1, [0]))))
        edge[1::2] -= 1
        out.append(edge.tolist())
    return out


_WITH_BYTES = "h long, o int, c1 long, c2 long, r int, twice boolean, large boolean, bytes binary"


def _rep_key(h: int, o: int, c1: int, c2: int, key: bytes, doc: int | None) -> int:
    """What marks the one text that supplies a class's bytes; the same as the column in ``_with_bytes``."""
    return xxhash.xxh3_64_intdigest(b"%d,%d,%d,%d,%b,%b" % (h, o, c1, c2, key.hex().encode(), b"" if doc is None else b"%d" % doc)) - (1 << 63)


def _with_bytes(texts: DataFrame, need: DataFrame, broadcast: int) -> DataFrame:
    """The bytes of every class in ``need``, each from its representative text."""
    out = pa.schema([("h", pa.int64()), ("o", pa.int32()), ("c1", pa.int64()), ("c2", pa.int64()), ("r", pa.int32()), ("twice", pa.bool_()), ("large", pa.bool_()), ("bytes", pa.binary())])
    if small(need, broadcast):

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = zip(*(batch.column(c).to_pylist() for c in (*_KEY, "key", "doc_id")), strict=True)
                yield pa.RecordBatch.from_pydict({"k": pa.array([_rep_key(*x) for x in rows], pa.int64()), "h": batch.column("h"), "flag": pa.array([2 * l + t for t, l in zip(batch.column("twice").to_pylist(), batch.column("large").to_pylist(), strict=True)], pa.int64())})  # noqa: E741

        table = need.mapInArrow(keys, "k long, h long, flag long").toArrow().sort_by("k")
        k, flag = table.column("k").to_numpy(), table.column("flag").to_numpy()
        shared = need.sparkSession.sparkContext.broadcast((k, flag, np.unique(table.column("h").to_numpy())))

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reps, flags, hashes = shared.value
            for batch in batches:
                rows = []
                for key, doc, b in _texts(batch):
                    found = _contexts_of(b, hashes)
                    own = np.array([_rep_key(*x[:4], key, doc) for x in found], np.int64)
                    hit = _shared(reps, own)
                    at = np.searchsorted(reps, own)
                    rows += [(*x, bool(flags[p] & 1), bool(flags[p] & 2), b[s[0] : s[0] + x[4] + LENGTH]) for (x, s), y, p in zip(found.items(), hit, at, strict=True) if y]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(out), out, strict=True)], schema=out)

        return texts.mapInArrow(pick, _WITH_BYTES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, classes in zip(batch.column("text").to_pylist(), batch.column("classes").to_pylist(), strict=True):
                b = (t or "").encode("utf-8", "replace")
                rows += [(c["h"], c["o"], c["c1"], c["c2"], c["r"], c["twice"], c["large"], b[c["start"] : c["start"] + c["r"] + LENGTH]) for c in classes]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(out), out, strict=True)], schema=out)

    classes = need.groupBy(F.col("key").alias("_key"), F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct(*_KEY, "r", "twice", "large", "start")).alias("classes"))
    joined = texts.join(classes, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).select("text", "classes")
    return joined.mapInArrow(cut, _WITH_BYTES)


_VERDICT = "h long, o int, c1 long, c2 long, ranges array<int>"
_VERDICT_SCHEMA = pa.schema([("h", pa.int64()), ("o", pa.int32()), ("c1", pa.int64()), ("c2", pa.int64()), ("ranges", pa.list_(pa.int32()))])
#: Bytes of contexts that are sorted at a time; an anchor hash's contexts are never parted.
AT_ONCE = 4_000_000


def _sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decides all contexts of a partition that is sorted by anchor hash."""

    def done(held: dict[tuple, tuple]) -> pa.RecordBatch:
        found = decide([(k[0], k[1], *v) for k, v in held.items()])
        rows = [(*k, x) for (k, v), x in zip(held.items(), found, strict=True) if not v[1] and x]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, _VERDICT_SCHEMA, strict=True)], schema=_VERDICT_SCHEMA)

    held: dict[tuple, tuple] = {}
    size, current = 0, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("h", "o", "c1", "c2", "r", "twice", "bytes")]
        for h, o, c1, c2, r, twice, b in zip(*columns, strict=True):
            if size > AT_ONCE and h != current:
                yield done(held)
                held, size = {}, 0
            current = h
            held[h, o, c1, c2] = (r, twice, b)
            size += len(b)
    if held:
        yield done(held)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window: its class, place and hash."""
    for batch in batches:
        for h, o, c1, c2, r, twice, b in zip(*(batch.column(c).to_pylist() for c in ("h", "o", "c1", "c2", "r", "twice", "bytes")), strict=True):
            d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b[i : i + LENGTH]) for i in range(r + 1)), "<i8").reshape(-1, 2)
            n = r + 1
            yield pa.RecordBatch.from_pydict({"h": np.full(n, h), "o": np.full(n, o, np.int32), "c1": np.full(n, c1), "c2": np.full(n, c2), "i": np.arange(n, dtype=np.int32), "w1": d[:, 0], "w2": d[:, 1], "m": np.full(n, 2 if twice else 1)})


def repeated_windows(texts: DataFrame, broadcast: int = BROADCAST, group: int = GROUP) -> DataFrame:
    """(key, spans) for texts (key, doc_id, text) that have repeated windows: spans are flat byte ranges [start, end, ...] that neither touch nor overlap."""
    hashes = checkpointed(texts.mapInArrow(_anchor_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"))
    wanted = None
    if small(hashes, broadcast):
        wanted = texts.sparkSession.sparkContext.broadcast(np.sort(hashes.toArrow().column("h").to_numpy()))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, doc, b in _texts(batch):
                rows += [(*c, len(s), s, key, doc) for c, s in _contexts_of(b, wanted.value if wanted else None).items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 9, _CONTEXT_TYPES, strict=True)], names=["h", "o", "c1", "c2", "r", "n", "starts", "key", "doc_id"])

    found = texts.mapInArrow(contexts, _CONTEXTS)
    if wanted is None:
        found = found.join(hashes, "h", "left_semi")
    rep = F.min(F.struct("key", "doc_id", F.element_at("starts", 1).alias("start")))
    classes = found.groupBy(*_KEY, "r").agg(F.sum("n").alias("n"), rep.alias("rep"))
    classes = checkpointed(classes.select(*_KEY, "r", (F.col("n") > 1).alias("twice"), "rep.*"))
    groups = classes.groupBy("h").agg(F.count("*").alias("d"), F.min("twice").alias("all_twice"))
    need = classes.join(groups.where("d > 1 AND NOT all_twice"), "h").withColumn("large", F.col("d") > group).drop("d", "all_twice")
    need = checkpointed(need)
    given, large = _with_bytes(texts, need, broadcast), not need.where("large").isEmpty()
    if large:
        given = checkpointed(given)
    sorted_ = given.where("NOT large").repartition("h").sortWithinPartitions("h").mapInArrow(_sort_groups, _VERDICT)
    verdict = classes.where("twice").select(*_KEY, F.array(F.lit(0), "r").alias("ranges")).unionByName(sorted_)
    if large:
        windows = given.where("large").dropDuplicates([*_KEY]).mapInArrow(_windows, "h long, o int, c1 long, c2 long, i int, w1 long, w2 long, m long")
        counts = windows.groupBy("w1", "w2").agg(F.sum("m").alias("_m")).where("_m > 1").select("w1", "w2")
        single = windows.where("m = 1").join(counts, ["w1", "w2"], "left_semi")
        verdict = verdict.unionByName(single.groupBy(*_KEY).agg(F.collect_list("i").alias("i")).select(*_KEY, F.flatten(F.transform("i", lambda i: F.array(i, i))).alias("ranges")))
    hits = found.select(*_KEY, "starts", "key").join(verdict, _KEY)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, own in zip(batch.column("key").to_pylist(), batch.column("own").to_pylist(), strict=True):
                r = np.array([(s + lo, s + hi + LENGTH) for x in own for s in x["starts"] for lo, hi in zip(x["ranges"][::2], x["ranges"][1::2], strict=True)], np.int64)
                r = r[np.argsort(r[:, 0], kind="stable")]
                reach = np.maximum.accumulate(r[:, 1])
                new = np.concatenate(([True], r[1:, 0] > reach[:-1]))
                rows.append((key, np.stack((r[new, 0], reach[np.concatenate((new[1:], [True]))]), axis=1).ravel()))
            yield pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in rows], pa.binary()), "spans": pa.array([s for _, s in rows], pa.list_(pa.int64()))})

    # equal texts have equal hits; a text's contexts are as many as it has
    by_text = hits.groupBy("key").agg(F.collect_set(F.struct("starts", "ranges")).alias("own"))
    return by_text.mapInArrow(merge, "key binary, spans array<long>")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("key"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast: int = BROADCAST, group: int = GROUP) -> DataFrame:
    """A row for each document: doc_id, n_bytes, spans (flat byte ranges that go), kept (the other bytes)."""
    text_batches(docs.sparkSession)
    texts = _keyed(docs, doc_id, text)
    spans = repeated_windows(texts, broadcast, group)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                all_, kept = [], []
                for t, s in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    b, s = (t or "").encode("utf-8", "replace"), s or []
                    all_.append(len(b))
                    kept.append(b"".join(b[x:y] for x, y in zip([0, *s[1::2]], [*s[::2], len(b)], strict=True)))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_bytes": pa.array(all_, pa.int64()), "spans": part.column("spans"), "kept": pa.array(kept, pa.binary())})

    return texts.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_bytes long, spans array<long>, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(documents(spark, sf_dir))
    n = F.coalesce(F.size("spans"), F.lit(0))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), (F.greatest(n, F.lit(0)) / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
