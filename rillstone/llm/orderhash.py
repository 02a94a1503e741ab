"""Document fingerprints by Order MinHash, within DataFrame functions.

A text's k-mers are its runs of ``K`` words (words longer than ``CUT`` characters are cut into pieces of that length, so
texts without blanks have k-mers too), each with its occurrence number. A hash of k-mer and number is its point on a circle.
From each of ``BINS`` fixed points of the circle the next ``TUPLE`` k-mers are taken, put back in the order of the text, and
hashed as a tuple. Two texts share a bin's tuple only if they have the same next k-mers in the same order, so the share of equal
bins falls with edit distance and not only with the sets of words. The rule is the same for texts of all lengths: short ones
find the next k-mers beyond the bin, where other bins may find them too.

All of it happens in arrays within a row: no Python, and no rows by word. The next document comes from a window within
ranges of ids, to each of which a copy of the following range's first document is added; the ranges' borders are
about quantiles, so no single task orders all documents. There are ``RANGES``, or as many more as keep a range to about
``RANGE_CHARS`` characters, up to ``MAX_RANGES``; their first ids are collected.

Defined results: null texts are empty. Texts without words have the empty fingerprint, which is like itself and nothing
else. With no more than ``K`` words, all words are the one k-mer. K-mers of a text count as the same, for their occurrence numbers,
if 40 bits of their hashes are equal. Null ids come first, as -2**63; rows with equal ids
are ordered by their texts' hashes (and share a task). A single document is its own next one. An empty table gives an empty one. Other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents
from .native import PLACES, Packed, Wide, let, words

K, TUPLE, BINS, CUT = 2, 2, 64, 16
#: Ranges of ids for the search of next documents.
RANGES, RANGE_CHARS, MAX_RANGES = 2000, 1 << 28, 20_000


def _bin(x: Column) -> Column:
    """-BINS/2 to BINS/2 - 1, in the order of the circle."""
    return F.shiftright(x, 58).cast("int")


def _kmers(text: Column) -> Column:
    cut = F.regexp_replace(text, r"([^\x20\x09-\x0D]{%d})(?=[^\x20\x09-\x0D])" % CUT, "$1 ")
    many = lambda h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - (K - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, K)]))
    few = lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(h)))
    return let(F.transform(words(cut), lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) > K, many(h)).otherwise(few(h)))


def _occurrence(s: Column, x: Column, i: Column, of: type) -> Column:
    """How many equal k-mers stand before place i of the sorted array, by doubling steps."""
    same = lambda back: F.coalesce(F.when(i >= back, of.same(F.get(s, i - back), x)), F.lit(False))
    steps = F.array(*[F.lit(1 << b) for b in range(29, -1, -1)])
    count = F.aggregate(steps, F.lit(0), lambda n, b: F.when(same(n + b), n + b).otherwise(n))
    return F.when(~same(F.lit(1)), F.lit(0)).when(~same(F.lit(2)), F.lit(1)).otherwise(count)


def _tuples(kmers: Column, of: type) -> Column:
    """The fingerprint of a text's k-mers, if there are any."""
    number = lambda s, x, i: F.xxhash64(F.get(kmers, of.place(x)).bitwiseAND(F.lit((1 << 40) - 1)), _occurrence(s, x, i, of))

    def of_circle(r: Column) -> Column:
        n, half = F.size(r), BINS // 2
        begins = F.filter(F.transform(r, lambda x, i: F.when((i == 0) | (_bin(of.rank(F.get(r, i - 1))) != _bin(of.rank(x))), i)), lambda i: i.isNotNull())
        at = lambda i: _bin(of.rank(F.get(r, i)))

        def starts(b: Column) -> Column:
            """The place in r of the first k-mer from each of the fixed points."""
            last = at(F.get(b, F.size(b) - 1))
            before = F.flatten(F.transform(b, lambda i, k: F.array_repeat(i, F.when(k == 0, at(i) + half + 1).otherwise(at(i) - at(F.get(b, k - 1))))))
            return F.concat(before, F.array_repeat(F.lit(0), half - 1 - last))

        def hashed(i: Column, k: Column) -> Column:
            places = F.array_sort(F.transform(F.sequence(F.lit(0), F.least(F.lit(TUPLE), n) - 1), lambda j: of.place(F.get(r, (i + j) % n))))
            whole = let(places, lambda p: F.xxhash64(*[F.get(kmers, F.get(p, j)) for j in range(TUPLE)]))  # nulls do not count
            return F.shiftleft(k.cast("long"), 32).bitwiseOR(whole.bitwiseAND(F.lit(0xFFFFFFFF)))

        return F.transform(let(begins, starts), hashed)

    points = lambda s: F.sort_array(F.transform(s, lambda x, i: of.make(number(s, x, i), of.place(x))))
    return let(let(F.sort_array(F.transform(kmers, lambda x, i: of.make(x, i))), points), of_circle)


def fingerprint(text: Column) -> Column:
    """An array with a long for every bin, its number above the 32-bit hash of its tuple; without k-mers it is empty."""
    return let(_kmers(text), lambda k: F.when(F.size(k) == 0, F.array().cast("array<bigint>")).when(F.size(k) < PLACES, _tuples(k, Packed)).otherwise(_tuples(k, Wide)))


def likeness(a: Column, b: Column) -> Column:
    """The share of bins with equal tuples among those that either fingerprint has; 1 for two empty ones."""
    bins = lambda x: F.transform(x, lambda y: F.shiftright(y, 32))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def as_text(f: Column) -> Column:
    return F.array_join(F.transform(f, lambda x: F.lower(F.lpad(F.hex(x), 10, "0"))), "")


def with_next(docs: DataFrame, *columns: str, ranges: int | None = None) -> DataFrame:
    """``docs`` (doc_id and others) with _next, a struct of ``columns`` of the next document by id; after the last comes the first."""
    keyed = docs.withColumn("_id", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))))
    if ranges is None:
        chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
        ranges = min(max(RANGES, chars // RANGE_CHARS), MAX_RANGES)
    shares = [i / ranges for i in range(1, ranges)]

    def range_of(bounds: list[int]) -> Column:
        steps = F.array(*[F.lit(1 << b) for b in range(len(bounds).bit_length() - 1, -1, -1)])
        return F.aggregate(steps, F.lit(0), lambda n, b: F.when(F.coalesce(F.get(F.lit(bounds), n + b - 1) <= F.col("_id"), F.lit(False)), n + b).otherwise(n)) - 1

    ids = keyed.select("_id")
    about = ids.agg(F.percentile_approx("_id", shares, 10 * ranges)).first()[0] or []
    firsts = sorted(r[0] for r in ids.groupBy(range_of(sorted({-(1 << 63), *about}))).agg(F.min("_id")).select("min(_id)").collect()) or [0]
    own = keyed.withColumn("_range", range_of(firsts)).withColumn("_copy", F.lit(0))
    after = own.where(F.col("_id").isin(firsts)).withColumn("_range", F.pmod(F.col("_range") - 1, F.lit(len(firsts)))).withColumn("_copy", F.lit(1))
    order = Window.partitionBy("_range").orderBy("_copy", "_id", "_order")
    all_ = own.unionByName(after).withColumn("_order", F.xxhash64("text"))
    return all_.withColumn("_next", F.lead(F.struct(*columns)).over(order)).where("_copy = 0").drop("_id", "_range", "_copy", "_order")


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of a text column."""
    return docs.withColumn(out, fingerprint(F.coalesce(F.col(text), F.lit(""))))


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fingerprints(documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    both = with_next(docs, "text", "fingerprint")
    n = F.length("text")
    moved = F.floor(n / 4).cast("int")
    edited = both.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", F.col("_next.fingerprint").alias("_of_next"), F.concat(F.substring("text", F.lit(1), n - moved), F.substring("_next.text", F.lit(1), moved)).alias("edited"))
    edited = fingerprints(edited, "edited", "edited_fingerprint")
    f, e = F.col("fingerprint"), F.col("edited_fingerprint")
    return edited.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(f).alias("fingerprint"), as_text(e).alias("edited_fingerprint"), likeness(f, e).alias("near_edited"), likeness(f, F.col("_of_next")).alias("near_next"))
