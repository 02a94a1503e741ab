"""Quality rules: counts of a text, base rules, and robust multivariate outliers.

Four transformed statistics of a document (log of the mean word length; square roots of the share of symbols, of
repeated lines, of words in repeated windows) are compared with the minimum-covariance-determinant estimate of its
language and source: from three starts (medians and quartile ranges; all rows; spatial signs), concentration steps take
the mean and covariance of the ``KEEP`` share of rows that is nearest by Mahalanobis distance, and of the three results the
one of least determinant stands. Rows beyond ``CUTOFF`` of it are
rejected. Every step is a sum by group with map-side partial sums; the nearest share comes from a histogram of the
logarithm of the distance, whose last bin counts in part, so no group is sorted or gathered. What a group is too small for comes from its language,
then from all rows. ``FLOOR`` is added to the covariance, for statistics that are 0 in most rows of a group.

Defined results: a null text has no words; it fails the base rules (under 50 words). Null languages and sources are
groups of their own. Rows that fail the base rules take no part in the estimates. With under ``LEAST`` rows in all,
nothing is rejected beyond the base rules. Repeated rows count each. An empty table gives an empty one. Other columns
are kept, but for those with the names of results; working columns begin with an underscore. Windows are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, documents, small
from .native import BLANKS, PLACES, let, packed, same_high, unpacked, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "base_failed", "distance", "kept")
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
KEEP, STEPS, LEAST = 0.75, 4, 100
#: Standard deviations that are added (in squares) to those of the four statistics.
FLOOR = (0.05, 0.05, 0.15, 0.15)
#: A squared distance; of normal rows, one in 100,000 is beyond it.
CUTOFF = 28.5
DIMS = len(FLOOR)
X = [f"_x{i}" for i in range(DIMS)]
#: Estimates of up to this number of groups are broadcast; more are joined by shuffle.
BROADCAST_GROUPS = 50_000


def _hashes(own: Column) -> Column:
    """A hash for each window of ``WINDOW`` words."""
    of = lambda h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))
    return let(F.transform(own, lambda w: F.xxhash64(w)), of)


def _repeat_words(own: Column) -> Column:
    """The number of words in windows that stand in the text more than once."""

    def covered(h: Column) -> Column:
        near = lambda s, x, k: same_high(F.get(s, k), x) & (F.get(h, unpacked(F.get(s, k))) == F.get(h, unpacked(x)))
        twice = lambda near: lambda s: F.filter(s, lambda x, i: F.coalesce(F.when(i > 0, near(s, x, i - 1)), F.lit(False)) | F.coalesce(near(s, x, i + 1), F.lit(False)))
        short = F.transform(let(F.sort_array(F.transform(h, lambda x, i: packed(x, i))), twice(near)), unpacked)
        # places beyond 24 bits: pairs instead
        long = F.transform(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), twice(lambda s, x, k: F.get(s, k)["h"] == x["h"])), lambda x: x["i"])
        places = F.sort_array(F.when(F.size(h) < PLACES, short).otherwise(long))
        return let(places, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x))

    return let(_hashes(own), covered)


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words (long) and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    counted = docs.withColumn("_t", t).withColumn("_of", let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("repeat"))))
    counted = counted.withColumn("_lines", let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("distinct"))))
    counted = counted.select(
        *[c for c in docs.columns if c not in (text, *COUNTS)],
        F.col("_of.n").alias("n_words"),
        F.length(F.translate("_t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.col("_lines.n") - F.col("_lines.distinct")).alias("n_dup_lines"),
        F.col("_lines.n").alias("n_lines"),
        F.col("_of.repeat").alias("n_repeat_words"),
    )
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def statistics() -> list[Column]:
    one = lambda c: F.greatest(F.col(c), F.lit(1)).cast("double")
    return [F.log(F.greatest(F.col("word_chars") / one("n_words"), F.lit(1.0))), F.sqrt(F.col("n_symbols") / one("word_chars")), F.sqrt(F.col("n_dup_lines") / one("n_lines")), F.sqrt(F.col("n_repeat_words") / one("n_words"))]


def _consistency() -> float:
    """By what the covariance of the nearest share of normal rows falls short; closed forms for four dimensions."""
    cdf4 = lambda x: 1 - math.exp(-x / 2) * (1 + x / 2)
    lo, hi = 0.0, 100.0
    for _ in range(80):
        lo, hi = ((lo + hi) / 2, hi) if cdf4((lo + hi) / 2) < KEEP else (lo, (lo + hi) / 2)
    return KEEP / (1 - math.exp(-lo / 2) * (1 + lo / 2 + lo * lo / 8))


PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]


def _estimate(mean: list[Column], cov: dict[tuple[int, int], Column], *others: Column) -> list[Column]:
    """Means and the Cholesky factor of the covariance with its floor, as columns _m0.. and _l00.."""
    low: dict[tuple[int, int], Column] = {}
    for i in range(DIMS):
        for j in range(i + 1):
            rest = reduce(lambda a, k: a - low[i, k] * low[j, k], range(j), cov[i, j] + (FLOOR[i] ** 2 if i == j else 0.0))  # noqa: B023
            low[i, j] = F.sqrt(F.greatest(rest, F.lit(FLOOR[i] ** 2 / 4))) if i == j else rest / low[j, j]
    return [*others, *[mean[i].alias(f"_m{i}") for i in range(DIMS)], *[low[p].alias(f"_l{p[0]}{p[1]}") for p in PAIRS]]


def _distance() -> Column:
    """The squared Mahalanobis distance of _x0.. by _m0.. and _l00.., by forward substitution."""
    y: list[Column] = []
    for i in range(DIMS):
        y.append(reduce(lambda a, k: a - F.col(f"_l{i}{k}") * y[k], range(i), F.col(X[i]) - F.col(f"_m{i}")) / F.col(f"_l{i}{i}"))  # noqa: B023
    return reduce(lambda a, b: a + b, [v * v for v in y])


def _with(rows: DataFrame, estimates: DataFrame, how: str = "inner", on: str | list[str] = "_key") -> DataFrame:
    return rows.join(F.broadcast(estimates) if small(estimates, BROADCAST_GROUPS) else estimates, on, how)


def _moments(y: list[Column], prefix: str, weight: Column | None = None) -> list[Column]:
    """Sums of ``y`` and of the products of its pairs, named by ``prefix``."""
    w = F.lit(1.0) if weight is None else weight
    return [*[F.sum(w * v).alias(f"{prefix}{i}") for i, v in enumerate(y)], *[F.sum(w * y[i] * y[j]).alias(f"{prefix}{i}{j}") for i, j in PAIRS]]


def _mean_cov(prefix: str, n: str, scale: float = 1.0) -> tuple[list[Column], dict[tuple[int, int], Column]]:
    mean = [F.col(f"{prefix}{i}") / F.col(n) for i in range(DIMS)]
    return mean, {(i, j): (F.col(f"{prefix}{i}{j}") / F.col(n) - mean[i] * mean[j]) * scale for i, j in PAIRS}


def _starts(rows: DataFrame) -> DataFrame:
    """Three estimates by _key to begin from: 0, medians and quartile ranges; 1, mean and covariance of all rows; 2, medians and
    the covariance of the directions from them (spatial signs)."""
    bins = rows.select("_key", F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.floor(F.col(x) * 256).cast("int").alias("bin")) for i, x in enumerate(X)])).alias("_b"))
    bins = bins.groupBy("_key", "_b.dim", "_b.bin").agg(F.count("*").alias("n"))
    upto, all_ = Window.partitionBy("_key", "dim").orderBy("bin"), Window.partitionBy("_key", "dim")
    bins = bins.select("*", (F.sum("n").over(upto) / F.sum("n").over(all_)).alias("upto"))
    at = lambda i, q: F.min(F.when((F.col("dim") == i) & (F.col("upto") >= q), (F.col("bin") + 0.5) / 256))
    quart = bins.groupBy("_key").agg(*[at(i, q).alias(f"q{i}_{int(100 * q)}") for i in range(DIMS) for q in (0.25, 0.5, 0.75)], F.sum(F.when(F.col("dim") == 0, F.col("n"))).alias("_n"))
    spread = lambda i: F.pow((F.col(f"q{i}_75") - F.col(f"q{i}_25")) / 1.349, F.lit(2.0))
    quart = checkpointed(quart.select("_key", "_n", *[F.col(f"q{i}_50").alias(f"_q{i}") for i in range(DIMS)], *[spread(i).alias(f"_v{i}") for i in range(DIMS)]))

    sd = [F.sqrt(F.col(f"_v{i}") + FLOOR[i] ** 2) for i in range(DIMS)]
    u = [(F.col(x) - F.col(f"_q{i}")) / sd[i] for i, x in enumerate(X)]
    size = F.greatest(F.sqrt(reduce(lambda a, b: a + b, [v * v for v in u])), F.lit(1e-9))
    same = [f"_q{i}" for i in range(DIMS)] + [f"_v{i}" for i in range(DIMS)]
    found = _with(rows, quart).select("_key", "_n", *same, *X, *[(v / size).alias(f"_u{i}") for i, v in enumerate(u)])
    found = checkpointed(found.groupBy("_key", "_n").agg(*[F.first(c).alias(c) for c in same], *_moments([F.col(x) for x in X], "_s"), *_moments([F.col(f"_u{i}") for i in range(DIMS)], "_t")))
    medians, spreads = [F.col(f"_q{i}") for i in range(DIMS)], {(i, j): F.col(f"_v{i}") if i == j else F.lit(0.0) for i, j in PAIRS}
    signs = {(i, j): DIMS * F.col(f"_t{i}{j}") / F.col("_n") * sd[i] * sd[j] for i, j in PAIRS}
    starts = [(medians, spreads), _mean_cov("_s", "_n"), (medians, signs)]
    return reduce(DataFrame.union, [found.select(*_estimate(*start, F.col("_key"), F.lit(k).alias("_start"), F.col("_n"))) for k, start in enumerate(starts)])


def fit(rows: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimates by _key of a table with _x0 to _x3: _key, _n, _m0.., _l00.."""
    own = ["_key", "_start"]
    estimates = checkpointed(_starts(rows))
    for step in range(STEPS):
        near = _with(rows, estimates).select(*own, "_n", *X, F.floor(32 * F.log2(_distance() + 2.0**-16)).cast("int").alias("_bin"))
        counts = near.groupBy(*own, "_bin").agg(F.count("*").alias("n"), F.first("_n").alias("_n"))
        reach = counts.select(*own, "_bin", "n", "_n", F.sum("n").over(Window.partitionBy(*own).orderBy("_bin")).alias("upto")).where(F.col("upto") >= KEEP * F.col("_n"))
        # the last bin counts with the weight that makes the sum of weights the share itself
        reach = reach.groupBy(*own).agg(F.min(F.struct("_bin", (1 - (F.col("upto") - KEEP * F.col("_n")) / F.col("n")).alias("part"))).alias("_r"))
        reach = checkpointed(reach.select(*own, F.col("_r._bin").alias("_reach"), F.col("_r.part").alias("_part")))
        chosen = _with(near, reach, on=own).where("_bin <= _reach").withColumn("_w", F.when(F.col("_bin") < F.col("_reach"), 1.0).otherwise(F.col("_part")))
        sums = chosen.groupBy(*own, "_n").agg(F.sum("_w").alias("_c"), *_moments([F.col(x) for x in X], "_s", F.col("_w")))
        estimates = checkpointed(sums.select(*_estimate(*_mean_cov("_s", "_c", _consistency() if step == STEPS - 1 else 1.0), *map(F.col, own), F.col("_n"))))
    det = reduce(lambda a, b: a + b, [F.log(F.col(f"_l{i}{i}")) for i in range(DIMS)])
    best = estimates.groupBy("_key").agg(F.min_by(F.struct(*[c for c in estimates.columns if c not in own]), F.struct(det, "_start")).alias("_best"))
    return best.select("_key", "_best.*")


def _keys(lang: str, source: str) -> list[Column]:
    own = lambda level, *of: F.to_json(F.struct(F.lit(level).alias("level"), *of))
    k, s = F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source")
    return [own(2, k, s), own(1, k), own(0)]


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``docs`` without the text, with the counts, base_failed, distance (null where there is no estimate) and kept."""
    marked = with_counts(docs, text).withColumns(dict(zip(X, statistics(), strict=True)) | {f"_k{i}": k for i, k in enumerate(_keys(lang, source))})
    marked = checkpointed(marked)
    rows = marked.where(~F.col("base_failed")).select(F.explode(F.array("_k0", "_k1", "_k2")).alias("_key"), *X)
    estimates = fit(rows).where(F.col("_n") >= LEAST)
    found = marked
    for i in range(3):
        found = _with(found.withColumn("_key", F.col(f"_k{i}")), estimates, "left").withColumn(f"_d{i}", _distance()).drop("_key", *estimates.columns)
    found = found.withColumn("distance", F.coalesce("_d0", "_d1", "_d2"))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)
    return found.withColumn("kept", kept).drop(*X, "_k0", "_k1", "_k2", "_d0", "_d1", "_d2")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
