"""Language identification by hierarchical discrimination.

A linear support vector machine for each language family against the rest picks the family; within a family, one linear
machine for each pair of its languages votes. Features are hashed 1- to 3-grams of letters over the whole text, as
square roots of counts, scaled to length one.

The machines are fitted in one task to a bounded sample: at most ``total`` rows, equally many of each language as far
as there are, chosen by a hash of doc_id, one row of an id (the least text); only their sparse feature vectors go
there. Learned are the ``LANGUAGES`` most frequent values of lang. Predictions cover all rows.

Defined results: null texts and texts without a letter are ``und`` with score 0. Rows with null doc_id, null text or
null lang are not learned from; held_out is false for a null doc_id. With a single learned language every text with a
letter gets it, with score 1; with none, all are ``und``. Repeated rows are predicted each. Other columns are kept, but
for those named lang_pred and score.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_batches

#: Families of language codes; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"),
    "indic": ("hi", "ur", "bn", "mr", "gu", "pa", "ne", "si"),
    "semitic": ("ar", "he", "am", "mt"),
    "turkic": ("tr", "az", "kk", "uz", "tk", "ky"),
    "uralic": ("fi", "et", "hu"),
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
DIMENSIONS = 1 << 12
#: The bound of the sample that is learned from, in rows.
TOTAL = 6000
#: The bound of the number of languages that are learned.
LANGUAGES = 500
#: One document in so many is held out of learning, and the remainder that is.
PARTS, HELD_OUT = 4, 2


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def features(text: str | None) -> np.ndarray | None:
    """The text's vector, or None for one without a letter."""
    x = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
    letter = _letters()[x]
    if not letter.any():
        return None
    x = np.where(letter, x, 0)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one separator after each word
    x, letter = np.concatenate(([0], x[keep])).astype(np.uint32), np.concatenate(([False], letter[keep]))
    with np.errstate(over="ignore"):
        one = x * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (x[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
        three = (two[:-1] ^ (x[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    grams = [one[letter], two, three] if len(x) > 2 else [one[letter], two]
    counts = np.bincount(np.concatenate(grams) >> np.uint32(20), minlength=DIMENSIONS)
    v = np.sqrt(counts).astype(np.float32)
    return v / np.linalg.norm(v)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, rounds: int = 150) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss for labels of 1 and -1, by accelerated gradient steps. Classes weigh the same."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    step = 1 / (1 / c + 2 * 2)  # rows have length sqrt(2) with the bias
    w = z = np.zeros(x.shape[1] + 1, np.float32)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ z[:-1] + z[-1]))
        pull = -2 * weight * slack * y
        grad = np.append(x.T @ pull, pull.sum()) + np.append(z[:-1], 0) / c
        new = (z - step * grad).astype(np.float32)
        w, z = new, new + k / (k + 3) * (new - w)
    return w


class Model:
    """The machines; ``predict`` is what tasks call."""

    def __init__(self, langs: list[str], families: list[str], by_family: np.ndarray, pairs: dict[tuple[str, str], np.ndarray]):
        self.langs, self.families, self.by_family, self.pairs = langs, families, by_family, pairs
        self.members = {f: [x for x in langs if FAMILY.get(x, x) == f] for f in families}

    @classmethod
    def fit(cls, x: np.ndarray, labels: list[str]) -> Model:
        langs = sorted(set(labels))
        families = sorted({FAMILY.get(lang, lang) for lang in langs})
        own, family = np.array(labels, object), np.array([FAMILY.get(lang, lang) for lang in labels], object)
        by_family = np.array([fit_svm(x, np.where(family == f, 1, -1).astype(np.float32)) for f in families]) if len(families) > 1 else np.zeros((len(families), DIMENSIONS + 1), np.float32)
        pairs = {}
        for f in families:
            for a, b in combinations([lang for lang in langs if FAMILY.get(lang, lang) == f], 2):
                of = (own == a) | (own == b)
                pairs[a, b] = fit_svm(x[of], np.where(own[of] == a, 1, -1).astype(np.float32))
        return cls(langs, families, by_family, pairs)

    def predict(self, text: str | None) -> tuple[str, float]:
        v = features(text) if self.langs else None
        if v is None:
            return "und", 0.0
        squash = lambda m: float(1 / (1 + np.exp(-4 * np.clip(m, -20, 20))))
        score, family = 1.0, self.families[0]
        if len(self.families) > 1:
            margins = self.by_family[:, :-1] @ v + self.by_family[:, -1]
            family, score = self.families[int(margins.argmax())], squash(margins.max())
        votes = {lang: [0, 0.0] for lang in self.members[family]}
        for a, b in combinations(self.members[family], 2):
            m = float(self.pairs[a, b][:-1] @ v + self.pairs[a, b][-1])
            votes[a if m >= 0 else b][0] += 1
            votes[a][1] += m
            votes[b][1] -= m
        best = max(votes, key=lambda lang: (votes[lang], lang))
        return best, score * (squash(votes[best][1] / (len(votes) - 1)) if len(votes) > 1 else 1.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % PARTS == HELD_OUT, F.lit(False))


def drawn(docs: DataFrame, total: int = TOTAL) -> tuple[DataFrame, int]:
    """The sample (at, lang, text), drawn a little too large, and how many rows of each language to keep."""
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    each = max(total // max(len(counts), 1), 1)
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, 1.1 * each / n))]) if counts else F.create_map().cast("map<string,double>")
    some = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    # a repeated id draws all its rows: one of them is learned from
    return some.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("_row")).select(F.xxhash64("doc_id").alias("at"), "_row.*"), each


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(a, lang, v) for a, lang, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) if (v := features(t)) is not None]
        at = [np.flatnonzero(v).astype("<u2") for _, _, v in found]
        yield pa.RecordBatch.from_pydict({"at": pa.array([a for a, _, _ in found], pa.int64()), "lang": pa.array([x for _, x, _ in found], pa.string()), "i": pa.array([i.tobytes() for i in at], pa.binary()), "v": pa.array([v[i].tobytes() for i, (_, _, v) in zip(at, found, strict=True)], pa.binary())})


def learn(docs: DataFrame, total: int = TOTAL) -> Model:
    """Fits the machines to rows of ``docs`` (doc_id, text, lang) that are not held out; see above for the bound. One task fits them, and only the machines go to the driver."""
    sample, each = drawn(docs, total)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        labels, kept = [], []
        for _, lang, v, i in sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("at", "lang", "v", "i")), strict=True)):
            seen[lang] = seen.get(lang, 0) + 1
            if seen[lang] <= each:
                labels.append(lang)
                kept.append((i, v))
        x = np.zeros((len(kept), DIMENSIONS), np.float32)
        for k, (i, v) in enumerate(kept):
            x[k, np.frombuffer(i, "<u2")] = np.frombuffer(v, "<f4")
        del kept
        if labels:
            yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(Model.fit(x, labels))], pa.binary())})

    found = sample.mapInArrow(_vectors, "at long, lang string, i binary, v binary").repartition(1).mapInArrow(fit, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else Model([], [], np.zeros((0, DIMENSIONS + 1), np.float32), {})


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    # else Spark copies it below a filter on lang_pred, and each task predicts twice, in two Python workers
    predict = predict.asNondeterministic()
    return docs.drop("lang_pred", "score").withColumn("_language", predict(F.col(text))).select("*", "_language.lang_pred", "_language.score").drop("_language")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
