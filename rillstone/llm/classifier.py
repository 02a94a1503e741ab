"""Quality classifier with hierarchical empirical Bayes.

Document evidence: a logistic regression on hashed 1- to 3-grams of characters and a few ratios of the whole text, fitted
on the driver to a bounded sample of labelled documents (about ``SAMPLE`` at most, chosen by a hash of doc_id, one row of an id,
that of the greatest text; their sparse vectors alone are collected). Site evidence: sums by host and by path of the labels, and of the predicted
probabilities where there is no label. A host's rate is a beta posterior around the global rate, a path's around its
host's; the priors' strengths are moment estimates of the spread between hosts and between the paths of a host, so sparse
sites shrink to their parents. A document's own evidence is taken out of its site's sums before the two are combined as
odds.

Sums are grouped with map-side partial sums; site tables are broadcast where small and joined by shuffle beyond that.

Defined results: null and empty texts have no document evidence and get their site's rate. Null hosts and paths are sites
of their own. Labels that are null, or of documents that do not exist, do not count; a document's repeated labels are
averaged. With labels of one class or none, only site rates speak. Null and equal ids keep their rows. An empty table gives
an empty one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, documents, small, text_batches

#: The bound of the sample that is learned from, in rows.
SAMPLE = 4000
DIMENSIONS = 1 << 12
RATIOS = 5
#: Documents with a smaller probability of being good are not kept.
THRESHOLD = 0.5
BROADCAST_SITES = 100_000


def features(text: str | None) -> np.ndarray:
    """The text's vector: gram counts (square roots, length one) and ratios."""
    out = np.zeros(DIMENSIONS + RATIOS, np.float32)
    if not text:
        return out
    x = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint32)
    with np.errstate(over="ignore"):
        one = x * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (x[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
        three = (two[:-1] ^ (x[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1) if len(x) > 2 else two[:0]
    counts = np.bincount(np.concatenate((one, two, three)) >> np.uint32(20), minlength=DIMENSIONS)
    grams = np.sqrt(counts)
    out[:DIMENSIONS] = grams / np.linalg.norm(grams)
    words = text.split()
    blank = np.count_nonzero((x == 32) | ((x >= 9) & (x <= 13)))
    upper = np.count_nonzero((x >= 65) & (x <= 90))
    letters = np.count_nonzero((x >= 97) & (x <= 122)) + upper
    marks = np.count_nonzero((x < 128) & (x > 32)) - letters
    out[DIMENSIONS:] = len(set(words)) / max(len(words), 1), upper / max(letters, 1), marks / len(x), blank / len(x), min(np.log1p(len(words)) / 10, 1)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 2e-5, rounds: int = 300) -> np.ndarray:
    """Weights and bias by accelerated gradient steps on the mean log loss with an L2 penalty."""
    step = 1 / (0.25 * float((x * x).sum(axis=1).max() + 1) + penalty)
    w = z = np.zeros(x.shape[1] + 1, np.float64)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-(x @ z[:-1].astype(np.float32) + z[-1])))
        grad = np.append(x.T @ (p - y).astype(np.float32), (p - y).sum()) / len(y) + penalty * np.append(z[:-1], 0)
        new = z - step * grad
        w, z = new, new + k / (k + 3) * (new - w)
    return w


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray | None, float]:
    """Weights (None without labels of both classes) and the sample's share of good documents. ``labels`` has doc_id and y."""
    n = labels.count()
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < min(1.0, sample / max(n, 1)) * (1 << 30))
    drawn = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max(F.struct("text", "y")).alias("_row")).select("_row.*")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column("text").to_pylist()]
            at = [np.flatnonzero(v).astype("<u2") for v in found]
            yield pa.RecordBatch.from_pydict({"i": pa.array([i.tobytes() for i in at], pa.binary()), "v": pa.array([v[i].tobytes() for i, v in zip(at, found, strict=True)], pa.binary()), "y": batch.column("y")})

    rows = sorted(drawn.mapInArrow(vectors, "i binary, v binary, y double").collect(), key=lambda r: (bytes(r["i"]), bytes(r["v"]), r["y"]))
    y = np.array([r["y"] for r in rows])
    rate = float((y.sum() + 1) / (len(y) + 2))
    if not len(y) or y.min() >= 0.5 or y.max() < 0.5:
        return None, rate
    x = np.zeros((len(rows), DIMENSIONS + RATIOS), np.float32)
    for k, r in enumerate(rows):
        x[k, np.frombuffer(r["i"], "<u2")] = np.frombuffer(r["v"], "<f4")
    return fit_logistic(x, y), rate


def _strength(groups: DataFrame, centre: Column) -> float:
    """How many rows the prior of a level counts for. ``groups`` has n and s (the sum of y), ``centre`` is the parent's rate."""
    r = groups.agg(
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - centre, F.lit(2.0))), F.sum("n"), F.sum(F.col("n") * F.col("n").cast("double")), F.count("*"), F.sum(F.col("n") * centre * (1 - centre))
    ).first()
    if not r[1]:
        return 1.0
    within = max(r[4] / r[1], 1e-6)
    between = max((r[0] - (r[3] - 1) * within) / max(r[1] - r[2] / r[1], 1.0), 1e-9)
    return float(min(max(within / between - 1, 1.0), 1e6))


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """For ``docs`` (doc_id, text, host, path) and ``labels`` (doc_id, quality): doc_id, host, path, p_document, p_site, score, kept.

    p_site is the path's posterior without the document itself; score is the probability that the document is good.
    """
    text_batches(docs.sparkSession)
    y = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").cast("double").alias("y"))
    weights, rate = learn(docs, y, sample)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def evidence(texts: pd.Series) -> pd.Series:
        w = shared.value
        return pd.Series([float(features(t) @ w[:-1] + w[-1]) if t and w is not None else None for t in texts], dtype="float64")

    scored = docs.select("doc_id", "host", "path", evidence("text").alias("_logit"))
    scored = scored.join(y, "doc_id", "left")
    p = F.when(F.col("_logit").isNotNull(), 1 / (1 + F.exp(-F.col("_logit")))).otherwise(F.lit(rate))
    scored = checkpointed(scored.select("doc_id", F.col("host").cast("string"), F.col("path").cast("string"), "_logit", p.alias("p_document"), F.coalesce("y", p).alias("_y")))
    site = F.to_json(F.struct("host", "path"))
    paths = checkpointed(scored.groupBy(site.alias("_site"), F.to_json(F.struct("host")).alias("_host")).agg(F.count("*").alias("n"), F.sum("_y").alias("s")))
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n"), F.sum("s")).first()
    mean = (total[1] + 1) / (total[0] + 2) if total[0] else rate
    m1 = _strength(hosts, F.lit(mean))
    hosts = checkpointed(hosts.select("_host", ((F.col("s") + m1 * mean) / (F.col("n") + m1)).alias("_rate")))
    paths = paths.join(F.broadcast(hosts) if small(hosts, BROADCAST_SITES) else hosts, "_host")
    m2 = _strength(paths, F.col("_rate"))
    sites = checkpointed(paths.select("_site", "n", "s", "_rate"))
    found = scored.withColumn("_site", site).join(F.broadcast(sites) if small(sites, BROADCAST_SITES) else sites, "_site")
    found = found.withColumn("p_site", (F.greatest(F.col("s") - F.col("_y"), F.lit(0.0)) + m2 * F.col("_rate")) / (F.col("n") - 1 + m2))
    odds = _logit(F.col("p_site")) + F.coalesce(F.col("_logit") - float(np.log(rate / (1 - rate))), F.lit(0.0))
    found = found.withColumn("score", 1 / (1 + F.exp(-odds)))
    return found.select("doc_id", "host", "path", "p_document", "p_site", "score", (F.col("score") >= threshold).alias("kept"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source and, within a source, by language; these tables have no addresses."""
    docs = documents(spark, sf_dir).select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
