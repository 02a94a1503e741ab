"""A corpus pipeline of five stages over ``documents``, each writing what the next one reads.

Every stage works on all rows that its predecessor kept, and every stage but the last returns the columns of documents.

- language_id drops the documents in which no language is found (null texts and texts without a letter) and sets ``lang``
  to the predicted language.
- simhash_near_dedup keeps one document, that of the smallest id, of each group of near-duplicates: texts whose sets of
  five-word shingles have a Jaccard similarity of 0.8 or more, directly or over others of the group.
- pii replaces personal data in ``text`` and sets ``n_chars`` anew.
- source_mixing puts the documents in the order of the mixture: numbered files, and rows in them, by place.
- packing returns the pieces of all documents with their places in sequences of at most 2048 tokens. Sequences follow the
  order of files and rows, so a prefix of them holds the sources by their target weights.

Null or missing columns, empty tables and repeated rows are handled as the operators' docstrings say; columns beyond
those of documents are not carried on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.llm import langid, mixing, packing, pii, simhash
from rillstone.llm.common import documents, shared_dir, text_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Texts in an Arrow batch, and entries of each worker's token cache: executors and their Python workers live through
#: all stages and hold what earlier ones have touched.
BATCH, CACHE = 250, 30_000
#: SQL has neither support vector machines nor tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text_batches(spark, BATCH)
    docs = docs.select(*COLUMNS)
    found = langid.identify(docs, langid.learn(docs))
    return found.where("lang_pred <> 'und'").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text_batches(spark, BATCH)
    return simhash.representatives(docs.select(*COLUMNS), words=5)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = spark.conf.get(pii.KEY_SETTING, pii.PUBLIC_KEY)
    return pii.replace(docs.select(*COLUMNS), key).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs.select(*COLUMNS), text="text")
    return mixed.repartitionByRange("place").sortWithinPartitions("place").select(*COLUMNS)


def _written_order(docs: DataFrame) -> Column:
    """The number of a row's file, as Spark's writers name them, above the row's place in it; of a table not from files, the place in its partition."""
    if not docs.inputFiles():
        return F.monotonically_increasing_id()
    file = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1)
    return F.shiftleft(F.when(file == "", 0).otherwise(file).cast("long"), packing.FILE_BITS) + F.col("_metadata.row_index")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text_batches(spark, BATCH)
    ordered = docs.select("doc_id", "text", _written_order(docs).alias("_order"))
    return packing.pack(ordered, cache=CACHE, order=F.col("_order"))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("pii", pii_surrogates),
    ("source_mixing", source_mixing),
    ("packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's result is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
