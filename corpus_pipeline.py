"""The corpus pipeline over `documents`.

Every stage gets all that its predecessor kept, written as Parquet and read again, and all but the last
return the columns of documents. Documents without an id are told apart by their text (common.document_key).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import bpe_codec, common, decontaminate, language_id, near_dedup, pii

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets lang to the predicted language; documents that the classifier rejects go."""
    common.bounded_batches(spark)
    found = language_id.identify(docs, language_id.learn(docs))
    return found.where("NOT rejected").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id; of repeated
    rows the first by text, language and source."""
    common.bounded_batches(spark)
    keyed = docs.withColumn("key", common.document_key())
    kept = near_dedup.grouped(docs).where("kept").select("key").distinct()
    first = Window.partitionBy("key").orderBy("text", "lang", "source", "n_chars")
    return keyed.join(kept, "key").withColumn("place", F.row_number().over(first)).where("place = 1").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    common.bounded_batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = docs.withColumn("key", common.document_key())
    # a few of all documents: the anti-join drops them by key
    leaks = decontaminate.contaminated(keyed.select(F.col("key").alias("doc_id"), "text"), items).select(F.col("doc_id").alias("key")).distinct()
    return keyed.join(leaks, "key", "left_anti").select(*COLUMNS)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes the name of its kind; n_chars follows."""
    common.bounded_batches(spark)
    clean = pii.redacted(docs, pii.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document and the text that they decode to."""
    common.bounded_batches(spark)
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    out = bpe_codec.encode(docs, vocabulary, bpe_codec.build_lexicon(docs, vocabulary), decoded=True)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language_id", language),
    ("near_dedup", dedup),
    ("decontaminate", decontamination),
    ("pii", privacy),
    ("bpe_codec", tokens),
]

#: SQL can express neither compression nor merging by rank: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = common.settled(stage(spark, docs, sf_dir), f"pipeline-{name.replace('_', '-')}")
        common.done_with(docs)  # of the tables that stages wrote; the input stays
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
