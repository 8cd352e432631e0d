"""The registered queries of the corpus operators: thin applications to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, chat_format, common, decontaminate, fill_middle, language_id, near_dedup, pii, source_mix, substring_dedup, token_counts, token_output, topk_search, vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_path(spark, "token-ids")
    token_output.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_output.digests(token_output.read(spark, path))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language_id.held_out()
    dictionaries = language_id.learn(docs.where(~held_out))
    found = language_id.identify(docs.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return bpe_codec.digests(docs, vocabulary, bpe_codec.build_lexicon(docs, vocabulary))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shards = common.settled(topk_search.index(docs), "shards", "wave")
    return topk_search.search(shards, docs.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.with_token_counts(docs, model).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.render(table(spark, sf_dir, "conversations"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = vector_codes.compressed(table(spark, sf_dir, "embeddings"))
    return made.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(back, 256).alias("restored_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_token_output": op2_token_output,
    "op3_decontaminate": op3_decontaminate,
    "op4_language_id": op4_language_id,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_topk_search": op6_topk_search,
    "op7_pii": op7_pii,
    "op8_token_counts": op8_token_counts,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_chat_format": op10_chat_format,
    "op11_source_mix": op11_source_mix,
    "op12_vector_codes": op12_vector_codes,
    "op13_fill_middle": op13_fill_middle,
}
