"""Queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from tidemark.llm import audit, bpe, chat, decontaminate, language_id, lexical, media, pii, quality, repeats, simhash, token_counts, token_file
from tidemark.llm.common import held_out, new_folder, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, ~held_out(F.col("doc_id")))
    return language_id.predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op3_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"), new_folder(spark, "media"))


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-files")
    manifest = token_file.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return token_file.read(manifest).select("doc_id", "start", "n_tokens", "ids_crc32", "file", "frame")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, test = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"))
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~test)
    return quality.score(docs, model).select("doc_id", test.alias("held_out"), "score", "predicted")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations")
    marks = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(marks).alias("text"))
    return chat.digest(chat.windows(said.select("conv_id", "turn", "role", "text").unionByName(extra)))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.remove(table(spark, sf_dir, "documents")))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_ALL = (
    op1_language_id,
    op2_simhash_dedup,
    op3_media_chunks,
    op4_token_file,
    op5_byte_bpe,
    op6_decontamination,
    op7_quality,
    op8_pii,
    op9_chat_windows,
    op10_repeats,
    op11_lexical_search,
    op12_token_counts,
    op13_filter_audit,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {"op9_chat_windows": chat.DIGEST_SQL, "op11_lexical_search": lexical.SEARCH_SQL, "op13_filter_audit": audit.AUDIT_SQL}
