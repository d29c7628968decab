"""A corpus pipeline of five of the training-data operators.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns a DataFrame, which is written as Parquet and read again for the next stage. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from tidemark.llm import bpe, common, decontaminate, language_id, pii, simhash


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a letter or with an ambiguous language go."""
    model = language_id.train(docs, ~common.held_out(F.col("doc_id")))
    return language_id.recognised(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows whose texts share 0.8 or more of their five-word shingles, the one with the least doc_id
    (a null id is the greatest), of equal ids the one with the least row number."""
    rows = common.materialize(common.numbered(docs), "near-rows")
    linked = simhash.similar(rows.select(F.col("row").alias("doc_id"), "given.text")).select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    place = F.struct(F.col("given.doc_id").isNull(), F.col("given.doc_id"), F.col("row"))
    keep = rows.select("row", place.alias("place")).join(linked, "row").groupBy("component").agg(F.min("place").alias("least")).select("least.row")
    return rows.join(keep, "row", "left_semi").select("given.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by the kind in brackets; n_chars follows the text."""
    return pii.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SimHash, the classifier and BPE have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None
