"""From documents to token ids in five stages; each works on all that the one before kept.

1. language: documents whose language is not recognised go.
2. near_duplicates: one document of each group of near duplicates stays.
3. decontamination: documents that hold benchmark passages go.
4. personal_data: personal data is masked in the texts.
5. encoding: texts become token ids, and are decoded again as a check.

A stage gets the documents as a table and returns a table; `run` writes each result to the
shared folder and reads it again, so a lost executor costs no more than a stage.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordance.llm import bpe, common, decontaminate, language, near_dup, personal


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return personal.mask_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and whether they decode to the text."""
    import public_tokenizers

    whole = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return whole.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"), "ids"
    )


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("encoding", encode),
]

#: SQL cannot express the language model, the classifier or the encoding; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir))
    return docs
