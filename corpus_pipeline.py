"""The training-data pipeline: quality rules, near and passage deduplication, pseudonyms, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``documents``. Operators remove their
intermediate tables, but for small ones that the result still reads (ids, scores, ranges); ``run`` removes these, and each stage's table, once the next one is written.

Null and empty texts fail the quality rules and go; rows without an id are judged like others and no duplicates of any; rows that repeat an id and a text fare alike. Ties go to the smaller id.
An empty table of documents gives no row, an empty table of labels no verdict beyond the rules. Other columns of documents are passed on by all stages but the last, which has the ids' own columns.
"""

from __future__ import annotations

import secrets

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import near_dedup, packing, pii, quality, suffix_dedup
from lexiloom.llm.common import materialise, remove_path, temporary_tables

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
#: The session setting that holds the key of the pseudonyms. Who knows the key can undo them, so there is no default: a session without one draws its own, which is lost with it.
KEY_SETTING = "spark.lexiloom.pseudonyms.key"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    if not spark.conf.get(KEY_SETTING, None):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    masked = pii.mask_personal_data(docs, spark.conf.get(KEY_SETTING)).drop("n_masked")
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = materialise(packing.encode_pieces(docs, TOKENIZER, END_ID), "pieces", keep=True)
    return packing.pack_pieces(pieces, ["doc_id", "piece", "ids_crc32"])


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("pseudonyms", pseudonyms),
    ("best_fit_packing", best_fit_packing),
]

#: The stages' language models and searches cannot be written in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with temporary_tables(spark) as written:
        for name, stage in STAGES[:-1]:
            with temporary_tables(spark):
                docs = materialise(stage(spark, docs, sf_dir), name, keep=True)
            while len(written) > 1:
                remove_path(spark, written.pop(0))
        return STAGES[-1][1](spark, docs, sf_dir)
