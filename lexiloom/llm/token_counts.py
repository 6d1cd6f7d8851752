"""Operator 4: token counts through a cache of content digests.

The content of a text, normalised as the tokenizer itself does before cutting, is digested (SHA-256) and joined with the
counts stored for the tokenizer's own digest. Only distinct misses are encoded, by the library, and appended to the cache.

The normalisation leaves counts unchanged: SentencePiece reads U+2581 as a space (identity models only); for a
``tokenizers`` file nothing is changed. Null texts count as empty; equal texts share one entry; empty tables give no row;
null ids are kept; other columns are ignored. Very long texts are encoded one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, note_table, scratch_path, slices, texts_of

CACHE_SCHEMA = "tokenizer binary, digest binary, n_tokens long"
#: Added to the tokenizer's digest; raised when the way of counting changes.
COUNT_VERSION = b"1"


@lru_cache(maxsize=2)
def _counter(path: str):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def tokenizer_digest(path: str) -> bytes:
    with open(path, "rb") as f:
        return hashlib.sha256(COUNT_VERSION + f.read()).digest()


def normalised(text: Column, path: str) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.translate(text, "▁", " ") if path.endswith(".model") else text


def encode_misses(misses: DataFrame, path: str) -> DataFrame:
    """``digest, n_tokens`` of distinct ``digest, text``."""
    bounded_batches(misses.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("digest").cast(pa.binary()), pa.array(count(texts_of(part)), pa.int64())], names=["digest", "n_tokens"])

    return misses.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def _keyed(docs: DataFrame, path: str) -> DataFrame:
    return docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), normalised(F.col("text"), path).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))


def fill_cache(docs: DataFrame, path: str, cache_path: str) -> None:
    """Append the counts of the contents that the cache at ``cache_path`` lacks."""
    version = tokenizer_digest(path)
    # copies collapse before the shuffle; the join with the cache keeps that partitioning
    misses = _keyed(docs, path).select("digest", "text").dropDuplicates(["digest"])
    stored = _stored(docs.sparkSession, cache_path, version)
    if stored is not None:
        misses = misses.join(stored, "digest", "left_anti")
    encode_misses(misses, path).select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)


def token_counts(docs: DataFrame, path: str, cache_path: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens``; what the cache at ``cache_path`` lacks is appended to it."""
    fill_cache(docs, path, cache_path)
    stored = _stored(docs.sparkSession, cache_path, tokenizer_digest(path))
    return _keyed(docs, path).select("doc_id", "n_bytes", "digest").join(stored, "digest").select("doc_id", "n_bytes", "n_tokens")


def _stored(spark: SparkSession, cache_path: str, version: bytes) -> DataFrame | None:
    """The counts of this tokenizer; None before the first call. A repeated entry (after a lost job) counts once."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer") == F.lit(version)).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An eighth of the documents arrive first and fill the cache; then all are counted, and the contents of the first ones are met there."""
    import public_tokenizers

    docs, model, cache = spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), scratch_path(spark, "counts")
    fill_cache(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(8)) == 0), model, cache)
    note_table(spark, cache)
    return token_counts(docs, model, cache).withColumn("over_limit", F.col("n_tokens") > 4096)
