"""Corpus tables derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.tables import dealt


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations: a recording is a conversation, the speaker a role, a character takes a second."""
    c = read(spark, sf_dir, "conversations")
    return c.select(
        F.concat_ws("/", F.lit("conv"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("segment_id"), F.col("conv_id").alias("recording_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
        (F.col("turn") * 10000).alias("start"), (F.col("turn") * 10000 + F.length("text")).alias("end"), F.col("role").alias("speaker_id"), (F.col("turn") % 2).alias("condition_id"), (F.col("role") != "system").alias("is_speech"), F.col("text").alias("orth"),
    )


SEGMENTS = """segments AS (SELECT concat('conv/', conv_id, '/', turn) AS segment_id, conv_id AS recording_id, conv_id * 1000 + turn AS seq, turn * 10000 AS start, turn * 10000 + length(text) AS "end",
  role AS speaker_id, turn % 2 AS condition_id, role <> 'system' AS is_speech, text AS orth FROM conversations)"""


def doc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as segments with condition (language) and recording (source)."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("segment_id"), F.col("source").alias("recording_id"), F.col("doc_id").alias("seq"), F.lit(0).cast("long").alias("start"), F.col("n_chars").alias("end"), F.col("lang").alias("condition_id"), F.col("text").alias("orth"))


DOC_SEGMENTS = """doc_segments AS (SELECT doc_id::VARCHAR AS segment_id, source AS recording_id, doc_id AS seq, 0 AS start, n_chars AS "end", lang AS condition_id, text AS orth FROM documents)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames: segment = user, time in order, a scalar value (rounded to whole numbers for exact sums)."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("segment_id"), F.col("event_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("tick"), F.round(F.col("value") * 100).cast("long").alias("x"), F.col("event_type").alias("label"))


FRAMES = """frames AS (SELECT user_id AS segment_id, event_id, epoch_us(ts) AS tick, round(value * 100)::BIGINT AS x, event_type AS label FROM events)"""


def arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as slot entries: segment = order, slot = line number in threes, label = return flag and mode, weight = quantity."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("segment_id"), F.floor((F.col("l_linenumber") - 1) / 3).cast("long").alias("slot"), F.concat("l_returnflag", F.col("l_suppkey").cast("string")).alias("label"), F.col("l_quantity").cast("long").alias("w"))


ARCS = """arcs AS (SELECT l_orderkey AS segment_id, ((l_linenumber - 1) // 3)::BIGINT AS slot, concat(l_returnflag, l_suppkey) AS label, l_quantity::BIGINT AS w FROM lineitem)"""


#: Components of an embedding.
DIMENSIONS = 64


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings in thousandths (whole numbers, so that sums are exact in any order)."""
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long")).alias("x"))


VECTORS = """vectors AS (SELECT vec_id, label, list_transform(embedding, lambda v: round(v::DOUBLE * 1000)::BIGINT) AS x FROM embeddings)"""


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order and line number, which the raw table repeats."""
    li = dealt(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity", "l_discount"), "l_orderkey")
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.max("l_returnflag").alias("flag"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.min("l_discount").alias("discount"))


ORDER_LINES = """order_lines AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, max(l_returnflag) AS flag, sum(l_quantity::BIGINT)::BIGINT AS quantity, min(l_discount) AS discount FROM lineitem GROUP BY 1, 2)"""
