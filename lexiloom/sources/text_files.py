"""Readers and writers of line-oriented corpus files, all through Spark's own text source."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("line"))


def read_segment_list(spark: SparkSession, path: str) -> DataFrame:
    """One name for each line; blank lines and those that begin with ``#`` are skipped."""
    return _lines(spark, path).filter("line <> '' AND NOT startswith(line, '#')").select(F.col("line").alias("name"))


def read_ctm(spark: SparkSession, path: str) -> DataFrame:
    """``name track start duration word [confidence]``; ``;;`` begins a comment."""
    parts = _lines(spark, path).filter("line <> '' AND NOT startswith(line, ';;')").select(F.split("line", r"\s+").alias("p"))
    start = F.get("p", 2).cast("double")
    return parts.select(F.get("p", 0).alias("recording_id"), F.get("p", 1).cast("int").alias("track"), start.alias("start"), F.round(start + F.get("p", 3).cast("double"), 6).alias("end"), F.get("p", 4).alias("word"), F.get("p", 5).cast("double").alias("conf"))


def write_ctm(words: DataFrame, path: str) -> None:
    fields = ["recording_id", "track", F.format_string("%.3f", "start"), F.format_string("%.3f", F.col("end") - F.col("start")), "word", F.format_string("%.3f", "conf")]
    ordered = words.repartitionByRange("recording_id", "start").sortWithinPartitions("recording_id", "start")
    ordered.select(F.concat_ws(" ", *(f if not isinstance(f, str) else F.col(f).cast("string") for f in fields)).alias("value")).write.text(path)


def read_stm(spark: SparkSession, path: str) -> DataFrame:
    """``name track speaker start end <condition> transcript``; the condition may be absent."""
    found = _lines(spark, path).filter("line <> '' AND NOT startswith(line, ';;')")
    form = r"^(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)(?:\s+(<[^>]*>))?\s*(.*)$"
    part = lambda k: F.regexp_extract("line", form, k)
    return found.select(part(1).alias("recording_id"), part(2).cast("int").alias("track"), part(3).alias("speaker_id"), part(4).cast("double").alias("start"), part(5).cast("double").alias("end"), part(6).alias("condition_id"), part(7).alias("orth"))


def write_stm(segments: DataFrame, path: str) -> None:
    ordered = segments.repartitionByRange("recording_id", "start").sortWithinPartitions("recording_id", "start")
    ordered.select(F.concat_ws(" ", "recording_id", F.col("track").cast("string"), "speaker_id", F.format_string("%.3f", "start"), F.format_string("%.3f", "end"), "condition_id", "orth").alias("value")).write.text(path)


def read_uem(spark: SparkSession, path: str) -> DataFrame:
    parts = _lines(spark, path).filter("line <> '' AND NOT startswith(line, ';;')").select(F.split("line", r"\s+").alias("p"))
    return parts.select(F.get("p", 0).alias("recording_id"), F.get("p", 1).cast("int").alias("track"), F.get("p", 2).cast("double").alias("start"), F.get("p", 3).cast("double").alias("end"))


def write_sentences(segments: DataFrame, path: str, column: str = "orth") -> None:
    segments.select(F.concat_ws("\t", "segment_id", column).alias("value")).write.text(path)


def read_vector_text(spark: SparkSession, path: str) -> DataFrame:
    """Blank-separated numbers, one vector for each line."""
    return _lines(spark, path).filter("line <> ''").select(F.split("line", r"\s+").cast("array<double>").alias("x"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).filter("line <> ''").select(F.col("line").alias("token")).distinct()


def read_arpa(spark: SparkSession, path: str, vocabulary: DataFrame | None = None, skip_infinite: bool = False) -> DataFrame:
    """``order, history, word, score, backoff`` with scores as -ln; n-grams with words outside the vocabulary are dropped.

    -99 and below, as well as ``-inf``, stand for the logarithm of zero: such scores are infinite, or their n-grams are dropped with ``skip_infinite``.

    A line is ``log10 <tab> words [<tab> log10 back-off]``; its order is its number of words, so lines may be read in any order.
    """
    parts = spark.read.text(path).select(F.split(F.rtrim("value"), "\t").alias("p")).filter((F.size("p") >= 2) & F.get("p", 0).rlike(r"^-?(\d|inf)"))
    words = parts.select("p", F.split(F.trim(F.get("p", 1)), " +").alias("w"))
    grams = words.select(F.size("w").alias("order"), F.array_join(F.slice("w", F.lit(1), F.size("w") - 1), " ").alias("history"), F.element_at("w", -1).alias("word"), (F.get("p", 0).cast("double") * -math.log(10)).alias("score"), F.coalesce(F.get("p", 2).cast("double") * -math.log(10), F.lit(0.0)).alias("backoff"), "w")
    grams = grams.withColumn("score", F.when(F.col("score") >= 99 * math.log(10), float("inf")).otherwise(F.col("score")))
    if skip_infinite:
        grams = grams.filter(F.col("score") < float("inf"))
    if vocabulary is not None:
        unknown = grams.select("w").distinct().select("w", F.explode("w").alias("token")).join(vocabulary, "token", "left_anti").select("w").distinct()
        grams = grams.join(unknown, "w", "left_anti")
    return grams.drop("w")


def write_ngrams(ngrams: DataFrame, path: str) -> None:
    """Parquet, one folder for each order."""
    ngrams.write.partitionBy("order").parquet(path)


def read_ngrams(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
