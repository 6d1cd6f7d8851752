"""Selection, partitioning and ordering of corpus segments (``segment_id, recording_id, seq, ...``)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.windows import number_rows


def short_name(segment_id: Column) -> Column:
    return F.substring_index(segment_id, "/", -1)


def keep_segments(segments: DataFrame, names: DataFrame, allow_empty: bool = False) -> DataFrame:
    """Segments listed in ``names(name)`` by full or short name. An empty list is an error unless allowed."""
    if not allow_empty and names.isEmpty():
        raise ValueError("the list of segments is empty")
    names = names.select("name").distinct()
    full = segments.join(names, segments["segment_id"] == names["name"], "left_semi")
    rest = segments.join(names, segments["segment_id"] == names["name"], "left_anti")
    return full.unionByName(rest.join(names, short_name(rest["segment_id"]) == names["name"], "left_semi"))


def skip_segments(segments: DataFrame, names: DataFrame) -> DataFrame:
    """Segments not listed in ``names(name)`` by full name."""
    return segments.join(names.select(F.col("name").alias("segment_id")), "segment_id", "left_anti")


def partition_segments(segments: DataFrame, n: int, k: int, bucket: Column, by: str = "segment") -> DataFrame:
    """Keep where ``index % n == k`` (k = n means 0). Segments count from 0 in order of ``seq``, recordings from 1."""
    if by == "segment":
        indexed = number_rows(segments, bucket, ["seq"])
    else:
        first = segments.groupBy("recording_id").agg(F.min("seq").alias("seq"))
        indexed = segments.join(number_rows(first, bucket, ["seq"]).select("recording_id", (F.col("index") + 1).alias("index")), "recording_id")
    return indexed.filter(F.col("index") % n == k % n).drop("index")


def skip_first(segments: DataFrame, m: int, n: int, bucket: Column) -> DataFrame:
    """Keep where ``floor(index / n) >= m``."""
    return number_rows(segments, bucket, ["seq"]).filter(F.floor(F.col("index") / n) >= m).drop("index")


def order_by_list(segments: DataFrame, order: DataFrame) -> DataFrame:
    """One row for each position of ``order(pos, segment_id)``; names that are repeated repeat, unknown ones do not appear."""
    return order.select("pos", "segment_id").join(segments, "segment_id")


def unknown_in_list(segments: DataFrame, order: DataFrame) -> DataFrame:
    return order.join(segments, "segment_id", "left_anti")


def shuffle_segments(segments: DataFrame, seed: int = 0) -> DataFrame:
    """A reproducible random order by ``shuffle_key``, a digest of seed and name."""
    return segments.withColumn("shuffle_key", F.md5(F.concat_ws("/", F.lit(str(seed)), "segment_id"))).orderBy("shuffle_key", "segment_id")


def custom_order(segments: DataFrame, key: Callable[..., Column], *columns: str) -> DataFrame:
    """Segments by ``order_key``, which the user's ``key`` (a pandas UDF or any function of columns) gives for each; equal keys in corpus order."""
    return segments.withColumn("order_key", key(*(F.col(c) for c in columns))).orderBy("order_key", "seq")


def sort_by_length(segments: DataFrame, bucket: Column, chunk: int = 0) -> DataFrame:
    """``rank`` within each chunk of consecutive segments (all, if chunk is 0) by length; stable."""
    indexed = number_rows(segments, bucket, ["seq"]).withColumn("chunk", F.floor(F.col("index") / chunk) if chunk else F.lit(0))
    length = F.col("end") - F.col("start")
    if chunk:
        return indexed.withColumn("rank", F.row_number().over(Window.partitionBy("chunk").orderBy(length, "index")) - 1)
    return number_rows(indexed, F.floor(length), [length, "index"], "rank")


def corpus_key(segments: DataFrame, parts: list, separator: str = "-") -> DataFrame:
    return segments.withColumn("key", F.concat_ws(separator, *parts))


def map_corpus_key(segments: DataFrame, mapping: DataFrame, default: str | None = None) -> DataFrame:
    """Look ``key`` up in ``mapping(key, value)``. Without a default, keys that are absent give null: see ``unmapped_keys``."""
    mapped = segments.join(mapping.select("key", "value"), "key", "left")
    return mapped if default is None else mapped.withColumn("value", F.coalesce("value", F.lit(default)))


def unmapped_keys(segments: DataFrame, mapping: DataFrame) -> DataFrame:
    return segments.join(mapping, "key", "left_anti").groupBy("key").agg(F.count("*").alias("n"))


def merge_corpora(*segments: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), segments)


def duplicate_segments(segments: DataFrame) -> DataFrame:
    """Names that a merged corpus holds more than once: its error table."""
    return segments.groupBy("segment_id").agg(F.count("*").alias("n")).filter("n > 1")


def build_segments(parts: DataFrame, attributes: DataFrame, defaults: dict) -> DataFrame:
    """Combine two part tables of segments; missing fields get defaults."""
    joined = parts.join(attributes, "segment_id", "full")
    return joined.select("segment_id", *(F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in joined.columns if c != "segment_id"))


def common_segments(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("segment_id").intersect(b.select("segment_id"))


def missing_segments(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("segment_id").distinct().join(b, "segment_id", "left_anti")


def take_batch(segments: DataFrame, limit: int) -> DataFrame:
    """The first segments of a work list."""
    return segments.orderBy("seq").limit(limit)


def size_statistics(recordings: DataFrame, segments: DataFrame) -> DataFrame:
    """Numbers of recordings, speech and other segments, and gross and net duration."""
    r = recordings.agg(F.count("*").alias("n_recordings"), F.sum("duration").alias("gross"))
    s = segments.agg(F.count_if("is_speech").alias("n_speech"), F.count_if(~F.col("is_speech")).alias("n_other"), F.sum(F.col("end") - F.col("start")).alias("net"))
    return r.crossJoin(s)  # one row each


def speaker_statistics(segments: DataFrame) -> DataFrame:
    """Segments, seconds and distinct speakers for each speaker, each gender and all; ``level`` tells which."""
    sets = segments.groupingSets([["speaker_id"], ["gender"], []], "speaker_id", "gender")
    return sets.agg(F.grouping_id().alias("level"), F.count("*").alias("n_segments"), F.sum(F.col("end") - F.col("start")).alias("seconds"), F.count_distinct(F.col("who")).alias("n_speakers"))


def condition_statistics(segments: DataFrame) -> DataFrame:
    return segments.groupBy("condition_id").agg(F.count("*").alias("n_segments"), F.sum(F.col("end") - F.col("start")).alias("seconds"))


def duration_histogram(segments: DataFrame, width: float) -> DataFrame:
    return segments.groupBy(F.floor((F.col("end") - F.col("start")) / width).alias("bin")).agg(F.count("*").alias("n"))


def long_segments(segments: DataFrame, least: float) -> DataFrame:
    return segments.filter(F.col("end") - F.col("start") >= least)
