"""Archives: named items as Parquet in buckets of the name's hash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def archive_write(items: DataFrame, path: str, buckets: int = 16, mode: str = "errorifexists") -> None:
    """``items(name, ...)``; ``mode`` is Spark's: overwrite, append, ignore or an error where the archive exists."""
    items.withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(buckets)).cast("int")).repartition("bucket").write.mode(mode).partitionBy("bucket").parquet(path)


def archive_read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def cache_by_label(frames: DataFrame, path: str, spread: int = 16, mode: str = "errorifexists") -> None:
    """Labelled frames ``segment_id, tick, label, ...`` in a folder for each label, in time order; a frequent label is written by ``spread`` tasks."""
    salt = F.pmod(F.xxhash64("segment_id"), F.lit(spread))
    frames.repartition("label", salt).sortWithinPartitions("label", "segment_id", "tick").write.mode(mode).partitionBy("label").parquet(path)


def cached_label(spark: SparkSession, path: str, label) -> DataFrame:
    """The frames of one label: only its folder is read."""
    return spark.read.parquet(path).filter(F.col("label") == label)


def archive_combine(archives: list[DataFrame], policy: str = "keep") -> DataFrame:
    """One item for each name: of the first archive that has it (``keep``) or of the last (``replace``)."""
    marked = reduce(DataFrame.unionByName, [a.withColumn("_source", F.lit(i)) for i, a in enumerate(archives)])
    order = F.col("_source") if policy == "keep" else F.desc("_source")
    return marked.withColumn("_rank", F.row_number().over(Window.partitionBy("name").orderBy(order))).filter("_rank = 1").drop("_rank", "_source")


def archive_conflicts(archives: list[DataFrame]) -> DataFrame:
    """Names whose copies differ."""
    both = reduce(DataFrame.unionByName, archives)
    values = [c for c in both.columns if c != "name"]
    return both.groupBy("name").agg(F.count_distinct(F.xxhash64(*values)).alias("versions")).filter("versions > 1")


def archive_select(archive: DataFrame, names: DataFrame) -> DataFrame:
    return archive.join(names.select("name"), "name", "left_semi")


def archive_remove(archive: DataFrame, names: DataFrame) -> DataFrame:
    return archive.join(names.select("name"), "name", "left_anti")
