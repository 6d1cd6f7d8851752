"""Window helpers that never put a whole table into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written


def number_rows(df: DataFrame, bucket: Column, order: list, name: str = "index") -> DataFrame:
    """Add a global row number from 0. ``bucket`` must grow with ``order``; only one count for each bucket is ordered globally."""
    marked = df.withColumn("_bucket", bucket)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = marked.groupBy("_bucket").agg(F.count("*").alias("_n")).select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    return marked.withColumn("_own", own).join(ahead, "_bucket").withColumn(name, (F.col("_ahead") + F.col("_own")).cast("long")).drop("_bucket", "_own", "_ahead")


def number_within(df: DataFrame, keys: list[str], order: list, name: str = "index", size: str | None = None) -> DataFrame:
    """Add the row's number from 0 among those of its ``keys`` (nulls equal), and with ``size`` how many these are. A key may hold most of the rows.

    One range shuffle sorts all rows, which are written; then only a row for each key and part is counted in order.
    """
    by = [*(F.col(k) for k in keys), *(F.col(c) if isinstance(c, str) else c for c in order)]
    placed = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_place", 33))
    own = Window.partitionBy(*keys)
    parts = placed.groupBy(*keys, "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_of"), "_first", ahead.alias("_ahead"), F.sum("_n").over(own).alias("_all"))
    same = reduce(lambda a, b: a & b, [placed[k].eqNullSafe(parts[f"_k{i}"]) for i, k in enumerate(keys)])
    joined = placed.join(parts, (placed["_part"] == parts["_of"]) & same).withColumn(name, F.col("_place") - F.col("_first") + F.col("_ahead"))
    return joined.select(*df.columns, name, *([F.col("_all").alias(size)] if size else []))


def running_sum(df: DataFrame, value: str, bucket: Column, order: list, name: str, before: bool = False) -> DataFrame:
    """Global running sum of ``value``, without the row itself if ``before``; two levels as in ``number_rows``."""
    marked = df.withColumn("_bucket", bucket)
    ahead = marked.groupBy("_bucket").agg(F.sum(value).alias("_s"))
    ahead = ahead.select("_bucket", F.coalesce(F.sum("_s").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    own = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    return marked.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0))).join(ahead, "_bucket").withColumn(name, F.col("_ahead") + F.col("_own")).drop("_bucket", "_own", "_ahead")


def runs(df: DataFrame, keys: list[str], order: list, value: str, name: str = "run") -> DataFrame:
    """Number the runs of equal ``value`` (nulls equal) within ``keys`` from 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    changed = first | ~F.lag(value).over(w).eqNullSafe(F.col(value))
    return df.withColumn("_new", changed.cast("int")).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")
