"""Joins of frames with alignments, time warping and constant-segment removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.windows import runs


def label_frames(frames: DataFrame, alignment: DataFrame) -> DataFrame:
    """Frames with the labels and weights of their time ``t``."""
    return frames.join(alignment.select("segment_id", "t", "label", "weight"), ["segment_id", "t"])


def uncovered_frames(frames: DataFrame, alignment: DataFrame) -> DataFrame:
    return frames.join(alignment, ["segment_id", "t"], "left_anti")


def warp_time(frames: DataFrame) -> DataFrame:
    """Close gaps: each frame ``start, end`` begins where the one before ends; ``offset`` is what it was moved by."""
    w = Window.partitionBy("segment_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    first = F.first("start").over(Window.partitionBy("segment_id").orderBy("start"))
    begin = first + F.coalesce(F.sum(F.col("end") - F.col("start")).over(w), F.lit(0))
    return frames.withColumn("warped", begin).withColumn("offset", F.col("start") - begin)


def constant_runs(samples: DataFrame, max_increment: int, least: int) -> DataFrame:
    """Runs of at least ``least`` samples that differ from the one before by ``max_increment`` at most."""
    w = Window.partitionBy("segment_id").orderBy("t")
    flat = samples.withColumn("flat", F.coalesce(F.abs(F.col("x") - F.lag("x").over(w)) <= max_increment, F.lit(False)))
    spans = runs(flat, ["segment_id"], ["t"], "flat").groupBy("segment_id", "run").agg(F.first("flat").alias("flat"), F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n"))
    return spans.filter(F.col("flat") & (F.col("n") >= least)).select("segment_id", "start", "end", "n")


def linear_alignment(segments: DataFrame, n_states: int) -> DataFrame:
    """Frame t of ``segments(segment_id, n_frames)`` gets state ``round((S - 1) / (T - 1) * t)``; segments of one frame get state 0."""
    spread = segments.select("segment_id", "n_frames", F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1)).alias("t"))
    return spread.select("segment_id", "t", F.floor((n_states - 1) * F.col("t") / F.greatest(F.col("n_frames") - 1, F.lit(1)) + 0.5).alias("state"))
