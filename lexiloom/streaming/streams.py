"""Structured Streaming counterparts of batch operators. Frames are ``segment_id, ts, x``; late rows are what the watermark drops."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import StructType

from lexiloom.operators.counts import tokens
from lexiloom.operators.models import all_scores


def stream_frames(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 10) -> DataFrame:
    """Frames that arrive as Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_integrate(frames: DataFrame, width: str, shift: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Sum of absolute values and mean of each segment in windows; works on batches too."""
    marked = frames.withWatermark("ts", late) if frames.isStreaming else frames
    window = F.window("ts", width, shift) if shift else F.window("ts", width)
    return marked.groupBy("segment_id", window.alias("w")).agg(F.sum(F.abs("x")).alias("energy"), F.avg("x").alias("mean"), F.count("*").alias("n")).select("segment_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "energy", "mean", "n")


def stream_silence_sessions(frames: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of activity parted by silence of over ``gap``."""
    marked = frames.withWatermark("ts", late) if frames.isStreaming else frames
    return marked.groupBy("segment_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("segment_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_dedup(frames: DataFrame, key: list[str], late: str = "10 minutes") -> DataFrame:
    """The first of equal keys within the watermark."""
    return frames.withWatermark("ts", late).dropDuplicatesWithinWatermark(key) if frames.isStreaming else frames.dropDuplicates(key)


def stream_token_counts(segments: DataFrame) -> DataFrame:
    """Running token counts; for output mode ``complete`` or ``update``."""
    return segments.select(F.explode(tokens(F.col("orth"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def stream_sync(frames: DataFrame, target: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Frames of one stream that start at a target time of the other."""
    a = frames.withWatermark("ts", late)
    b = target.select(F.col("segment_id").alias("target_segment"), F.col("ts").alias("target_ts")).withWatermark("target_ts", late)
    return a.join(b, F.expr("segment_id = target_segment AND ts = target_ts")).drop("target_segment", "target_ts")


def stream_normalise(frames: DataFrame, length: int, right: int, gap: str = "10 minutes", variance: bool = True) -> DataFrame:
    """``segment_id, ts, x, normalised``: a frame comes out once ``right`` later ones are there, normalised over the last ``length``; a zero deviation counts as one.

    The frames of a segment arrive in order of time. Once the watermark is ``gap`` past a segment's last frame, the frames that still wait come out with the last
    full window, and the segment's state, which holds ``max(length, right + 1)`` frames, goes.
    """
    kept = max(length, right + 1)
    margin = int(pd.Timedelta(gap).total_seconds() * 1000)

    def rows(key, ts: list, xs: list, places: list[int], windows: list[list[float]]) -> pd.DataFrame:
        out = []
        for i, w in zip(places, windows, strict=True):
            deviation = float(np.std(w)) if variance else 1.0
            out.append((key[0], ts[i], xs[i], (xs[i] - float(np.mean(w))) / (deviation if deviation > 0 else 1.0)))
        return pd.DataFrame(out, columns=["segment_id", "ts", "x", "normalised"])

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ts, xs, seen = (list(state.get[0]), list(state.get[1]), state.get[2]) if state.exists else ([], [], 0)
        if state.hasTimedOut:
            last = range(max(0, len(xs) - min(right, seen)), len(xs))
            yield rows(key, ts, xs, list(last), [xs[-length:]] * len(last))
            state.remove()
            return
        new = pd.concat(list(parts)).sort_values("ts", kind="stable")
        old = len(xs)
        ts, xs = ts + new["ts"].tolist(), xs + new["x"].astype(float).tolist()
        ends = [e for e in range(old, len(xs)) if seen + e - old >= right]
        if ends:
            yield rows(key, ts, xs, [e - right for e in ends], [xs[max(0, e + 1 - length) : e + 1] for e in ends])
        state.update((ts[-kept:], xs[-kept:], seen + len(new)))
        state.setTimeoutTimestamp(max(int(ts[-1].timestamp() * 1000), state.getCurrentWatermarkMs()) + margin)

    kind = frames.schema["segment_id"].dataType.simpleString()
    marked = frames.select("segment_id", "ts", F.col("x").cast("double").alias("x")).withWatermark("ts", gap)
    return marked.groupBy("segment_id").applyInPandasWithState(step, f"segment_id {kind}, ts timestamp, x double, normalised double", "ts array<timestamp>, xs array<double>, seen long", "append", "EventTimeTimeout")


def stream_bayes(frames: DataFrame, densities: DataFrame, delay: int = 0) -> DataFrame:
    """``segment_id, ts, density, score``: after each frame beyond the first ``delay`` the density with the lowest score summed over the segment so far.

    The densities are a small static model; the state of a segment is one sum for each. The frames of a segment arrive in order of time.
    """
    kind = {c: t.simpleString() for c, t in (("segment_id", frames.schema["segment_id"].dataType), ("density", densities.schema["density"].dataType))}
    scored = all_scores(frames.select("segment_id", "ts", "x"), densities)
    flat = scored.select("segment_id", "ts", F.transform("_scores", lambda s: s["score"]).alias("scores"), F.transform("_scores", lambda s: s["density"]).alias("names"))

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(parts)).sort_values("ts", kind="stable")
        total, seen = (np.array(state.get[0]), state.get[1]) if state.exists else (0.0, 0)
        sums = total + np.cumsum(np.stack(new["scores"].to_list()), axis=0)
        names, best = new["names"].iloc[0], sums.argmin(axis=1)
        out = pd.DataFrame({"segment_id": key[0], "ts": new["ts"].to_numpy(), "density": [names[k] for k in best], "score": sums.min(axis=1)})
        yield out.iloc[max(0, delay - seen) :]
        state.update((sums[-1].tolist(), seen + len(new)))

    return flat.groupBy("segment_id").applyInPandasWithState(step, f"segment_id {kind['segment_id']}, ts timestamp, density {kind['density']}, score double", "sums array<double>, seen long", "append", "NoTimeout")
