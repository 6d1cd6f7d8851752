"""Functions of users over vectors and segments: Arrow batches in, Arrow batches out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scorer(fn: Callable[[np.ndarray], np.ndarray]):
    """A column function from ``fn(matrix of vectors) -> a score for each``; vectors are of one size, a null one has no score."""

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(x), x.index, dtype=object)
        there = x.notna()
        if there.any():
            out[there] = np.asarray(fn(np.stack(x[there].to_list())), float)
        return out

    return score


def register_scorer(spark: SparkSession, name: str, fn: Callable[[np.ndarray], np.ndarray]) -> None:
    """Make the scorer known to SQL by its name."""
    spark.udf.register(name, scorer(fn))


def batch_score(frames: DataFrame, make: Callable[[], Callable[[np.ndarray], np.ndarray]], d: int, batch: int = 100, name: str = "score") -> DataFrame:
    """Frames with the scores of a user's model over batches of at most ``batch`` vectors; ``make`` loads the model once for each worker. Vectors of other sizes than d go."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import DoubleType

    predict = predict_batch_udf(make, return_type=DoubleType(), batch_size=batch, input_tensor_shapes=[[d]])
    return frames.filter(F.size("x") == d).withColumn(name, predict(F.col("x").cast("array<double>")))


def for_each_segment(rows: DataFrame, fn: Callable[[object, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, order: list[str], key: str = "segment_id") -> DataFrame:
    """``fn(segment, its rows in order, part by part)`` for every segment: no segment is held whole. What ``fn`` leaves unread is skipped."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[object, pd.DataFrame]]:
        for b in batches:
            if len(b):
                changes = np.flatnonzero((b[key] != b[key].shift()).to_numpy())
                for a, z in zip(changes, [*changes[1:], len(b)], strict=True):
                    yield b[key].iloc[a], b.iloc[a:z]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for segment, own in groupby(parts(batches), key=lambda p: p[0]):
            yield from fn(segment, (part for _, part in own))

    return rows.filter(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
