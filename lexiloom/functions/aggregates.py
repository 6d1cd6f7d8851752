"""An aggregate with a state of its own: weighted count, sum and sum of squares as 24 bytes that merge across parts.

The state is what is shuffled, so groups of any size cost a row for each part; ``register`` makes the steps known to SQL by name.
It is the twin of the built-in sums and the pattern for aggregates that Spark lacks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VALUE = "struct<n: double, mean: double, variance: double>"


def _pack(n: float, s: float, q: float) -> bytes:
    return np.array([n, s, q], "<f8").tobytes()


def stats_state(x: pd.Series, weight: pd.Series) -> bytes:
    """The state of a part's values; null values and weights are left out."""
    x, w = x.astype("float64").to_numpy(), weight.astype("float64").to_numpy()
    good = ~(np.isnan(x) | np.isnan(w))
    x, w = x[good], w[good]
    return _pack(w.sum(), (w * x).sum(), (w * x * x).sum())


def stats_merge(state: pd.Series) -> bytes:
    """The state of several parts together."""
    return np.frombuffer(b"".join(map(bytes, state.dropna())), "<f8").reshape(-1, 3).sum(axis=0).astype("<f8").tobytes()


def stats_value(state: pd.Series) -> pd.DataFrame:
    """Weight, mean and population variance; the latter two null without weight."""
    known = state.notna().to_numpy()
    cells = np.zeros((len(state), 3))
    cells[known] = np.frombuffer(b"".join(map(bytes, state[known])), "<f8").reshape(-1, 3)
    n = cells[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(n != 0, cells[:, 1] / n, np.nan)
        variance = np.where(n != 0, np.maximum(cells[:, 2] / n - mean * mean, 0.0), np.nan)
    as_null = lambda v: pd.Series(v, dtype="object").where(~np.isnan(v), None)
    return pd.DataFrame({"n": n, "mean": as_null(mean), "variance": as_null(variance)})


def _functions() -> dict:
    from pyspark.sql.functions import PandasUDFType, pandas_udf

    return {"stats_state": pandas_udf(stats_state, "binary", PandasUDFType.GROUPED_AGG), "stats_merge": pandas_udf(stats_merge, "binary", PandasUDFType.GROUPED_AGG), "stats_value": pandas_udf(stats_value, VALUE)}


def register(spark: SparkSession) -> None:
    """``stats_state(x, weight)``, ``stats_merge(state)`` and ``stats_value(state)`` in SQL."""
    for name, f in _functions().items():
        spark.udf.register(name, f)


def weighted_stats(rows: DataFrame, keys: list[str], x: str = "x", weight: str | None = None, parts: int = 64) -> DataFrame:
    """``keys, n, mean, variance``: a group is cut in ``parts`` by the hash of its rows' place, and the parts' states are merged."""
    f = _functions()
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    dealt = rows.select(*keys, F.col(x).cast("double").alias("_x"), w.alias("_w"), F.pmod(F.monotonically_increasing_id(), F.lit(parts)).alias("_part"))
    states = dealt.groupBy(*keys, "_part").agg(f["stats_state"]("_x", "_w").alias("_state"))
    return states.groupBy(*keys).agg(f["stats_merge"]("_state").alias("_state")).withColumn("_v", f["stats_value"]("_state")).select(*keys, "_v.*")
