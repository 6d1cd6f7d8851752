"""Mixtures of diagonal Gaussians, one for each label, trained together with hard or soft counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a model that is broadcast; the model is the user's choice and does not grow with the corpus.
MODEL_BYTES = 256 << 20
#: Cells (vectors x densities x components) that a task works on at once.
CELLS = 1 << 20


def _tables(model: DataFrame) -> dict:
    """``label -> densities, means, 1 / variances, constants`` of a collected model."""
    rows = model.groupBy("label", "density").agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "var"))).alias("c"), F.first("weight").alias("weight")).orderBy("label", "density").collect()
    if sum(24 * len(r.c) for r in rows) > MODEL_BYTES:
        raise ValueError("the model is too large to be broadcast")
    out: dict = {}
    for r in rows:
        out.setdefault(r.label, []).append((r.density, [c.mean for c in r.c], [c["var"] for c in r.c], r.weight))
    tables = {}
    for label, densities in out.items():
        ids, means, variances, weights = (np.array(x) for x in zip(*densities, strict=True))
        tables[label] = (ids, means, 1 / variances, 0.5 * np.log(2 * np.pi * variances).sum(axis=1) - np.log(weights))
    return tables


def _scores(x: np.ndarray, table: tuple) -> np.ndarray:
    """Minus the logarithm of weight times density: vectors in rows."""
    _, means, inverse, constant = table
    step = max(1, CELLS // means.size)
    return np.concatenate([0.5 * (((x[k : k + step, None] - means) ** 2) * inverse).sum(axis=2) + constant for k in range(0, len(x), step)])


def _statistics(vectors: DataFrame, model: DataFrame, d: int, viterbi: bool, weight_threshold: float) -> DataFrame:
    """``label, density, n, v``: weights, and sums and sums of squares as one array; a row with density null has the vectors' weights and summed log-likelihood."""
    shared = vectors.sparkSession.sparkContext.broadcast(_tables(model))
    weighted = "weight" in vectors.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for frame in frames:
            for label, part in frame.groupby("label"):
                table = shared.value.get(label)
                if table is None:
                    continue
                x = np.stack(part["x"].to_list()).astype(np.float64)
                weight = part["weight"].to_numpy(np.float64) if weighted else np.ones(len(x))
                scores = _scores(x, table)
                low = scores.min(axis=1)
                total = np.exp(low[:, None] - scores).sum(axis=1)
                if viterbi:
                    share = np.zeros_like(scores)
                    share[np.arange(len(x)), scores.argmin(axis=1)] = 1
                else:
                    share = np.exp(low[:, None] - scores) / total[:, None]
                share = share * weight[:, None]
                if not viterbi:
                    share[share <= weight_threshold] = 0
                if label not in sums:
                    k = len(table[0])
                    sums[label] = [np.zeros(k), np.zeros((k, 2 * d)), 0.0, 0.0]
                held = sums[label]
                held[0] += share.sum(axis=0)
                held[1] += np.concatenate([share.T @ x, share.T @ (x * x)], axis=1)
                held[2] += weight.sum()
                held[3] += float((weight * (np.log(total) - low)).sum())
        for label, (n, v, all_of, likelihood) in sums.items():
            ids = shared.value[label][0].tolist()
            yield pd.DataFrame({"label": [label] * (len(ids) + 1), "density": pd.array([*ids, None], dtype="Int64"), "n": [*n.tolist(), all_of], "v": [*v.tolist(), [likelihood] + [0.0] * (2 * d - 1)]})

    kind = vectors.schema["label"].dataType.simpleString()
    good = vectors.filter(F.col("label").isNotNull() & (F.size("x") == d) & ~F.exists("x", lambda c: c.isNull())).select("label", "x", *(["weight"] if weighted else []))
    parts = good.mapInPandas(run, f"label {kind}, density long, n double, v array<double>")
    return parts.groupBy("label", "density").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("v", F.lit(i))) for i in range(2 * d))).alias("v"))


def train_mixtures(vectors: DataFrame, start: DataFrame, iterations: int, viterbi: bool = True, weight_threshold: float = 0.0, min_variance: float = 1e-3, min_weight: float = 0.0, min_relative: float = 0.0, stop: float | None = None) -> DataFrame:
    """``label, density, dim, mean, var, weight``: a mixture for each label, from ``vectors(label, x[, weight])`` and a first model of the same columns.

    A vector counts for the densities of its own label: for the best one (``viterbi``; of equals the first), or for each with its posterior, where weight times posterior is over
    ``weight_threshold``. All labels are trained in one pass a round: tasks add up weights, sums and squares for each density they meet, and only these are shuffled. Densities
    without weight vanish, as do those below ``max(min_weight, min_relative * the label's weight)``, but for the label's heaviest. Training ends early once the mean
    log-likelihood rises by less than the share ``stop``. Vectors that lack the label, a component or a mixture are left out; labels without vectors vanish.
    """
    spark = vectors.sparkSession
    d = start.agg(F.max("dim")).first()[0] + 1
    model, before = start.select("label", "density", "dim", "mean", "var", "weight"), None
    for _ in range(iterations):
        # a row for each density
        found = _statistics(vectors, model, d, viterbi, weight_threshold).collect()
        found = spark.createDataFrame(found, "label {}, density long, n double, v array<double>".format(vectors.schema["label"].dataType.simpleString()))
        by_label = Window.partitionBy("label")
        heavy = found.filter("density IS NOT NULL AND n > 0").withColumn("_first", F.row_number().over(by_label.orderBy(F.desc("n"), "density")) == 1)
        heavy = heavy.withColumn("_bar", F.greatest(F.lit(float(min_weight)), F.sum("n").over(by_label) * min_relative)).filter((F.col("n") >= F.col("_bar")) | F.col("_first"))
        heavy = heavy.withColumn("weight", F.col("n") / F.sum("n").over(by_label))
        cells = heavy.select("label", "density", "n", "v", "weight", F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("dim"))
        mean = F.get("v", F.col("dim")) / F.col("n")
        variance = F.greatest(F.get("v", F.col("dim") + d) / F.col("n") - mean * mean, F.lit(float(min_variance)))
        new = cells.select("label", "density", "dim", mean.alias("mean"), variance.alias("var"), "weight")
        model = spark.createDataFrame(new.collect(), new.schema)
        total = found.filter("density IS NULL").agg((F.sum(F.get("v", F.lit(0))) / F.sum("n")).alias("likelihood")).first()[0]
        if stop is not None and before is not None and total is not None and total - before < stop * abs(before):
            break
        before = total
    return model


def log_likelihood(vectors: DataFrame, model: DataFrame) -> DataFrame:
    """``label, n, likelihood``: weight and mean log-likelihood of each label's vectors in its mixture."""
    d = model.agg(F.max("dim")).first()[0] + 1
    return _statistics(vectors, model, d, False, 0.0).filter("density IS NULL").select("label", "n", (F.get("v", F.lit(0)) / F.col("n")).alias("likelihood"))
