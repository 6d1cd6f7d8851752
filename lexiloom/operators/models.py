"""Mergeable sufficient statistics and the models estimated from them. Vectors are array columns ``x``."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def accumulate(vectors: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """``keys, dim, n, s, q``: weight, weighted sum and sum of squares for each key and dimension."""
    weight = F.lit(1) if weight is None else weight
    spread = vectors.select(*keys, weight.alias("_w"), F.posexplode("x").alias("dim", "v"))
    return spread.groupBy(*keys, "dim").agg(F.sum("_w").alias("n"), F.sum(F.col("_w") * F.col("v")).alias("s"), F.sum(F.col("_w") * F.col("v") * F.col("v")).alias("q"))


def combine_accumulators(*parts: DataFrame) -> DataFrame:
    keys = [c for c in parts[0].columns if c not in ("n", "s", "q")]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))


def gaussian_estimate(acc: DataFrame, min_variance: float = 0.0) -> DataFrame:
    """Mean and population variance, the latter not below the floor."""
    mean = F.col("s") / F.col("n")
    return acc.withColumn("mean", mean).withColumn("var", F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(min_variance)))


def _whole(vectors: DataFrame, d: int) -> DataFrame:
    """Vectors of d components without nulls; matrices leave out all others."""
    return vectors.filter((F.size("x") == d) & ~F.exists("x", lambda v: v.isNull()))


def products(vectors: DataFrame, d: int) -> DataFrame:
    """``i, j, n, p``: sums of products of the lower triangle. A task multiplies its batches as matrices and sends d (d + 1) / 2 sums."""
    whole = vectors.schema["x"].dataType.elementType.typeName() in ("byte", "short", "integer", "long")
    number, kind = ("bigint", np.int64) if whole else ("double", np.float64)
    i, j = np.tril_indices(d)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums = 0, np.zeros((d, d), kind)
        for b in batches:
            if len(b):
                m = np.stack(b["x"].to_list()).astype(kind)
                n, sums = n + len(b), sums + m.T @ m
        if n:
            yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "n": n, "p": sums[i, j]})

    parts = _whole(vectors, d).select("x").mapInPandas(partial, f"i int, j int, n bigint, p {number}")
    return parts.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))


def _sums(vectors: DataFrame, keys: list[str], d: int) -> DataFrame:
    sums = _whole(vectors, d).groupBy(*keys).agg(*(F.sum(F.element_at("x", i + 1)).alias(f"s{i}") for i in range(d)))
    return sums.select(*keys, F.posexplode(F.array(*(F.col(f"s{i}") for i in range(d)))).alias("dim", "s"))


def _product(vectors: DataFrame, a: str, b: str) -> Column:
    """The product of two sums as a double; whole numbers are multiplied exactly, as their product may be beyond a long."""
    if vectors.schema["x"].dataType.elementType.typeName() in ("byte", "short", "integer", "long"):
        return (F.col(a).cast("decimal(19,0)") * F.col(b).cast("decimal(19,0)")).cast("double")
    return F.col(a) * F.col(b)


def covariance(vectors: DataFrame, d: int, normalise: bool = True, floor: float | None = None) -> DataFrame:
    """``i, j, v``: scatter around the mean, divided by n if ``normalise``; elements below ``floor`` are raised to it."""
    s = _sums(vectors, [], d)
    joined = products(vectors, d).join(F.broadcast(s.select(F.col("dim").alias("i"), F.col("s").alias("si"))), "i").join(F.broadcast(s.select(F.col("dim").alias("j"), F.col("s").alias("sj"))), "j")  # d rows each
    v = F.col("p") - _product(vectors, "si", "sj") / F.col("n")
    v = v / F.col("n") if normalise else v
    return joined.select("i", "j", (v if floor is None else F.greatest(v, F.lit(floor))).alias("v"))


def scatter_matrices(vectors: DataFrame, d: int) -> DataFrame:
    """``i, j, between, within, total`` of labelled vectors."""
    s = _sums(vectors, ["label"], d)
    n = _whole(vectors, d).groupBy("label").agg(F.count("*").alias("n"))
    per_class = s.select("label", F.col("dim").alias("i"), F.col("s").alias("si")).join(s.select("label", F.col("dim").alias("j"), F.col("s").alias("sj")), "label").filter("j <= i").join(n, "label")
    classes = per_class.groupBy("i", "j").agg(F.sum(_product(vectors, "si", "sj") / F.col("n")).alias("c"))
    g = _sums(vectors, [], d)
    glob = g.select(F.col("dim").alias("i"), F.col("s").alias("gi")).crossJoin(g.select(F.col("dim").alias("j"), F.col("s").alias("gj"))).filter("j <= i")  # d rows each
    all_of = products(vectors, d).join(classes, ["i", "j"]).join(glob, ["i", "j"])
    mean = _product(vectors, "gi", "gj") / F.col("n")
    return all_of.select("i", "j", (F.col("c") - mean).alias("between"), (F.col("p") - F.col("c")).alias("within"), (F.col("p") - mean).alias("total"))


def class_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("n"))


def log_prior(counts: DataFrame, backoff: float = 0.0) -> DataFrame:
    """Logarithm of the normalised ``max(count, backoff)``."""
    n = F.greatest(F.col("n").cast("double"), F.lit(backoff))
    total = counts.agg(F.sum(n).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("label", F.ln(n / F.col("total")).alias("log_prior"))  # one row


def map_class_labels(counts: DataFrame, disregard: DataFrame) -> DataFrame:
    """Dense new indices of the classes that are kept: there is one row for each class."""
    kept = counts.join(disregard, "label", "left_anti")
    return kept.select("label", (F.dense_rank().over(Window.orderBy("label")) - 1).alias("mapped"))


def all_scores(vectors: DataFrame, densities: DataFrame) -> DataFrame:
    """Vectors with ``_scores``, an array of ``score, density``.

    ``densities(density, dim, mean, var[, weight])`` is a model with every dimension from 0: its size does not grow with the corpus, so it joins every
    vector as one broadcast row, and no component or score is shuffled. A score is half of ``sum((x - mean)^2 / var) + ln(2 pi var)`` over dimensions,
    without the logarithm of the weight if there is one. Null or missing components add nothing; vectors without ``x`` go.
    """
    weight = F.first("weight") if "weight" in densities.columns else F.lit(1.0)
    cells = F.array_sort(F.collect_list(F.struct("dim", F.col("mean").alias("mean"), F.col("var").alias("var"), F.ln(2 * F.pi() * F.col("var")).alias("norm"))))
    each = densities.groupBy("density").agg(cells.alias("cells"), F.ln(weight).alias("prior"))
    model = each.agg(F.array_sort(F.collect_list(F.struct("density", "cells", "prior"))).alias("_model"))

    def score(one: Column) -> Column:
        cell = F.zip_with("x", one["cells"], lambda v, c: F.coalesce(F.pow(v - c["mean"], 2) / c["var"] + c["norm"], F.lit(0.0)))
        return F.struct((0.5 * F.aggregate(cell, F.lit(0.0), lambda a, v: a + v) - one["prior"]).alias("score"), one["density"].alias("density"))

    scored = vectors.filter("x IS NOT NULL").crossJoin(F.broadcast(model))  # one row
    return scored.withColumn("_scores", F.transform("_model", score)).drop("_model")


def density_scores(vectors: DataFrame, densities: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, density, score`` for each vector and density; low is near."""
    return all_scores(vectors, densities).select(*keys, F.inline("_scores")).select(*keys, "density", "score")


def best_density(vectors: DataFrame, densities: DataFrame) -> DataFrame:
    """Each vector with its ``density`` of the lowest ``score``; of equal scores the first density counts."""
    return all_scores(vectors, densities).withColumn("_best", F.array_min("_scores")).drop("_scores").withColumns({"score": F.col("_best.score"), "density": F.col("_best.density")}).drop("_best")


def mixture_scores(vectors: DataFrame, densities: DataFrame) -> DataFrame:
    """Each vector with the ``score`` of the whole mixture: minus the logarithm of the summed weighted densities."""
    low = F.array_min(F.transform("_scores", lambda s: s["score"]))
    total = F.aggregate("_scores", F.lit(0.0), lambda a, s: a + F.exp(F.col("_low") - s["score"]))
    return all_scores(vectors, densities).withColumn("_low", low).withColumn("score", F.col("_low") - F.ln(total)).drop("_scores", "_low")


def bayes_window(frames: DataFrame, densities: DataFrame, length: int, order: list[str]) -> DataFrame:
    """Each of the frames ``segment_id, x, ...`` with the ``density`` of the lowest summed ``score`` of the last ``length`` frames up to it; of equals the first."""
    w = Window.partitionBy("segment_id").orderBy(*order).rowsBetween(1 - length, Window.currentRow)
    add = lambda a, b: F.zip_with(a, b, lambda p, q: F.struct((p["score"] + q["score"]).alias("score"), p["density"].alias("density")))
    kept = all_scores(frames, densities).withColumn("_kept", F.collect_list("_scores").over(w))
    total = F.aggregate(F.slice("_kept", F.lit(2), F.size("_kept")), F.element_at("_kept", 1), add)
    return kept.withColumn("_best", F.array_min(total)).withColumns({"score": F.col("_best.score"), "density": F.col("_best.density")}).drop("_best", "_kept", "_scores")


def density_clusters(vectors: DataFrame, start: DataFrame, iterations: int) -> DataFrame:
    """``density, dim, mean`` of clusters of density means: each round the means of ``vectors(x)`` go to their nearest cluster, whose mean they become.

    ``start(density, dim, mean)`` are the first clusters; one that is nearest to none keeps its mean. The clusters are a small model, collected after every round.
    """
    spark, model = vectors.sparkSession, start.select("density", "dim", "mean")
    for _ in range(iterations):
        near = best_density(vectors, model.withColumn("var", F.lit(1.0)))
        new = accumulate(near, ["density"]).select("density", "dim", (F.col("s") / F.col("n")).alias("_new"))
        moved = model.join(new, ["density", "dim"], "left").select("density", "dim", F.coalesce("_new", "mean").alias("mean"))
        model = spark.createDataFrame(moved.collect(), moved.schema)
    return model


def gmm_train(vectors: DataFrame, start: DataFrame, iterations: int, min_variance: float = 1e-3, threshold: float | None = None) -> DataFrame:
    """``density, dim, mean, var, weight`` by Viterbi training: every vector goes to its best density, which is then estimated anew in the same pass.

    It ends early once the mean score falls by less than the share ``threshold``, if one is given. ``start`` and each model are small tables of densities; one is collected
    after every round to cut the lineage. Densities without vectors vanish.
    """
    spark, model, before = vectors.sparkSession, start, None
    share = F.col("n") / F.sum("n").over(Window.partitionBy("dim"))  # of a model
    for _ in range(iterations):
        seen = Observation()
        best = best_density(vectors, model).observe(seen, F.avg("score").alias("score"))
        new = gaussian_estimate(accumulate(best, ["density"]), min_variance).select("density", "dim", "mean", "var", share.alias("weight"))
        weighted, model = "weight" in model.columns, spark.createDataFrame(new.collect(), new.schema)
        now = seen.get["score"] if weighted else None  # scores without weights are another measure
        if threshold is not None and before is not None and now is not None and before - now < threshold * abs(before):
            break
        before = now
    return model


def mixture_prior(acc: DataFrame, label_map: DataFrame) -> DataFrame:
    """``label, log_prior``: logarithm of a label's share of all density weights ``acc(mixture, density, n)`` by ``label_map(mixture, label)``."""
    n = acc.join(label_map, "mixture").groupBy("label").agg(F.sum("n").cast("double").alias("n"))
    return log_prior(n)


def gmm_split(densities: DataFrame, share: float = 0.5) -> DataFrame:
    """Each density becomes two, its mean moved by plus and minus a share of the deviation."""
    moved = [densities.select((F.col("density") * 2 + k).alias("density"), "dim", (F.col("mean") + sign * share * F.sqrt("var")).alias("mean"), "var") for k, sign in ((0, -1), (1, 1))]
    return moved[0].unionByName(moved[1])


def gmm_prune(acc: DataFrame, min_weight: float, min_rel: float) -> DataFrame:
    """``mixture, density, n`` without densities below ``max(min_weight, total * min_rel)``, but never without the heaviest."""
    w = Window.partitionBy("mixture")
    bar = F.greatest(F.lit(min_weight), F.sum("n").over(w) * min_rel)
    first = F.row_number().over(w.orderBy(F.desc("n"), "density")) == 1
    return acc.withColumn("_keep", (F.col("n") >= bar) | first).filter("_keep").drop("_keep")


def map_accumulators(acc: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Merge accumulators by ``mapping(key, target)``."""
    return acc.join(mapping, key).groupBy("target", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))


def cart_examples(rows: DataFrame, properties: list[str], label: str) -> DataFrame:
    """One row for each distinct property set and class with its count."""
    return rows.groupBy(*properties, label).agg(F.count("*").alias("n"))


def entropy(counts: Column) -> Column:
    """Bits of an array of counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
    return F.aggregate(counts, F.lit(0.0), lambda a, b: a - F.when(b > 0, b / total * F.log2(b / total)).otherwise(0.0))


def split_gain(examples: DataFrame, questions: dict[str, Column], label: str) -> DataFrame:
    """Entropy gain of each yes/no question: one aggregation for all. Children weigh by the number of example rows."""
    asked = examples.select(label, "n", F.explode(F.array(*(F.struct(F.lit(k).alias("question"), F.coalesce(q, F.lit(False)).alias("yes")) for k, q in questions.items()))).alias("a")).select(label, "n", "a.question", "a.yes")
    cells = asked.groupBy("question", "yes", label).agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    sides = cells.groupBy("question", "yes").agg(F.collect_list(F.col("n").cast("double")).alias("counts"), F.sum("rows").alias("rows"))
    all_of = cells.groupBy("question", label).agg(F.sum("n").alias("n")).groupBy("question").agg(F.collect_list(F.col("n").cast("double")).alias("all_counts"))
    parted = sides.groupBy("question").agg(F.sum(entropy(F.col("counts")) * F.col("rows")).alias("parted"), F.sum("rows").alias("rows"))
    return parted.join(all_of, "question").select("question", (entropy(F.col("all_counts")) - F.col("parted") / F.col("rows")).alias("gain"))


def _best_questions(placed: DataFrame, label: str, min_obs: float, min_gain: float) -> DataFrame:
    """``node, gain, question``: the best split of every node by ``placed(node, label, n, answers)``; of equal gains the first question."""
    total = placed.groupBy("node", label).agg(F.sum("n").cast("double").alias("n")).groupBy("node").agg(entropy(F.collect_list("n")).alias("whole"))
    cells = placed.select("node", label, "n", F.posexplode("answers").alias("question", "yes")).groupBy("node", "question", "yes", label).agg(F.sum("n").cast("double").alias("n"), F.count("*").alias("rows"))
    sides = cells.groupBy("node", "question", "yes").agg(entropy(F.collect_list("n")).alias("h"), F.sum("n").alias("obs"), F.sum("rows").alias("rows"))
    splits = sides.groupBy("node", "question").agg(F.sum(F.col("h") * F.col("rows")).alias("parted"), F.sum("rows").alias("rows"), F.min("obs").alias("least"), F.count("*").alias("sides"))
    gains = splits.filter((F.col("sides") == 2) & (F.col("least") >= min_obs)).join(total, "node").select("node", "question", (F.col("whole") - F.col("parted") / F.col("rows")).alias("gain")).filter(F.col("gain") >= min_gain)
    return gains.groupBy("node").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "question")).alias("b")).select("node", (-F.col("b.loss")).alias("gain"), "b.question")


def cart_train(examples: DataFrame, questions: dict[str, Column], label: str, min_obs: float = 1.0, min_gain: float = 0.0, max_leaves: int = 256) -> dict | int:
    """A tree for ``cart_apply`` from examples with counts ``n``: the split of the largest entropy gain first, until ``max_leaves``.

    Both sides of a split hold ``min_obs`` observations at least; children weigh by their number of example rows. An undefined answer goes to "no".
    A job scores all nodes that the growth reaches next, so there are about as many jobs as levels; one row for each node comes to the driver.
    """
    asks = list(questions.values())
    answers = F.array(*(F.coalesce(q, F.lit(False)) for q in asks))
    known: dict[int, tuple[float, int] | None] = {}  # node -> best gain and question; node k has the children 2 k and 2 k + 1

    def grow() -> tuple[dict[int, int], list[int]]:
        """The splits that the known gains lead to, and the leaves, of which some may be unknown."""
        chosen, leaves = {}, [1]
        while len(leaves) < max_leaves:
            open_ = [k for k in leaves if known.get(k)]
            if not open_:
                break
            best = min(open_, key=lambda k: (-known[k][0], k))
            chosen[best] = known[best][1]
            leaves.remove(best)
            leaves += [2 * best, 2 * best + 1]
        return chosen, sorted(leaves)

    def tree(chosen: dict[int, int], leaf, k: int = 1):
        return {"question": asks[chosen[k]], "yes": tree(chosen, leaf, 2 * k), "no": tree(chosen, leaf, 2 * k + 1)} if k in chosen else leaf(k)

    chosen, leaves = grow()
    while unknown := [k for k in leaves if k not in known]:
        number = {k: i for i, k in enumerate(leaves)}
        placed = cart_apply(examples.withColumn("answers", answers), tree(chosen, number.get), "node").filter(F.col("node").isin([number[k] for k in unknown]))
        found = {leaves[r.node]: (r.gain, r.question) for r in _best_questions(placed.select("node", label, "n", "answers"), label, min_obs, min_gain).collect()}
        known |= {k: found.get(k) for k in unknown}
        chosen, leaves = grow()
    number = {k: i for i, k in enumerate(leaves)}
    return tree(chosen, number.get)


def cart_apply(rows: DataFrame, tree: dict, name: str = "leaf") -> DataFrame:
    """``tree`` is a leaf number or ``{"question": Column, "yes": tree, "no": tree}``; an undefined answer goes to "no"."""

    def walk(node) -> Column:
        return F.lit(node) if isinstance(node, int) else F.when(node["question"], walk(node["yes"])).otherwise(walk(node["no"]))

    return rows.withColumn(name, walk(tree))


def cart_leaf_report(examples: DataFrame, label: str) -> DataFrame:
    """``leaf, n, rows, classes, entropy, best`` of examples with ``leaf`` and count ``n``; of equally frequent classes the least is best."""
    cells = examples.groupBy("leaf", label).agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    best = F.min_by(F.col(label), F.struct(-F.col("n"), F.col(label)))
    return cells.groupBy("leaf").agg(F.sum("n").alias("total"), F.sum("rows").alias("rows"), F.count("*").alias("classes"), F.collect_list(F.col("n").cast("double")).alias("_n"), best.alias("best")).withColumn("entropy", entropy(F.col("_n"))).drop("_n").withColumnRenamed("total", "n")


def _matrix(cells: DataFrame, value: str):
    """The d x d matrix of a lower triangle ``i, j, value``; d does not grow with the corpus."""
    rows = cells.select("i", "j", F.col(value).alias("v")).collect()
    d = 1 + max(r.i for r in rows)
    out = np.zeros((d, d))
    for r in rows:
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def _as_table(spark, vectors, values) -> DataFrame:
    cells = [(k, i, float(vectors[i, k]), float(values[k])) for k in range(vectors.shape[1]) for i in range(vectors.shape[0])]
    return spark.createDataFrame(cells, "component int, dim int, weight double, value double")


def pca(cov: DataFrame, k: int | None = None, share: float = 1.0, least: float | None = None) -> DataFrame:
    """``component, dim, weight, value``: the k largest eigenvectors of a covariance table, or those of values of ``least`` or more, or the fewest that hold ``share`` of the variance; signs by their largest entry.

    The three rules exclude each other.
    """
    if (k is not None) + (least is not None) + (share != 1.0) > 1:
        raise ValueError("a number, a least value or a share of the variance can be asked for, not several")
    values, vectors = np.linalg.eigh(_matrix(cov, "v"))
    values, vectors = values[::-1], vectors[:, ::-1]
    if least is not None:
        k = int(np.count_nonzero(values >= least))
    elif k is None:
        k = min(len(values), 1 + int(np.searchsorted(np.cumsum(values), share * values.sum() * (1 - 1e-12))))
    vectors = vectors[:, :k]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    return _as_table(cov.sparkSession, vectors, values[:k])


def lda(scatter: DataFrame, k: int) -> DataFrame:
    """The k leading solutions of ``between v = value within v`` by Cholesky whitening of the d x d matrices."""
    low = np.linalg.cholesky(_matrix(scatter, "within"))
    inverse = np.linalg.inv(low)
    values, vectors = np.linalg.eigh(inverse @ _matrix(scatter, "between") @ inverse.T)
    vectors = (inverse.T @ vectors)[:, ::-1][:, :k]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    return _as_table(scatter.sparkSession, vectors, values[::-1][:k])


def project(vectors: DataFrame, components: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, component, y``: vectors times components, which are a small model with every dimension from 0 and join as one broadcast row."""
    each = components.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "weight"))), lambda c: c["weight"]).alias("weights"))
    model = each.agg(F.array_sort(F.collect_list(F.struct("component", "weights"))).alias("_model"))

    def one(c: Column) -> Column:
        terms = F.zip_with("x", c["weights"], lambda v, w: F.coalesce(v * w, F.lit(0.0)))
        return F.struct(c["component"].alias("component"), F.aggregate(terms, F.lit(0.0), lambda a, v: a + v).alias("y"))

    return vectors.filter("x IS NOT NULL").crossJoin(F.broadcast(model)).select(*keys, F.inline(F.transform("_model", one)))  # one row
