"""Mixtures, trees, alignments with broken words, quantiles and interpolation against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import quantiles
from lexiloom.operators import evaluate, frames, mixtures, models, trees, vectors


def em_round(x, labels, model, viterbi, threshold, floor):
    """One round of training by the definition; ``model`` is label -> list of (density, mean, variance, weight)."""
    out, likelihood = {}, 0.0
    for label, densities in model.items():
        rows = x[labels == label]
        logs = np.array([[np.log(w) - 0.5 * (((v - m) ** 2) / s + np.log(2 * np.pi * s)).sum() for _, m, s, w in densities] for v in rows])
        total = np.logaddexp.reduce(logs, axis=1)
        likelihood += total.sum()
        share = np.eye(len(densities))[logs.argmax(axis=1)] if viterbi else np.exp(logs - total[:, None])
        share[share <= threshold] = 0
        n = share.sum(axis=0)
        kept = [k for k in range(len(densities)) if n[k] > 0]
        out[label] = [(densities[k][0], share[:, k] @ rows / n[k], np.maximum(share[:, k] @ (rows**2) / n[k] - (share[:, k] @ rows / n[k]) ** 2, floor), n[k] / n.sum()) for k in kept]
    return out, likelihood / len(x)


@pytest.mark.parametrize("viterbi", [True, False])
def test_mixtures_by_label(spark, viterbi):
    rng = np.random.default_rng(4)
    labels = rng.choice(["a", "b"], 200)
    x = rng.normal(size=(200, 3)) + 3 * rng.integers(0, 2, (200, 1)) + 5 * (labels == "b")[:, None]
    data = spark.createDataFrame([(str(c), [float(v) for v in r]) for c, r in zip(labels, x)] + [("c", [0.0, 0.0, 0.0]), (None, [0.0, 0.0, 0.0]), ("a", None), ("a", [1.0, None, 2.0]), ("b", [1.0])], "label string, x array<double>").repartition(3)
    model = {c: [(k, np.full(3, float(2 * k + 5 * (c == "b"))), np.ones(3), 0.5) for k in range(2)] for c in "ab"}
    model["b"].append((7, np.full(3, 500.0), np.ones(3), 1e-9))  # meets no vector
    start = spark.createDataFrame([(c, k, d, float(m[d]), float(s[d]), w) for c, ds in model.items() for k, m, s, w in ds for d in range(3)], "label string, density int, dim int, mean double, var double, weight double")
    likelihoods = []
    for _ in range(3):
        model, now = em_round(x, labels, model, viterbi, 1e-6, 1e-3)
        likelihoods.append(now)
    got = {(r.label, r.density, r.dim): (r.mean, r["var"], r.weight) for r in mixtures.train_mixtures(data, start, 3, viterbi, weight_threshold=1e-6).collect()}
    want = {(c, k, d): (m[d], s[d], w) for c, ds in model.items() for k, m, s, w in ds for d in range(3)}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)
    assert likelihoods == sorted(likelihoods)
    short = mixtures.train_mixtures(data, start, 50, viterbi, weight_threshold=1e-6, stop=10.0)  # stops once a second round is known
    two = mixtures.train_mixtures(data, start, 2, viterbi, weight_threshold=1e-6)
    assert sorted(map(tuple, short.collect())) == sorted(map(tuple, two.collect()))
    final = mixtures.log_likelihood(data.filter("label = 'a'"), start).first()
    plain = np.logaddexp.reduce([np.log(0.5) - 0.5 * (((x[labels == "a"] - 2.0 * k) ** 2) + np.log(2 * np.pi)).sum(axis=1) for k in range(2)], axis=0)
    assert final.likelihood == pytest.approx(plain.mean()) and final.n == (labels == "a").sum()
    weighted = mixtures.train_mixtures(data.withColumn("weight", F.lit(2.0)), start, 1, viterbi, weight_threshold=1e-6)
    plain_round = mixtures.train_mixtures(data, start, 1, viterbi, weight_threshold=1e-6)
    assert {(r.label, r.density, r.dim): round(r.mean, 4) for r in weighted.collect()} == {(r.label, r.density, r.dim): round(r.mean, 4) for r in plain_round.collect()}
    pruned = mixtures.train_mixtures(data, start, 1, viterbi, min_weight=1e9)
    assert pruned.groupBy("label").agg(F.count_distinct("density").alias("n")).filter("n <> 1").isEmpty()
    assert mixtures.train_mixtures(data.limit(0), start, 1, viterbi).count() == 0


def plain_tree(rows, plan, most, cost):
    """The greedy growth by its definition: ``rows`` are (properties, n, payload), questions are functions."""
    leaves, done, closed = [("", rows)], [], []
    for action, questions, min_obs, min_gain in plan:
        open_, waiting = leaves, []
        leaves = []
        while open_ and len(open_) + len(waiting) + len(closed) < most:
            best = None
            for i, (path, part) in enumerate(open_):
                for q, ask in enumerate(questions):
                    yes, no = [r for r in part if ask(r[0])], [r for r in part if not ask(r[0])]
                    if not yes or not no or min(sum(r[1] for r in yes), sum(r[1] for r in no)) < min_obs:
                        continue
                    gain = cost(part, yes, no)
                    if gain >= min_gain and gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, i, yes, no)
            if best is None:
                break
            _, i, yes, no = best
            path, _ = open_.pop(i)
            open_.append((path + "n", no))
            (open_ if action == "split" else waiting if action == "partition" else closed).append((path + "y", yes))
        leaves = open_ + waiting
    return {path: {r[0] for r in part} for path, part in leaves + closed}


def gaussian_cost(part):
    n = sum(r[1] for r in part)
    s, q = (sum(np.array(r[2][k]) for r in part) for k in (0, 1))
    return 0.5 * n * (len(s) * (1 + math.log(2 * math.pi)) + np.log(np.maximum(q / n - (s / n) ** 2, 1e-3)).sum())


@pytest.mark.parametrize("kind", ["gaussian", "entropy"])
def test_trees_by_a_plan(spark, kind):
    rnd = random.Random(8)
    rows = []
    for k in range(60):
        a, b, n = rnd.randint(0, 5), rnd.randint(0, 3), rnd.randint(1, 9)
        points = [(rnd.gauss(3.0 * (a > 2), 1), rnd.gauss(2.0 * (b > 0) * (a > 2) - a / 3, 1)) for _ in range(n)]
        rows.append(((k, a, b), n, ([sum(p[i] for p in points) for i in range(2)], [sum(p[i] ** 2 for p in points) for i in range(2)], rnd.choice("xyz") if rnd.random() < 0.3 else "x" if a > 2 else "y")))
    data = spark.createDataFrame([(*p, n, s, q, c) for p, n, (s, q, c) in rows], "k int, a int, b int, n int, s array<double>, q array<double>, c string").repartition(3)
    plan = [("split", [lambda p, t=t: p[1] > t for t in range(5)], 20, 0.01), ("cluster", [lambda p, t=t: p[2] > t for t in range(3)], 5, 0.0), ("partition", [lambda p: p[0] % 2 == 0], 1, 0.0)]
    steps = [trees.Step({f"a{t}": F.col("a") > t for t in range(5)}, "split", 20, 0.01), trees.Step({f"b{t}": F.col("b") > t for t in range(3)}, "cluster", 5, 0.0), trees.Step({"even": F.col("k") % 2 == 0}, "partition", 1, 0.0)]

    def bits(part):
        total = sum(r[1] for r in part)
        return -sum(v / total * math.log2(v / total) for v in (sum(r[1] for r in part if r[2][2] == c) for c in "xyz") if v)

    gains = {"gaussian": lambda part, yes, no: gaussian_cost(part) - gaussian_cost(yes) - gaussian_cost(no), "entropy": lambda part, yes, no: bits(part) - (len(yes) * bits(yes) + len(no) * bits(no)) / len(part)}
    for most in (4, 9, 30):
        want = plain_tree(rows, plan, most, gains[kind])
        tree = trees.grow_tree(data, steps, None if kind == "gaussian" else "c", max_leaves=most)
        got = {}
        for r in models.cart_apply(data, tree).collect():
            got.setdefault(r.leaf, set()).add((r.k, r.a, r.b))
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert trees.grow_tree(data.limit(0), steps, "c") == 0 and trees.grow_tree(data, [], "c") == 0


def broken(a, b):
    """The rule by its wording; a part within a word ends two bytes before the word's end at least."""
    if a == b:
        return True
    if a.startswith("-") and a.endswith("-") and len(a) > 1:
        part = a[1:-1]
        return any(b[k : k + len(part)] == part and len(b) - k - len(part) >= 2 for k in range(len(b)))
    if a.startswith("-"):
        return b.endswith(a[1:])
    return a.endswith("-") and b.startswith(a[:-1]) and not b.startswith(a)


def test_broken_words(spark, monkeypatch):
    rnd = random.Random(6)
    word = lambda hyphens: rnd.choice(["", "", "-"] if hyphens else [""]) + "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 3))) + rnd.choice(["", "", "-"] if hyphens else [""])
    for _ in range(300):
        a, b = word(True), word(False)
        assert evaluate.is_broken_match(a, b) == broken(a, b), (a, b)
    for cells in (1 << 20, 12):
        monkeypatch.setattr(evaluate, "CELLS", cells)
        for _ in range(60):
            a, b = [word(True) for _ in range(rnd.randint(0, 8))], [word(False) for _ in range(rnd.randint(0, 8))]
            cost = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i in range(len(a) + 1):
                for j in range(len(b) + 1):
                    if i or j:
                        cost[i][j] = min([cost[i - 1][j] + 2] * (i > 0) + [cost[i][j - 1] + 1] * (j > 0) + ([cost[i - 1][j - 1] + 3 * (not broken(a[i - 1], b[j - 1]))] if i and j else []))
            pairs = evaluate.align(a, b, 1, 2, 3, broken=True)
            assert sum(2 if j < 0 else 1 if i < 0 else 3 * (not broken(a[i], b[j])) for i, j in pairs) == cost[-1][-1]
    rows = [("x", ["ab-", "c"], ["abc", "c"]), ("y", ["-bc"], ["x"])]
    data = spark.createDataFrame(rows, "segment_id string, ref array<string>, hyp array<string>")
    assert {r.segment_id: r.n_sub for r in evaluate.word_errors(data, broken=True).collect()} == {"x": 0, "y": 1}
    assert {r.segment_id: r.n_sub for r in evaluate.word_errors(data).collect()} == {"x": 1, "y": 1}


def test_order_statistics(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "PARTS", 4)  # more passes
    rnd = random.Random(1)
    for values in ([5.0], [1.0, 1.0, 1.0], [rnd.gauss(0, 1) for _ in range(300)], [10.0 ** rnd.randint(-300, 300) * rnd.choice([-1, 1]) for _ in range(200)], [-1.7e308, 0.0, 1.7e308]):
        data = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double").repartition(3)
        ranks = sorted({0, len(values) - 1, len(values) // 2, len(values) // 3})
        assert quantiles.order_statistics(data, "x", ranks) == [sorted(values)[r] for r in ranks]
    data = spark.createDataFrame([(float(v),) for v in range(7)], "x double")
    assert quantiles.exact_percentiles(data, "x", [0.0, 0.25, 0.4]) == pytest.approx([0, 1.5, 2.4]) and quantiles.exact_percentiles(data.limit(0), "x", [0.5]) == []
    with pytest.raises(ValueError):
        quantiles.order_statistics(data, "x", [7])


def test_window_kinds_in_one_pass(spark):
    """Blocks that go on over Arrow batches, short segments beside a long one, and windows of too few frames."""
    rng = np.random.default_rng(5)
    x = {s: rng.integers(1, 50, (t, 2)).astype(float) for s, t in (("a", 1), ("b", 3), ("c", 41), ("d", 12), ("e", 7))}
    data = spark.createDataFrame([(s, t, v.tolist()) for s, vs in x.items() for t, v in enumerate(vs)], "segment_id string, tick long, x array<double>")
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "5")
    try:
        rows = vectors.window_normalise_kinds(data, {"mean": 1, "divide-by-mean": 5}, 6, 2, [], block=8).collect()
    finally:
        spark.conf.set(setting, before)
    assert len(rows) == sum(map(len, x.values()))
    for r in rows:
        vs = x[r.segment_id]
        end = min(r.tick + 2, len(vs) - 1)
        window = vs[max(0, end - 5) : end + 1]
        assert np.allclose(r["mean"], vs[r.tick] - window.mean(axis=0))
        assert r["divide-by-mean"] is None if len(window) < 5 else np.allclose(r["divide-by-mean"], vs[r.tick] / window.mean(axis=0))


def test_window_quantiles(spark):
    rnd = random.Random(2)
    x = {s: [rnd.randint(0, 50) for _ in range(n)] for s, n in ((1, 40), (2, 3), (3, 1))}
    data = spark.createDataFrame([(s, t, v) for s, row in x.items() for t, v in enumerate(row)], "segment_id int, tick int, x long")
    for length, right, block in ((7, 2, 5), (7, 0, 100), (50, 3, 8), (4, 3, 3)):
        got = {(r.segment_id, r.tick): r.quantiles for r in vectors.window_quantiles(data, 4, length, right, [], block).collect()}
        assert len(got) == data.count()
        for (s, t), q in got.items():
            e = min(t + right, len(x[s]) - 1)
            w = sorted(x[s][max(0, e - length + 1) : e + 1])
            assert q == [w[k * (len(w) - 1) // 4] for k in range(5)]


def test_polynomials(spark):
    points = {1: [(0, 1.0), (2, 5.0), (3, 4.0), (7, 0.0), (8, 2.0)], 2: [(4, 3.0)]}
    data = spark.createDataFrame([(s, t, v) for s, p in points.items() for t, v in p], "segment_id int, tick long, x double")
    target = spark.createDataFrame([(s, t) for s in (1, 2, 3) for t in range(-1, 10)], "segment_id int, tick long")
    for order in (1, 2, 3, 4, 9):
        got = {(r.segment_id, r.tick): r.x for r in frames.interpolate_polynomial(data, target, order, "flag").collect()}
        assert len(got) == 33
        for (s, t), value in got.items():
            p = points.get(s, [])
            if not p or not p[0][0] <= t <= p[-1][0]:
                assert value is None
                continue
            c = next(k for k, (u, _) in enumerate(p) if u >= t)
            e = min(max(c + order // 2, order), len(p) - 1)
            used = p[max(e - order, 0) : e + 1]
            want = sum(v * math.prod((t - b) / (a - b) for b, _ in used if b != a) for a, v in used)
            assert value == pytest.approx(want)
    assert frames.interpolate_polynomial(data, target, 2).count() == 10
    with pytest.raises(Exception, match="outside"):
        frames.interpolate_polynomial(data, target, 2, "error").collect()


def test_random_vectors_do_not_depend_on_partitions(spark):
    rows = spark.range(200).withColumnRenamed("id", "k")
    a = {r.k: r.x for r in vectors.random_vectors(rows.repartition(1), 4, 3, ["k"]).collect()}
    b = {r.k: r.x for r in vectors.random_vectors(rows.repartition(7), 4, 3, ["k"]).collect()}
    c = {r.k: r.x for r in vectors.random_vectors(rows, 4, 4, ["k"]).collect()}
    assert a == b and a != c
    flat = np.array(list(a.values())).ravel()
    assert abs(flat.mean()) < 0.12 and abs(flat.std() - 1) < 0.1


def test_equal_answers_are_added_up_before_python(spark):
    data = spark.range(1000).selectExpr("0 AS node", "array(id % 2 = 0, id % 3 = 0) AS answers", "1 AS n", "array(id % 6) AS s", "array((id % 6) * (id % 6)) AS q")
    best = trees._gaussian_questions(data, 2, 1, 1.0, 0.0, 1e-3)
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [node" in plan[plan.index("MapInPandas") :]
    assert best.count() == 1
