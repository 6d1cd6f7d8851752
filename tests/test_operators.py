"""Small fixtures for what SQL does not show."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import corpus, counts, evaluate, frames, models, slots, transcripts


@pytest.fixture(scope="module")
def ten_by_three(spark):
    rows = [(f"c/r{r}/s{s}", r, r * 3 + s, float(s), s + 0.5 + (7 * r + s) % 5) for r in range(10) for s in range(3)]
    return spark.createDataFrame(rows, "segment_id string, recording_id int, seq long, start double, end double")


def test_partitions_are_disjoint_and_cover(ten_by_three):
    bucket = F.floor(F.col("seq") / 4)
    for by in ("segment", "recording"):
        parts = [{r.segment_id for r in corpus.partition_segments(ten_by_three, 4, k, bucket, by).collect()} for k in range(4)]
        assert sum(map(len, parts)) == 30 and len(set().union(*parts)) == 30
    assert {r.recording_id for r in corpus.partition_segments(ten_by_three, 4, 1, bucket, "recording").collect()} == {0, 4, 8}


def test_lists_by_full_and_short_name(spark, ten_by_three):
    names = spark.createDataFrame([("c/r1/s2",), ("s0",)], "name string")
    assert corpus.keep_segments(ten_by_three, names).count() == 11
    with pytest.raises(ValueError):
        corpus.keep_segments(ten_by_three, names.limit(0))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_alignment_cost_is_least():
    rnd = random.Random(3)
    for _ in range(200):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randint(0, 9))] for _ in "ab")
        pairs = evaluate.align(a, b)
        assert [i for i, _ in pairs if i >= 0] == list(range(len(a))) and [j for _, j in pairs if j >= 0] == list(range(len(b)))
        assert sum(i < 0 or j < 0 or a[i] != b[j] for i, j in pairs) == distance(a, b)


def test_word_errors(spark):
    rows = [("x", ["a", "b", "c"], ["a", "x", "c", "d"]), ("empty", [], []), ("ins", [], ["q"]), ("del", ["q"], [])]
    got = {r.segment_id: tuple(r)[1:] for r in evaluate.word_errors(spark.createDataFrame(rows, "segment_id string, ref array<string>, hyp array<string>")).collect()}
    assert got == {"x": (3, 1, 0, 1), "empty": (0, 0, 0, 0), "ins": (0, 1, 0, 0), "del": (1, 0, 1, 0)}


def test_lm_text(spark):
    lines = ["A B A"] * 6 + ["A A A"] * 5 + ["A B C"] * 4 + ["B B C"] * 3 + ["B B A", "B B A", "C C"]
    segments = spark.createDataFrame(list(enumerate(lines)), "segment_id long, orth string")
    lm = counts.estimate_backoff_lm(counts.ngram_counts(segments, 2), 2)
    per_history = lm.filter("history <> ''").groupBy("history").agg(F.sum(F.exp(-F.col("score"))).alias("p")).collect()
    assert all(0.3 < r.p <= 1.0 + 1e-9 for r in per_history)
    scores = counts.lm_score(counts.lm_events(segments, 2), lm, 2)
    assert scores.count() == sum(len(x.split()) + 1 for x in lines) and scores.filter("score <= 0").isEmpty()


def test_accumulators_merge(spark):
    acc = spark.createDataFrame([(0, 2.0, 2.0, 3.0)], "dim int, n double, s double, q double")
    row = models.gaussian_estimate(acc).first()
    assert (row["mean"], row["var"]) == (1.0, 0.5)
    assert models.gaussian_estimate(models.combine_accumulators(acc, acc)).first()["var"] == 0.5


def test_sliding_window_keeps_its_tail(spark):
    x = [1, 5, 2, 8, 3, 9, 4]
    data = spark.createDataFrame([(1, t, v) for t, v in enumerate(x)], "segment_id int, tick int, x long")
    got = [r.normalised for r in frames.sliding_normalise(data, 4, 2, [], variance=False).orderBy("tick").collect()]
    want = []
    for t in range(7):
        e = min(t + 2, 6)
        w = x[max(0, e - 3) : e + 1]
        want.append(x[t] - sum(w) / len(w))
    assert got == pytest.approx(want)


def test_posteriors_sum_to_one(spark):
    arcs = spark.createDataFrame([(1, "a", 0, 3, 0.5), (1, "b", 1, 4, 0.25), (1, "c", 2, 2, 1.0)], "segment_id int, label string, start_t int, end_t int, posterior double")
    assert all(abs(r.p - 1) < 1e-9 for r in slots.frame_cn(arcs).groupBy("slot").agg(F.sum("posterior").alias("p")).collect())


def test_noise(spark):
    rows = [("[NOISE] uh a  b [X]", "a b"), ("uh uh", ""), ("uhm", "uhm"), ("", "")]
    data = spark.createDataFrame(rows, "orth string, want string")
    assert data.filter(transcripts.strip_noise(F.col("orth")) != F.col("want")).isEmpty()


def test_projections(spark):
    import numpy as np

    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(300, 3)) @ np.diag([1.0, 3.0, 0.5]) + rnd.integers(0, 3, (300, 1)) * np.array([2.0, 0.0, 0.0])
    label = rnd.integers(0, 3, 300)
    data = spark.createDataFrame([(i, int(label[i]), x[i].tolist()) for i in range(300)], "vec_id int, label int, x array<double>")
    top = {r.dim: (r.weight, r.value) for r in models.pca(models.covariance(data, 3), 1).collect()}
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    assert top[0][1] == pytest.approx(values[-1]) and abs(sum(top[d][0] * vectors[d, -1] for d in range(3))) == pytest.approx(1)
    found = {r.dim: (r.weight, r.value) for r in models.lda(models.scatter_matrices(data, 3), 1).collect()}
    means = [x[label == c].mean(axis=0) for c in range(3)]
    between = sum((label == c).sum() * np.outer(means[c] - x.mean(axis=0), means[c] - x.mean(axis=0)) for c in range(3))
    within = sum((x[label == c] - means[c]).T @ (x[label == c] - means[c]) for c in range(3))
    v = np.array([found[d][0] for d in range(3)])
    assert between @ v == pytest.approx(found[0][1] * (within @ v), rel=1e-6, abs=1e-6)


def test_matrices_and_projections_against_numpy(spark):
    """Eigen equations of pca and lda, the share of variance, and projections by the definition."""
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 3, 300)
    x = rng.integers(-50, 50, (300, 5)) + 20 * labels[:, None] * np.array([1, 0, 2, 0, 1])
    rows = [(k, int(c), [int(v) for v in r]) for k, (c, r) in enumerate(zip(labels, x))]
    whole = spark.createDataFrame(rows, "vec_id long, label int, x array<long>")
    data = whole.unionByName(spark.createDataFrame([(-1, 0, None), (-2, 1, [1, None, 3, 4, 5]), (-3, 1, [1, 2])], whole.schema))  # without all components: left out
    cov = np.cov(x.T, bias=True)
    found = models.pca(models.covariance(data, 5)).collect()
    vectors = np.zeros((5, 5))
    for r in found:
        vectors[r.dim, r.component] = r.weight
    values = np.array([next(r.value for r in found if r.component == k) for k in range(5)])
    assert np.allclose(cov @ vectors, vectors * values) and np.all(np.diff(values) <= 0) and np.allclose(vectors.T @ vectors, np.eye(5))
    shares = np.cumsum(values) / values.sum()
    for share in (0.5, 0.8, 1.0):
        assert len({r.component for r in models.pca(models.covariance(data, 5), share=share).collect()}) == 1 + int(np.argmax(shares >= share - 1e-9))
    y = {(r.vec_id, r.component): r.y for r in models.project(whole, models.pca(models.covariance(data, 5), 2), ["vec_id"]).collect()}
    assert np.allclose([[y[k, c] for c in range(2)] for k in range(300)], x @ vectors[:, :2])
    means = np.array([x[labels == c].mean(axis=0) for c in range(3)])
    within = sum((x[labels == c] - means[c]).T @ (x[labels == c] - means[c]) for c in range(3))
    between = sum((labels == c).sum() * np.outer(means[c] - x.mean(axis=0), means[c] - x.mean(axis=0)) for c in range(3))
    axes, value = np.zeros((5, 2)), np.zeros(2)
    for r in models.lda(models.scatter_matrices(data, 5), 2).collect():
        axes[r.dim, r.component], value[r.component] = r.weight, r.value
    assert np.allclose(between @ axes, within @ axes * value)


def test_training_stops_and_reports(spark):
    rows = [(k, [float(v)]) for k, v in enumerate([0.0, 0.1, 0.2, 9.0, 9.1, 9.2])]
    data = spark.createDataFrame(rows, "vec_id long, x array<double>")
    start = spark.createDataFrame([(0, 0, 1.0, 1.0), (1, 0, 5.0, 1.0), (2, 0, 90.0, 1.0)], "density int, dim int, mean double, var double")
    model = {r.density: (round(r.mean, 6), r.weight) for r in models.gmm_train(data, start, 50, threshold=1e-6).collect()}
    assert model == {0: (0.1, 0.5), 1: (9.1, 0.5)}  # the third has no vectors
    scored = models.mixture_scores(data, start.withColumn("weight", F.lit(1 / 3))).orderBy("vec_id").collect()
    normal = [sum(np.exp(-0.5 * (r.x[0] - m) ** 2) / np.sqrt(2 * np.pi) / 3 for m in (1, 5, 90)) for r in scored]
    assert np.allclose([r.score for r in scored], -np.log(normal))


def test_matrices_of_large_sums(spark):
    """The product of two sums is beyond a long, the sums and products of vectors are not."""
    x = F.array((F.col("id") % 3 + 1000000).alias("a"), F.lit(1000000).cast("long"))
    data = spark.range(9000).select((F.col("id") % 2).alias("label"), x.alias("x"))
    assert {(r.i, r.j): round(r.v, 2) for r in models.covariance(data, 2).collect()} == {(0, 0): 0.67, (1, 0): 0.0, (1, 1): 0.0}
    got = {(r.i, r.j): (r.within, r.total) for r in models.scatter_matrices(data, 2).collect()}
    assert got[0, 0] == pytest.approx((6000, 6000), abs=10) and got[1, 1] == pytest.approx((0, 0), abs=10)


def test_complex_functions_of_small_components(spark, tmp_path):
    """Components that round to zero have no sign, in the query as in its SQL."""
    import duckdb

    from lexiloom.plans import catalogue
    from tests.oracle import compare

    data = spark.createDataFrame([(0, 1, [-0.0001, 0.0001, -0.0001, -0.0001, 0.5, -0.0001])], "vec_id long, label int, embedding array<float>")
    data.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert compare(spark, con, str(tmp_path), catalogue.QUERIES["complex_functions"], catalogue.ORACLE["complex_functions"]) == ""
