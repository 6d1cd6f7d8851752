"""Segment and speaker models, tree growing, users' functions and stateful streams against brute force or batch twins."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import scorers
from lexiloom.operators import adaptation, confusion, frames, lexicon, models
from lexiloom.sources import archives
from lexiloom.streaming import streams


def test_segment_clusters(spark):
    rng = np.random.default_rng(1)
    rows, xs = [], {}
    for s in range(9):
        x = rng.normal(s % 3 * 4.0, 1.0, (20, 2))
        xs[s] = x
        rows += [("r", s, v.tolist()) for v in x]
    df = spark.createDataFrame([*rows, ("lone", 1, [0.0, 1.0]), ("lone", 1, None)], "recording_id string, segment_id int, x array<double>")
    got = {r.segment_id: r.cluster for r in adaptation.segment_clusters(df, 2).filter("recording_id = 'r'").collect()}

    def cost(x):
        return len(x) * math.log(np.linalg.det(np.cov(x.T, bias=True) + 1e-6 * np.eye(2)))

    groups, bar = {s: [s] for s in xs}, 0.5 * (2 + 3) * math.log(180)
    while len(groups) > 1:
        data = lambda g: np.concatenate([xs[s] for s in groups[g]])
        gain, child, parent = min((0.5 * (cost(np.concatenate([data(i), data(j)])) - cost(data(i)) - cost(data(j))), i, j) for i in groups for j in groups if j < i)
        if gain >= bar:
            break
        groups[parent] += groups.pop(child)
    assert got == {s: g for g, members in groups.items() for s in members}
    assert len(set(got.values())) == 3
    assert adaptation.segment_clusters(df.filter("recording_id = 'lone'"), 2).count() == 1
    assert adaptation.segment_clusters(df.limit(0), 2).count() == 0


def test_change_points(spark):
    rng = np.random.default_rng(2)
    xs = [rng.normal(size=n).tolist() for n in (9, 9, 7, 2)]
    df = spark.createDataFrame([*enumerate(xs), (9, None), (10, [])], "id int, x array<double>")
    got = {r.id: r for r in adaptation.change_points(df, "id", 3).collect()}
    assert set(got) == {0, 1, 2, 3}
    for k, x in enumerate(xs[:3]):
        cuts = [(0, *c, len(x)) for c in combinations(range(1, len(x)), 2)]
        error, best = min((sum(np.var(x[a:b]) * (b - a) for a, b in zip(c, c[1:])), c[1:]) for c in cuts)
        assert got[k].error == pytest.approx(error) and tuple(got[k].ends) == best
    assert got[3].ends == [1, 2]


def bits(ns):
    return -sum(n / sum(ns) * math.log2(n / sum(ns)) for n in ns)


@pytest.mark.parametrize("most", [2, 4, 100])
def test_cart_train(spark, most):
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b), int(c), int(a * 2 + (b > 1)) if rng.random() < 0.9 else 0, int(rng.integers(1, 9))) for a, b, c in rng.integers(0, 4, (60, 3))]
    df = spark.createDataFrame([*rows, (None, 1, 1, 0, 2)], "a int, b int, c int, y int, n int")
    rows.append((None, 1, 1, 0, 2))
    asks = {f"{c}>{k}": (i, k) for i, c in enumerate("abc") for k in range(3)}
    tree = models.cart_train(df, {name: F.col(name[0]) > k for name, (_, k) in asks.items()}, "y", min_obs=8, min_gain=0.01, max_leaves=most)
    got = sorted(tuple(sorted(x)) for x in models.cart_apply(df, tree).groupBy("leaf").agg(F.collect_list(F.struct(F.coalesce("a", F.lit(-1)), "b", "c", "y", "n")).alias("m")).select("m").rdd.map(lambda r: [tuple(x) for x in r.m]).collect())

    def weigh(part):
        ns = {}
        for r in part:
            ns[r[3]] = ns.get(r[3], 0) + r[4]
        return bits(list(ns.values()))

    def split(part):
        best = None
        for name, (i, k) in asks.items():
            yes, no = [r for r in part if r[i] is not None and r[i] > k], [r for r in part if not (r[i] is not None and r[i] > k)]
            if not yes or not no or min(sum(r[4] for r in s) for s in (yes, no)) < 8:
                continue
            gain = weigh(part) - (len(yes) * weigh(yes) + len(no) * weigh(no)) / len(part)
            if gain >= 0.01 and (best is None or gain > best[0] + 1e-9):
                best = (gain, yes, no)
        return best

    leaves = [rows]
    while len(leaves) < most:
        best = max(((split(x) or (0,), k) for k, x in enumerate(leaves)), key=lambda g: g[0][0])
        if len(best[0]) == 1:
            break
        leaves[best[1] : best[1] + 1] = best[0][1:]
    assert got == sorted(tuple(sorted(tuple(-1 if v is None else v for v in r) for r in x)) for x in leaves)
    assert models.cart_train(df.limit(0), {"q": F.col("a") > 1}, "y") == 0


def test_affine_transform_and_shift(spark):
    rng = np.random.default_rng(4)
    x, a, b = rng.normal(size=(30, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    y = x @ a.T + b
    vectors = spark.createDataFrame([("k", i, v.tolist()) for i, v in enumerate(x)], "speaker string, density int, x array<double>")
    dens = spark.createDataFrame([(i, d, float(y[i, d]), float(1 + d)) for i in range(30) for d in range(3)], "density int, dim int, mean double, var double")
    got = {r.row: r.weights for r in adaptation.affine_transform(vectors, dens, "speaker", 3).collect()}
    assert np.allclose([got[i] for i in range(3)], np.column_stack([b, a]), atol=1e-6)
    shifts = spark.createDataFrame([("l", 0, 2.0)], "leaf string, dim int, shift double")
    classes = spark.createDataFrame([(0, "l"), (1, "m")], "density int, leaf string")
    moved = {(r.density, r.dim): r.mean for r in adaptation.apply_shift(dens, classes, shifts).collect()}
    assert moved[0, 0] == pytest.approx(y[0, 0] + 2) and moved[0, 1] == pytest.approx(y[0, 1]) and moved[1, 0] == pytest.approx(y[1, 0]) and len(moved) == 90


def test_mfcc(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=100)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)] + [("short", 0, 1.0)], "segment_id string, tick int, x double")
    got = {r.frame: r.cepstrum for r in adaptation.mfcc(df, 32, 10, 6, 4, ["tick"], alpha=0.9).collect()}
    v = x - 0.9 * np.concatenate([x[:1], x[:-1]])
    mel = adaptation.mel_filters(32, 6, 16000.0)
    assert sorted(got) == list(range(7))
    for f in got:
        logs = np.log(np.abs(np.fft.rfft(v[f * 10 : f * 10 + 32] * np.hamming(32))) @ mel)
        assert np.allclose(got[f], [sum(logs[j] * math.cos(math.pi * k * (j + 0.5) / 6) for j in range(6)) for k in range(4)])


def test_aligned_slots(spark):
    cn = lambda rows: spark.createDataFrame([("s", *r) for r in rows], "segment_id string, slot long, label string, posterior double")
    a = cn([(0, "a", 1.0), (1, "b", 0.75), (1, "x", 0.25), (2, "c", 1.0)])
    combined = lambda *cns: {(r.slot, r.label): round(r.posterior, 6) for r in confusion.combine_aligned_cns(list(cns), [0.5, 0.5]).collect()}
    shorter = cn([(0, "a", 1.0), (1, "c", 1.0)])
    want = {(0, "a"): 1.0, (1, "b"): 0.375, (1, "x"): 0.125, (1, "*EPS*"): 0.5, (2, "c"): 1.0}
    assert combined(a, shorter) == want and combined(shorter, a) == want
    # two skipped slots cost as much as two unlike pairs: slots are paired
    other = cn([(0, "a", 1.0), (1, "c", 1.0), (2, "d", 1.0)])
    assert combined(a, other) == {(0, "a"): 1.0, (1, "b"): 0.375, (1, "x"): 0.125, (1, "c"): 0.5, (2, "c"): 0.5, (2, "d"): 0.5}


def test_lexicon_and_label_store(spark, tmp_path):
    lex = spark.createDataFrame([("a", ["a"], ["A"]), ("b", ["b"], ["B", "P"])], "lemma string, orths array<string>, prons array<string>")
    phrases = spark.createDataFrame([("b a",), ("a z",), ("a",), ("b a",)], "phrase string")
    got = {r.lemma: r.prons for r in lexicon.add_phrases(lex, phrases).collect()}
    assert got == {"a": ["A"], "b": ["B", "P"], "b a": ["B A", "P A"]}
    assert lexicon.lexicon_add(lex, lex).count() == 2
    sounds = spark.createDataFrame([("A",), ("B",)], "phoneme string")
    assert lexicon.merge_phonemes(sounds, sounds.filter("phoneme = 'A'")).count() == 2
    f = spark.createDataFrame([("s", 2, "n", 1.0), ("s", 1, "n", 2.0), ("t", 1, "m", 3.0)], "segment_id string, tick int, label string, x double")
    archives.cache_by_label(f, f"file://{tmp_path}/labels")
    stored = archives.cached_label(spark, f"file://{tmp_path}/labels", "n")
    assert [r.x for r in stored.orderBy("segment_id", "tick").collect()] == [2.0, 1.0]
    assert "PartitionFilters: [isnotnull(label" in stored._jdf.queryExecution().toString()


def test_user_functions(spark):
    df = spark.createDataFrame([("s", 1, [1.0, 2.0]), ("s", 2, None), ("t", 1, [3.0, 4.0])], "segment_id string, tick int, x array<double>")
    assert sorted(((r.s is None), r.s) for r in df.select(scorers.scorer(lambda m: m.sum(axis=1))("x").alias("s")).collect() if r.s is not None) == [(False, 3.0), (False, 7.0)]
    assert df.select(scorers.scorer(lambda m: m.sum(axis=1))("x").alias("s")).filter("s IS NULL").count() == 1
    seen = scorers.for_each_segment(df, lambda s, parts: iter([pd.DataFrame({"s": [s], "n": [next(parts)["tick"].iloc[0]]})]), "s string, n int", ["tick"])
    assert sorted(map(tuple, seen.collect())) == [("s", 1), ("t", 1)]
    tiny = spark.createDataFrame([("s", 0, 5, "n"), ("s", 1, 5, "n")], "segment_id string, tick int, x int, label string")
    assert {r.silent for r in frames.silence_flags(tiny, 3, 1, []).collect()} == {True}


def run_stream(spark, tmp_path, rows, schema, op, name):
    """One file for each part, oldest first; the stream takes one a time."""
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/{name}")
    source = streams.stream_frames(spark, f"file://{tmp_path}/{name}", spark.createDataFrame([], schema).schema, files_per_trigger=1)
    query = op(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/{name}_cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.table(name).collect()


def test_stateful_streams(spark, tmp_path):
    start = pd.Timestamp("2026-01-01")
    at = lambda i: (start + pd.Timedelta(seconds=i)).to_pydatetime()
    xs = np.random.default_rng(6).normal(size=20).round(3)
    parts = [[("s", at(i), float(xs[i])) for i in range(a, a + 5)] for a in range(0, 20, 5)]
    got = run_stream(spark, tmp_path, [*parts, [("other", at(10_000), 0.0)], [("other", at(20_000), 1.0)]], "segment_id string, ts timestamp, x double", lambda f: streams.stream_normalise(f, 4, 2, "10 seconds"), "normal")
    batch = spark.createDataFrame([("s", i, float(x)) for i, x in enumerate(xs)], "segment_id string, tick int, x double")
    want = {round(r.x, 6): r.normalised for r in frames.sliding_normalise(batch, 4, 2, []).collect()}
    mine = {round(r.x, 6): r.normalised for r in got if r.segment_id == "s"}
    assert len(mine) >= 18 and all(mine[x] == pytest.approx(want[x], abs=1e-6) for x in mine)

    dens = spark.createDataFrame([(k, 0, float(k), 1.0) for k in range(3)], "density int, dim int, mean double, var double")
    vectors = [[(s, t, [x]) for s, t, x in part] for part in parts]
    got = run_stream(spark, tmp_path, vectors, "segment_id string, ts timestamp, x array<double>", lambda f: streams.stream_bayes(f, dens, 3), "bayes")
    sums = np.cumsum([[0.5 * ((x - k) ** 2 + math.log(2 * math.pi)) for k in range(3)] for x in xs], axis=0)
    rows = sorted(got, key=lambda r: r.ts)
    assert [r.density for r in rows] == sums.argmin(axis=1)[3:].tolist() and np.allclose([r.score for r in rows], sums.min(axis=1)[3:])


def test_many_segment_clusters(spark):
    """Segments of several blocks, some of them alike, against one united after the other by all pairs; distances are looked up again only where needed."""
    rng = np.random.default_rng(5)
    rows = [(r, s, v) for r in ("p", None) for s in range(60) for v in rng.integers(0, 4, (6, 2)).astype(float).tolist()]
    rows += [("p", 60 + s, v) for s in (0, 1) for v in ([0.0, 1.0], [2.0, 1.0], [1.0, 3.0])]
    df = spark.createDataFrame(rows, "recording_id string, segment_id int, x array<double>")
    got = {(r.recording_id, r.segment_id): r.cluster for r in adaptation.segment_clusters(df, 2, lam=0.4, block=16).collect()}
    want = {}
    for name in ("p", None):
        x = {s: np.array([v for r, k, v in rows if r == name and k == s]) for s in sorted({k for r, k, _ in rows if r == name})}
        m = {s: np.array([len(v), *(z for i in range(2) for z in (v[:, i].sum(), *((v[:, i] * v[:, j]).sum() for j in range(i + 1))))]) for s, v in x.items()}
        pair = lambda i, j: float(adaptation._Likelihoods(np.stack([m[i], m[j]]), 2, 1e-6).distance(0, np.array([1]))[0])  # noqa: B023, E731
        far = {(i, j): pair(i, j) for i in m for j in m if j < i}
        cluster, bar = {s: s for s in m}, 0.4 * 2.5 * math.log(sum(v[0] for v in m.values()))
        while far:
            gain, child, parent = min((v, *k) for k, v in far.items())
            if gain >= bar:
                break
            m[parent] = m[parent] + m.pop(child)
            far = {k: pair(*k) if parent in k else v for k, v in far.items() if child not in k}
            cluster = {s: parent if c == child else c for s, c in cluster.items()}
        assert 1 < len(m) < 60
        want |= {(name, s): c for s, c in cluster.items()}
    assert got == want


def test_segment_clusters_look_up_few_distances(monkeypatch):
    """Pairs for which a distance is worked out: about one for each pair of segments, where all of them were looked up again after each union before."""
    rng, n = np.random.default_rng(6), 400
    x = rng.normal(size=(n, 20, 2))
    m = np.stack([np.full(n, 20.0), x[..., 0].sum(1), (x[..., 0] ** 2).sum(1), x[..., 1].sum(1), (x[..., 0] * x[..., 1]).sum(1), (x[..., 1] ** 2).sum(1)], axis=1)
    seen, plain = [], adaptation._Likelihoods.distance
    monkeypatch.setattr(adaptation._Likelihoods, "distance", lambda self, i, others: (seen.append(len(others)), plain(self, i, others))[1])
    near = adaptation._Likelihoods(m, 2, 1e-6)
    first = [near.distance(i, np.arange(i)) for i in range(1, n)]
    gains, partners = np.array([np.inf, *(f.min() for f in first)]), np.array([-1, *(f.argmin() for f in first)])
    adaptation._united(near, None, gains, partners, np.inf)
    assert sum(seen) < 2 * n * n
    s = np.stack([adaptation._square(v, 2) for v in m])
    assert np.allclose(adaptation._Likelihoods(m, 2, 1e-6).own, adaptation._likelihood(s, 1e-6))
