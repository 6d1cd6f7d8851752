"""Merged states, pruning by rates, system combination, affine maps, aggregates and what else SQL does not show, against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import aggregates
from lexiloom.operators import adaptation, arcs, confusion, evaluate, lattice, models, vectors
from lexiloom.sources import text_files


def random_lattice(rnd, name, n=6):
    """Arcs to larger states, several states of one time."""
    times = sorted(rnd.randint(0, 4) * 10 for _ in range(n))
    out = [(name, k, k + 1, rnd.choice("ab"), times[k], times[k + 1], float(rnd.randint(1, 9))) for k in range(n - 1)]
    out += [(name, a, b, rnd.choice("abc"), times[a], times[b], float(rnd.randint(1, 9))) for a in range(n) for b in range(a + 2, n) if rnd.random() < 0.4]
    return [a for a in out if a[4] < a[5]]


SCHEMA = "segment_id string, src long, dst long, label string, start_t int, end_t int, score double"


def test_merged_states_keep_the_best_path(spark):
    rnd = random.Random(3)
    rows = [a for k in range(30) for a in random_lattice(rnd, f"s{k}")]
    data = spark.createDataFrame(rows, SCHEMA)
    merged = arcs.merge_states(data)
    for segment in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == segment]
        best = {min(r[4] for r in own): 0.0}  # least cost to each time, over arcs of any state
        for r in sorted(own, key=lambda r: r[4]):
            if r[4] in best:
                best[r[5]] = min(best.get(r[5], math.inf), best[r[4]] + r[6])
        last = max(r[5] for r in own)
        found = [r for r in lattice.best_path(merged.filter(F.col("segment_id") == segment)).collect()] if segment in ("s0", "s1", "s2") else None
        if found is not None and last in best:
            assert sum(r.score for r in found) == best[last]
    assert merged.filter("src >= dst").isEmpty()
    with pytest.raises(ValueError):
        arcs.merge_states(data, "other")


def plain_prune(rows, threshold, low, high, most):
    """The four cases one after the other."""
    costs = [-math.log(r[-1]) for r in rows]
    seconds = (max(r[5] for r in rows) - min(r[4] for r in rows)) / 100
    few, many = math.floor(low * seconds), min(math.floor(high * seconds) if high is not None else 2**31, most or 2**31)
    if low and len(rows) <= few:
        return set(rows)
    t, least = min(threshold, max(costs) - min(costs)), min(costs)
    count = lambda: sum(c - least <= t for c in costs)
    while count() > many and t > 0.1:
        t *= 0.9
    while low and count() < few and 0 < t < 100:
        t *= 1.2
    return {r for r, c in zip(rows, costs) if c - least <= t}


def test_pruning_by_rates(spark):
    rnd = random.Random(5)
    rows = [(f"s{k}", j, j + 1, "a", 0, rnd.choice([40, 100, 300]), 1.0, rnd.random() ** 4 + 1e-9) for k in range(40) for j in range(rnd.randint(1, 20))]
    data = spark.createDataFrame(rows, SCHEMA + ", posterior double").repartition(3)
    for threshold, low, high, most in ((1.5, 0.0, None, None), (3.0, 5.0, 9.0, None), (0.3, 8.0, None, 7), (20.0, 0.0, 4.0, 3), (0.05, 12.0, None, None)):
        got = {tuple(r) for r in arcs.prune_by_rate(data, threshold, low, high, most).collect()}
        assert got == {x for k in range(40) if (own := [r for r in rows if r[0] == f"s{k}"]) for x in plain_prune(own, threshold, low, high, most)}
    paths = arcs.prune_by_rate(data, 0.0)
    assert sorted(map(tuple, paths.select("segment_id", "src").collect())) == sorted((r[0], r[1]) for r in rows)


def plain_alignment(a, slots, sub, ins, dele):
    """Least total cost by the full matrix."""
    cost = np.zeros((len(a) + 1, len(slots) + 1))
    for i in range(len(a) + 1):
        for j in range(len(slots) + 1):
            if i or j:
                cost[i, j] = min(([cost[i - 1, j] + ins(a[i - 1])] if i else []) + ([cost[i, j - 1] + dele(slots[j - 1])] if j else []) + ([cost[i - 1, j - 1] + sub(a[i - 1], slots[j - 1])] if i and j else []))
    return cost


def plain_rover(systems, weights, alpha, null, kind):
    slots = []
    for k, words in enumerate(systems):  # words are (word, confidence, begin, end)
        if kind == "unit":
            ins, dele = (lambda w: 1.0), (lambda s: 0.0 if any(e[0] == "" for e in s) else 1.0)
            sub = lambda w, s: 0.0 if any(e[0] == w[0] for e in s) else 1.0
        else:
            ins = (lambda w: 3.0) if kind == "words" else (lambda w: w[3] - w[2] + 0.003)
            dele = lambda s: min((0.001 if kind == "words" else 0.002) if e[0] == "" else 3.0 if kind == "words" else e[3] - e[2] + 0.003 for e in s)
            pair = lambda w, e: 4.0 * (e[0] != w[0]) if kind == "words" else abs(e[2] - w[2]) + abs(e[3] - w[3]) + 0.001 * (e[0] != w[0])
            sub = lambda w, s: min((pair(w, e) for e in s if e[0]), default=ins(w) - 0.001)
        cost = plain_alignment(words, slots, sub, ins, dele)
        i, j, merged, missing = len(words), len(slots), [], ("", null, 0, 0)
        while i or j:
            if i and j and abs(cost[i, j] - cost[i - 1, j - 1] - sub(words[i - 1], slots[j - 1])) < 1e-9:
                i, j = i - 1, j - 1
                merged.append([*slots[j], words[i]])
            elif j and abs(cost[i, j] - cost[i, j - 1] - dele(slots[j - 1])) < 1e-9:
                j -= 1
                merged.append([*slots[j], missing])
            else:
                i -= 1
                merged.append([missing] * k + [words[i]])
        slots = merged[::-1]
    out = []
    for slot in slots:
        total = sum(w * e[1] for w, e in zip(weights, slot)) or 1.0
        scores = {}
        for w, e in zip(weights, slot):
            scores[e[0]] = scores.get(e[0], 0.0) + alpha * w + (1 - alpha) * w * e[1] / total
        word = min(scores, key=lambda x: (-round(scores[x], 12), x))
        out += [word] if word else []
    return out


@pytest.mark.parametrize("kind", ["unit", "words", "times"])
def test_combination_of_systems_of_unequal_length(spark, kind):
    rnd = random.Random(9)
    cases = []
    for _ in range(40):
        systems = []
        for _ in range(3):
            at, words = 0, []
            for _ in range(rnd.randint(0, 7)):
                end = at + rnd.randint(5, 60)
                words.append((rnd.choice("abcd"), round(rnd.random(), 2), at / 100, end / 100))
                at = end + rnd.choice([0, 0, 20])
            systems.append(words)
        cases.append(systems)
    rows = [(k, s, [w[0] for w in words], [w[1] for w in words], [round(100 * w[2]) for w in words], [round(100 * w[3]) for w in words]) for k, systems in enumerate(cases) for s, words in enumerate(systems)]
    data = spark.createDataFrame(rows, "segment_id int, system int, words array<string>, confidences array<double>, starts array<int>, ends array<int>").repartition(3)
    weights = [1.0, 0.8, 0.9]
    got = {r.segment_id: r.words for r in confusion.rover(data, weights, 0.3, 0.6, kind).collect()}
    assert got == {k: plain_rover(systems, weights, 0.3, 0.6, kind) for k, systems in enumerate(cases)}


def test_slot_alignment_in_a_band(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(confusion, "SLOT_CELLS", 8)
    monkeypatch.setattr(confusion, "BAND", 6)
    for _ in range(40):
        n, m = rng.integers(0, 12, 2)
        costs, ins, dele = rng.random((n, m)), rng.random(n), rng.random(m)
        pairs = confusion.align_slots(lambda i: costs[i], ins, dele)
        assert [i for i, _ in pairs if i >= 0] == list(range(n)) and [j for _, j in pairs if j >= 0] == list(range(m))
        full = plain_alignment(list(range(n)), list(range(m)), lambda i, j: costs[i, j], lambda i: ins[i], lambda j: dele[j])[-1, -1]
        found = sum(dele[j] if i < 0 else ins[i] if j < 0 else costs[i, j] for i, j in pairs)
        assert found >= full - 1e-9 and (max(n, m) > 6 or abs(found - full) < 1e-9)


def test_slot_alignment_meets_all_slots(monkeypatch):
    """However few cells are kept, words meet slots far from the diagonal, and the pairs are those of one whole table."""
    rng = np.random.default_rng(5)
    for _ in range(60):
        n, m = rng.integers(0, 40, 2)
        costs, ins, dele = (rng.choice([0.0, 1.0], size) if rng.random() < 0.5 else rng.random(size) for size in ((n, m), n, m))
        whole = confusion.align_slots(lambda i: costs[i], ins, dele)  # noqa: B023
        with monkeypatch.context() as few:
            few.setattr(confusion, "SLOT_CELLS", 8)
            few.setattr(confusion, "BAND", 6)
            assert confusion.align_slots(lambda i: costs[i], ins, dele) == whole  # noqa: B023
        full = plain_alignment(list(range(n)), list(range(m)), lambda i, j: costs[i, j], lambda i: ins[i], lambda j: dele[j])[-1, -1]  # noqa: B023
        assert abs(sum(dele[j] if i < 0 else ins[i] if j < 0 else costs[i, j] for i, j in whole) - full) < 1e-9
    # 6,000 words, the first 1,800 of which come last as slots: the others are 1,800 places from the diagonal, a band of those cells had 1,398
    words, slots = np.arange(6000), np.concatenate([np.arange(1800, 6000), np.arange(1800)])
    pairs = confusion.align_slots(lambda i: (slots != words[i]) * 3.0, np.ones(6000), np.ones(6000))
    assert sum(i >= 0 and j >= 0 and slots[j] == words[i] for i, j in pairs) == 4200


def test_oracle_and_graph_errors_search(spark):
    rnd = random.Random(4)
    slots, refs, want = [], [], {}
    for k in range(30):
        cn = [{rnd.choice("abc") if rnd.random() < 0.8 else confusion.EPSILON for _ in range(rnd.randint(1, 3))} for _ in range(rnd.randint(1, 6))]
        words = [rnd.choice("abcd") for _ in range(rnd.randint(0, 7))]
        slots += [(k, i, w, 1.0 / len(s)) for i, s in enumerate(cn) for w in s]
        refs.append((k, words))
        want[k] = plain_alignment(words, cn, lambda w, s: float(w not in s), lambda w: 1.0, lambda s: float(confusion.EPSILON not in s))[-1, -1]
    cn, ref = spark.createDataFrame(slots, "segment_id int, slot long, label string, posterior double"), spark.createDataFrame(refs, "segment_id int, words array<string>")
    assert {r.segment_id: r.cost for r in confusion.oracle_error(cn, ref).collect()} == want
    rows = [a for k in range(20) for a in random_lattice(rnd, f"s{k}")]
    rows = [r for r in rows if r[0] in {s for s in {r[0] for r in rows} if min(r[1] for r in rows if r[0] == s) == 0}]
    refs = [(s, [rnd.choice("abc") for _ in range(rnd.randint(0, 6))]) for s in sorted({r[0] for r in rows})]

    def paths(own, at, last):
        return [[]] if at == last else [[r[3], *rest] for r in own if r[1] == at for rest in paths(own, r[2], last)]

    got = {r.segment_id: r.errors for r in confusion.graph_error_rate(spark.createDataFrame([r[:4] for r in rows if True], "segment_id string, src long, dst long, label string"), spark.createDataFrame(refs, "segment_id string, words array<string>")).collect()} if all(paths([r for r in rows if r[0] == s], 0, max(r[2] for r in rows if r[0] == s)) for s, _ in refs) else None
    if got is not None:
        for s, words in refs:
            own = [r for r in rows if r[0] == s]
            distance = lambda p: plain_alignment(words, p, lambda a, b: float(a != b), lambda w: 1.0, lambda w: 1.0)[-1, -1]  # noqa: B023, E731
            assert got[s] == min(distance(p) for p in paths(own, 0, max(r[2] for r in own)))


def test_phoneme_errors_of_unequal_lengths(spark):
    lexicon = spark.createDataFrame([("ab", "a b"), ("b", "b"), ("cab", "k a b")], "token string, phon string")
    pairs = spark.createDataFrame([("x", ["ab", "b"], ["cab"]), ("y", ["cab", "zz"], []), ("z", [], ["b"])], "segment_id string, ref array<string>, hyp array<string>")
    got = {r.segment_id: (r.n_tokens, r.n_ins + r.n_del + r.n_sub) for r in evaluate.phoneme_errors(pairs, lexicon).collect()}
    assert got == {"x": (3, 2), "y": (3, 3), "z": (0, 1)}


def likelihood(w, x, means, variances):
    y = np.concatenate([np.ones((len(x), 1)), x], axis=1) @ w.T
    return len(x) * np.log(abs(np.linalg.det(w[:, 1:]))) - 0.5 * (((y - means) ** 2) / variances).sum()


def test_likeliest_affine_maps(spark):
    rng = np.random.default_rng(6)
    model = {0: (np.array([0.0, 0.0]), np.array([1.0, 2.0])), 1: (np.array([4.0, -3.0]), np.array([0.5, 1.0])), 2: (np.array([-2.0, 5.0]), np.array([1.5, 0.7]))}
    rows = []
    for key, a, b in (("p", np.array([[1.5, 0.3], [-0.2, 0.8]]), np.array([1.0, -2.0])), ("q", np.eye(2), np.zeros(2))):
        for _ in range(300):
            c = int(rng.integers(0, 3))
            rows.append((key, c, (a @ (model[c][0] + rng.normal(size=2) * np.sqrt(model[c][1])) + b).tolist()))
    rows.append(("few", 0, [1.0, 2.0]))
    data = spark.createDataFrame(rows, "key string, density int, x array<double>").repartition(3)
    densities = spark.createDataFrame([(c, d, float(m[d]), float(v[d])) for c, (m, v) in model.items() for d in range(2)], "density int, dim int, mean double, var double")
    got = {}
    for r in adaptation.affine_transform(data, densities, "key", 2, "likelihood").collect():
        got.setdefault(r.key, {})[r.row] = r.weights
    assert [got["few"][i] for i in range(2)] == [[0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    for key in "pq":
        x = np.array([r[2] for r in rows if r[0] == key])
        means, variances = (np.array([model[r[1]][k] for r in rows if r[0] == key]) for k in (0, 1))
        w = np.array([got[key][i] for i in range(2)])
        best = likelihood(w, x, means, variances)
        assert best >= likelihood(np.concatenate([np.zeros((2, 1)), np.eye(2)], axis=1), x, means, variances) - 1e-9
        step = 1e-4  # a stationary point: nothing near is likelier
        for i in range(2):
            for j in range(3):
                for sign in (1, -1):
                    moved = w.copy()
                    moved[i, j] += sign * step
                    assert likelihood(moved, x, means, variances) <= best + 1e-6
        extended = np.concatenate([np.ones((len(x), 1)), x], axis=1)
        g = np.stack([(extended.T * (1 / variances[:, i])) @ extended for i in range(2)])
        k = np.stack([(means[:, i] / variances[:, i]) @ extended for i in range(2)])
        course = [likelihood(adaptation.likeliest_map(g, k, float(len(x)), n), x, means, variances) for n in range(8)]
        assert all(b >= a - 1e-9 for a, b in zip(course, course[1:]))
    with pytest.raises(ValueError):
        adaptation.affine_transform(data, densities, "key", 2, "other")


def test_segments_are_aligned_together():
    """Many alignments as rows are those one by one, with costs that leave ties, and unequal and empty sides."""
    rng = np.random.default_rng(3)
    n, m = rng.integers(0, 7, 60), rng.integers(0, 7, 60)
    costs, ins, dele = rng.integers(0, 2, (60, 6, 6)).astype(float), rng.choice([0.7, 1.0], (60, 6)), rng.choice([0.0, 0.3, 1.0], (60, 6))
    words, slots, sizes = confusion.align_many(lambda i: costs[:, i], ins, dele, n, m)
    for b in range(60):
        want = confusion.align_slots(lambda i, b=b: costs[b, i, : m[b]], ins[b, : n[b]], dele[b, : m[b]])
        assert list(zip(words[b, : sizes[b]].tolist(), slots[b, : sizes[b]].tolist(), strict=True)) == want
    assert sorted(np.concatenate(list(confusion.alike(n, 40))).tolist()) == list(range(60))


def test_single_slots_are_paired_or_not(spark, monkeypatch):
    """A segment's only slots need no alignment where a pair costs no more than both alone; the first system needs none at all."""

    def refuse(*_):
        raise AssertionError("aligned")

    rows = lambda p: spark.createDataFrame([("s", 0, label, x) for label, x in p.items()], "segment_id string, slot long, label string, posterior double")
    found = lambda a, b: {(r.slot, r.label): round(r.posterior, 9) for r in confusion.combine_aligned_cns([rows(a), rows(b)], [0.5, 0.5]).collect()}
    e = confusion.EPSILON
    assert found({"x": 0.2, e: 0.8}, {"y": 0.3, e: 0.7}) == {(0, "x"): 0.1, (0, "y"): 0.15, (0, e): 0.75}
    monkeypatch.setattr(confusion, "align_slots", refuse)
    assert found({"x": 0.6, "y": 0.4}, {"y": 1.0}) == {(0, "x"): 0.3, (0, "y"): 0.7}


def test_rover_together_and_alone(spark, monkeypatch):
    """Short segments in groups have the words that each has alone (as segments beyond the band are)."""
    rng = np.random.default_rng(4)
    rows = [(s, k, [str(w) for w in rng.choice(["a", "b", "c"], rng.integers(0, 6))]) for s in range(80) for k in range(3)]
    data = spark.createDataFrame([(s, k, w, [float(c) for c in rng.choice([0.2, 0.5, 0.9], len(w))]) for s, k, w in rows], "segment_id int, system int, words array<string>, confidences array<double>")
    found = []
    for band in (1000, -1):
        monkeypatch.setattr(confusion, "BAND", band)
        found.append([{r.segment_id: r.words for r in confusion.rover(data, weights, alpha).collect()} for weights, alpha in (([1.0, 1.0, 1.0], 0.0), ([0.2, 0.3, 0.5], 0.5))])
    assert found[0] == found[1] and len(found[0][0]) == 80


def test_mergeable_aggregate(spark):
    rng = np.random.default_rng(1)
    rows = [("ab"[k % 2], float(v), float(w)) for k, (v, w) in enumerate(rng.normal(size=(500, 2)) ** 2)] + [("a", None, 1.0), ("b", 1.0, None), ("none", None, 2.0)]
    data = spark.createDataFrame(rows, "g string, x double, w double").repartition(5)
    got = {r.g: r for r in aggregates.weighted_stats(data, ["g"], "x", "w").collect()}
    for g in "ab":
        x, w = (np.array([r[k] for r in rows if r[0] == g and r[1] is not None and r[2] is not None]) for k in (1, 2))
        assert (got[g].n, got[g].mean, got[g].variance) == pytest.approx((w.sum(), np.average(x, weights=w), np.average(x * x, weights=w) - np.average(x, weights=w) ** 2))
    assert (got["none"].n, got["none"].mean, got["none"].variance) == (0.0, None, None)


def test_windows_of_vectors(spark):
    rnd = random.Random(7)
    x = {1: [[rnd.random() + 1, rnd.random() + 2] for _ in range(23)], 2: [[1.0, 2.0]]}
    data = spark.createDataFrame([(s, t, v) for s, rows in x.items() for t, v in enumerate(rows)], "segment_id int, tick int, x array<double>")
    for kind in ("level", "mean", "mean-and-variance", "mean-and-variance-1D", "divide-by-mean", "mean-norm"):
        for r in vectors.window_normalise(data, kind, 6, 2, [], block=4).collect():
            e = min(r.tick + 2, len(x[r.segment_id]) - 1)
            w, v = np.array(x[r.segment_id][max(0, e - 5) : e + 1]), np.array(r.x)
            one = lambda s: np.where(s > 0, s, 1.0)
            want = {"level": lambda: v - [w[:, 0].max(), 0], "mean": lambda: v - w.mean(0), "mean-and-variance": lambda: (v - w.mean(0)) / one(w.std(0)), "mean-and-variance-1D": lambda: (v - w.mean()) / one(w.std()), "divide-by-mean": lambda: v / w.mean(0), "mean-norm": lambda: v / np.sqrt((w**2).sum(1)).mean()}[kind]()
            assert r.normalised == pytest.approx(want.tolist())


def test_small_rules(spark, tmp_path):
    cov = spark.createDataFrame([(0, 0, 4.0), (1, 1, 1.0), (1, 0, 0.0), (2, 2, 0.5), (2, 0, 0.0), (2, 1, 0.0)], "i int, j int, v double")
    assert {r.component for r in models.pca(cov, least=1.0).collect()} == {0, 1}
    with pytest.raises(ValueError):
        models.pca(cov, k=1, least=1.0)
    (tmp_path / "lm").write_text("\\data\\\n\n\\1-grams:\n-99\t<s>\t-0.5\n-1\ta\n-inf\tb\n\n\\2-grams:\n-0.5\t<s> a\n\\end\\\n")
    whole = {r.word: r.score for r in text_files.read_arpa(spark, str(tmp_path / "lm")).filter("order = 1").collect()}
    assert whole["<s>"] == whole["b"] == math.inf and whole["a"] == pytest.approx(math.log(10))
    assert text_files.read_arpa(spark, str(tmp_path / "lm"), skip_infinite=True).count() == 2
    nbest = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], "segment_id string, rank int, words string")
    assert [r.words for r in lattice.select_n_best(nbest, 1).collect()] == ["y"]


def test_mbr_nbest_lists(spark):
    """Pairs are compared once, in as many tasks as shuffles have; lists of one hypothesis, equal and missing words."""
    rng = random.Random(9)
    rows = [(s, r, "".join(rng.choice("ab") for _ in range(rng.randrange(0, 6))), 1.0 / (1 + r)) for s in range(30) for r in range(rng.randrange(1, 6))] + [(99, 0, "lone", 0.5), (98, 0, None, 0.5), (98, 1, "x", 0.5)]
    data = spark.createDataFrame(rows, "segment_id int, rank int, words string, posterior double")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    for segment in range(30):
        own = [(r, w, p) for s, r, w, p in rows if s == segment]
        risks = [(round(sum(p * distance(w, v) for _, v, p in own), 6), r) for r, w, _ in own]
        got = next(r for r in mbr if r.segment_id == segment) if segment else None
        if segment == 0:
            result = confusion.mbr_nbest(data)
            mbr = result.collect()
            assert {r.segment_id: r.risk for r in mbr if r.segment_id > 90} == {99: 0.0, 98: None}
            assert "Exchange hashpartitioning(segment_id" in (plan := result._jdf.queryExecution().executedPlan().toString()) and "REPARTITION_BY_NUM" in plan
            got = next(r for r in mbr if r.segment_id == 0)
        assert (round(got.risk, 6), got.rank) == min(risks)


def test_python_takes_few_rows_at_a_time():
    """Batches are cut by bytes before Python objects are made of them, and no row is lost."""
    import pyarrow as pa

    from lexiloom.functions.tables import slices

    batches = [pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["x" * size] * n)], names=["k", "text"]) for n, size in ((1000, 100), (3, 50_000), (0, 1), (7, 1))]
    cut = list(slices(iter(batches), 20_000))
    assert [k for b in cut for k in b.column("k").to_pylist()] == [*range(1000), 0, 1, 2, *range(7)]
    assert max(b.num_rows for b in cut) < 200 and [b.num_rows for b in cut][-4:] == [1, 1, 1, 7]
