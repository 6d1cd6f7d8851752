"""Lattice dynamic programs against all paths of small random graphs."""

import math
import random

import pytest

from lexiloom.operators import lattice

SCHEMA = "segment_id long, src long, dst long, label string, score double"


def paths(arcs, at, final):
    if at == final:
        return [[]]
    return [[a, *rest] for a in arcs if a[1] == at for rest in paths(arcs, a[2], final)]


@pytest.fixture(scope="module")
def graphs(spark):
    rnd, rows = random.Random(9), []
    for segment in range(25):
        n = rnd.randint(1, 5)
        chain = [(segment, s, s + 1, rnd.choice("ab"), rnd.random()) for s in range(n)]
        more = [(segment, s, rnd.randint(s + 1, n), rnd.choice("abc"), rnd.random()) for s in range(n) for _ in range(rnd.randint(0, 2))]
        rows += list({(a[1], a[2], a[3], a[0]): a for a in chain + more}.values())
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    return spark.createDataFrame(rows, SCHEMA).repartition(3), {s: paths(a, 0, max(x[2] for x in a)) for s, a in by.items()}


def test_best_and_n_best(graphs):
    arcs, all_paths = graphs
    got = {}
    for r in lattice.best_path(arcs).collect():
        got[r.segment_id] = got.get(r.segment_id, 0.0) + r.score
    assert got == {s: pytest.approx(min(sum(a[4] for a in p) for p in ps)) for s, ps in all_paths.items()}
    ranked = {}
    for r in lattice.n_best(arcs, 3).orderBy("segment_id", "rank").collect():
        ranked.setdefault(r.segment_id, []).append((r.words, r.score))
    for segment, ps in all_paths.items():
        best = {}
        for p in ps:
            words = " ".join(a[3] for a in p)
            best[words] = min(best.get(words, math.inf), sum(a[4] for a in p))
        want = sorted(best.items(), key=lambda x: x[1])[:3]
        assert [w for w, _ in ranked[segment]] == [w for w, _ in want] and [c for _, c in ranked[segment]] == pytest.approx([c for _, c in want])


def test_posteriors(graphs):
    arcs, all_paths = graphs
    got = {(r.segment_id, r.src, r.dst, r.label): r.posterior for r in lattice.arc_posteriors(arcs).collect()}
    for segment, ps in all_paths.items():
        total = sum(math.exp(-sum(a[4] for a in p)) for p in ps)
        for arc in {a for p in ps for a in p}:
            want = sum(math.exp(-sum(a[4] for a in p)) for p in ps if arc in p) / total
            assert got[(segment, arc[1], arc[2], arc[3])] == pytest.approx(want)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert lattice.best_path(none).count() == lattice.n_best(none, 2).count() == lattice.arc_posteriors(none).count() == 0


def test_n_best_of_equal_costs(spark):
    """Words that begin others of the same cost may come after them, by what follows: no list may lose them on the way."""
    rng = random.Random(3)
    rows, want = [], {}
    for segment in range(200):
        paths = {0: {("", 0.0)}}
        for dst in range(1, 8):
            into = {}
            for src in {max(dst - 1, 0), max(dst - 2, 0)}:
                label, score = rng.choice("ANR"), float(rng.randrange(0, 2))
                rows.append((segment, src, dst, label, score))
                for words, cost in paths[src]:
                    longer = f"{words} {label}" if words else label
                    into[longer] = min(cost + score, into.get(longer, 1e9))
            paths[dst] = set(into.items())
        want[segment] = [w for w, _ in sorted(paths[7], key=lambda x: (x[1], x[0]))]
    arcs = spark.createDataFrame(rows, "segment_id int, src long, dst long, label string, score double")
    for n in (1, 5):
        got = {}
        for r in lattice.n_best(arcs, n).orderBy("segment_id", "rank").collect():
            got.setdefault(r.segment_id, []).append(r.words)
        assert got == {segment: words[:n] for segment, words in want.items()}
