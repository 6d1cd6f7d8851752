import random
import re
from itertools import combinations

import numpy as np
import pytest

from lexiloom.llm import near_dedup
from lexiloom.llm.components import connected_components


def brute(rows, words, threshold=80):
    sets = {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        sets[doc_id] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= threshold * len(x | y):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {d: (len(sets[d]), root(d), root(d) == d) for d in sets}


def corpus(rnd, groups, most):
    rows = []
    for _ in range(groups):
        base = [str(rnd.randint(0, 400)) for _ in range(rnd.randint(20, 120))]
        for _ in range(rnd.randint(1, most)):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 6, 9])):
                w[rnd.randrange(len(w))] = str(rnd.randint(0, 9999))
            if rnd.random() < 0.1:
                base = w  # copies of copies drift
            rows.append(" ".join(w))
    rows += [None, "", " \n", "one", "ONE", "one two", "One two", "x\x00y", "a b c", "c b a", "a b c d e f g h i j k", "a b c d e f g h i j"]
    rnd.shuffle(rows)
    return [(3 * i, t) for i, t in enumerate(rows)]


def found(spark, rows, words, extra=()):
    docs = spark.createDataFrame([(d, t, 0) for d, t in [*rows, *extra]], "doc_id long, text string, label int")
    return near_dedup.near_duplicates(docs, words=words).collect()


def test_groups_equal_brute_force(spark):
    rows = corpus(random.Random(3), 60, 12)
    for words in (2, 5):
        want = brute(rows, words)
        got = found(spark, rows, words, [rows[0], (None, rows[1][1]), (None, None)])
        assert len(got) == len(rows) + 3
        assert {r.doc_id: tuple(r)[1:] for r in got if r.doc_id is not None} == want
        assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)


@pytest.mark.parametrize("far", [3, 2000])
def test_large_nodes_are_split_and_blocked(spark, monkeypatch, far):
    monkeypatch.setattr(near_dedup, "NODE", 8)
    monkeypatch.setattr(near_dedup, "FAR", far)
    rows = corpus(random.Random(8), 6, 60)
    got = found(spark, rows, 2)
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute(rows, 2)


def test_empty(spark):
    assert found(spark, [], 2) == [] and [tuple(r) for r in found(spark, [(1, None)], 2)] == [(1, 0, 1, True)]


def test_signature_estimates():
    rnd = np.random.default_rng(0)
    error = []
    for _ in range(40):
        a = rnd.integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2)
        b = np.concatenate([a[:444], rnd.integers(0, 2**63, 56).astype(np.uint64) * np.uint64(2)])
        error.append(np.mean(near_dedup.signature(a) == near_dedup.signature(b)) - 444 / 556)
    assert abs(np.mean(error)) < 0.01 and np.std(error) < 0.04


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 90), (90, 95), (7, 7)]
    labels = {r.id: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert labels == {**{i: 1 for i in range(1, 61)}, 90: 90, 95: 90, 100: 90}


def test_measured_recall_near_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.85 among many other texts: 0.99 of them are found at least."""
    rnd, rows, pairs = random.Random(21), [], 0
    while pairs < 300:
        w = [str(rnd.randint(0, 10**6)) for _ in range(rnd.randint(80, 240))]
        v = list(w)
        for _ in range(round(len(w) * 0.052)):
            v[rnd.randrange(len(v))] = str(rnd.randint(0, 10**6))
        x, y = (set(zip(t, t[1:])) for t in (w, v))  # noqa: B905
        if 80 * len(x | y) <= 100 * len(x & y) <= 85 * len(x | y):
            rows += [(2 * pairs, " ".join(w)), (2 * pairs + 1, " ".join(v))]
            pairs += 1
    got = {r.doc_id: r.component_id for r in found(spark, rows, 2)}
    assert sum(got[2 * k + 1] == 2 * k for k in range(300)) >= 297


def test_words_of_equal_polynomial_hashes_are_told_apart(spark):
    """The Thue-Morse word and its complement agree under every polynomial modulo 2^64."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [w[:n] for n in (1024, 2048) for w in (word, word.translate(str.maketrans("ab", "ba")))]
    got = found(spark, [(k, f"{t} x") for k, t in enumerate(texts)], 2)
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 1, 2: 2, 3: 3}


def template_family(rnd, n, length=100, own=(17, 26)):
    """Pages of one template, each with a share of words of its own: alike at 0.6 to 0.8, but for planted copies of a few and pages of hardly more than the template."""
    base = [f"t{i}" for i in range(length)]
    texts = []
    for k in range(n):
        w = list(base)
        for i in rnd.sample(range(0, length, 2), rnd.randint(*own) // 2):
            w[i] = f"u{rnd.randint(0, 10**7)}"
        if k % 50 == 7 and texts:  # near another page, not near the template's other pages
            w = texts[rnd.randrange(len(texts))].split()
            w[rnd.randrange(len(w))] = "changed"
        if k % 97 == 3:
            w = base[: length - rnd.randint(0, 12)]
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("node, far, side", [(20, 30, 4096), (20, 30, 25), (20, 2000, 25), (400, 2000, 4096)])
def test_template_families(spark, monkeypatch, node, far, side):
    for name, value in (("NODE", node), ("FAR", far), ("SIDE", side)):
        monkeypatch.setattr(near_dedup, name, value)
    rnd = random.Random(13)
    rows = list(enumerate(template_family(rnd, 260))) + [(1000 + k, t) for k, t in enumerate(template_family(rnd, 30, 60, (2, 9)))]
    for words in (1, 2):
        got = found(spark, rows, words)
        assert {r.doc_id: tuple(r)[1:] for r in got} == brute(rows, words)
