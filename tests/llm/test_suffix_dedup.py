import hashlib
import random

import numpy as np
import pytest

from lexiloom.llm import suffix_dedup as sd


def brute(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - sd.LENGTH + 1):
            w = raw[s : s + sd.LENGTH]
            if w in seen:
                gone[s : s + sd.LENGTH] = True
            seen.add(w)
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
        out[doc_id] = (len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


def corpus(rnd, n):
    word = lambda: "".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(1, 8)))
    passages = [" ".join(word() for _ in range(k)) for k in (5, 14, 20, 25, 60, 200)]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randint(1, 6)):
            parts.append(rnd.choice(passages) if rnd.random() < 0.5 else " ".join(word() for _ in range(rnd.randint(1, 60))))
        rows.append(" ".join(parts))
        if rnd.random() < 0.3:
            t = list(rnd.choice(rows))
            for _ in range(rnd.randint(0, 3)):
                t[rnd.randrange(len(t))] = rnd.choice("xyz\x00")
            rows.append("".join(t))
    rows += [None, "", "a" * 99, "a" * 100, "a" * 500, "ab" * 300, "\x00" * 250, "b\x00" * 200, "x" * 150 + "\x00" * 150]
    rnd.shuffle(rows)
    return [(2 * i, t) for i, t in enumerate(rows)]


def result(spark, rows):
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, lo int").repartition(3)
    got = sd.cut_repeats(docs, sd._digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect()
    return [(r.doc_id, tuple(r)[1:]) for r in got]


@pytest.mark.parametrize("hot,block", [(5000, 1 << 20), (3, 256)])
def test_removal_equals_brute_force(spark, monkeypatch, hot, block):
    monkeypatch.setattr(sd, "HOT", hot)
    monkeypatch.setattr(sd, "BLOCK", block)
    rows = corpus(random.Random(hot), 60)
    rows.append((None, rows[5][1]))
    got = result(spark, [*rows, rows[7]])
    assert len(got) == len(rows) + 1 and dict(got) == brute(rows)


def test_hot_edges_make_no_large_group(spark, monkeypatch):
    """A passage in every text: the groups at its edges, where contexts differ, are never gathered beyond ``HOT``."""
    monkeypatch.setattr(sd, "HOT", 20)
    rnd = random.Random(2)
    noise = lambda n: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    passage = noise(240)
    rows = [(i, noise(130) + passage + noise(130)) for i in range(300)]
    kept = sd._bytes_of

    def watched(opened, docs):
        pieces = kept(opened, docs).cache()
        groups = pieces.filter("data IS NOT NULL").groupBy("key").count().agg({"count": "max"}).first()[0]
        assert (groups or 0) <= sd.HOT
        return pieces

    monkeypatch.setattr(sd, "_bytes_of", watched)
    assert dict(result(spark, rows)) == brute(rows)


@pytest.mark.parametrize("hot", [5000, 1])
def test_texts_under_one_id_are_judged_apart(spark, monkeypatch, hot):
    """Null and repeated ids: every string stays at one place, and texts without repeats stay whole."""
    monkeypatch.setattr(sd, "HOT", hot)
    rnd = random.Random(hot)
    noise = lambda n: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    passage, other = noise(200), noise(150)
    clean = [(None, noise(900)), (7, noise(900))]
    twice = [(None, noise(500) + passage + noise(90)), (None, noise(500) + passage + noise(120)), (7, noise(300) + other + noise(50)), (7, noise(300) + other + noise(70)), (9, noise(40) + passage)]
    got = result(spark, [*clean, *twice])
    whole = [(d, (len(t), 0, 0, hashlib.sha256(t.encode()).hexdigest())) for d, t in clean]
    assert all(w in got for w in whole)
    assert sorted(g[1][1] for g in got) == [0, 0, 0, 0, 150, 200, 200]
    assert [g[1][1] for g in got if g[0] == 9] == [200] and sum(g[1][1] for g in got if g[0] is None) == 200


def test_empty(spark):
    assert result(spark, []) == []


def test_maximal_repeats_of_a_small_text():
    text = b"banana"
    order = sorted(range(6), key=lambda i: text[i:])
    common = lambda a, b: next((k for k in range(9) if a[k : k + 1] != b[k : k + 1] or not a[k : k + 1]), 9)
    lcp = np.array([0] + [common(text[a:], text[b:]) for a, b in zip(order[:-1], order[1:])])
    left = np.array([text[i - 1] if i else -1 for i in order])
    found = {(text[order[a] : order[a] + n], tuple(sorted(order[a:b]))) for n, a, b in sd.maximal_repeats(lcp, left, 1)}
    assert found == {(b"a", (1, 3, 5)), (b"ana", (1, 3))}
