import hashlib
import random
import re

import numpy as np

from lexiloom.llm import fingerprints as fp
from lexiloom.llm.shingles import shingle_hashes

TEXTS = [None, "", " ", "one two", "a b c d e f g", "a b c d e f g", "é😀 " * 40, "x\x0by z\tq " * 300, " ".join(map(str, range(3000)))]


def words(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_shingles_are_those_of_the_words():
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab \n\tAé") for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    for n in (1, 2, 5):
        hashed, seen = shingle_hashes(texts, n), {}
        for text, h in zip(texts, hashed):
            w = re.findall(r"[^\x20\x09-\x0D]+", text)
            plain = [tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
            assert len(plain) == len(h)
            for a, b in zip(plain, h.tolist()):
                assert seen.setdefault(a, b) == b
        assert len(set(seen.values())) == len(seen)


def test_estimates():
    rnd = np.random.default_rng(1)
    a, b = rnd.integers(0, 2**63, 6000).astype(np.uint64), rnd.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = a * np.uint64(2), b * np.uint64(2)
    b = np.concatenate([b, a[:2000]])  # resemblance 2000 / 10000
    x, y = fp.sketch(a), fp.sketch(b)
    assert (fp.merge(x, y) == fp.sketch(np.concatenate([a, b]))).all()
    assert abs(fp.resemblance(x, y) - 0.2) < 0.15 and abs(fp.containment(x, y) - 1 / 3) < 0.25
    assert abs(fp.distinct_count(x) / 6000 - 1) < 0.35
    assert (fp.from_text(fp.to_text(x)) == x).all() and len(fp.from_text("")) == 0


def test_edited_and_next(spark, monkeypatch):
    monkeypatch.setattr(fp, "RUN_DOCS", 3)
    ids = [None, 7, 5, 3, 11, 13, 17, 19, 2]
    docs = spark.createDataFrame(list(zip(ids, TEXTS, range(9))), "doc_id long, text string, run int").repartition(4)
    got = {r.doc_id: r for r in fp.edit_likeness(docs).collect()}
    order = sorted(range(9), key=lambda i: -1 if ids[i] is None else ids[i])
    assert len(got) == 9
    for here, after in zip(order, order[1:] + order[:1]):
        text, follow = TEXTS[here] or "", TEXTS[after] or ""
        edited = text[: len(text) - len(text) // 4] + follow[: len(text) // 4]
        row = got[ids[here]]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for near, other in ((row.near_edited, edited), (row.near_next, follow)):
            a, b = words(text, 5), words(other, 5)
            want = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(near - want) < (1e-9 if len(a | b) <= fp.K else 0.15)
    assert got[11].fingerprint == got[13].fingerprint
    assert fp.edit_likeness(docs.limit(0)).count() == 0 and fp.fingerprints(docs).count() == 9
    one = fp.edit_likeness(docs.filter("doc_id = 11")).first()
    assert one.near_next == 1.0
