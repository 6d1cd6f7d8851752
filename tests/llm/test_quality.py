import random
import re
from collections import Counter

import duckdb
import numpy as np

from lexiloom.llm import quality

CLEAN = "the quick brown fox jumps over a lazy dog while many other animals look on from far away hills and rivers".split()


def text(rnd, n, mark=""):
    return " ".join(rnd.choice(CLEAN) + str(rnd.randint(0, 99)) * (rnd.random() < 0.3) + mark for _ in range(n))


def brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = Counter(x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), sum(lines.values()) - len(lines), len(repeated)


def test_base_features():
    rnd = random.Random(1)
    texts = ["", " \n\t", "a", "a a a a", "a b c a b c", "x\nx\nx\n \n ", "\x1c\x85 b"] + ["".join(rnd.choice("ab#\n \té") for _ in range(rnd.randint(0, 60))) for _ in range(500)]
    assert [quality.base_features(t) for t in texts] == [brute(t) for t in texts]


def test_trigrams():
    texts = ["", "a", "ab", "abc", "", "é😀xyz", "\n"]
    got, sizes = quality.buckets_of(texts)
    want = [(ord(t[i]) * 961 + ord(t[i + 1]) * 31 + ord(t[i + 2])) % quality.BUCKETS for t in texts for i in range(len(t) - 2)]
    assert got.tolist() == want and sizes.tolist() == [max(0, len(t) - 2) for t in texts]
    assert len(quality.buckets_of(["", "a"])[0]) == 0


def test_verdict_and_sql(spark):
    rnd = random.Random(4)
    rows = [(i, text(rnd, 80, "" if i % 4 else "$$$"), "en") for i in range(120)] + [(200, None, None), (201, "", "x"), (202, "same words " * 60, "x"), (None, text(rnd, 90), "x"), (5, rows_text := text(rnd, 70), "x"), (5, rows_text, "x")]
    rows = [r for r in rows if r[0] != 5 or r[1] == rows_text]
    labels = [(i, int(i % 4 > 0), int(i == 7)) for i in range(0, 120, 2)] + [(5, 1, 0), (5, 1, 0), (None, 0, 0), (9, None, 1)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.judge(docs, marks)
    kept = {r.doc_id: r.kept for r in got.collect()}
    assert all(kept[i] == (i % 4 > 0) for i in range(120)) and not kept[200] and not kept[201] and not kept[202]
    frames = {"documents": docs.toPandas(), "labels": marks.toPandas()}
    con = duckdb.connect()
    for name, frame in frames.items():
        con.register(name, frame)
    want = con.execute(quality.ORACLE_SQL.replace("FROM documents", "FROM (SELECT doc_id::BIGINT AS doc_id, text FROM documents WHERE doc_id IS NOT NULL AND doc_id <> 5)")).df().sort_values("doc_id")
    mine = quality.judge(docs.filter("doc_id <> 5"), marks).toPandas().sort_values("doc_id")
    for column in mine:
        assert (mine[column].to_numpy() == want[column].to_numpy()).all(), column
    assert quality.judge(docs.limit(0), marks).count() == 0
    none = quality.judge(docs, marks.limit(0)).collect()
    assert len(none) == len(rows) and any(r.kept for r in none)


def test_all_labels_count(spark):
    """Over 20,000 labelled documents: target and threshold are those of all of them."""
    rnd = random.Random(9)
    n, words = 20_600, ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(52)) + (" " + "xyz" * (i % 5) if i % 3 else " #q" * (i % 7))) for i in range(n)]
    marks = [(i, int(i % 3 > 0), int(i % 10 == 1)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    buckets, sizes = quality.buckets_of([t for _, t in rows])
    raw, target = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    raw += np.bincount(buckets, minlength=quality.BUCKETS)
    target += np.bincount(buckets[np.repeat([q == 1 and not x for _, q, x in marks], sizes)], minlength=quality.BUCKETS)
    ratios = np.rint((np.log(target / target.sum()) - np.log(raw / raw.sum())) * quality.SCALE).astype(np.int64)
    ends = np.cumsum(sizes)
    sums = np.concatenate([[0], np.cumsum(ratios[buckets])])
    scores = np.floor((sums[ends] - sums[ends - sizes]) / sizes).astype(np.int64)
    failed = np.array([100 * brute(t)[4] > 50 * brute(t)[0] for _, t in rows])
    good = np.array([q == 1 for _, q, _ in marks])
    bar = np.floor((3 * scores[good & ~failed].mean() + scores[~good & ~failed].mean()) / 4)
    got = {r.doc_id: (r.score, r.kept) for r in quality.judge(docs, labels).collect()}
    assert [got[i] for i in range(n)] == list(zip(scores.tolist(), (~failed & (scores >= bar)).tolist(), strict=True))
