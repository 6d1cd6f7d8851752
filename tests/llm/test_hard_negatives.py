import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>, score int, slot int"


def brute(rows, anchor, positives=5, negatives=10):
    """All anchors against all rows; of anchors with one id the row of the least label and vector."""
    good = [(i, c, [math.floor(256 * float(np.float32(x))) for x in v]) for i, c, v, *_ in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    as_bytes = lambda v: np.array(v, "<i4").tobytes()
    anchors = {}
    for i, c, v in good:
        if anchor(i):
            anchors[i] = min(anchors.get(i, (c, v)), (c, v), key=lambda x: (x[0], as_bytes(x[1])))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, (c, v) in anchors.items():
        scored = sorted(((dot(v, w), j, d) for j, d, w in good if j != i), key=lambda x: (-x[0], x[1]))
        for ps, p, _ in [x for x in scored if x[2] == c][:positives]:
            found = [x for x in scored if x[2] != c and 30 * ps <= 100 * x[0] <= 90 * ps][:negatives]
            out += [(i, p, k + 1, n, ps, ns) for k, (ns, n, _) in enumerate(found)]
    return sorted(out)


def vectors_of(n, rnd, d=6):
    rows = []
    for i in range(n):
        v = [rnd.gauss(0, 0.3) + 0.5 * (i % 3 == 0) for _ in range(d)]
        rows.append((i, i % 4, v, 1, 2))
    rows += [(n, None, rows[0][2], 0, 0), (None, 1, rows[0][2], 0, 0), (n + 1, 1, None, 0, 0), (n + 2, 1, [0.1, None] + [0.0] * (d - 2), 0, 0), (n + 3, 1, [math.inf] + [0.0] * (d - 1), 0, 0), (n + 4, 1, [math.nan] * d, 0, 0)]
    rows += [(n + 5 + k, k % 4, rows[7][2], 0, 0) for k in range(12)]  # ties
    rows += [(40, 2, rows[9][2], 0, 0), (3, 1, rows[9][2], 0, 0), (n + 30, 0, [0.0] * d, 0, 0), (n + 31, 0, rows[1][2][:3], 0, 0), (n + 32, 1, [], 0, 0)]
    return rows


@pytest.mark.parametrize("first, items, anchors, step, clusters", [(16_384, 16_384, 1024, 1024, 8), (20, 16, 3, 7, 3), (5, 8, 2, 4, 1)])
def test_against_all_pairs(spark, monkeypatch, first, items, anchors, step, clusters):
    for name, value in (("FIRST", first), ("ITEMS", items), ("ANCHORS", anchors), ("STEP", step)):
        monkeypatch.setattr(hn, name, value)
    rows = vectors_of(170, random.Random(3))
    data = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, hn.mine(data, F.col("vec_id") % 10 == 0, clusters=clusters).collect()))
    assert got == brute(rows, lambda i: i % 10 == 0)
    assert len(got) > 300


def test_bounds_hold():
    rng = np.random.default_rng(5)
    for spread in (0.05, 0.5, 3.0):
        centres = hn.fit_centres(rng.normal(size=(50, 8)), 4)
        members = centres[1] * 5 + spread * rng.normal(size=(40, 8))
        items = rng.normal(size=(300, 8)) * rng.integers(0, 9, (300, 1))
        widest = np.array([1.0, hn._cosines(members, centres)[:, 1].min(), 1.0, 1.0])
        bounds = hn.upper_bounds(items, centres, widest)[:, 1]
        scores = items @ members.T / hn._lengths(members)
        assert (scores <= bounds[:, None] + 1e-12).all()


def test_walks_end_early(spark, monkeypatch):
    """Members of a narrow cluster stop long before the end of their list: far bands are not read."""
    monkeypatch.setattr(hn, "FIRST", 64)
    rnd = random.Random(4)
    rows = [(i, i % 2, [1 + 0.01 * rnd.gauss(0, 1), 0.01 * rnd.gauss(0, 1), 0.0], 0, 0) for i in range(60)]
    rows += [(100 + i, i % 2, [0.001 * rnd.gauss(0, 1), rnd.gauss(0, 1) * 0.2, rnd.gauss(0, 1) * 0.2], 0, 0) for i in range(3000)]
    rows += [(4000 + i, i % 2, [0.6 + 0.01 * rnd.gauss(0, 1), 0.2, 0.1], 0, 0) for i in range(40)]
    seen = []
    own = hn._Lists.band
    monkeypatch.setattr(hn._Lists, "band", lambda self, r, clusters: (seen.append((r, self.bands)), own(self, r, clusters))[1])
    data = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, hn.mine(data, F.col("vec_id").isin(0, 10, 20), clusters=1).collect()))
    assert got == brute(rows, lambda i: i in (0, 10, 20)) and got
    assert max(r for r, _ in seen) + 1 < seen[0][1]


def test_edges(spark):
    data = spark.createDataFrame(vectors_of(20, random.Random(1)), SCHEMA)
    anchor = F.col("vec_id") % 10 == 0
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    for none in (data.limit(0), data.filter("vec_id > 0 AND vec_id < 5"), data.filter("label IS NULL")):
        out = hn.mine(none, anchor)
        assert out.columns == columns and out.count() == 0
    large = spark.createDataFrame([(0, 0, [2.0**30], 0, 0)], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        hn.mine(large, anchor).collect()
