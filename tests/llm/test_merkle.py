import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import merkle, sha256

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos int, _file string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, more=0):
    values = [row[0], row[3], row[2], None if row[4] is None else row[4] + more, row[1]]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain(rows, fanout=2):
    """``(leaf, subroot, root, proof, folded, verified)`` of every row, with its tampered leaf, by lists of levels."""

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][k : k + fanout]) for k in range(0, len(out[-1]), fanout)])
        return out

    def steps(tree, k):
        for level in tree[:-1]:
            first = k // fanout * fanout
            run = level[first : first + fanout]
            yield run[: k - first], run[k - first + 1 :]
            k //= fanout

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(plain_leaf(r)))) for x in langs]
    trees = [levels([plain_leaf(r) for r in g]) for g in groups]
    upper = levels([t[-1][0] for t in trees])
    out = []
    for j, (group, tree) in enumerate(zip(groups, trees)):
        for k, row in enumerate(group):
            path = [*steps(tree, k), *steps(upper, j)]
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            at = plain_leaf(row, 1) if tampered else tree[0][k]
            for left, right in path:
                at = h(*left, at, *right)
            out.append((row[0], tree[0][k], tree[-1][0], upper[-1][0], h(*(s for left, right in path for s in (*left, *right))), at, at == upper[-1][0]))
    return out


def rows_of(n, rnd, langs):
    texts = [None, "", "é😀\n", "x" * 3000, "plain text"]
    return [(rnd.choice([None, i, i, i, i // 2]), rnd.choice(texts), rnd.choice(langs), rnd.choice([None, "", "web"]), rnd.choice([None, 0, i]), "t", i, "f") for i in range(n)]


def test_hashes():
    rng = np.random.default_rng(1)
    digests = rng.integers(0, 256, (5, 3, 32)).astype(np.uint8)
    states = sha256.start(5)
    for k in range(3):
        states = sha256.from_bytes(sha256.to_bytes(sha256.absorb(states, sha256.hex_blocks(digests[:, k]))))
    for got, own in zip(sha256.finish(states, np.full(5, 3)), digests):
        assert bytes(got).hex() == h(*(bytes(d).hex() for d in own))


@pytest.mark.parametrize("n, fanout, block", [(1, 2, 256), (2, 2, 256), (3, 2, 4), (37, 2, 4), (64, 2, 8), (65, 2, 8), (150, 2, 256), (41, 3, 9), (29, 5, 5)])
def test_manifest(spark, monkeypatch, n, fanout, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rows = rows_of(n, random.Random(n), ["en", "de", None, "", "é", "zz"] if n > 40 else ["en", None])
    rows += rows[:2]  # repeated rows
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    manifest = merkle.build_manifest(docs, fanout=fanout, replacement=merkle.tampered_leaf())
    got = [tuple(r) for r in merkle.folded(manifest).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(plain(rows, fanout), key=key)
    assert bytes(manifest.root.first().digest).hex() == got[0][3]


def test_without_replacement_all_verify(spark):
    rows = rows_of(30, random.Random(2), ["en"])
    docs = spark.createDataFrame(rows, SCHEMA)
    assert merkle.folded(merkle.build_manifest(docs)).filter("NOT verified").isEmpty()
    shuffled = merkle.build_manifest(docs.repartition(7, F.rand(1)))
    assert merkle.build_manifest(docs).root.first() == shuffled.root.first()
    other = docs.withColumn("text", F.when(F.col("pos") == 3, F.lit("changed")).otherwise(F.col("text")))
    assert merkle.build_manifest(other).root.first() != shuffled.root.first()
    empty = merkle.build_manifest(docs.limit(0))
    assert merkle.folded(empty).count() == 0 and empty.root.count() == 0
    with pytest.raises(ValueError):
        merkle.build_manifest(docs, fanout=1)


def test_written_and_read_again(spark, tmp_path):
    rows = rows_of(40, random.Random(6), ["en", "de", None])
    manifest = merkle.build_manifest(spark.createDataFrame(rows, SCHEMA), replacement=merkle.tampered_leaf())
    merkle.write_manifest(manifest, f"file://{tmp_path}/manifest")
    again = merkle.read_manifest(spark, f"file://{tmp_path}/manifest")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, merkle.folded(again).collect()), key=key) == sorted(plain(rows), key=key)
    assert again.root.first() == manifest.root.first() and again.subroots.count() == 3
