"""Operator 6: document fingerprints as bottom-k sketches of shingle hashes.

A sketch holds the ``k`` smallest distinct hashes of a text's five-word shingles, ascending, 40 bits each, written in base64. Sketches of
parts merge into that of the whole; two of them estimate resemblance and containment, one estimates the number of distinct shingles.
Texts of up to ``k`` shingles are represented exactly.

Null texts count as empty. A text without words has the empty fingerprint; two of them are alike (1), one and another text are not (0).
Documents are ordered by id, nulls first, repeated ids by their text; the next of the last is the first. An empty table gives no row.
Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, slices, texts_of
from .shingles import shingle_hashes

K, WORDS = 128, 5
_BITS = np.uint64(24)  # 40 of 64 bits stay
#: Documents of one sorted run, and the most runs (each is one task, read as a stream).
RUN_DOCS, MAX_RUNS = 4000, 20_000


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct 40-bit hashes."""
    short = hashes >> _BITS
    if len(short) > 4 * k:  # repeats may use up places: then all are sorted
        low = np.unique(np.partition(short, 2 * k)[: 2 * k])
        if len(low) > k:
            return low[:k]
    return np.unique(short)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Exact below k, else (k - 1) over the k-th smallest hash as a share of the range."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**40 / (float(a[-1]) + 1)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The share of the k smallest hashes of the union that both have."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    first = np.concatenate([[True], ~twice])
    place = np.cumsum(first)  # rank of each value in the union
    n = min(int(place[-1]), k)
    return float(np.count_nonzero(twice & (place[1:] <= n))) / n


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    union = distinct_count(merge(a, b, k), k)
    return min(1.0, resemblance(a, b, k) * union / distinct_count(a, k))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 5)
    return np.pad(raw, ((0, 0), (0, 3))).copy().view("<u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """``doc_id, fingerprint, n_distinct`` (estimated distinct shingles)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sketches = [sketch(h, k) for h in shingle_hashes(texts_of(part), words)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(to_text, sketches), pa.string()), pa.array([distinct_count(s, k) for s in sketches], pa.float64())], names=["doc_id", "fingerprint", "n_distinct"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string, n_distinct double")


def with_next(docs: DataFrame) -> DataFrame:
    """Sorted runs of ``run, ahead, doc_id, text``, each followed by the first document of the next run (``ahead``).

    Only ids go through the two small passes that find the runs; texts are shuffled once.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    n = docs.count()
    runs = max(1, min(MAX_RUNS, n // RUN_DOCS))
    bounds = docs.select(F.percentile_approx(key, [i / runs for i in range(1, runs)] or [0.5], 50 * runs).alias("b")).first().b or []
    bounds = np.unique(np.array(bounds if runs > 1 else [], np.int64))
    run_of = F.pandas_udf(lambda s: pd.Series(np.searchsorted(bounds, s.to_numpy(), side="right")), "int")
    # a row for each run
    heads = {r.run: r.head for r in docs.select(key.alias("key")).groupBy(run_of("key").alias("run")).agg(F.min("key").alias("head")).collect()}
    order = sorted(heads)
    before = {heads[r]: order[i - 1] for i, r in enumerate(order)}
    keys, values = np.array(sorted(before), np.int64), np.array([before[h] for h in sorted(before)], np.int64)

    def copy_to(s: pd.Series) -> pd.Series:
        at = np.minimum(np.searchsorted(keys, s.to_numpy()), len(keys) - 1)
        return pd.Series(np.where(keys[at] == s.to_numpy(), values[at], -1))

    placed = docs.withColumn("_key", key).withColumn("_run", run_of("_key")).withColumn("_copy", F.pandas_udf(copy_to, "int")("_key"))
    copies = F.filter(F.array(F.struct(F.col("_run").alias("run"), F.lit(False).alias("ahead")), F.struct(F.col("_copy").alias("run"), F.lit(True).alias("ahead"))), lambda x: x["run"] >= 0)
    spread = placed.select("doc_id", "text", F.explode(copies).alias("at")).select("at.run", "at.ahead", "doc_id", "text")
    return spread.repartitionById(len(bounds) + 1, "run").sortWithinPartitions("run", "ahead", F.col("doc_id").asc_nulls_first(), "text")


def edit_likeness(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document."""
    ordered = with_next(docs)
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def rows(ids: list, texts: list[str], own: list[np.ndarray], follow: list[str], follow_sketch: list[np.ndarray]) -> pa.RecordBatch:
        edited = [t[: len(t) - len(t) // 4] + f[: len(t) // 4] for t, f in zip(texts, follow, strict=True)]
        new = [sketch(h, k) for h in shingle_hashes(edited, words)]
        columns = [ids, [len(t) for t in texts], [hashlib.sha256(e.encode()).hexdigest() for e in edited], list(map(to_text, own)), list(map(to_text, new)), [resemblance(a, b, k) for a, b in zip(own, new, strict=True)], [resemblance(a, b, k) for a, b in zip(own, follow_sketch, strict=True)]]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the document that waits for its next one: run, id, text, sketch
        for batch in batches:
            for part in slices(batch, "text"):
                texts = texts_of(part)
                sketches = [sketch(h, k) for h in shingle_hashes(texts, words)]
                done: list[tuple] = []
                for here, ahead, doc_id, text, own in zip(part.column("run").to_pylist(), part.column("ahead").to_pylist(), part.column("doc_id").to_pylist(), texts, sketches, strict=True):
                    if last is not None and last[0] == here:
                        done.append((*last[1:], text, own))
                        last = None
                    if not ahead:
                        last = (here, doc_id, text, own)
                if done:
                    yield rows(*map(list, zip(*done, strict=True)))

    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))
