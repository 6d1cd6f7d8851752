"""Operator 3: quality rules and a hashed n-gram log-likelihood ratio.

Character trigrams are hashed to buckets. Two multinomials over the buckets get add-one smoothing: the raw corpus, counted over all
documents, and the trusted target, counted over all documents labelled quality 1 and not toxic. For the latter the texts are shuffled once to
meet the labels; for the threshold, scores meet all labels by id. A document's score is the sum of the buckets'
log ratios over its number of trigrams. The threshold lies a quarter of the way from the mean score of
documents labelled good to that of documents labelled bad, both among those that pass the base rules: good texts vary little, bad ones
much. Without labels of both kinds it is ``DEFAULT_THRESHOLD``; without trusted documents every score is 0.

Log ratios are held as integers (2**-16), scores and threshold are whole numbers too, so the verdict depends neither on the order of sums
nor on the partitioning.

Null texts have no words and fail the base rules; so do empty ones. Texts under three characters score 0. Rows are judged alone:
repeated rows get the same verdict. Null ids count as unlabelled. A document labelled more than once counts by its least
quality and its greatest toxicity. Empty tables give no row; other columns of the documents are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, materialise, slices, temporary_tables, texts_of

BUCKETS = 1 << 16
SCALE = 1 << 16
#: Per trigram, in 2**-16: used where labels of one kind are missing.
DEFAULT_THRESHOLD = -SCALE // 4
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = "#*$%&|<>"
_FACTORS = (961, 31, 1)


def buckets_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every trigram, text after text, and the number of trigrams of each text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    sizes = np.maximum(lengths - 2, 0)
    if not sizes.sum():
        return np.zeros(0, np.uint32), sizes
    hashed = codes[:-2] * np.uint32(_FACTORS[0]) + codes[1:-1] * np.uint32(_FACTORS[1]) + codes[2:]
    inside = np.ones(len(codes), bool)
    ends = np.cumsum(lengths)
    inside[np.maximum(ends[lengths > 0] - 1, 0)] = False
    inside[np.maximum(ends[lengths > 1] - 2, 0)] = False
    return (hashed & np.uint32(BUCKETS - 1))[inside[:-2]], sizes


def base_features(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = _WORD.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols = sum(map(text.count, _SYMBOLS))
    seen: set[str] = set()
    repeated_lines = 0
    for line in text.split("\n"):
        if line in seen:
            repeated_lines += 1
        elif _WORD.search(line):
            seen.add(line)
    repeated = 0
    if n >= 4:
        number: dict[str, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        pairs = ids[:-1] * len(number) + ids[1:]
        if len(number) > 2_000_000:
            pairs = np.unique(pairs, return_inverse=True)[1]
        keys, inverse, count = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        if len(keys) < n - 2:
            at = np.flatnonzero(count[inverse] > 1)
            marked = np.zeros(n, bool)
            for k in range(3):
                marked[at + k] = True
            repeated = int(np.count_nonzero(marked))
    return n, chars, symbols, repeated_lines, repeated


def labelled(labels: DataFrame) -> DataFrame:
    """``doc_id, trusted, good`` of all labelled ids."""
    return labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(((F.min("quality") == 1) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)).alias("trusted"), (F.min("quality") == 1).alias("good"))


def _counted(docs: DataFrame, name: str) -> DataFrame:
    """``bucket`` and its number of trigrams in the texts: at most ``BUCKETS`` rows a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                total += np.bincount(buckets_of(texts_of(part))[0], minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["bucket", name])

    return docs.select("text").mapInArrow(run, f"bucket int, {name} long")


def bucket_counts(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``bucket, raw, target`` over all documents: at most ``BUCKETS`` rows. ``marks`` is that of ``labelled``.

    The ids of ``marks`` grow with the input, so they are never broadcast: texts are dealt by id, and each task hashes its share of the marks.
    """
    bounded_batches(docs.sparkSession)
    trusted = docs.select("doc_id", "text").join(marks.filter("trusted").select("doc_id").hint("shuffle_hash"), "doc_id")
    raw = _counted(docs, "raw").withColumn("target", F.lit(0).cast("long"))
    target = _counted(trusted, "target").select("bucket", F.lit(0).cast("long").alias("raw"), "target")
    return raw.union(target).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: list) -> np.ndarray:
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in counts:
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    if target.sum() == BUCKETS:  # nothing is trusted: no verdict beyond the base rules
        return np.zeros(BUCKETS, np.int64)
    return np.rint((np.log(target / target.sum()) - np.log(raw / raw.sum())) * SCALE).astype(np.int64)


FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"]


def score_documents(docs: DataFrame, ratios: np.ndarray, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of the documents, base features, ``score`` and ``base_failed``, which take the place of columns of their names."""
    bounded_batches(docs.sparkSession)
    carry = [c for c in carry if c not in (*FEATURES, "base_failed")]
    names = [*carry, *FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = texts_of(part)
                buckets, sizes = buckets_of(texts)
                sums = np.concatenate([[0], np.cumsum(ratios[buckets])])
                ends = np.cumsum(sizes)
                scores = np.floor((sums[ends] - sums[ends - sizes]) / np.maximum(sizes, 1)).astype(np.int64)
                columns = zip(*map(base_features, texts), strict=True)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), *(pa.array(c, pa.int64()) for c in columns), pa.array(scores)], names=names)

    chosen = docs.select(*dict.fromkeys([*carry, "text"]))
    schema = T.StructType([*(chosen.schema[c] for c in carry), *(T.StructField(n, T.LongType()) for n in FEATURES)])
    return chosen.mapInArrow(run, schema).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def threshold_of(scored: DataFrame, marks: DataFrame) -> int:
    """A quarter of the way from the mean score of all documents labelled good to that of all labelled bad, among those that pass the base rules."""
    means = scored.filter("NOT base_failed").select("doc_id", "score").join(marks.hint("shuffle_hash"), "doc_id").groupBy("good").agg(F.sum("score").alias("total"), F.count("*").alias("n")).collect()  # two rows
    mean = {r.good: r.total / r.n for r in means}
    return int(np.floor((3 * mean[True] + mean[False]) / 4)) if len(mean) == 2 else DEFAULT_THRESHOLD


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, int, DataFrame]:
    """The buckets' log ratios, the threshold and, as a table, ``doc_id``, base features and score of every document."""
    with temporary_tables(docs.sparkSession):
        marks = materialise(labelled(labels), "labels")
        ratios = log_ratios(bucket_counts(docs, marks).collect())
        scored = materialise(score_documents(docs, ratios, ["doc_id"]), "scores", keep=True)
        return ratios, threshold_of(scored, marks), scored


def judge(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Base features and verdict of every document, beside its id or the columns ``carry``, for which texts are scored again."""
    ratios, threshold, scored = fit(docs, labels)
    if carry:
        scored = score_documents(docs, ratios, carry)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns. Columns with the names of the features are not touched."""
    plain = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    return judge(plain, labels, ["row"]).filter("kept").select("row.*")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, text FROM docs),
windows AS (SELECT doc_id, i, w[i:i+2] AS g FROM words, unnest(range(1, len(w) - 1)) AS t(i)),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
marked AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, unnest([0, 1, 2]) AS t(k) GROUP BY doc_id),
lines AS (SELECT doc_id, l, count(*) AS n FROM docs, unnest(string_split(text, chr(10))) AS t(l) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l),
dups AS (SELECT doc_id, sum(n - 1) AS n FROM lines GROUP BY doc_id),
base AS (
  SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(marked.n, 0)::BIGINT AS n_repeat_words, text
  FROM words LEFT JOIN dups USING (doc_id) LEFT JOIN marked USING (doc_id)),
codes AS (SELECT doc_id, list_transform(range(1, length(text) + 1), lambda i: unicode(text[i])::BIGINT) AS c FROM docs WHERE length(text) >= 3),
grams AS (SELECT doc_id, (c[i] * 961 + c[i + 1] * 31 + c[i + 2]) % 65536 AS bucket FROM codes, unnest(range(1, len(c) - 1)) AS t(i)),
labelled AS (SELECT doc_id, min(quality) = 1 AND coalesce(max(toxic), 0) = 0 AS trusted, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
counts AS (SELECT bucket, count(*) AS raw, count(*) FILTER (trusted) AS target FROM grams LEFT JOIN labelled USING (doc_id) GROUP BY bucket),
smooth AS (SELECT b AS bucket, coalesce(raw, 0) + 1.0::DOUBLE AS raw, coalesce(target, 0) + 1.0::DOUBLE AS target FROM range(65536) AS t(b) LEFT JOIN counts ON bucket = b),
ratios AS (SELECT bucket, CASE WHEN sum(target) OVER () = 65536 THEN 0 ELSE round_even((ln(target / sum(target) OVER ()) - ln(raw / sum(raw) OVER ())) * 65536, 0)::BIGINT END AS ratio FROM smooth),
scores AS (SELECT doc_id, floor(sum(ratio)::DOUBLE / count(*))::BIGINT AS score FROM grams JOIN ratios USING (bucket) GROUP BY doc_id),
scored AS (SELECT base.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, coalesce(score, 0)::BIGINT AS score, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base LEFT JOIN scores USING (doc_id)),
means AS (SELECT good, sum(score)::DOUBLE / count(*) AS m FROM scored JOIN labelled USING (doc_id) WHERE NOT base_failed GROUP BY good),
bar AS (SELECT CASE WHEN count(*) = 2 THEN floor((3 * max(m) FILTER (good) + max(m) FILTER (NOT good)) / 4) ELSE -16384 END AS t FROM means)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed, NOT base_failed AND score >= t AS kept FROM scored, bar
"""
