"""Operator 13: benchmark decontamination by a broadcast hash set of normalised n-grams.

A-Z become lower case; words are runs of digits, small letters and characters beyond ASCII. A window is ``n`` consecutive words of an item, or all words of an
item that has fewer. The items' texts are broadcast and turned into a hash set of windows in each worker. A document's windows are hashed from those of half
the length, looked up in a table of bits and then in the set, and every hit is verified on the words themselves. Words inside a window that occurs are hit;
their spans, or whole documents, can be removed.

Items are broadcast in blocks of about ``BLOCK_BYTES`` of words. A benchmark over one block is scanned for block by block, and a document's spans and
items are united by id and digest of the text, so a broadcast never grows with the benchmark.

Null texts have no words, and neither have empty ones: no window, no hit. Rows of the benchmark that share an id are one item; those without an id are one item, whose
id is written as empty text. Rows that repeat are judged alike. An empty table of documents gives no row, an empty benchmark no hit. Other columns are
kept by ``decontaminate`` and ignored by the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, slices, texts_of
from .shingles import _LOWER, _STEP, hash_identities, identities, mix

N = 10
#: Bytes of normalised items in one broadcast.
BLOCK_BYTES = 8 << 20
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


class Words:
    """The words of some texts, side by side: where they are, whose they are, what they are."""

    def __init__(self, texts: list[str]):
        encoded = [t.encode() for t in texts]
        self.data = _LOWER[np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)]
        inside = _WORD[self.data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        edge = np.concatenate([[0], edge]) if inside[0] else edge
        self.starts, self.ends = edge[::2], edge[1::2]
        self.text_starts = np.concatenate([[0], np.cumsum([len(e) + 1 for e in encoded])])
        self.bounds = np.searchsorted(self.starts, self.text_starts)
        self.owner = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        self.low, self.high = identities(self.data, self.starts, self.ends)
        self.sizes = self.ends - self.starts
        self._hashes = {1: hash_identities(self.low, self.high, self.sizes)}

    def windows(self, n: int) -> np.ndarray:
        """The hashes of all runs of ``n`` words, across texts too."""
        if n not in self._hashes:
            first = 1 << (n - 1).bit_length() - 1  # the largest power of two below n
            a, b = self.windows(first), self.windows(n - first)
            m = max(0, len(self.starts) - n + 1)
            self._hashes[n] = mix(a[:m] * _STEP + b[first : first + m])
        return self._hashes[n]

    def whole(self, at: np.ndarray, n: int) -> np.ndarray:
        """Which of the runs of ``n`` words that begin at ``at`` lie in one text."""
        return self.owner[at] == self.owner[at + n - 1]

    def same(self, at: np.ndarray, other: Words, there: np.ndarray, n: int) -> np.ndarray:
        """Which runs of ``n`` words equal those of ``other``: by all bytes of all words."""
        equal = np.ones(len(at), bool)
        for k in range(n):
            i, j = at + k, there + k
            equal &= (self.low[i] == other.low[j]) & (self.high[i] == other.high[j]) & (self.sizes[i] == other.sizes[j])
            for p in np.flatnonzero(equal & (self.sizes[i] > 16)):  # known by a digest so far
                x, y = i[p], j[p]
                equal[p] = (self.data[self.starts[x] : self.ends[x]] == other.data[other.starts[y] : other.ends[y]]).all()
        return equal


class WindowSet:
    """The windows of items. For each length: the distinct windows by hash, one place of each, and the items that hold them."""

    def __init__(self, ids: list[str], texts: list[str], n: int):
        self.ids, self.words, self.tables = np.array(ids, object), Words(texts), {}
        counts = np.diff(self.words.bounds)
        for length in sorted({n} | set(counts[(counts > 0) & (counts < n)].tolist())):
            at = np.flatnonzero(np.repeat((counts >= n) if length == n else (counts == length), counts))
            at = at[at + length <= len(self.words.starts)]
            at = at[self.words.whole(at, length)]
            if len(at):
                self.tables[length] = self._table(at, length)

    def _table(self, at: np.ndarray, length: int) -> tuple:
        hashes = self.words.windows(length)[at]
        order = np.argsort(hashes, kind="stable")
        at, hashes = at[order], hashes[order]
        group = np.zeros(len(at), np.int64)  # the first place of an equal window
        left = np.arange(len(at))
        while len(left):  # one turn, unless different windows share a hash
            head = left[np.concatenate([[True], hashes[left][1:] != hashes[left][:-1]])]
            lead = head[np.searchsorted(hashes[head], hashes[left])]
            equal = self.words.same(at[left], self.words, at[lead], length)
            group[left[equal]] = lead[equal]
            left = left[~equal]
        heads, member = np.unique(group, return_inverse=True)
        pairs = np.unique(np.stack([member, self.words.owner[at]], axis=1), axis=0)
        bits = max(16, int(16 * len(heads)).bit_length())
        seen = np.zeros(1 << bits, bool)
        shift = np.uint64(64 - bits)
        seen[hashes[heads] >> shift] = True
        return hashes[heads], at[heads], pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(heads) + 1)), seen, shift

    def hits(self, words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``length, places, groups`` of the windows that occur in ``words``."""
        for length, (hashes, places, _, _, seen, shift) in self.tables.items():
            found = words.windows(length)
            at = np.flatnonzero(seen[found >> shift])
            at = at[words.whole(at, length)]
            group = np.searchsorted(hashes, found[at])
            while len(at):  # the groups of one hash, one after the other
                may = (group < len(hashes)) & (hashes[np.minimum(group, len(hashes) - 1)] == found[at])
                at, group = at[may], group[may]
                equal = words.same(at, self.words, places[group], length)
                yield length, at[equal], group[equal]
                at, group = at[~equal], group[~equal] + 1

    def judge(self, texts: list[str]) -> tuple[np.ndarray, list[list[int]], list[list[str]]]:
        """For each text its words, the word ranges that are hit (first, end, first, end ...) and the ids of the items."""
        words = Words(texts)
        cover, owners, items = np.zeros(len(words.starts) + 1, np.int64), [], []
        for length, at, group in self.hits(words):
            np.add.at(cover, at, 1)
            np.add.at(cover, at + length, -1)
            _, _, holders, bounds, _, _ = self.tables[length]
            pairs = np.unique(np.stack([words.owner[at], group], axis=1), axis=0)
            sizes = bounds[pairs[:, 1] + 1] - bounds[pairs[:, 1]]
            within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            owners.append(np.repeat(pairs[:, 0], sizes))
            items.append(holders[np.repeat(bounds[pairs[:, 1]], sizes) + within])
        spans: list[list[int]] = [[] for _ in texts]
        ids: list[list[str]] = [[] for _ in texts]
        if owners:
            hit = (np.cumsum(cover)[:-1] > 0).astype(np.int8)
            new = np.concatenate([[True], words.owner[1:] != words.owner[:-1]])
            begins = np.flatnonzero((hit == 1) & (new | (np.concatenate([[0], hit[:-1]]) == 0)))
            ends = np.flatnonzero((hit == 1) & np.concatenate([new[1:] | (hit[1:] == 0), [True]])) + 1
            for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
                k = int(words.owner[a])
                spans[k] += [a - int(words.bounds[k]), b - int(words.bounds[k])]
            for k, item in np.unique(np.stack([np.concatenate(owners), np.concatenate(items)], axis=1), axis=0).tolist():
                ids[k].append(self.ids[item])
        return np.diff(words.bounds), spans, [sorted(set(x)) for x in ids]


def _item_blocks(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """``block, item_id, text`` of the items with words, and the number of blocks."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words.alias("text")).filter("text <> ''").distinct()
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item_id"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    return items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), blocks


def _scan(docs: DataFrame, items: list, n: int) -> DataFrame:
    """``row, n_words, spans, items`` from ``row, text``: one block of items against all documents."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(([r.item_id for r in items], [r.text for r in items]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = None
        for batch in batches:
            windows = windows or WindowSet(*shared.value, n)
            for part in slices(batch, "text"):
                counts, spans, ids = windows.judge(texts_of(part))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.string()))], names=["row", "n_words", "spans", "items"])

    row = docs.schema["row"].dataType.simpleString()
    return docs.mapInArrow(run, f"row {row}, n_words long, spans array<long>, items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, row: Column, n: int = N) -> DataFrame:
    """``row, n_words, spans, items`` for every document: what ``row`` says of it, its words, the ranges of words that are hit and the ids of the items that hit."""
    items, blocks = _item_blocks(benchmark)
    block = lambda b: items.filter(F.col("block") == b).select("item_id", "text").collect()  # noqa: E731  bounded by BLOCK_BYTES, but for one longer text
    rows = docs.select(row.alias("row"), "text")
    if blocks == 1:
        return _scan(rows, block(0), n)
    # equal ids with equal texts are hit alike, so they are one
    digest = F.struct(F.xxhash64(F.col("row")).alias("of_row"), F.sha2(F.col("text").cast("binary"), 256).alias("of_text"))
    keyed = docs.select(F.struct(row.alias("row"), F.col("text")).alias("all")).select("all.row", "all.text")
    met = None
    for b in range(blocks):
        found = _scan(keyed.select(digest.alias("row"), "text"), block(b), n).filter("size(spans) > 0").select(F.to_json("row").alias("key"), "spans", "items").distinct()
        met = found if met is None else met.union(found)
    met = met.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    counted = _scan(keyed.select(F.struct("row", F.to_json(digest).alias("key")).alias("row"), "text"), [], n).select("row.row", "row.key", "n_words")
    empty = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
    return counted.join(met, "key", "left").select("row", "n_words", empty("spans", "array<long>"), empty("items", "array<string>"))


def _pairs(spans: str) -> Column:
    """The ranges as structs, ascending; those of several blocks may overlap."""
    at = F.transform(F.sequence(F.lit(0), F.floor(F.size(spans) / 2).cast("int") - 1), lambda k: F.struct(F.get(spans, 2 * k).alias("first"), F.get(spans, 2 * k + 1).alias("end")))
    return F.when(F.size(spans) > 0, F.array_sort(at)).otherwise(F.array().cast("array<struct<first: bigint, end: bigint>>"))


def n_hit(spans: str) -> Column:
    """Words inside the ranges, each once."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["first"], a["end"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end"))
    return F.aggregate(_pairs(spans), start, step, lambda a: a["n"])


def cut_spans(text: str, spans: list[int]) -> str:
    """``text`` without its hit ranges of words, from the first letter of each to the last; the words around are kept apart as they were."""
    words, raw, at, kept = Words([text]), text.encode(), 0, []
    for first, end in sorted(zip(spans[::2], spans[1::2], strict=True)):
        a, b = int(words.starts[first]), int(words.ends[end - 1])
        kept.append(raw[at : max(at, a)])
        at = max(at, b)
    return b"".join([*kept, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, remove: str = "documents") -> DataFrame:
    """``docs`` without the documents that are hit, or (``remove="spans"``) without the spans of words that are; columns as they were."""
    if remove not in ("documents", "spans"):
        raise ValueError("documents or spans can be removed")
    judged = contamination(docs, benchmark, F.struct(*(F.col(f"`{c}`") for c in docs.columns)), n)
    if remove == "documents":
        return judged.filter("size(spans) = 0").select("row.*")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, spans = batch.column("row"), batch.column("spans").to_pylist()
            columns = row.flatten()
            k = schema.names.index("text")
            columns[k] = pa.array([t if not s else cut_spans(t, s) for t, s in zip(columns[k].to_pylist(), spans, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return judged.select("row", "spans").mapInArrow(run, schema)


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    judged = contamination(docs, benchmark, F.struct("doc_id")).withColumn("n_hit", n_hit("spans"))
    listed = F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256)
    return judged.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
WITH items AS (
    SELECT coalesce(item_id::VARCHAR, '') AS item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL
), windows AS (
    SELECT DISTINCT item_id, least(len(w), {N}) AS m, array_to_string(w[k:k + least(len(w), {N}) - 1], ' ') AS words
    FROM items, unnest(range(1, greatest(len(w) - {N}, 0) + 2)) AS t(k) WHERE len(w) > 0
), docs AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents
), hits AS (
    SELECT r, k, m, item_id FROM (SELECT r, k, m, array_to_string(w[k:k + m - 1], ' ') AS words FROM docs, (SELECT DISTINCT m FROM windows), unnest(range(1, greatest(len(w) - m, -1) + 2)) AS t(k))
    JOIN windows USING (m, words)
), covered AS (
    SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, k, m FROM hits), unnest(range(k, k + m)) AS t(p) GROUP BY r
), listed AS (
    SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)
"""
