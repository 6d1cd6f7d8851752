"""Operator 12: hard negatives by lists that the anchors of a cluster share.

Anchors are clustered by angle. For a cluster with centre c and greatest angle t between a member and c, no member's score with a vector x, per unit of the
member's length, is over |x| cos(max(0, angle(x, c) - t)). Every vector gets this *bound* for every cluster once, and its place in the cluster's list: a band
of the descending bounds, ``FIRST`` vectors in the first one and four times as many in each next. The members of a cluster walk its list together, band by
band and inside a band by descending bound, until the best that is left to come can change nothing: for the positives until it is below the last one held, for the
negatives also when it is below the least score asked for. Only anchors that are still open enter the next band. A list that is walked to its end is
an exhaustive search, so results never depend on the centres; these are fitted to at most ``SAMPLE`` anchors.

The vectors of a band meet a cluster's open anchors in groups of about ``ITEMS`` vectors and ``ANCHORS`` anchors, so no cluster, label or copy is gathered
in one task. Scores are sums of integers and exact.

Rows with a null id, label, vector or component, or a component that is not finite, take no part. Shorter vectors count as filled up with zeros.
A row that repeats another is a candidate of its own; rows with an anchor's id are no candidates for it, and of several anchors with one id only the row with the least label
and vector (by bytes) is an anchor. Ties go to the smaller id. Empty tables give no row. Other columns are ignored. Components of 2^31 or more after
scaling, or scores beyond 64 bits, raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, temporary_tables

CLUSTERS, SAMPLE = 8, 2000
#: Vectors in the first band of a list.
FIRST = 16_384
#: Vectors and open anchors of a group, about; vectors of one step of a walk.
ITEMS, ANCHORS, STEP = 16_384, 1024, 1024
#: Slack by which bounds are raised against rounding.
_SLACK = 1e-6


def integer_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, label, vector`` of the rows that take part: components as floor(scale * x), 32 bits each."""
    bounded_batches(embeddings.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            values = np.floor(scale * pc.fill_null(column.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False))
            ends = np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            good = np.flatnonzero(bad[ends] == bad[starts])
            if any(np.abs(values[starts[k] : ends[k]]).max(initial=0) >= 2**31 for k in good):
                raise ValueError("a component is too large for exact scores")
            raw = [values[starts[k] : ends[k]].astype("<i4").tobytes() for k in good]
            at = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("label").take(at), pa.array(raw, pa.binary())], names=["vec_id", "label", "vector"])

    rows = embeddings.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    return rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").mapInArrow(run, "vec_id long, label long, vector binary")


def _matrix(rows: list[bytes], width: int = 0) -> np.ndarray:
    width = max([width, *(len(r) // 4 for r in rows)])
    return np.frombuffer(b"".join(r.ljust(4 * width, b"\0") for r in rows), "<i4").reshape(len(rows), width).astype(np.float64)


def _lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1))


def _cosines(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of vectors with unit centres; vectors of length zero lie in every direction."""
    width = max(vectors.shape[1], centres.shape[1])
    vectors, centres = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (vectors, centres))
    size = _lengths(vectors)
    return np.where(size[:, None] > 0, np.clip(vectors @ centres.T / np.maximum(size, 1e-300)[:, None], -1, 1), 1.0)


def fit_centres(sample: np.ndarray, clusters: int, rounds: int = 10) -> np.ndarray:
    """Unit centres of spherical k-means: the farthest rows first, then means."""
    unit = sample / np.maximum(_lengths(sample), 1e-300)[:, None]
    chosen = [0]
    while len(chosen) < min(clusters, len(unit)):
        chosen.append(int((unit @ unit[chosen].T).max(axis=1).argmin()))
    centres = unit[chosen]
    for _ in range(rounds):
        nearest = (unit @ centres.T).argmax(axis=1)
        sums = np.stack([unit[nearest == k].sum(axis=0) for k in range(len(centres))])
        size = _lengths(sums)
        centres = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-300)[:, None], centres)
    return centres


def upper_bounds(vectors: np.ndarray, centres: np.ndarray, widest: np.ndarray) -> np.ndarray:
    """For each vector and cluster the most that a member's score can be, per unit of its length."""
    apart = np.maximum(0.0, np.arccos(_cosines(vectors, centres)) - np.arccos(np.clip(widest, -1, 1)) - _SLACK)
    return _lengths(vectors)[:, None] * np.cos(apart) * (1 + 1e-9) + _SLACK


class _Lists:
    """The shared lists: ``vectors`` with their bounds and bands, and what is known of every band."""

    def __init__(self, vectors: DataFrame, anchors: DataFrame, clusters: int):
        sample = [bytes(r.vector) for r in anchors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()]
        self.centres = centres = fit_centres(_matrix(sample), clusters)
        clustered = "vec_id long, label long, vector binary, cluster int, cosine double, length double"

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    rows = _matrix(batch.column("vector").to_pylist())
                    near = _cosines(rows, centres)
                    best = near.argmax(axis=1)
                    more = [pa.array(best, pa.int32()), pa.array(near[np.arange(len(best)), best]), pa.array(_lengths(rows))]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "vector")), *more], names=[c.split()[0] for c in clustered.split(", ")])

        self.anchors = materialise(anchors.select("vec_id", "label", "vector").mapInArrow(assign, clustered), "anchors")
        widest = np.ones(len(centres))
        for r in self.anchors.groupBy("cluster").agg(F.min("cosine").alias("c")).collect():
            widest[r.cluster] = r.c

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    bounds = upper_bounds(_matrix(batch.column("vector").to_pylist()), centres, widest)
                    yield batch.append_column("bounds", pa.ListArray.from_arrays(pa.array(np.arange(0, bounds.size + 1, bounds.shape[1]), pa.int32()), pa.array(bounds.ravel())))

        bounded = vectors.select("vec_id", "label", "vector").mapInArrow(bound, "vec_id long, label long, vector binary, bounds array<double>")
        self.rows = materialise(bounded.withColumn("row", F.monotonically_increasing_id()), "bounds")
        n = self.rows.count()
        shares = []
        while FIRST * 4 ** len(shares) < n:
            shares.append(1 - FIRST * (4 ** (len(shares) + 1) - 1) / 3 / n)
        shares = [s for s in shares if s > 0]
        each = self.rows.select(F.posexplode("bounds").alias("cluster", "bound"))
        cuts = {r.cluster: sorted(set(r.cuts), reverse=True) for r in each.groupBy("cluster").agg(F.percentile_approx("bound", shares or [1.0], 100_000).alias("cuts")).collect()} if shares else {}
        self.cuts = [cuts.get(k, []) for k in range(len(centres))]
        self.bands = 1 + max(map(len, self.cuts))
        self.n = n

    def band(self, r: int, clusters: list[int]) -> DataFrame:
        """``cluster, bound`` and the vector, for the vectors in band ``r`` of the lists of ``clusters``."""
        entries = []
        for k in clusters:
            if r <= len(self.cuts[k]):
                at = F.get("bounds", F.lit(k))
                inside = F.lit(True) if r == len(self.cuts[k]) else at >= self.cuts[k][r]
                inside = inside & (at < self.cuts[k][r - 1]) if r else inside
                entries.append(F.when(inside, F.struct(F.lit(k).alias("cluster"), at.alias("bound"))))
        listed = F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull())) if entries else F.explode(F.array().cast("array<struct<cluster: int, bound: double>>"))
        return self.rows.select("vec_id", "label", "vector", "row", listed.alias("e")).select("e.cluster", "e.bound", "vec_id", "label", "vector", "row")

    def size(self, r: int) -> int:
        """Vectors in band ``r``, about."""
        return min(self.n, FIRST * 4**r)

    def ahead(self, r: int) -> Column:
        """The greatest bound of what comes in band ``r`` and later, by the row's cluster; below all scores where nothing comes."""
        return F.element_at(F.array(*(F.lit(float(c[r - 1]) if r <= len(c) else float("-inf")) for c in self.cuts)), F.col("cluster") + 1)


class _Group:
    """Anchors that walk a part of their list together: what each of them, or each of its slots, asks for and holds."""

    def __init__(self, rows: list[dict], k: int, same: bool):
        self.k, self.same = k, same
        vector_of = {r["id"]: r["vector"] for r in rows}
        ids = sorted(vector_of)
        self.vectors = _matrix([vector_of[i] for i in ids])
        self.lengths, self.biggest = _lengths(self.vectors), float(np.abs(self.vectors).max(initial=0))
        place = {i: k for k, i in enumerate(ids)}
        column = lambda c, t: np.array([r[c] for r in rows], t)
        self.anchor, self.ids, self.slots, self.labels = np.array([place[r["id"]] for r in rows]), column("id", np.int64), column("slot", np.int64), column("label", np.int64)
        self.low, self.high, self.floor = column("low", np.int64), column("high", np.int64), column("floor", np.int64)
        self.full = column("full", bool)
        self.held = np.zeros((3, 0), np.int64)  # slot row, score, id

    def walk(self, ids: np.ndarray, labels: np.ndarray, vectors: list[bytes], bounds: np.ndarray) -> bool:
        """One step down the list. False once nothing further down can change what is held."""
        most = self.lengths[self.anchor] * bounds[0] * (1 + 1e-9) + _SLACK
        open_ = np.flatnonzero((most >= self.low) & ~(self.full & (self.floor > most)))
        if not len(open_):
            return False
        items = _matrix(vectors, self.vectors.shape[1])
        own = np.pad(self.vectors, ((0, 0), (0, items.shape[1] - self.vectors.shape[1])))
        top = float(np.abs(items).max(initial=0)) * self.biggest * items.shape[1]
        if top >= 2.0**63:
            raise ValueError("a score is beyond 64 bits")
        used, at = np.unique(self.anchor[open_], return_inverse=True)
        scores = (items @ own[used].T).astype(np.int64) if top < 2.0**53 else items.astype(np.int64) @ own[used].T.astype(np.int64)
        scores = scores[:, at]
        fits = (scores >= np.maximum(self.low, self.floor)[open_]) & (scores <= self.high[open_])
        fits &= (labels[:, None] == self.labels[open_]) == self.same
        fits &= ids[:, None] != self.ids[open_]
        i, j = np.nonzero(fits)
        if len(i):
            held = np.concatenate([self.held, np.stack([open_[j], scores[i, j], ids[i]])], axis=1)
            held = held[:, np.lexsort((held[2], -held[1], held[0]))]
            first = np.searchsorted(held[0], held[0])
            self.held = held = held[:, np.arange(held.shape[1]) - first < self.k]
            counts = np.bincount(held[0], minlength=len(self.ids))
            done = np.flatnonzero(counts == self.k)
            last = held[1, np.searchsorted(held[0], done, side="right") - 1]
            self.floor[done], self.full[done] = np.maximum(self.floor[done], last), True
        return True

    def found(self) -> pa.RecordBatch:
        at, score, other = self.held
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.ids[at], self.slots[at], score, other)], names=["anchor_id", "slot", "score", "other_id"])


def _walk_groups(rows: DataFrame, k: int, same: bool) -> DataFrame:
    """``anchor_id, slot, score, other_id``: for each group of ``rows`` what its anchors hold after the walk. Anchors come first, then vectors by descending bound."""
    keys = ["cluster", "piece", "block"]
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, F.col("bound").desc_nulls_first(), "id")
    bounded_batches(rows.sparkSession, STEP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, waiting, group, going = None, [], None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in keys], axis=1)
            is_item = batch.column("bound").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1) | (is_item[1:] != is_item[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if tuple(key[a]) != here:
                    if group is not None:
                        yield group.found()
                    here, waiting, group, going = tuple(key[a]), [], None, True
                part = batch.slice(a, b - a)
                if not is_item[a]:
                    waiting += part.select(["id", "label", "vector", "slot", "low", "high", "floor", "full"]).to_pylist()
                elif waiting and going:
                    first = group is None
                    group = group or _Group(waiting, k, same)
                    ids, labels, bounds = (part.column(c).to_numpy() for c in ("id", "label", "bound"))
                    vectors = part.column("vector").to_pylist()
                    sizes = [0, min(64, len(ids)), len(ids)] if first else [0, len(ids)]  # the first few set a floor for the rest
                    for x, y in zip(sizes[:-1], sizes[1:], strict=True):
                        going = going and (x == y or group.walk(ids[x:y], labels[x:y], vectors[x:y], bounds[x:y]))
        if group is not None:
            yield group.found()

    return ordered.mapInArrow(run, "anchor_id long, slot long, score long, other_id long")


def _search(lists: _Lists, asked: DataFrame, k: int, same: bool) -> DataFrame:
    """The first ``k`` for every row of ``asked`` (``id, slot, label, vector, cluster, length, low, high``): ``anchor_id, slot, score, other_id, rank``."""
    by_slot = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "other_id")
    none = F.lit(-(2**63))
    open_ = materialise(asked.withColumns({"floor": none, "full": F.lit(False)}), "open")
    found = []
    for r in range(lists.bands):
        counts = {c.cluster: c["count"] for c in open_.groupBy("cluster").count().collect()}  # a row for each cluster
        if not counts:
            break
        pieces = max(1, -(-lists.size(r) // ITEMS))
        blocks = F.element_at(F.array(*(F.lit(max(1, -(-counts.get(c, 0) // ANCHORS))) for c in range(len(lists.centres)))), F.col("cluster") + 1)
        anchors = open_.withColumn("block", F.pmod(F.xxhash64("id"), blocks)).withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)).cast("array<bigint>")))
        anchors = anchors.select("cluster", "piece", "block", F.lit(None).cast("double").alias("bound"), "id", "label", "vector", "slot", "low", "high", "floor", "full")
        items = lists.band(r, sorted(counts)).withColumn("piece", F.pmod(F.xxhash64("row"), F.lit(pieces))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)))
        zero = F.lit(0).cast("long")
        items = items.select("cluster", "piece", "block", "bound", F.col("vec_id").alias("id"), "label", "vector", *(zero.alias(c) for c in ("slot", "low", "high", "floor")), F.lit(False).alias("full"))
        found.append(materialise(_walk_groups(anchors.union(items), k, same), "found"))
        held = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(by_slot)).filter(F.col("rank") <= k)
        held = materialise(held, "held", keep=True)
        found = [held.drop("rank")]
        if r + 1 < lists.bands:
            last = held.groupBy(F.col("anchor_id").alias("id"), "slot").agg(F.count("*").alias("n"), F.min("score").alias("least"))
            most = F.col("length") * lists.ahead(r + 1) * (1 + 1e-9) + _SLACK
            going = open_.drop("floor", "full").join(last, ["id", "slot"], "left").withColumn("full", F.coalesce(F.col("n") == k, F.lit(False))).withColumn("floor", F.when(F.col("full"), F.col("least")).otherwise(none))
            going = going.filter((most >= F.col("low")) & ~(F.col("full") & (F.col("floor") > most)))
            open_ = materialise(going.select(*open_.columns), "open")
    return held if found else asked.sparkSession.createDataFrame([], "anchor_id long, slot long, score long, other_id long, rank int")


def mine(embeddings: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, lower: int = 30, upper: int = 90, clusters: int = CLUSTERS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from ``vec_id, label, embedding``.

    ``anchor`` says which ids are anchors. Their positives are the best others of their label; negatives are the best of other labels with scores
    from ``lower`` to ``upper`` percent of the positive's.
    """
    spark = embeddings.sparkSession
    with temporary_tables(spark):
        vectors = materialise(integer_vectors(embeddings), "vectors")
        anchors = vectors.filter(anchor).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("v")).select("vec_id", "v.label", "v.vector")
        anchors = materialise(anchors, "anchors")
        if anchors.isEmpty():
            return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
        lists = _Lists(vectors, anchors, clusters)
        asked = lists.anchors.select(F.col("vec_id").alias("id"), F.lit(0).cast("long").alias("slot"), "label", "vector", "cluster", "length", F.lit(-(2**63)).alias("low"), F.lit(2**63 - 1).alias("high"))
        with temporary_tables(spark):
            best = materialise(_search(lists, asked, positives, True).select("anchor_id", F.col("rank").cast("long").alias("slot"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives", keep=True)
            window = best.filter("positive_score >= 0").select(F.col("anchor_id").alias("id"), "slot", F.expr(f"({lower} * positive_score + 99) div 100").alias("low"), F.expr(f"{upper} * positive_score div 100").alias("high"))
            found = _search(lists, asked.drop("slot", "low", "high").join(window, "id").select(*asked.columns), negatives, False)
            out = found.join(best, ["anchor_id", "slot"])
            out = out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
            out = materialise(out, "negatives", keep=True)
        return materialise(out, "negatives", keep=True)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label")))
    return mine(rows, F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_dot_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same QUALIFY k <= 5
), n AS (
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank, id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
