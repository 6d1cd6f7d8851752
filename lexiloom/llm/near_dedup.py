"""Operator 5: near-duplicate groups by a chosen-path set similarity join.

Every distinct shingle set gets a minwise signature. In each of ``TREES`` independent trees a set walks down by minwise tokens that its
path chooses, two branches a level, so sets that agree on the tokens of a whole path meet in its node. At Jaccard similarity 0.8 a pair
meets in a tree of three levels with probability 0.94, in at least one of four trees with 0.99999. Nodes with the same members count once.

Members of a node of up to ``NODE`` are compared with each other by 256-byte sketches, with four standard errors of allowance. In a larger
node all members are compared with one of them, the pivot. Those at ``NEAR`` or more are alike; those at ``RETIRE`` or more leave the node, since no partner of
theirs can be less near. The rest has to meet only those far from the pivot: these are compared with all of the rest, in blocks; where they are over ``FAR``
themselves, the rest branches once more. So a dense family costs one comparison for each member, and no pair is lost by it. Sets that are alike along any
chain form a *cluster*.

Clusters, which are families of copies, are then compared exhaustively on the full sets of the texts, words as they are and not as hashes. A cluster is
dealt to blocks of bounded rows and bytes (mostly one), each with the cluster's least member. Up to ``FAR`` members that are then outside a cluster's main component are
compared with all others of it, sketches first; only the texts of those that could be linked follow them. Groups give back a spanning star of each of
their components, never all pairs, so no link between different components is lost and dense groups stay linear.

Where more are outside, the cluster is a family of texts that share a template and are no copies. There a shingle is *rare* if at most ``RARE`` members have it. At similarity s two sets
that have no rare shingle in common share at most what the rest of the smaller one holds, which is under s unless one of the two has a share of at most ``(1 - s) / (1 + s)`` of rare shingles (a ninth
at 0.8). So pairs of sets over that share meet in the lists of rare shingles, which are short; only the others, texts of hardly more than the template, are compared with all that are outside.

Texts without words, null texts among them, have an empty set and are linked with nothing. Equal sets are one vertex. Ids are the vertices:
rows that repeat an id share its component. Rows without an id are not linked, their component is null and they are kept. Empty tables give no row;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, slices, temporary_tables, texts_of
from .components import connected_components
from .shingles import _LOWER, mix, shingle_hashes

TREES, COORDINATES, SKETCH = 4, 24, 256
#: Members of a node or cluster that are compared in one group.
NODE = 400
#: Sets far from a large node's pivot that are still compared with all the rest; more of them branch. Members outside a cluster's main component likewise; more of them meet by rare shingles.
FAR = 2000
#: Members of a cluster that have a rare shingle, at most; rows and columns of a group that compares sketches alone.
RARE, SIDE = 16, 4096
#: Bytes of texts in one group, on average at most.
GROUP_BYTES = 4 << 20
#: Standard errors of the sketch's estimate by which a pair may miss the threshold and still be confirmed on full sets.
ERRORS = 4.0
#: Estimated similarity to the pivot of a large node from which a set is alike, and from which it leaves the node. A partner (0.8) of a set at RETIRE has
#: at least RETIRE - 0.2 with the pivot; the rest of the difference is ERRORS standard errors of two estimates.
NEAR, RETIRE = 0.37, 0.75
_RANDOM = np.random.default_rng(20240229)
_FLIPS = _RANDOM.integers(0, 2**32, SKETCH, dtype=np.uint32)
_FACTORS = _RANDOM.integers(0, 2**31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FOLD = bytes(_LOWER)
_SEEDS = _RANDOM.integers(1, 2**63, TREES).astype(np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """``SKETCH`` minwise values of a non-empty set."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    step = max(1, (1 << 18) // len(short))
    out = np.empty(SKETCH, np.uint32)
    for k in range(0, SKETCH, step):
        out[k : k + step] = ((short[None, :] ^ _FLIPS[k : k + step, None]) * _FACTORS[k : k + step, None]).min(axis=1)
    return out


def _branch(nodes: np.ndarray, keys: np.ndarray, tree: int, first: int, among: int) -> np.ndarray:
    """The two children of each node (columns) for the sets (rows): the node picks two of ``among`` coordinates of its tree."""
    rows = np.arange(len(nodes))[:, None]
    picked = (nodes >> np.uint64(7)) % np.uint64(among)
    other = (picked + np.uint64(1) + (nodes >> np.uint64(29)) % np.uint64(among - 1)) % np.uint64(among)
    children = []
    for pick in (picked, other):
        at = pick.astype(np.int64) + first + tree * COORDINATES
        children.append(mix(nodes ^ mix((keys[rows, at].astype(np.uint64) << np.uint64(32)) + at.astype(np.uint64))))
    return np.concatenate(children, axis=1)


def leaves(keys: np.ndarray) -> np.ndarray:
    """The nodes on the third level of all trees: eight for each tree."""
    out = []
    for tree in range(TREES):
        nodes = np.full((len(keys), 1), _SEEDS[tree])
        for first, among in ((0, 2), (2, 6), (8, 8)):
            nodes = _branch(nodes, keys, tree, first, among)
        out.append(nodes)
    return np.concatenate(out, axis=1)


def document_sets(docs: DataFrame, words: int, lower: bool) -> DataFrame:
    """``doc_id, n_shingles, set_hash, keys, sketch``; the last three are null for empty sets."""
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "n_shingles", "set_hash", "keys", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [np.unique(h) for h in shingle_hashes(texts_of(part), words, lower)]
                signs = [signature(s) if len(s) else None for s in sets]
                hashes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                keys = [None if s is None else s[: TREES * COORDINATES].tobytes() for s in signs]
                sketches = [None if s is None else s.astype(np.uint8).tobytes() for s in signs]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, sets), pa.int64()), *(pa.array(c, pa.binary()) for c in (hashes, keys, sketches))], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, keys binary, sketch binary")


def _matrix(column: pa.Array, dtype: type) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1)


def _paths(sets: DataFrame) -> DataFrame:
    """``node, id, tree`` for every set and leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nodes = leaves(_matrix(batch.column("keys"), np.uint32))
                ids = np.repeat(batch.column("id").to_numpy(), nodes.shape[1])
                trees = np.tile(np.repeat(np.arange(TREES, dtype=np.int32), nodes.shape[1] // TREES), len(nodes))
                yield pa.RecordBatch.from_arrays([pa.array(nodes.ravel().view(np.int64)), pa.array(ids), pa.array(trees)], names=["node", "id", "tree"])

    return sets.select("id", "keys").mapInArrow(run, "node long, id long, tree int")


def _beside_pivot(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``pivot, id, likeness``: the others of large nodes beside the node's pivot. Many nodes of a family have one pivot, so pairs are far fewer than members."""
    pairs = members.filter("id <> pivot").select("pivot", "id").distinct()
    # the sketches that are asked for, so that all sets are read but not shuffled where these are few
    sketches = materialise(sets.select("id", "sketch").join(members.select("id").distinct(), "id", "left_semi"), "sketches")
    rows = pairs.join(sketches.select(F.col("id").alias("pivot"), F.col("sketch").alias("other")), "pivot").join(sketches, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                agree = np.count_nonzero(_matrix(batch.column("sketch"), np.uint8) == _matrix(batch.column("other"), np.uint8), axis=1) / SKETCH
                yield batch.select(["pivot", "id"]).append_column("likeness", pa.array((agree - 1 / 256) / (1 - 1 / 256)))

    return rows.select("pivot", "id", "sketch", "other").mapInArrow(run, "pivot long, id long, likeness double")


def _staying(members: DataFrame, compared: DataFrame) -> DataFrame:
    """``node, id, tree, far, n, n_far`` of large nodes that hold a set far from the pivot: the sets that have to meet there without it."""
    rows = members.join(compared.filter(F.col("likeness") < RETIRE), ["pivot", "id"]).select("node", "id", "tree", (F.col("likeness") < NEAR).alias("far"))
    sized = rows.groupBy("node").agg(F.count("*").alias("n"), F.count_if("far").alias("n_far")).filter("n_far > 0")
    return rows.join(sized, "node")


def _blocks(staying: DataFrame) -> DataFrame:
    """Groups ``node, id`` in which the far sets of a node meet its others, a block of these at a time."""
    blocks = F.ceil(F.col("n") / NODE).cast("int")
    block = F.explode(F.when(F.col("far"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), blocks).cast("int"))))
    return staying.withColumn("block", block).select(F.xxhash64("node", "block").alias("node"), "id")


def _deeper(staying: DataFrame, sets: DataFrame) -> DataFrame:
    """The children of what stays: both of the sets far from the pivot, the first one of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees, far = batch.column("tree").to_numpy(), batch.column("far").to_numpy(zero_copy_only=False)
            for tree in np.unique(trees).tolist():
                part = batch.filter(pa.array(trees == tree))
                nodes = _branch(part.column("node").to_numpy().view(np.uint64)[:, None], _matrix(part.column("keys"), np.uint32), tree, 16, 8)
                both = np.stack([np.ones(len(nodes), bool), far[trees == tree]], axis=1)
                ids = np.repeat(part.column("id").to_numpy(), both.sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[both].view(np.int64)), pa.array(ids), pa.array(np.full(len(ids), tree, np.int32))], names=["node", "id", "tree"])

    return staying.join(sets.select("id", "keys"), "id").select("node", "id", "tree", "keys", "far").mapInArrow(run, "node long, id long, tree int").distinct()


def _nodes(paths: DataFrame, level: int) -> DataFrame:
    """Nodes of two members or more, one for each distinct membership: ``node, n, pivot``.

    The pivot has the least hash, which every level draws anew, so that most likely it is of the node's largest family.
    """
    drawn = F.xxhash64("id", F.lit(level))
    sized = paths.groupBy("node").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(-1))).alias("y"), F.min(F.struct(drawn.alias("h"), "id")).alias("p"))
    return sized.filter("n > 1").groupBy("n", "x", "y", "p").agg(F.min("node").alias("node")).select("node", "n", F.col("p.id").alias("pivot"))


def _estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of every row of a with every row of b; a byte agrees by chance once in 256 times."""
    agree = np.stack([np.count_nonzero(b == row, axis=1) for row in a]) / SKETCH
    return (agree - 1 / 256) / (1 - 1 / 256)


def _least_reachable(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the least row of its component."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(linked)).min(axis=1)
        new = np.minimum(label, near)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _by_group(rows: DataFrame, group: str, columns: list[str], links_of) -> DataFrame:
    """Apply ``links_of(list of rows) -> (a, b)`` to each group; groups are of bounded size and come one after the other."""
    ordered = rows.select(group, *columns).repartition(group).sortWithinPartitions(group, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        for batch in batches:
            found = []
            for key, *row in zip(*(batch.column(c).to_pylist() for c in (group, *columns)), strict=True):
                if key != here:
                    if len(held) > 1:
                        found.append(links_of(held))
                    here, held = key, []
                held.append(row)
            if found:
                yield _as_pairs(found)
        if len(held) > 1:
            yield _as_pairs([links_of(held)])

    return ordered.mapInArrow(run, "a long, b long")


def _as_pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]).astype(np.int64)) for k in (0, 1)], names=["a", "b"])


def _stars(ids: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    label = _least_reachable(linked)
    others = np.flatnonzero(label != np.arange(len(label)))
    return ids[label[others]], ids[others]


def _least_estimate(share: float) -> float:
    return share - ERRORS * (share * (1 - share) / SKETCH) ** 0.5


def _alike(share: float):
    cut = _least_estimate(share)

    def links_of(rows: list) -> tuple[np.ndarray, np.ndarray]:
        sketches = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), -1)
        return _stars(np.array([r[0] for r in rows], np.int64), _estimates(sketches, sketches) >= cut)

    return links_of


def exact_sets(texts: list[str], words: int, lower: bool) -> list[np.ndarray]:
    """The shingle sets of a few texts as numbers that stand for their words themselves."""
    number: dict[bytes, int] = {}
    ids, bounds = [], [0]
    for text in texts:
        raw = text.encode()
        found = (raw.translate(_FOLD) if lower else raw).split()
        for w in set(found).difference(number):
            number[w] = len(number) + 1
        ids += map(number.__getitem__, found)
        ids += [0] * (max(0, words - len(found)) if found else 0)  # fewer words than a shingle: one shingle that ends in no words
        bounds.append(len(ids))
    word = np.array(ids, np.int64)
    shingle, base = word, len(number) + 1
    for k in range(1, words):
        shingle = shingle[: len(word) - k] * base + word[k:]
        if k < words - 1:
            shingle = np.unique(shingle, return_inverse=True)[1]
    return [np.unique(shingle[a : max(a, b - words + 1)]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def linked_sets(sets: list[np.ndarray], threshold: int) -> np.ndarray:
    """Which pairs of sets reach the threshold, by exact intersection sizes."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    _, tokens, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = times[tokens] > 1
    tokens, owner = np.unique(tokens[shared], return_inverse=True)[1], owner[shared]
    common = np.zeros((n, n), np.float32)
    step = max(1, 8_000_000 // n)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    top = int(tokens[-1]) + 1 if len(tokens) else 0
    for low in range(0, top, step):
        a, b = np.searchsorted(tokens, (low, low + step))
        has = np.zeros((n, min(step, top - low)), np.float32)
        has[owner[a:b], tokens[a:b] - low] = 1
        common += np.rint(has @ has.T)
    common = np.rint(common).astype(np.int64)
    return (100 * common >= threshold * (sizes[:, None] + sizes[None, :] - common)) & (sizes > 0)[:, None] & (sizes > 0)[None, :]


def _exact(words: int, lower: bool, threshold: int):
    def links_of(rows: list) -> tuple[np.ndarray, np.ndarray]:
        """Rows are ``id, label, text``; members of one component need no link."""
        ids, labels = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        linked = linked_sets(exact_sets([r[2] for r in rows], words, lower), threshold)
        return _stars(ids, linked & ((labels[:, None] != labels[None, :]) | (ids[:, None] == ids[None, :])) | np.eye(len(ids), dtype=bool))

    return links_of


def _candidates(share: float):
    cut = _least_estimate(share)

    def run(rows: list) -> tuple[np.ndarray, np.ndarray]:
        """Rows are ``id, label, sketch, group, is_row, size``; those that may be linked with another label's of the other side, in groups of texts of bounded rows and bytes."""
        ids, labels, sizes = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 5))
        is_row = np.array([r[4] for r in rows], bool)
        sketches = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1)

        def parts(at: np.ndarray) -> list[np.ndarray]:
            block = np.arange(len(at)) // NODE + np.cumsum(sizes[at]) // GROUP_BYTES
            return np.split(at, np.flatnonzero(np.diff(block)) + 1) if len(at) else []

        out_ids, out_groups = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, a in enumerate(parts(np.flatnonzero(is_row))):
            for j, b in enumerate(parts(np.flatnonzero(~is_row))):
                open_pair = (_estimates(sketches[a], sketches[b]) >= cut) & (labels[a][:, None] != labels[b][None, :])
                met = np.unique(np.concatenate([ids[a][open_pair.any(axis=1)], ids[b][open_pair.any(axis=0)]]))
                out_ids.append(met)
                out_groups.append(np.full(len(met), mix(np.array([rows[0][3], i * SIDE + j], np.int64).view(np.uint64)).sum().astype(np.uint64).view(np.int64)))
        return np.concatenate(out_ids), np.concatenate(out_groups)

    return run


def _pairs(share: float):
    cut = _least_estimate(share)

    def run(rows: list) -> tuple[np.ndarray, np.ndarray]:
        """Rows are ``id, label, sketch``; the pairs of different labels that may be linked, the smaller id first."""
        ids, labels = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
        sketches = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1)
        i, j = np.nonzero((_estimates(sketches, sketches) >= cut) & (labels[:, None] != labels[None, :]) & (ids[:, None] < ids[None, :]))
        return ids[i], ids[j]

    return run


def near_duplicates(docs: DataFrame, words: int = 5, threshold: int = 80, lower: bool = True) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row."""
    with temporary_tables(docs.sparkSession):
        rows = materialise(document_sets(docs, words, lower), "sets")
        full = rows.filter("set_hash IS NOT NULL AND doc_id IS NOT NULL")
        sets = materialise(full.groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "vertices")

        clusters = _clusters(sets, threshold / 100)
        labels = _components(clusters, sets, docs, words, lower, threshold)

        known = sets.select("set_hash", "id").join(labels, "id", "left").select("set_hash", F.coalesce("label", "id").alias("component"))
        out = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_hash")).alias("set_hash")).join(known, "set_hash", "left")
        out = materialise(out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")), "components", keep=True)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _clusters(sets: DataFrame, share: float) -> DataFrame:
    """``id, cluster`` of all sets that have a candidate."""
    with temporary_tables(sets.sparkSession):
        paths, groups, stars = _paths(sets), [], []
        for level in count():
            nodes = materialise(_nodes(paths, level), "nodes")
            members = materialise(paths.join(nodes, "node"), "members")
            groups.append(members.filter(F.col("n") <= NODE).select("node", "id"))
            # tables of their own, so that their joins with all sets are planned by their true size
            large = materialise(members.filter(F.col("n") > NODE), "large")
            if large.isEmpty():
                break
            compared = materialise(_beside_pivot(large, sets), "pivots")
            stars.append(compared.filter(F.col("likeness") >= NEAR).select(F.col("pivot").alias("a"), F.col("id").alias("b")))
            staying = materialise(_staying(large, compared), "staying")
            groups.append(_blocks(staying.filter(F.col("n_far") <= FAR)))
            mixed = staying.filter(F.col("n_far") > FAR)
            if mixed.isEmpty():
                break
            paths = materialise(_deeper(mixed, sets), "paths")
        met = reduce(DataFrame.union, groups).join(sets.select("id", "sketch"), "id")
        alike = reduce(DataFrame.union, [_by_group(met, "node", ["id", "sketch"], _alike(share)), *stars])
        return materialise(connected_components(alike).select("id", F.col("label").alias("cluster")), "clusters", keep=True)


def _components(clusters: DataFrame, sets: DataFrame, docs: DataFrame, words: int, lower: bool, threshold: int) -> DataFrame:
    """``id, label`` by exact comparison within clusters."""
    exact = _exact(words, lower, threshold)
    with temporary_tables(docs.sparkSession):
        # the one shuffle of all texts; the hint keeps its way the same at every size
        texts = docs.select(F.col("doc_id").alias("id"), "text").join(clusters.hint("merge"), "id")
        texts = materialise(texts.select("id", "cluster", F.coalesce("text", F.lit("")).alias("text")), "texts")
        blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(F.col(n) / NODE), F.ceil(F.col(size) / GROUP_BYTES)).cast("int")
        deal = lambda to, *seed: F.pmod(F.xxhash64("id", *map(F.lit, seed)), to).cast("int")

        # an id may stand in several rows, of which those with other sets than the vertex's count for the exact comparison too
        sizes = materialise(texts.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).withColumn("blocks", blocks("n", "size")), "sizes")
        sized = texts.join(sizes.select("cluster", "blocks"), "cluster")
        everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
        dealt = sized.withColumn("block", F.explode(F.when(F.col("id") == F.col("cluster"), everywhere).otherwise(F.array(deal(F.col("blocks"))))))
        dealt = dealt.select(F.xxhash64("cluster", "block").alias("group"), "id", F.col("id").alias("label"), "text")
        # a cluster's least id is in all its blocks and any other id in one, so the stars of the groups are labels already
        labels = materialise(_by_group(dealt, "group", ["id", "label", "text"], exact).groupBy(F.col("b").alias("id")).agg(F.min("a").alias("label")), "labels", keep=True)

        # of clusters in several blocks, only light rows until it is known which texts have to meet
        split = sizes.filter("blocks > 1")
        if split.isEmpty():
            return labels
        light = texts.groupBy("cluster", "id").agg(F.sum(F.octet_length("text")).alias("size")).join(split.select("cluster"), "cluster").join(labels, "id", "left")
        light = materialise(light.select("id", "cluster", "size", F.coalesce("label", "id").alias("label")), "split")
        counts = light.groupBy("cluster", "label").agg(F.count("*").alias("n"))
        main = counts.groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("outside"))
        main = materialise(main.filter("outside > 0"), "main")
        if main.isEmpty():
            return labels
        sketched = light.join(main, "cluster").join(sets.select("id", "sketch"), "id")
        sketched = materialise(sketched.withColumn("out", F.col("label") != F.col("main")).select("cluster", "id", "label", "size", "sketch", "out", (F.col("outside") > FAR).alias("family")), "sketched")
        few = sketched.filter("NOT family")
        chosen = _across(few.filter("out"), few, threshold / 100)
        families = sketched.filter("family")
        if not families.isEmpty():
            pairs, plain = _by_rare_shingles(families, texts, words, lower, threshold)
            # those of hardly more than the template against all, and all that are outside against those
            chosen = chosen.union(_across(plain.filter("out"), families, threshold / 100)).union(_across(families.filter("out"), plain, threshold / 100)).union(pairs)
        chosen = materialise(chosen.distinct(), "chosen")
        pairs = chosen.join(light.select("id", "label"), "id").join(texts.select("id", "text"), "id")
        more = _by_group(pairs, "group", ["id", "label", "text"], exact)
        label_of = light.select("id", "label").distinct()
        more = more.join(label_of.select(F.col("id").alias("a"), F.col("label").alias("x")), "a").join(label_of.select(F.col("id").alias("b"), F.col("label").alias("y")), "b")
        merged = connected_components(more.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("id").alias("old"), F.col("label").alias("new"))
        # what was its own label has no row yet
        own = merged.filter("old <> new").select(F.col("old").alias("id"), F.col("new").alias("label"))
        known = labels.join(merged, F.col("label") == F.col("old"), "left").select("id", F.coalesce("new", "label").alias("label"))
        return materialise(known.join(own, "id", "left_anti").union(own), "labels", keep=True)


def _across(rows: DataFrame, columns: DataFrame, share: float) -> DataFrame:
    """``id, group`` of those in ``rows`` and ``columns`` (``cluster, id, label, sketch``) that may be linked with another label's of the other side, by sketches in groups of bounded sides."""
    deal = lambda to, seed: F.pmod(F.xxhash64("id", F.lit(seed)), to).cast("int")
    sides = lambda df, name: df.groupBy("cluster").agg(F.ceil(F.count("*") / SIDE).cast("int").alias(name))
    sized = sides(rows, "i_of").join(sides(columns, "j_of"), "cluster")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = rows.join(sized, "cluster").withColumn("i", deal(F.col("i_of"), 0)).withColumn("j", every("j_of")).withColumn("is_row", F.lit(True))
    b = columns.join(sized, "cluster").withColumn("j", deal(F.col("j_of"), 1)).withColumn("i", every("i_of")).withColumn("is_row", F.lit(False))
    kept = ["cluster", "i", "j", "id", "label", "size", "sketch", "is_row"]
    met = a.select(*kept).union(b.select(*kept)).withColumn("group", F.xxhash64("cluster", "i", "j")).withColumn("again", F.col("group"))
    found = _by_group(met, "group", ["id", "label", "sketch", "again", "is_row", "size"], _candidates(share))
    return found.select(F.col("a").alias("id"), F.col("b").alias("group"))


def _by_rare_shingles(families: DataFrame, texts: DataFrame, words: int, lower: bool, threshold: int) -> tuple[DataFrame, DataFrame]:
    """``id, group``: pairs of members with different labels that share a rare shingle and may be linked; and the members with a text of hardly more than the template."""
    share = threshold / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [np.unique(h) for h in shingle_hashes(texts_of(part), words, lower)]
                sizes = np.array([len(h) for h in found])
                of = lambda c: pa.array(np.repeat(part.column(c).to_numpy(), sizes))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([of("cluster"), of("id"), of("row"), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))], names=["cluster", "id", "row", "n", "shingle"])

    members = families.select("cluster", "id").distinct()
    own = texts.join(members, ["cluster", "id"]).select("cluster", "id", F.xxhash64("text").alias("row"), "text").distinct()
    spread = materialise(own.mapInArrow(run, "cluster long, id long, row long, n long, shingle long"), "spread")
    # lists of one membership are one; a list's members are few, and only lists of rare shingles are joined again
    lists = spread.groupBy("cluster", "shingle").agg(F.count("*").alias("df"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(-1))).alias("y")).filter(F.col("df") <= RARE)
    rare = materialise(spread.join(lists, ["cluster", "shingle"]).select("cluster", "id", "row", "n", "shingle", "df", "x", "y"), "rare")
    over = rare.groupBy("cluster", "id", "row", "n").agg(F.count("*").alias("k")).filter(F.col("k") * (1 + share) > F.col("n") * (1 - share))
    plain = spread.select("cluster", "id", "row").distinct().join(over, ["cluster", "id", "row"], "left_anti").select("cluster", "id").distinct()
    node = F.xxhash64("cluster", "df", "x", "y")
    met = rare.filter("df > 1").select(node.alias("node"), "id").distinct().join(families.select("id", "label", "sketch"), "id")
    pairs = _by_group(met, "node", ["id", "label", "sketch"], _pairs(share)).distinct()
    grouped = pairs.select(F.xxhash64("a", "b").alias("group"), F.explode(F.array("a", "b")).alias("id")).select("id", "group")
    return materialise(grouped.distinct(), "pairs"), materialise(families.join(plain, ["cluster", "id"], "left_semi"), "plain")


def drop_near_duplicates(docs: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """``docs`` without those whose component has a smaller id."""
    gone = near_duplicates(docs, words, threshold).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2)
