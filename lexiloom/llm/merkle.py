"""Operator 11: Merkle manifest of a dataset, as a tree of SHA-256 midstates.

A leaf is the hash of a row's columns, each with its length. Leaves of one group (``lang``) ascend by id; every ``fanout`` consecutive nodes become their
parent's hash until one is left, the group's subroot; the subroots, by group, likewise give the root. A parent retains the hash state before each of its
child slots. A digest is 64 letters and so exactly one block of SHA-256, so these states are 32 bytes each and can be resumed anywhere: to fold a replaced
child up, its parent's state before that slot goes on with the replacement and the siblings to its right alone; what lies left of it is in the state.

The tree is built by *blocks* of at most ``BLOCK`` nodes, which hold several levels each: a block is one row of the manifest with its digests and states,
and its root is a node of the next round. So rounds grow with the logarithm of the rows to the base ``BLOCK``, and no task holds more than some blocks.
Proofs come down the same way: a block gets the path above its root and hands each of its nodes that path with its own part before it. Texts are
hashed where they are read and never shuffled.

Null texts and other null columns are marked as such and differ from empty ones. A null group is a group of its own, the first. Rows without an id come
first in their group; rows that repeat an id are ordered by their leaf, so the root does not depend on how rows are stored. Every row is a leaf, repeated
ones too. An empty table has no root and gives no row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import sha256
from .common import bounded_batches, materialise, temporary_tables

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of one block at most.
BLOCK = 256
#: Nodes that a task hashes side by side, about.
LANES = 8192


def field(value: Column) -> Column:
    """A column as its number of bytes, a colon and its text; ``-`` for null."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    """The 32 bytes of a row's hash."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their place in their tree, and ``height``: one range sort, counts of each part, offsets.

    Equal rows are told apart by their place in the table that holds them, so that any number of copies is dealt out.
    """
    rows = rows.withColumn("_file", F.xxhash64("_metadata.file_path")).withColumn("_row", F.col("_metadata.row_index"))
    by = [F.col("tree"), *(F.col(c).asc_nulls_first() for c in order), F.col("_file"), F.col("_row")]
    sorted_ = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("_file", "_row").withColumn("place", F.monotonically_increasing_id())
    placed = materialise(sorted_, "sorted").withColumn("part", F.shiftright("place", 33))
    parts = placed.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    offset = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("tree", "part", "first", offset.alias("offset"), F.sum("n").over(tree).alias("n"))
    return placed.join(parts, ["tree", "part"]).withColumn("pos", F.col("place") - F.col("first") + F.col("offset")).drop("place", "part", "first", "offset")


def _height(n: Column, fanout: int) -> Column:
    powers = [fanout**k for k in range(63) if fanout**k < 2**62]
    return F.size(F.filter(F.array(*map(F.lit, powers)), lambda x: x < n))


def _levels(digests: np.ndarray, sizes: np.ndarray, heights: np.ndarray, fanout: int) -> tuple[list[bytes], list[bytes]]:
    """Several blocks' trees side by side: for each block the digests of all its levels, and its parents' states before each child slot."""
    out_digests, out_states = [[] for _ in sizes], [[] for _ in sizes]
    active = np.arange(len(sizes))
    while True:
        ends = np.cumsum(sizes)
        for k, a, b in zip(active.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
            out_digests[k].append(digests[a:b].tobytes())
        more = heights > 0
        digests, active, sizes, heights = digests[np.repeat(more, sizes)], active[more], sizes[more], heights[more] - 1
        if not len(active):
            return [b"".join(x) for x in out_digests], [b"".join(x) for x in out_states]
        parents = -(-sizes // fanout)
        pos = np.arange(len(digests)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        above = np.repeat(np.cumsum(parents) - parents, sizes) + pos // fanout
        running, kept = sha256.start(int(parents.sum())), np.zeros((int(parents.sum()), fanout, 32), np.uint8)
        for slot in range(fanout):
            here = np.flatnonzero(pos % fanout == slot)
            into = above[here]
            kept[into, slot] = sha256.to_bytes(running[:, into])
            running[:, into] = sha256.absorb(running[:, into], sha256.hex_blocks(digests[here]))
        digests, sizes = sha256.finish(running, np.bincount(above, minlength=len(kept))), parents
        ends = np.cumsum(sizes)
        for k, a, b in zip(active.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
            out_states[k].append(kept[a:b].tobytes())


_BLOCKS = "tree string, block long, n int, height int, levels int, digests binary, states binary, ids array<long>, replacements binary"


def _span(fanout: int) -> int:
    """Levels of a block."""
    return max(k for k in range(1, 64) if k == 1 or fanout**k <= BLOCK)


def _blocks(nodes: DataFrame, fanout: int) -> DataFrame:
    """The rows of one round from ``tree, pos, height, digest, id, replacement``."""
    span = _span(fanout)
    bounded_batches(nodes.sparkSession, LANES)
    names = [c.split()[0] for c in _BLOCKS.split(", ")]

    def build(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(np.append(starts, table.num_rows))
        raw = lambda c: b"".join(table.column(c).to_pylist())
        heights = table.column("height").to_numpy()[starts].astype(np.int64)
        levels = np.minimum(heights, span)
        digests, states = _levels(np.frombuffer(raw("digest"), np.uint8).reshape(-1, 32), sizes, levels, fanout)
        replaced, ends = raw("replacement"), np.append(starts, table.num_rows).tolist()
        ids = pa.ListArray.from_arrays(pa.array(np.append(starts, table.num_rows), pa.int32()), table.column("id").combine_chunks())
        first = lambda c, t: pa.array(table.column(c).take(pa.array(starts)).to_pylist(), t)
        columns = [first("tree", pa.string()), first("block", pa.int64()), pa.array(sizes, pa.int32()), pa.array(heights, pa.int32()), pa.array(levels, pa.int32()), pa.array(digests, pa.binary()), pa.array(states, pa.binary()), ids]
        columns.append(pa.array([replaced[32 * a : 32 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            # pos starts anew or jumps at each block's first row
            starts = np.flatnonzero(np.concatenate([[True], table.column("first").to_numpy()[1:]]))
            if len(starts) > 1:
                yield build(table.slice(0, int(starts[-1])), starts[:-1])
            held = table.slice(int(starts[-1]))
        if held is not None:
            yield build(held, np.zeros(1, np.int64))

    size = fanout**span
    dealt = nodes.withColumn("block", F.expr(f"pos div {size}")).withColumn("first", F.expr(f"pos % {size} = 0"))
    dealt = dealt.select("tree", "block", "pos", "first", "height", "digest", "id", "replacement").repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    return dealt.mapInArrow(run, _BLOCKS)


def _root(blocks: DataFrame) -> Column:
    return F.expr("substring(digests, -32, 32)")


def _rounds(nodes: DataFrame, fanout: int, name: str) -> list[DataFrame]:
    """The manifest's blocks, round by round from the leaves up."""
    span, rounds = _span(fanout), []
    while True:
        blocks = materialise(_blocks(nodes, fanout), name, keep=True)
        rounds.append(blocks)
        rest = blocks.filter(F.col("height") > span)
        if rest.isEmpty():
            return rounds
        nodes = rest.select("tree", F.col("block").alias("pos"), (F.col("height") - span).alias("height"), _root(rest).alias("digest"), F.lit(None).cast("long").alias("id"), F.lit(b"").alias("replacement"))


def _tops(rounds: list[DataFrame], fanout: int) -> DataFrame:
    """``tree, digest``: what remains of each tree."""
    out = None
    for blocks in rounds:
        done = blocks.filter(F.col("height") <= _span(fanout)).select("tree", _root(blocks).alias("digest"))
        out = done if out is None else out.union(done)
    return out


def _step(fanout: int) -> np.dtype:
    """One level of a path: siblings left and right of the node, the parent's state before the node's slot, the siblings in order."""
    return np.dtype([("left", "u1"), ("right", "u1"), ("state", "u1", 32), ("siblings", "u1", (fanout - 1, 32))])


def _paths(n: int, levels: int, digests: bytes, states: bytes, above: bytes, fanout: int) -> np.ndarray:
    """The paths (n, levels + those above) of a block's nodes."""
    kind = _step(fanout)
    upper = np.frombuffer(above, kind)
    out = np.zeros((n, levels + len(upper)), kind)
    out[:, levels:] = upper
    nodes, kept = np.frombuffer(digests, np.uint8).reshape(-1, 32), np.frombuffer(states, np.uint8).reshape(-1, fanout, 32)
    at, size, first, first_parent = np.arange(n), n, 0, 0
    for level in range(levels):
        parent, slot = at // fanout, at % fanout
        count = np.minimum(size - parent * fanout, fanout)
        step = out[:, level]
        step["left"], step["right"], step["state"] = slot, count - slot - 1, kept[first_parent + parent, slot]
        for k in range(fanout - 1):
            has = np.flatnonzero(k < count - 1)
            step["siblings"][has, k] = nodes[first + parent[has] * fanout + k + (k >= slot[has])]
        first, first_parent, size, at = first + size, first_parent + -(-size // fanout), -(-size // fanout), parent
    return out


def fold(digests: np.ndarray, paths: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Digests (n, 32) folded up their paths (n, levels) of ``lengths`` levels each: states resumed with the node and its right siblings."""
    digests = digests.copy()
    for level in range(paths.shape[1]):
        active = np.flatnonzero(lengths > level)
        step = paths[active, level]
        running = sha256.absorb(sha256.from_bytes(step["state"]), sha256.hex_blocks(digests[active]))
        for k in range(step["siblings"].shape[1]):
            more = np.flatnonzero(step["right"] > k)
            if len(more):
                running[:, more] = sha256.absorb(running[:, more], sha256.hex_blocks(step["siblings"][more, step["left"][more].astype(np.int64) + k]))
        digests[active] = sha256.finish(running, 1 + step["left"].astype(np.int64) + step["right"])
    return digests


def proof_digest(path: np.ndarray) -> str:
    """The hash of all siblings of a path, level by level, left to right."""
    n = path["left"].astype(np.int64) + path["right"]
    return hashlib.sha256(sha256.hex_text(path["siblings"][np.arange(path["siblings"].shape[1]) < n[:, None]]).tobytes()).hexdigest()


def _handed_down(rounds: list[DataFrame], top: DataFrame, fanout: int) -> DataFrame:
    """The leaf blocks, each with the path above its root: ``top`` has ``tree, path, subroot, root`` for every tree."""
    span, joined = _span(fanout), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                paths = _paths(row["n"], row["levels"], row["digests"], row["states"], row["path"], fanout)
                first, n = row["block"] * fanout**span, row["n"]
                yield pa.RecordBatch.from_arrays([pa.array([row["tree"]] * n), pa.array(range(first, first + n), pa.int64()), pa.array([p.tobytes() for p in paths], pa.binary()), pa.array([row["subroot"]] * n, pa.binary()), pa.array([row["root"]] * n, pa.binary())], names=["tree", "block", "path", "subroot", "root"])

    for blocks in reversed(rounds):
        done = blocks.filter(F.col("height") <= span).join(top, "tree")
        if joined is not None:
            given = joined.mapInArrow(run, "tree string, block long, path binary, subroot binary, root binary")
            done = done.unionByName(blocks.filter(F.col("height") > span).join(given, ["tree", "block"]))
        joined = done
    return joined


@dataclass
class Manifest:
    """The blocks of the groups' trees and of the subroots' tree, round by round; ``subroots`` has ``tree, pos, digest``, ``root`` one row (none without rows)."""

    rounds: list[DataFrame]
    upper: list[DataFrame]
    subroots: DataFrame
    root: DataFrame
    fanout: int


def group_key(group: Column) -> Column:
    """A name for each group that keeps their order by bytes, null first."""
    return F.coalesce(F.concat(F.lit(":"), group.cast("string")), F.lit(""))


def build_manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", key: str = "doc_id", fanout: int = 2, replacement: Column | None = None) -> Manifest:
    """The manifest of ``docs``. ``replacement`` may give the leaf (32 bytes) that shall be folded up instead of a row's own; null keeps that."""
    if fanout < 2:
        raise ValueError("a parent has two children or more")
    spark = docs.sparkSession
    own = leaf([F.col(c) for c in columns])
    with temporary_tables(spark):
        rows = docs.select(group_key(F.col(group)).alias("tree"), F.col(key).cast("long").alias("id"), own.alias("digest"), (F.lit(None).cast("binary") if replacement is None else replacement).alias("replacement"))
        leaves = _numbered(materialise(rows, "leaves"), ["id", "digest"])
        nodes = leaves.select("tree", "pos", _height(F.col("n"), fanout).alias("height"), "digest", "id", F.coalesce("replacement", "digest").alias("replacement"))
        rounds = _rounds(nodes, fanout, "manifest")
        groups = materialise(_tops(rounds, fanout).select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest"), "groups")
        placed = materialise(_numbered(groups, ["group"]), "subroots", keep=True)
        upper = _rounds(placed.select("tree", "pos", _height(F.col("n"), fanout).alias("height"), "digest", F.col("pos").alias("id"), F.lit(b"").alias("replacement")), fanout, "manifest")
    return Manifest(rounds, upper, placed.select(F.col("group").alias("tree"), "pos", "digest"), _tops(upper, fanout).select("digest"), fanout)


def write_manifest(manifest: Manifest, path: str) -> None:
    """The manifest as Parquet tables below ``path``: blocks of each round of the groups' trees and of the subroots' tree, subroots, root and a row that says how many there are."""
    spark = manifest.root.sparkSession
    for name, rounds in (("groups", manifest.rounds), ("upper", manifest.upper)):
        for k, blocks in enumerate(rounds):
            blocks.write.parquet(f"{path}/{name}/{k}")
    manifest.subroots.write.parquet(f"{path}/subroots")
    manifest.root.write.parquet(f"{path}/root")
    spark.createDataFrame([(manifest.fanout, len(manifest.rounds), len(manifest.upper))], "fanout int, groups int, upper int").write.parquet(f"{path}/shape")


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    shape = spark.read.parquet(f"{path}/shape").first()
    rounds = lambda name, n: [spark.read.schema(_BLOCKS).parquet(f"{path}/{name}/{k}") for k in range(n)]
    subroots = spark.read.schema("tree string, pos long, digest binary").parquet(f"{path}/subroots")
    return Manifest(rounds("groups", shape.groups), rounds("upper", shape.upper), subroots, spark.read.schema("digest binary").parquet(f"{path}/root"), shape.fanout)


def folded(manifest: Manifest) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every leaf; digests in hex.

    ``folded_root`` comes from the replacement, where there is one, and the original siblings.
    """
    fanout = manifest.fanout
    start = _tops(manifest.upper, fanout).select("tree", F.lit(b"").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    bounded_batches(manifest.root.sparkSession)

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = _paths(row["n"], row["levels"], row["digests"], row["states"], row["path"], fanout)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array([p.tobytes() for p in found], pa.binary()), pa.array([row["root"]] * row["n"], pa.binary())], names=["pos", "path", "root"])

    given = _handed_down(manifest.upper, start, fanout).mapInArrow(paths, "pos long, path binary, root binary")
    top = manifest.subroots.join(given, "pos").select("tree", "path", F.col("digest").alias("subroot"), "root")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def emit(rows: list[dict]) -> pa.RecordBatch:
        sizes = np.array([r["n"] for r in rows])
        depth = np.array([r["levels"] + len(r["path"]) // _step(fanout).itemsize for r in rows])
        all_paths = np.zeros((int(sizes.sum()), int(depth.max())), _step(fanout))
        at = 0
        for row, deep in zip(rows, depth.tolist(), strict=True):
            all_paths[at : at + row["n"], :deep] = _paths(row["n"], row["levels"], row["digests"], row["states"], row["path"], fanout)
            at += row["n"]
        lengths = np.repeat(depth, sizes)
        new = fold(np.frombuffer(b"".join(r["replacements"] for r in rows), np.uint8).reshape(-1, 32), all_paths, lengths)
        own = [d for r in rows for d in (r["digests"][32 * k : 32 * k + 32].hex() for k in range(r["n"]))]
        spread = lambda c: [r[c].hex() for r in rows for _ in range(r["n"])]
        roots, ends = spread("root"), [bytes(d).hex() for d in new]
        proofs = [proof_digest(p[:n]) for p, n in zip(all_paths, lengths.tolist(), strict=True)]
        columns = [pa.array([i for r in rows for i in r["ids"]], pa.int64()), *map(pa.array, (own, spread("subroot"), roots, proofs, ends, [a == b for a, b in zip(roots, ends, strict=True)]))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, LANES // BLOCK):
                yield emit(batch.slice(k, LANES // BLOCK).to_pylist())

    return _handed_down(manifest.rounds, top, fanout).mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def tampered_leaf() -> Column:
    """The leaf with one more character stated, where 7 divides the crc32 of the decimal id; null elsewhere."""
    values = {c: F.col(c) for c in COLUMNS} | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, leaf([values[c] for c in COLUMNS]))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(build_manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), replacement=tampered_leaf()))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{chars}", "text")) + ")"
#: DuckDB has no crc32; bit by bit over the bytes of the decimal id.
_CRC = """list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::UBIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT]),
        lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END))"""

ORACLE_SQL = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, coalesce(':' || lang, '') AS tree, {_LEAF.format(chars="n_chars")} AS leaf,
        CASE WHEN xor({_CRC}, 4294967295::UBIGINT) % 7 = 0 THEN {_LEAF.format(chars="(n_chars + 1)")} END AS changed
    FROM documents
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), levels AS (
    SELECT tree, 0 AS level, pos, n, leaf AS digest FROM placed
    UNION ALL
    SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM levels WHERE n > 1 GROUP BY tree, level, pos // 2, n
), subroots AS (
    SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, level AS height FROM levels WHERE n = 1
), upper AS (
    SELECT 0 AS level, pos, n, digest FROM subroots
    UNION ALL
    SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY level, pos // 2, n
), steps AS (
    SELECT a.tree, a.level, a.pos, b.digest AS sibling, b.pos < a.pos AS is_left FROM levels a LEFT JOIN levels b ON a.tree = b.tree AND a.level = b.level AND a.pos // 2 = b.pos // 2 AND a.pos <> b.pos WHERE a.n > 1
), upper_steps AS (
    SELECT a.level, a.pos, b.digest AS sibling, b.pos < a.pos AS is_left FROM upper a LEFT JOIN upper b ON a.level = b.level AND a.pos // 2 = b.pos // 2 AND a.pos <> b.pos WHERE a.n > 1
), paths AS (
    SELECT p.tree, p.pos, s.level, s.sibling, s.is_left FROM placed p JOIN steps s ON p.tree = s.tree AND p.pos // (2 ** s.level)::BIGINT = s.pos
    UNION ALL
    SELECT p.tree, p.pos, r.height + s.level, s.sibling, s.is_left FROM placed p JOIN subroots r USING (tree) JOIN upper_steps s ON r.pos // (2 ** s.level)::BIGINT = s.pos
), folds AS (
    SELECT tree, pos, 0 AS level, coalesce(changed, leaf) AS digest FROM placed
    UNION ALL
    SELECT f.tree, f.pos, f.level + 1, sha256(CASE WHEN p.sibling IS NULL THEN f.digest WHEN p.is_left THEN p.sibling || f.digest ELSE f.digest || p.sibling END)
    FROM folds f JOIN paths p ON f.tree = p.tree AND f.pos = p.pos AND f.level = p.level
), ends AS (
    SELECT tree, pos, arg_max(digest, level) AS folded_root FROM folds GROUP BY tree, pos
), proofs AS (
    SELECT tree, pos, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof_sha256 FROM paths GROUP BY tree, pos
)
SELECT doc_id, leaf, r.digest AS subroot, (SELECT digest FROM upper WHERE n = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = (SELECT digest FROM upper WHERE n = 1) AS verified
FROM placed JOIN subroots r USING (tree) JOIN ends e ON placed.tree = e.tree AND placed.pos = e.pos LEFT JOIN proofs q ON placed.tree = q.tree AND placed.pos = q.pos
"""
