"""Operator 7: removal of repeated passages by a common-prefix interval tree over an enhanced suffix array.

A byte goes if some string of ``LENGTH`` bytes covers it that also starts earlier (smaller id, or same document and earlier start).

1. Every string of ``LENGTH`` bytes has an anchor: the leftmost least hash among its ``GRAM``-byte substrings. Equal strings have equal anchors
   at equal offsets, so strings meet by their anchor's hash. The strings of one anchor occurrence are consecutive: they are its *context*.
2. Contexts with equal bytes, known by a 128-bit BLAKE2 digest, need no comparison: all but the first go. Each task settles its own before
   the shuffle, so copies and common passages leave one row a task.
3. Contexts that share an anchor hash but differ come together with their bytes. Their string starts form a (sparse) suffix array with
   common-prefix lengths; a stack scan gives its intervals; those whose occurrences differ to the left are the maximal repeat groups, with
   all occurrences. All but the first occurrence of each are removed.
   Anchor hashes with over ``HOT`` contexts need no array: each of their contexts is cut into its strings of ``LENGTH`` bytes, which are known by a
   128-bit hash. Each task settles its own strings, and after the shuffle a stream of sorted hashes tells the first from the others: no list of a group.
4. The removed ranges of a document are united and cut out.

Matches never cross documents. Null texts are empty; texts under ``LENGTH`` bytes stay whole. Rows that repeat an id and text are the same document and get
the same result; other texts under one id, or without id, are documents of their own, told apart by a hash and in its order. A null id counts as the smallest. Empty tables give no row; other columns are ignored. Very long texts are read in blocks.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, slices, temporary_tables, texts_of
from .shingles import mix

LENGTH, GRAM = 100, 32
_WIDTH = LENGTH - GRAM + 1  # anchors to choose from in a string
HOT = 5000
#: Start positions per block of a long text; contexts or strings settled together in a task; bytes of contexts in one suffix array.
BLOCK, SETTLED, ARRAY_BYTES = 1 << 20, 200_000, 1 << 18
NO_ID = -(2**63)
#: A document: its id, and a hash of its text.
_DOC = np.dtype([("doc", np.int64), ("mark", np.int64)])
#: The digest of a context.
_CONTENT = np.dtype([("content", np.int64), ("rest", np.int64)])
_INDEX = np.uint64(22)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _BASE_INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Contexts:
    """The contexts of a few texts, as arrays."""

    def __init__(self, blobs: list[bytes], firsts: list[int]):
        """``firsts``: where each blob begins in its document."""
        data = np.frombuffer(b"".join(blobs), np.uint8)
        n = len(data)
        sizes = np.array([len(b) for b in blobs], np.int64)
        ends = np.cumsum(sizes)
        up, down = _powers(1 << max(20, n.bit_length()))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n])])
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
        least = (grams >> _INDEX << _INDEX) | np.arange(len(grams), dtype=np.uint64)
        span = 1
        while 2 * span <= _WIDTH:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < _WIDTH:
            least = np.minimum(least[: -(_WIDTH - span)], least[_WIDTH - span :])
        anchor = (least & np.uint64((1 << int(_INDEX)) - 1)).astype(np.int64)  # of the string from each position
        counts = np.maximum(sizes - LENGTH + 1, 0)
        blob = np.repeat(np.arange(len(blobs)), counts)
        starts = np.arange(len(blob)) + np.repeat(ends - sizes - (np.cumsum(counts) - counts), counts)
        anchor = anchor[starts]
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (blob[1:] != blob[:-1])])
        at = np.flatnonzero(new)
        lo = starts[at]
        self.n = np.diff(np.append(at, len(starts)))
        stop = lo + self.n + LENGTH - 1
        self.blob = blob[at]
        self.offset = anchor[at] - lo
        self.lo = lo - (ends - sizes)[self.blob] + np.array(firsts, np.int64)[self.blob]
        self.key = grams[anchor[at]]
        self.content = _digests(data, lo, stop)


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    view = memoryview(data)
    return np.frombuffer(b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), _CONTENT)


def blocks_of(texts: list[str]) -> tuple[list[bytes], list[int], list[int]]:
    """Blobs of at most ``BLOCK`` string starts, where each begins, and the text it is of. Texts that hold no string are left out."""
    blobs, firsts, owners = [], [], []
    for k, text in enumerate(texts):
        raw = text.encode()
        for a in range(0, max(0, len(raw) - LENGTH + 1), BLOCK):
            blobs.append(raw[a : a + BLOCK + LENGTH - 1])
            firsts.append(a)
            owners.append(k)
    return blobs, firsts, owners


def _docs_of(batch: pa.RecordBatch, kind: np.dtype = _DOC) -> np.ndarray:
    out = np.empty(batch.num_rows, kind)
    for name in kind.names:
        out[name] = batch.column(name).to_numpy()
    return out


def _doc_arrays(doc: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(doc[name])) for name in doc.dtype.names]


def _order(*columns: np.ndarray) -> np.ndarray:
    """The order by the columns, the first one foremost."""
    plain = [part for c in columns for part in ([c[name] for name in c.dtype.names] if c.dtype.names else [c])]
    return np.lexsort(plain[::-1])


def _carried(column: np.ndarray, group: np.ndarray, last) -> np.ndarray:
    """The value of each row's group; ``last`` where the group began in an earlier batch."""
    out = column[group]
    if last is not None:
        out[group < 0] = last
    return out


def _spread(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mix(doc["mark"].astype(np.uint64) + start.astype(np.uint64))


def _settle(rows: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Sort contexts (key, content, doc, lo, ...) and tell which are the first with their content."""
    order = _order(*rows[:4])
    rows = [r[order] for r in rows]
    first = np.ones(len(order), bool)
    first[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
    # a repeated row of a document is that document again
    same = np.zeros(len(order), bool)
    group = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    same[~first] = ((rows[2] == rows[2][group]) & (rows[3] == rows[3][group]))[~first]
    return [r[~same] for r in rows], first[~same]


_FOUND = "settled boolean, key long, content long, rest long, doc long, mark long, lo long, n int, offset int"


def _found(settled: bool, rows: list[np.ndarray]) -> pa.RecordBatch:
    whole = lambda r: pa.array(r.view(np.int64) if r.dtype == np.uint64 else r)
    arrays = [pa.array(np.full(len(rows[0]), settled)), whole(rows[0]), *_doc_arrays(rows[1]), *_doc_arrays(rows[2]), whole(rows[3]), pa.array(rows[4].astype(np.int32)), pa.array(rows[5].astype(np.int32))]
    return pa.RecordBatch.from_arrays(arrays, names=["settled", "key", "content", "rest", "doc", "mark", "lo", "n", "offset"])


def _ranges_found(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Removed ranges in the form of settled contexts; their keys only spread them."""
    key = _spread(doc, start)
    return _found(True, [key, np.zeros(len(doc), _CONTENT), doc, start, end - start - LENGTH + 1, np.zeros(len(doc), np.int32)])


def contexts(docs: DataFrame) -> DataFrame:
    """The contexts of all texts, and as ``settled`` the united ranges of those that repeat an earlier one of the same task."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                rows, first = _settle([np.concatenate([h[k] for h in held]) for k in range(6)])
                yield _found(False, [r[first] for r in rows])
                yield _ranges_found(*unite(rows[2][~first], rows[3][~first], (rows[3] + rows[4] + LENGTH - 1)[~first]))
                held.clear()

        for batch in batches:
            for part in slices(batch, "text"):
                blobs, firsts, owners = blocks_of(texts_of(part))
                if blobs:
                    ids = _docs_of(part)[np.array(owners)]
                    for a, b in _runs([len(x) for x in blobs]):
                        c = Contexts(blobs[a:b], firsts[a:b])
                        held.append([c.key, c.content, ids[a:b][c.blob], c.lo, c.n, c.offset])
                if sum(len(h[0]) for h in held) > SETTLED:
                    yield from flush()
        yield from flush()

    return _keyed(docs).mapInArrow(run, _FOUND)


def _runs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Cut a list of sizes into runs that fit the index bits of ``Contexts``."""
    a, total = 0, 0
    for k, n in enumerate(sizes):
        if k > a and total + n > 2 * BLOCK:
            yield a, k
            a, total = k, 0
        total += n
    if sizes:
        yield a, len(sizes)


def open_contexts(found: DataFrame) -> DataFrame:
    """Settled ranges, and of other contexts the first ones of keys with different contents."""
    ordered = found.repartition("key").sortWithinPartitions("key", "content", "rest", "doc", "mark", "lo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, content, doc, lo of the last first context
        waiting = None  # the only first context of the last key so far, as rows of length one
        for batch in batches:
            done = batch.column("settled").to_numpy(zero_copy_only=False)
            if done.any():
                yield batch.filter(pa.array(done))
                batch = batch.filter(pa.array(~done))
            if not batch.num_rows:
                continue
            key, lo, n, offset = (batch.column(c).to_numpy() for c in ("key", "lo", "n", "offset"))
            rows = [key, _docs_of(batch, _CONTENT), _docs_of(batch), lo, n, offset]
            key, content = rows[0], rows[1]
            before_key, before_content = np.roll(key, 1), np.roll(content, 1)
            new_key, new = key != before_key, (key != before_key) | (content != before_content)
            new_key[0] = last is None or key[0] != last[0]
            new[0] = new_key[0] or content[0] != last[1]
            firsts = np.flatnonzero(new)
            group = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            doc0, lo0 = (_carried(rows[k], group, last and last[k]) for k in (2, 3))
            settled = ~new & ((rows[2] != doc0) | (rows[3] != lo0))
            if settled.any():
                yield _ranges_found(*unite(rows[2][settled], rows[3][settled], (rows[3] + rows[4] + LENGTH - 1)[settled]))
            if len(firsts):
                f = [r[firsts] for r in rows]
                alone = waiting is not None and not new_key[firsts[0]]
                if alone:
                    f = [np.concatenate([w, r]) for w, r in zip(waiting, f, strict=True)]
                number = np.cumsum(np.concatenate([[True], f[0][1:] != f[0][:-1]])) - 1
                size = np.bincount(number)
                many = size[number] > 1
                continues = last is not None and not alone and not new_key[firsts[0]]  # of a key that has shown more than one
                if continues:
                    many |= number == 0
                open_last = size[-1] == 1 and not (continues and number[-1] == 0)
                if many.any():
                    yield _found(False, [r[many] for r in f])
                waiting = [r[-1:].copy() for r in f] if open_last else None
                last = (key[firsts[-1]], content[firsts[-1]], rows[2][firsts[-1]], rows[3][firsts[-1]])

    return ordered.mapInArrow(run, _FOUND)


def maximal_repeats(lcp: np.ndarray, left: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Stack scan of a suffix array: ``length, first, last`` (places in it) of the intervals of common prefix ``least`` or more that differ to the left.

    ``lcp[i]`` is the common prefix of places i - 1 and i; ``left`` the byte before each suffix, negative where there is none.
    """
    n = len(left)
    bounds = np.flatnonzero(np.concatenate([[True], lcp[1:] < least, [True]]))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a < 2:
            continue
        stack: list[tuple[int, int]] = []  # common prefix, first place
        for i in range(a + 1, b + 1):
            here = int(lcp[i]) if i < b and i < n else 0
            start = i - 1
            while stack and stack[-1][0] > here:
                length, start = stack.pop()
                part = left[start:i]
                if (part < 0).any() or (part != part[0]).any():
                    yield length, start, i
            if here >= least and (not stack or stack[-1][0] < here):
                stack.append((here, start))


def repeats_in(pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Removed ranges ``doc, start, end`` among contexts ``doc, lo, bytes``."""
    sizes = np.array([len(p[2]) for p in pieces], np.int64)
    docs, los = np.array([p[0] for p in pieces], _DOC), np.array([p[1] for p in pieces], np.int64)
    width = int(sizes.max())
    data = np.frombuffer(b"".join(p[2] for p in pieces) + bytes(width), np.uint8)
    counts = sizes - LENGTH + 1
    piece = np.repeat(np.arange(len(pieces)), counts)
    inside = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = (np.cumsum(sizes) - sizes)[piece] + inside
    room = sizes[piece] - inside
    suffixes = np.lib.stride_tricks.sliding_window_view(data, width)[begin]
    suffixes[np.arange(width) >= room[:, None]] = 0
    order = np.argsort(np.ascontiguousarray(suffixes).view(f"S{width}").ravel(), kind="stable")
    # S-strings end at their trailing zeros, which only changes the order of suffixes with real zero bytes: equal ones stay neighbours
    sorted_rows, room, piece, inside = suffixes[order], room[order], piece[order], inside[order]
    differ = sorted_rows[1:] != sorted_rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    lcp = np.concatenate([[0], np.minimum(common, np.minimum(room[1:], room[:-1]))])
    left = np.where(inside > 0, data[np.maximum(begin[order] - 1, 0)].astype(np.int16), -1)
    doc, start = docs[piece], los[piece] + inside
    place = np.empty(len(doc), np.int64)
    place[_order(doc, start)] = np.arange(len(doc))
    out_at, out_length = [], []
    # most intervals are pairs: these at once
    joined = np.concatenate([[False], lcp[1:] >= LENGTH, [False]])
    pair = joined[1:-1] & ~joined[:-2] & ~joined[2:]
    at = np.flatnonzero(pair) + 1
    at = at[(left[at] != left[at - 1]) | (left[at] < 0)]
    later = np.where(place[at] > place[at - 1], at, at - 1)
    out_at.append(later)
    out_length.append(lcp[at])
    rest = lcp.copy()
    rest[np.flatnonzero(pair) + 1] = 0
    for length, a, b in maximal_repeats(rest, left, LENGTH):
        member = np.arange(a, b)
        first = a + int(np.argmin(place[a:b]))
        out_at.append(member[member != first])
        out_length.append(np.full(b - a - 1, length))
    at, length = np.concatenate(out_at), np.concatenate(out_length).astype(np.int64)
    # the same place may come twice where a document's row is repeated: an occurrence at the first place is no later one
    return unite(doc[at], start[at], start[at] + length)


def unite(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unite overlapping and touching ranges of each document."""
    if not len(doc):
        return doc, start, end
    order = _order(doc, start)
    doc, start, end = doc[order], start[order], end[order]
    number = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])]).astype(np.int64)
    shift = number * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], start[1:] + shift[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], reach[last] - shift[last]


#: Bytes of a context; or, without ``data``, a string of a hot anchor by its hash (key, content); or a range that is settled.
_PIECES = "settled boolean, key long, content long, doc long, mark long, lo long, size int, data binary"
_RANGES = "doc long, mark long, start long, end long"


def _strings(kind: bool, key: np.ndarray, content: np.ndarray, doc: np.ndarray, lo: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(np.full(len(key), kind)), pa.array(key), pa.array(content), *_doc_arrays(doc), pa.array(lo), pa.array(size.astype(np.int32)), pa.nulls(len(key), pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["settled", "key", "content", "doc", "mark", "lo", "size", "data"])


def _settled_strings(rows: list[tuple[int, int, tuple[int, int], int]]) -> Iterator[pa.RecordBatch]:
    """Of strings (key, content, doc, lo) the first with their content, and the united ranges of the others."""
    rows, first = _settle([np.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (np.int64, np.int64, _DOC, np.int64), strict=True)])
    key, content, doc, lo = (r[first] for r in rows)
    yield _strings(False, key, content, doc, lo, np.full(len(key), LENGTH))
    doc, start, end = unite(rows[2][~first], rows[3][~first], rows[3][~first] + LENGTH)
    spread = _spread(doc, start).view(np.int64)
    yield _strings(True, spread, spread, doc, start, end - start)


def _bytes_of(opened: DataFrame, docs: DataFrame) -> DataFrame:
    """The bytes of open contexts; where their key is hot, their strings."""
    hot = materialise(opened.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > HOT).select("key", F.lit(True).alias("hot")), "hot")
    flagged = opened.join(hot, "key", "left").select("doc", "mark", F.struct("key", "lo", "n", F.coalesce("hot", F.lit(False)).alias("hot")).alias("c"))
    lists = flagged.groupBy("doc", "mark").agg(F.collect_list("c").alias("list"))
    joined = lists.join(_keyed(docs), ["doc", "mark"]).select("doc", "mark", "text", "list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings: list[tuple[int, int, tuple[int, int], int]] = []
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for doc, text, found in zip(_docs_of(part).tolist(), texts_of(part), part.column("list").to_pylist(), strict=True):
                    raw = text.encode()
                    for c in found:
                        lo, n = c["lo"], c["n"]
                        if not c["hot"]:
                            rows.append((False, c["key"], 0, *doc, lo, n + LENGTH - 1, raw[lo : lo + n + LENGTH - 1]))
                            continue
                        for at in range(lo, lo + n):
                            strings.append((*struct.unpack("<qq", hashlib.blake2b(raw[at : at + LENGTH], digest_size=16).digest()), doc, at))
                    if len(strings) > SETTLED:
                        yield from _settled_strings(strings)
                        strings.clear()
                if rows:
                    kinds = (pa.bool_(), *[pa.int64()] * 5, pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["settled", "key", "content", "doc", "mark", "lo", "size", "data"])
        if strings:
            yield from _settled_strings(strings)

    return joined.mapInArrow(run, _PIECES)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _later(rows: list[np.ndarray], last: tuple | None) -> tuple[np.ndarray, tuple]:
    """Which of the sorted strings (key, content, doc, lo) are elsewhere than the first with their content; ``last`` is that of the string before and of the last one."""
    key, content = rows[:2]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
    new[0] = last is None or (key[0], content[0]) != last[:2]
    group = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
    doc, lo = (_carried(rows[k], group, last and last[k]) for k in (2, 3))
    return (rows[2] != doc) | (rows[3] != lo), (key[-1], content[-1], doc[-1], lo[-1])


def _ranges_of(pieces: DataFrame) -> DataFrame:
    # equal bytes under a key: one row for each, with its first place; the others are settled by the row itself
    ordered = pieces.repartition("key").sortWithinPartitions("key", "content", "doc", "mark", "lo")
    ranges = lambda columns: pa.RecordBatch.from_arrays([*_doc_arrays(columns[0]), *map(pa.array, columns[1:])], names=["doc", "mark", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, size, whole = None, [], 0, []  # whole: complete groups that wait for an array of fair size

        def close() -> None:
            nonlocal held
            seen: dict[bytes, tuple[tuple[int, int], int]] = {}
            for doc, lo, data in held:
                if data not in seen:
                    seen[data] = (doc, lo)
                elif seen[data] != (doc, lo):
                    settled.append((doc, lo, lo + len(data)))
            if len(seen) > 1:
                whole.extend((*place, data) for data, place in seen.items())
            held = []

        def scan() -> Iterator[pa.RecordBatch]:
            nonlocal size, whole
            parts = [repeats_in(whole)] if whole else []
            if settled:
                parts.append(tuple(np.array(list(c), t) for c, t in zip(zip(*settled, strict=True), (_DOC, np.int64, np.int64), strict=True)))
            if parts:
                yield ranges(unite(*(np.concatenate([p[k] for p in parts]) for k in range(3))))
            whole, size = [], 0
            settled.clear()

        settled: list[tuple[tuple[int, int], int, int]] = []
        last = None  # key, content, doc, lo of the first of the last strings
        for batch in batches:
            done, whole_piece = batch.column("settled").to_numpy(zero_copy_only=False), batch.column("data").is_valid().to_numpy(zero_copy_only=False)
            if done.any():
                start = batch.column("lo").to_numpy()[done]
                yield ranges((_docs_of(batch)[done], start, start + batch.column("size").to_numpy()[done]))
            strings = ~done & ~whole_piece
            if strings.any():
                rows = [(_docs_of(batch) if c == "doc" else batch.column(c).to_numpy())[strings] for c in ("key", "content", "doc", "lo")]
                later, last = _later(rows, last)
                yield ranges(unite(rows[2][later], rows[3][later], rows[3][later] + LENGTH))
            batch = batch.filter(pa.array(whole_piece))
            for key, doc, lo, data in zip(batch.column("key").to_pylist(), _docs_of(batch).tolist(), batch.column("lo").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if key != here:
                    close()
                    here = key
                    if size > ARRAY_BYTES:
                        yield from scan()
                held.append((doc, lo, data))
                size += len(data)
        close()
        yield from scan()

    return ordered.mapInArrow(run, _RANGES)


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """``doc, mark, ranges`` (start and end in bytes, not yet united) of documents with repeated passages."""
    with temporary_tables(docs.sparkSession):
        opened = materialise(open_contexts(contexts(docs)), "contexts")
        settled = opened.filter("settled")
        spans = settled.select("doc", "mark", F.col("lo").alias("start"), (F.col("lo") + F.col("n") + LENGTH - 1).alias("end"))
        compared = _ranges_of(_bytes_of(opened.filter("NOT settled").drop("settled", "content", "rest"), docs))
        ranges = materialise(spans.union(compared), "ranges", keep=True)
    return ranges.groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))


def cut_repeats(docs: DataFrame, emit, schema: str) -> DataFrame:
    """Apply ``emit(row columns, raw texts, united ranges)`` to every document with its removed ranges."""
    bounded_batches(docs.sparkSession)
    names = [f.name for f in docs.schema]
    ranges = repeated_ranges(docs)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({"_doc": F.coalesce("doc_id", F.lit(NO_ID)), "_mark": F.xxhash64(text), "text": text})
    joined = keyed.join(ranges.withColumnsRenamed({"doc": "_doc", "mark": "_mark", "ranges": "_ranges"}), ["_doc", "_mark"], "left").select(*names, "_ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raws, cuts = [t.encode() for t in texts_of(part)], []
                for raw, found in zip(raws, part.column("_ranges").to_pylist(), strict=True):
                    a = np.array([r["start"] for r in found or []], np.int64)
                    b = np.array([r["end"] for r in found or []], np.int64)
                    _, a, b = unite(np.zeros(len(a), np.int64), a, b)
                    cuts.append((a.tolist(), np.minimum(b, len(raw)).tolist()))
                yield emit(part, raws, cuts)

    return joined.mapInArrow(run, schema)


def kept_bytes(raw: bytes, starts: list[int], ends: list[int]) -> bytes:
    return b"".join(raw[a:b] for a, b in zip([0, *ends], [*starts, len(raw)], strict=True))


def whole_characters(raw: bytes, starts: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    """Ranges shrunk so that no UTF-8 character is cut."""
    inside = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80
    out = []
    for a, b in zip(starts, ends, strict=True):
        while inside(a):
            a += 1
        while inside(b):
            b -= 1
        if a < b:
            out.append((a, b))
    return [a for a, _ in out], [b for _, b in out]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with cut texts, and ``n_chars``, where there is such a column, counted anew. Null texts become empty."""
    schema = docs.schema
    counted = "n_chars" in schema.names

    def emit(part: pa.RecordBatch, raws: list[bytes], cuts: list[tuple[list[int], list[int]]]) -> pa.RecordBatch:
        texts = [kept_bytes(r, *whole_characters(r, *c)).decode() for r, c in zip(raws, cuts, strict=True)]
        new = {"text": pa.array(texts, part.column("text").type)}
        if counted:
            new["n_chars"] = pa.array(map(len, texts), part.column("n_chars").type)
        return pa.RecordBatch.from_arrays([new.get(n, part.column(n)) for n in schema.names], names=schema.names)

    return cut_repeats(docs, emit, schema)


def _digest(part: pa.RecordBatch, raws: list[bytes], cuts: list[tuple[list[int], list[int]]]) -> pa.RecordBatch:
    columns = [[len(r) for r in raws], [sum(b) - sum(a) for a, b in cuts], [len(a) for a, _ in cuts]]
    shas = [hashlib.sha256(kept_bytes(r, *c)).hexdigest() for r, c in zip(raws, cuts, strict=True)]
    return pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns), pa.array(shas, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return cut_repeats(docs, _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
