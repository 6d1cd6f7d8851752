"""Operator 9: packing documents into few sequences by linear grouping and best fit.

A piece is at most ``capacity`` tokens long, so the corpus is a histogram of at most ``capacity`` lengths, whatever its size. The plan
is made on that histogram; the pieces themselves are ranked and joined to it by Spark.

1. Large lengths, in falling order, form groups of equally many pieces; each group is rounded up to its longest.
2. Configurations over these few sizes: the largest one left, filled up by a bounded knapsack, as often as the counts allow.
3. Actual pieces take the places of the rounded ones, which leaves each sequence its real room, known in runs of equal sequences.
4. Small pieces, longest first, go where the least room is left that still takes them; only what fits nowhere opens sequences.

Null texts are empty documents, which hold the end id alone. Null or repeated document ids are packed like others. An empty table gives
no row. Other columns are ignored. Only documents longer than the capacity are cut.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, slices, texts_of
from .library_ids import library_encoder

CAPACITY = 4096
#: Number of groups, and the share of the capacity (one in so many) from which a piece is large: each is planned, the best plan is taken.
VARIANTS = ((384, 3), (384, 8), (768, 4))
#: Pieces of one length that are ranked in one task.
RANKED_TOGETHER = 200_000


def encode_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: the tokens of each text and an end id, cut at the capacity."""
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(texts_of(part)), strict=True):
                    ids = np.append(ids.astype("<u4"), np.uint32(end_id)).astype("<u4")
                    rows += [(doc_id, k, a, len(x := ids[a : a + capacity]), zlib.crc32(x.tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Intervals of ranks within a length and the sequences that take them.

    A rank r from ``lo`` to below ``hi`` goes to sequence ``base + (r - lo + shift) // each``.
    """

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 384, large: int = 4):
        self.capacity, self.intervals, self.sequences = capacity, [], 0
        self.used: dict[int, int] = defaultdict(int)  # ranks given away of each length
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> runs (first sequence, number)
        self.rooms: list[int] = []
        limit = capacity // large
        self._large({n: c for n, c in histogram.items() if n > limit}, groups)
        for length in sorted((n for n in histogram if n <= limit), reverse=True):
            self._small(length, histogram[length])

    def _take(self, length: int, count: int, base: int, each: int, shift: int = 0) -> None:
        lo = self.used[length]
        self.intervals.append((length, lo, lo + count, base, each, shift))
        self.used[length] = lo + count

    def _give_room(self, room: int, first: int, number: int) -> None:
        if room and number:
            if not self.room.get(room):
                bisect.insort(self.rooms, room)
            self.room[room].append((first, number))

    # large pieces

    def _large(self, counts: dict[int, int], groups: int) -> None:
        total = sum(counts.values())
        if not total:
            return
        size = -(-total // groups)
        members: list[list[list[int]]] = [[]]  # of each group: [length, number], longest first
        free = size
        for length in sorted(counts, reverse=True):
            left = counts[length]
            while left:
                if not free:
                    members.append([])
                    free = size
                n = min(left, free)
                members[-1].append([length, n])
                left, free = left - n, free - n
        sizes = [m[0][0] for m in members]
        remaining = [sum(n for _, n in m) for m in members]
        queue = [[list(x) for x in m] for m in members]
        while any(remaining):
            config = self._configuration(sizes, remaining)
            times = min(remaining[g] // a for g, a in config.items())
            self._substitute(config, times, queue)
            for g, a in config.items():
                remaining[g] -= a * times

    def _configuration(self, sizes: list[int], remaining: list[int]) -> dict[int, int]:
        """The largest size left and the fullest choice of others beside it."""
        first = next(g for g, n in enumerate(remaining) if n)
        space = self.capacity - sizes[first]
        how = np.full(space + 1, -1, np.int64)  # the last group that made this fill
        how[0] = len(sizes)
        reached = np.zeros(space + 1, bool)
        reached[0] = True
        trail: list[np.ndarray] = []
        for g, n in enumerate(remaining):
            left = n - (g == first)
            before = reached.copy()
            trail.append(before)
            if left <= 0 or sizes[g] > space:
                continue
            wave = before
            for _ in range(min(left, space // sizes[g])):
                shifted = np.zeros_like(wave)
                shifted[sizes[g] :] = wave[: -sizes[g]]
                wave = shifted & ~reached
                if not wave.any():
                    break
                reached |= wave
                how[wave] = g
        config, at = defaultdict(int), int(np.flatnonzero(reached)[-1])
        while at:
            config[int(how[at])] += 1
            at -= sizes[int(how[at])]
        config[first] += 1
        return dict(config)

    def _substitute(self, config: dict[int, int], times: int, queue: list[list[list[int]]]) -> None:
        """Deal the actual pieces of each group to ``times`` sequences; sequences with equal contents form runs."""
        base, cuts, taken = self.sequences, {0, times}, {}
        self.sequences += times
        for g, each in config.items():
            runs, given = [], 0  # (first place, length); places are dealt each by each
            want = each * times
            while given < want:
                head = queue[g][0]
                n = min(head[1], want - given)
                runs.append((given, head[0], n))
                self._take(head[0], n, base + given // each, each, given % each)
                given += n
                head[1] -= n
                if not head[1]:
                    queue[g].pop(0)
            taken[g] = ([r[0] for r in runs], [r[1] for r in runs])
            for place, _, n in runs:
                cuts |= {place // each, -(-place // each), (place + n) // each, min(times, -(-(place + n) // each))}
        edges = sorted(cuts)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            fill = 0
            for g, each in config.items():
                places, lengths = taken[g]
                fill += sum(lengths[bisect.bisect_right(places, a * each + k) - 1] for k in range(each))
            self._give_room(self.capacity - fill, base + a, b - a)

    # small pieces

    def _small(self, length: int, count: int) -> None:
        while count:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = self.capacity // length
                number = -(-count // each)
                first, room = self.sequences, self.capacity
                self.sequences += number
            else:
                room = self.rooms[at]
                first, number = self.room[room].pop()
                if not self.room[room]:
                    self.rooms.pop(at)
            each = room // length
            full = min(number, count // each)
            if full:
                self._take(length, full * each, first, each)
                self._give_room(room - each * length, first, full)
                count -= full * each
            if full < number:
                if count:  # fewer than one sequence takes
                    self._take(length, count, first + full, count)
                    self._give_room(room - count * length, first + full, 1)
                    full, count = full + 1, 0
                if room < self.capacity:
                    self._give_room(room, first + full, number - full)


def pack_pieces(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``length``; ``order`` makes ranks definite."""
    spark = pieces.sparkSession
    counted = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    plan = min((Plan({r.length: r.n for r in counted}, capacity, *v) for v in VARIANTS), key=lambda p: p.sequences)
    salts = max(1, max((r.n for r in counted), default=0) // RANKED_TOGETHER)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    ahead = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1
    ranked = salted.withColumn("_own", own).join(ahead, ["length", "_salt"]).withColumn("_rank", F.col("_own") + F.col("_ahead"))
    # the plan depends on the capacity and the number of groups, not on the corpus
    steps = spark.createDataFrame(plan.intervals, "_length long, _lo long, _hi long, _base long, _each long, _shift long")
    placed = ranked.join(F.broadcast(steps), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    placed = placed.withColumn("sequence_id", F.col("_base") + F.floor((F.col("_rank") - F.col("_lo") + F.col("_shift")) / F.col("_each")))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *order).rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*pieces.columns, "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = materialise(encode_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 1), "pieces")
    return pack_pieces(pieces, ["doc_id", "piece", "ids_crc32"])
