"""Dynamic programs inside lattices: ``arcs(segment_id, src, dst, label, score)``, scores are costs, arcs lead to larger states.

The least state of a segment is initial, the largest final. Segments are small and many: they are dealt to partitions once, sorted, and an Arrow
batch of many segments goes through Python at a time.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def by_segment(arcs: DataFrame, solve: Callable[[object, list[tuple]], list[tuple]], extra: str) -> DataFrame:
    """``solve(segment_id, sorted arcs) -> rows`` for every segment; rows begin with the segment."""
    columns = ["segment_id", "src", "dst", "label", "score"]
    schema = StructType([arcs.schema["segment_id"], *StructType.fromDDL(extra)])
    arrow = to_arrow_schema(schema)

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, group, out = None, [], []
        for batch in batches:
            for segment, *arc in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if group and segment != here:
                    out += solve(here, group)
                    group = []
                here = segment
                group.append(tuple(arc))
            if out:
                yield emit(out)
                out = []
        if group and (out := solve(here, group)):
            yield emit(out)

    return arcs.select(*columns).repartition("segment_id").sortWithinPartitions(*columns[:4]).mapInArrow(run, schema)


def best_path(arcs: DataFrame) -> DataFrame:
    """``segment_id, pos, src, dst, label, score`` of the least-cost path; of equal arcs the first label."""

    def solve(segment: object, group: list[tuple]) -> list[tuple]:
        cost, back = {group[0][0]: 0.0}, {}
        for arc in group:
            c = cost.get(arc[0], math.inf) + arc[3]
            if c < cost.get(arc[1], math.inf):
                cost[arc[1]], back[arc[1]] = c, arc
        path, at = [], max(a[1] for a in group)
        while at in back:
            path.append(back[at])
            at = back[at][0]
        return [(segment, pos, *arc) for pos, arc in enumerate(path[::-1])]

    return by_segment(arcs, solve, "pos long, src long, dst long, label string, score double")


def n_best(arcs: DataFrame, n: int) -> DataFrame:
    """``segment_id, rank, words, score`` of the n least-cost paths with different words; of equal costs the first words."""

    def leading(found: dict[str, float]) -> dict[str, float]:
        """Without those that n others precede whatever follows. Of equal costs, words of which others are a beginning may come first or last: what follows decides."""
        kept, cost, ahead, level = {}, None, 0, []
        for words, c in sorted(found.items(), key=lambda x: (x[1], x[0] and f"{x[0]} ")):
            if c != cost:
                cost, ahead, level = c, ahead + len(level), []
            if ahead >= n:
                break
            text = words and f"{words} "
            if ahead + sum(not text.startswith(other) for other in level) < n:
                kept[words] = c
            level.append(text)
        return kept

    def solve(segment: object, group: list[tuple]) -> list[tuple]:
        best: dict[int, dict[str, float]] = {group[0][0]: {"": 0.0}}
        for k, (src, dst, label, score) in enumerate(group):
            if k and group[k - 1][0] != src and len(best.get(src, ())) > n:  # all arcs to src were seen
                best[src] = leading(best[src])
            into = best.setdefault(dst, {})
            for words, cost in best.get(src, {}).items():
                longer = f"{words} {label}" if words else label
                into[longer] = min(cost + score, into.get(longer, math.inf))
        found = heapq.nsmallest(n, best[max(a[1] for a in group)].items(), key=lambda x: (x[1], x[0]))
        return [(segment, rank, words, cost) for rank, (words, cost) in enumerate(found)]

    return by_segment(arcs, solve, "rank long, words string, score double")


def select_n_best(nbest: DataFrame, k: int) -> DataFrame:
    """The k-th (from 0) of every segment's list; segments whose list is shorter give nothing."""
    return nbest.filter(F.col("rank") == k)


def arc_posteriors(arcs: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Forward-backward posteriors of all arcs, costs scaled by alpha; nothing for a segment whose last state cannot be reached."""

    def plus(a: float, b: float) -> float:
        low, high = min(a, b), max(a, b)
        return high if low == -math.inf else high + math.log1p(math.exp(low - high))

    def solve(segment: object, group: list[tuple]) -> list[tuple]:
        final = max(a[1] for a in group)
        ahead, behind = {group[0][0]: 0.0}, {final: 0.0}
        for src, dst, _, score in group:
            ahead[dst] = plus(ahead.get(dst, -math.inf), ahead.get(src, -math.inf) - alpha * score)
        for src, dst, _, score in sorted(group, key=lambda a: -a[1]):
            behind[src] = plus(behind.get(src, -math.inf), behind.get(dst, -math.inf) - alpha * score)
        if ahead.get(final, -math.inf) == -math.inf:
            return []
        return [(segment, src, dst, label, math.exp(ahead.get(src, -math.inf) - alpha * score + behind.get(dst, -math.inf) - ahead[final])) for src, dst, label, score in group]

    return by_segment(arcs, solve, "src long, dst long, label string, posterior double")
