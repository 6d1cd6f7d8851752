"""Exact quantiles of a column of any length: ranks are narrowed down by counts of ranges, nothing is sorted or gathered."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges into which an interval is cut in a pass.
PARTS = 1024


def order_statistics(values: DataFrame, column: str, ranks: list[int]) -> list[float]:
    """The values at ``ranks`` (from 0) of the ascending column; null and NaN are left out.

    Each pass counts the values of every open interval in ``PARTS`` equal ranges, with the least and greatest value of each; a rank goes on in its range until that holds one value alone. A task
    sends a row for each range; the open intervals, at most one for each rank, come to the driver. Seven passes or so narrow any doubles.
    """
    numbers = values.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    low, high, n = numbers.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if any(not 0 <= r < n for r in ranks):
        raise ValueError(f"there are {n} values")
    known: dict[int, float] = {}
    open_ = {(low, high): [(r, r) for r in sorted(set(ranks))]}  # interval -> (rank, rank within it)
    while True:
        for a, b in [k for k in open_ if k[0] == k[1]]:
            known |= {rank: a for rank, _ in open_.pop((a, b))}
        if not open_:
            return [known[r] for r in ranks]
        intervals = sorted(open_)
        # half the width first: the whole one may be too large for a double
        place = lambda a, b: F.least(F.floor((F.col("v") / 2 - a / 2) / (b / 2 - a / 2) * PARTS), F.lit(PARTS - 1)).cast("int")
        cells = F.array(*(F.when((F.col("v") >= a) & (F.col("v") <= b), F.struct(F.lit(k).alias("interval"), place(a, b).alias("part"))) for k, (a, b) in enumerate(intervals)))
        counted = numbers.select("v", F.explode(F.filter(cells, lambda c: c.isNotNull())).alias("c")).groupBy("c.interval", "c.part").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
        parts: dict[int, list] = {}
        for r in counted.orderBy("interval", "part").collect():
            parts.setdefault(r.interval, []).append((r.n, r.a, r.b))
        narrowed: dict[tuple[float, float], list[tuple[int, int]]] = {}
        for k, interval in enumerate(intervals):
            wanted, before = list(open_[interval]), 0
            for count, a, b in parts[k]:
                while wanted and wanted[0][1] < before + count:
                    rank, within = wanted.pop(0)
                    narrowed.setdefault((a, b), []).append((rank, within - before))
                before += count
        open_ = narrowed


def exact_percentiles(values: DataFrame, column: str, shares: list[float]) -> list[float]:
    """Percentiles as ``F.percentile`` has them, interpolated between neighbours, of a column of any length; empty without values."""
    n = values.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)").count()
    if not n:
        return []
    at = [s * (n - 1) for s in shares]
    ranks = sorted({r for p in at for r in (math.floor(p), math.ceil(p))})
    value = dict(zip(ranks, order_statistics(values, column, ranks), strict=True))
    out = []
    for p in at:
        a, b = math.floor(p), math.ceil(p)
        out.append(value[a] if value[a] == value[b] else (b - p) * value[a] + (p - a) * value[b])
    return out
