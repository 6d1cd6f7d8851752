"""Time-stamped frames (``segment_id, tick, x, ...``): time joins, windows, normalisation. Ticks are whole numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.windows import runs


def _by_time(extra: list | None = None) -> Window:
    return Window.partitionBy("segment_id").orderBy("tick", *(extra or []))


def sync(frames: DataFrame, target: DataFrame) -> DataFrame:
    """Frames that start at a target time."""
    return frames.join(target.select("segment_id", "tick").distinct(), ["segment_id", "tick"], "left_semi")


def unmatched_targets(frames: DataFrame, target: DataFrame) -> DataFrame:
    return target.join(frames, ["segment_id", "tick"], "left_anti")


def copy_timestamps(frames: DataFrame, target: DataFrame, order: list) -> DataFrame:
    """The i-th frame of a segment gets the i-th target time."""
    w = Window.partitionBy("segment_id")
    a = frames.withColumn("_i", F.row_number().over(w.orderBy("tick", *order))).withColumnRenamed("tick", "old_tick")
    b = target.select("segment_id", "tick", *order).withColumn("_i", F.row_number().over(w.orderBy("tick", *order))).select("segment_id", "_i", "tick")
    return a.join(b, ["segment_id", "_i"]).drop("_i")


def predict_frames(frames: DataFrame, target: DataFrame, strict: bool = False) -> DataFrame:
    """As-of join: each target time gets the frame with equal start, else the last earlier one, before the first frame that first one.

    ``strict`` takes the last frame that is strictly earlier. Frames of one segment and tick must be unique.
    """
    rank = F.lit(2 if strict else 0)
    both = frames.select("segment_id", "tick", "x", rank.alias("side")).unionByName(target.select("segment_id", "tick", F.lit(None).cast(frames.schema["x"].dataType).alias("x"), F.lit(1).alias("side")))
    w = Window.partitionBy("segment_id").orderBy("tick", "side")
    last = F.last("x", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # before the first frame: that one, by its own least time
    after = F.min(F.when(F.col("side") != 1, F.struct("tick", "x"))).over(Window.partitionBy("segment_id"))["x"]
    return both.withColumn("x", F.coalesce(last, after)).filter("side = 1").select("segment_id", "tick", "x")


def interpolate_frames(frames: DataFrame, target: DataFrame) -> DataFrame:
    """Linear interpolation at target times; targets before the first or after the last frame of their segment are left out."""
    both = frames.select("segment_id", "tick", "x", F.lit(0).alias("side")).unionByName(target.select("segment_id", "tick", F.lit(None).cast(frames.schema["x"].dataType).alias("x"), F.lit(1).alias("side")))
    w = Window.partitionBy("segment_id").orderBy("tick", "side")
    point = F.when(F.col("side") == 0, F.struct("tick", "x"))
    a = F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # the next frame is the last one in the order turned round
    b = F.last(point, ignorenulls=True).over(Window.partitionBy("segment_id").orderBy(F.desc("tick"), F.desc("side")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = both.withColumn("a", a).withColumn("b", b).filter("side = 1 AND a IS NOT NULL AND (b IS NOT NULL OR a.tick = tick)")
    share = (F.col("tick") - F.col("a.tick")) / (F.col("b.tick") - F.col("a.tick"))
    return joined.select("segment_id", "tick", F.when(F.col("a.tick") == F.col("tick"), F.col("a.x").cast("double")).otherwise(F.col("a.x") + share * (F.col("b.x") - F.col("a.x"))).alias("x"))


def interpolate_polynomial(frames: DataFrame, target: DataFrame, order: int = 1, outside: str = "drop") -> DataFrame:
    """``segment_id, tick, x`` at target times, on the polynomial through ``order + 1`` frames around each; frames of one segment have different ticks.

    With c the first frame at or after the target, the last control point is frame ``c + order // 2``, moved so that all of them exist; shorter segments take all their frames. A target at a frame's time is a copy.
    Targets outside their segment's frames: ``drop``; ``flag`` keeps them without ``x``; ``error`` raises. Two windows with a bounded number of rows gather the points.
    """
    if outside not in ("drop", "flag", "error"):
        raise ValueError("targets outside can be dropped, flagged or raise an error")
    w = Window.partitionBy("segment_id").orderBy("tick")
    around = F.collect_list(F.struct(F.col("tick").alias("t"), F.col("x").cast("double").alias("x"))).over(w.rowsBetween(-order, order))
    numbered = frames.select("segment_id", "tick", "x", (F.row_number().over(w) - 1).alias("_c"), F.count("*").over(Window.partitionBy("segment_id")).alias("_n"), around.alias("_around"))
    last = F.least(F.greatest(F.col("_c") + order // 2, F.lit(order)), F.col("_n") - 1)
    first = F.greatest(last - order, F.lit(0))
    begin = F.greatest(F.col("_c") - order, F.lit(0))
    point = F.struct("tick", F.slice("_around", (first - begin + 1).cast("int"), (last - first + 1).cast("int")).alias("p"))
    points = numbered.select("segment_id", "tick", F.lit(1).alias("_side"), point.alias("_point"), (F.col("_c") == 0).alias("_first"))
    both = points.unionByName(target.select("segment_id", "tick", F.lit(0).alias("_side"), F.lit(None).cast(points.schema["_point"].dataType).alias("_point"), F.lit(False).alias("_first")))
    # the next frame, at the target's time too, is the last one in the order turned round
    back = Window.partitionBy("segment_id").orderBy(F.desc("tick"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = both.withColumn("_next", F.last("_point", ignorenulls=True).over(back)).withColumn("_before_all", F.last(F.when(F.col("_side") == 1, F.col("_first")), ignorenulls=True).over(back)).filter("_side = 0")
    t, p = F.col("tick").cast("double"), F.col("_next.p")
    weight = lambda a, i: F.aggregate(F.filter(p, lambda b, j: j != i), F.lit(1.0), lambda z, b: z * (t - b["t"]) / (a["t"] - b["t"]))
    value = F.aggregate(F.transform(p, lambda a, i: a["x"] * weight(a, i)), F.lit(0.0), lambda z, v: z + v)
    copy = F.get(F.filter(p, lambda a: a["t"] == F.col("tick")), F.lit(0))["x"]
    inside = F.col("_next").isNotNull() & (~F.col("_before_all") | (F.col("_next.tick") == F.col("tick")))
    x = F.when(inside, F.coalesce(copy, value))
    if outside == "error":
        x = F.when(inside, F.coalesce(copy, value)).otherwise(F.raise_error(F.concat(F.lit("target outside of its segment: "), F.col("tick").cast("string"))).cast("double"))
    out = placed.filter(inside) if outside == "drop" else placed
    return out.select("segment_id", "tick", x.alias("x"))


def select_in_intervals(frames: DataFrame, intervals: DataFrame, width: int) -> DataFrame:
    """Frames inside an interval ``[start, end)`` of their segment: equi-join on time buckets, then the exact test."""
    buckets = intervals.select("segment_id", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("_bucket"))
    hit = frames.withColumn("_bucket", F.floor(F.col("tick") / width)).join(buckets, ["segment_id", "_bucket"]).filter((F.col("tick") >= F.col("start")) & (F.col("tick") < F.col("end")))
    return hit.select(*frames.columns).distinct()


def cut(frames: DataFrame, start: int, end: int) -> DataFrame:
    return frames.filter(F.col("tick").between(start, end))


def delay(frames: DataFrame, offsets: list[int], order: list, margin: str = "copy") -> DataFrame:
    """Neighbours at offsets as columns ``x_<k>``; beyond an end: the end's frame (``copy``) or zero."""
    w = _by_time(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = frames
    for k in offsets:
        neighbour = F.lag("x", -k).over(w) if k < 0 else F.lead("x", k).over(w) if k else F.col("x")
        neighbour = F.lag("x", abs(k)).over(w) if k < 0 else neighbour
        beyond = (F.first("x") if k < 0 else F.last("x")).over(whole) if margin == "copy" else F.lit(0)
        out = out.withColumn(f"x_{'m' if k < 0 else 'p'}{abs(k)}", F.coalesce(neighbour, beyond))
    return out


def splice(frames: DataFrame, left: int, right: int, order: list) -> DataFrame:
    return frames.withColumn("spliced", F.collect_list("x").over(_by_time(order).rowsBetween(-left, right)))


def aggregate_sequence(frames: DataFrame, size: int, order: list) -> DataFrame:
    """Groups of ``size`` frames as one packet."""
    numbered = frames.withColumn("_i", F.row_number().over(_by_time(order)) - 1)
    packed = F.transform(F.sort_array(F.collect_list(F.struct("_i", "x"))), lambda p: p["x"])
    return numbered.groupBy("segment_id", F.floor(F.col("_i") / size).alias("packet")).agg(packed.alias("xs"))


def disaggregate(packets: DataFrame) -> DataFrame:
    return packets.select("segment_id", "packet", F.posexplode("xs").alias("i", "x"))


def regression(frames: DataFrame, width: int, order: list, degree: int = 1) -> DataFrame:
    """Regression over ``2 width + 1`` frames, whose ends repeat: ``slope``, the sum of dt x over that of dt squared, or for degree 2 ``curve``."""
    spread = delay(frames, [k for k in range(-width, width + 1) if k], order)
    steps = range(-width, width + 1)
    if degree == 2:
        n, m, q = len(steps), sum(k * k for k in steps), sum(k**4 for k in steps)
        total = sum(((m - n * k * k) * (F.col(f"x_{'m' if k < 0 else 'p'}{abs(k)}") if k else F.col("x")) for k in steps), F.lit(0))
        return spread.withColumn("curve", total * (2 / (m * m - n * q))).select(*frames.columns, "curve")
    total = sum((k * F.col(f"x_{'m' if k < 0 else 'p'}{abs(k)}") for k in steps if k), F.lit(0))
    return spread.withColumn("slope", total / sum(k * k for k in range(-width, width + 1))).select(*frames.columns, "slope")


def sliding_normalise(frames: DataFrame, length: int, right: int, order: list, variance: bool = True) -> DataFrame:
    """Mean (and population variance) over a sliding window by prefix sums.

    The window of frame t ends at ``e = min(t + right, T - 1)`` and holds the ``length`` frames up to e (all from the start before that),
    so the last ``right`` frames reuse the last full window. A zero deviation counts as one.
    """
    w = _by_time(order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = frames.withColumn("_t", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy("segment_id"))).withColumn("_s", F.sum("x").over(upto)).withColumn("_q", F.sum(F.col("x") * F.col("x")).over(upto))
    # prefix sums at the window's ends lie at fixed offsets in the same order; the last frames reuse the last full window
    last = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inner = F.col("_t") + right < F.col("_n")
    sums = sums.withColumn("_e", F.least(F.col("_t") + right, F.col("_n") - 1))
    for name in "sq":
        beyond = F.col(f"_{name}")
        sums = sums.withColumn(f"_{name}e", F.when(inner, F.lead(beyond, right).over(w)).otherwise(F.last(beyond).over(last)))
        shift = right - length  # of the row before the window
        begin = F.lag(beyond, -shift).over(w) if shift < 0 else F.lead(beyond, shift).over(w) if shift else beyond
        tail = F.max(F.when(F.col("_t") == F.col("_n") - 1 - length, F.struct(beyond.alias("v"))))
        sums = sums.withColumn(f"_{name}b", F.when(inner, begin).otherwise(tail.over(last)["v"]))
    placed = sums
    count = F.least(F.lit(length), F.col("_e") + 1)
    mean = (F.col("_se") - F.coalesce("_sb", F.lit(0))) / count
    square = (F.col("_qe") - F.coalesce("_qb", F.lit(0))) / count
    deviation = F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))
    value = (F.col("x") - mean) / F.when(deviation > 0, deviation).otherwise(1.0) if variance else F.col("x") - mean
    return placed.withColumn("normalised", value).select(*frames.columns, "normalised")


def segment_normalise(frames: DataFrame) -> DataFrame:
    w = Window.partitionBy("segment_id")
    deviation = F.stddev_pop("x").over(w)
    return frames.withColumn("normalised", (F.col("x") - F.avg("x").over(w)) / F.when(deviation > 0, deviation).otherwise(1.0))


def histogram(frames: DataFrame, bucket: float) -> DataFrame:
    return frames.groupBy("label", F.floor(F.col("x") / bucket).alias("bin")).agg(F.count("*").alias("n"))


def histogram_normalise(frames: DataFrame, train: DataFrame, bucket: float) -> DataFrame:
    """Frames with ``normalised``: x moved from its bucket to the first one where ``train(bin, n)`` has as large a share below or in it as the frames of that label have.

    The place inside a bucket is kept. ``train`` is one histogram and joins as one broadcast row; its length is the range of values over the bucket.
    """
    w = Window.partitionBy("label")
    share = F.sum("n").over(w.orderBy("bin")) / F.sum("n").over(w)
    total = train.agg(F.sum("n").alias("_total"))  # one row
    steps = train.crossJoin(F.broadcast(total)).agg(F.array_sort(F.collect_list(F.struct("bin", F.col("n").alias("n"), "_total"))).alias("_train"))
    upto = F.aggregate("_train", F.array().cast("array<struct<bin:bigint,sum:bigint,p:double>>"), lambda a, t: F.concat(a, F.array(_step(a, t))))
    cdf = steps.select(upto.alias("_train"))
    mapped = histogram(frames, bucket).withColumn("_p", share).crossJoin(F.broadcast(cdf)).select("label", "bin", F.element_at(F.filter("_train", lambda t: t["p"] >= F.col("_p")), 1)["bin"].alias("_to"))
    joined = frames.withColumn("bin", F.floor(F.col("x") / bucket)).join(mapped, ["label", "bin"])
    return joined.withColumn("normalised", F.col("x") + (F.col("_to") - F.col("bin")) * bucket).select(*frames.columns, "normalised")


def _step(a: Column, t: Column) -> Column:
    total = F.coalesce(F.try_element_at(a, F.lit(-1))["sum"], F.lit(0)) + t["n"]
    return F.struct(t["bin"].alias("bin"), total.alias("sum"), (total / t["_total"]).alias("p"))


def silence_flags(frames: DataFrame, length: int, right: int, order: list, sparse: float = 0.1, min_snr: float = 1.0, share: float = 0.5, min_speech: int = 1, min_silence: int = 1) -> DataFrame:
    """Frames with ``silent``. The threshold of a frame comes from the ``length`` energies ``x`` around it (``right`` of them later).

    Noise and speech are the values with a share ``sparse`` of these below and above (less while the window is not full). Where they differ by over
    ``min_snr``, the threshold lies ``share`` of the way between them, but at least ``min_snr`` over the noise, as it also does elsewhere. Runs shorter
    than ``min_speech`` or ``min_silence`` take the decision before them; a segment begins silent.
    """
    w = _by_time(order)
    around = F.array_sort(F.collect_list("x").over(w.rowsBetween(right + 1 - length, right)))
    n = F.size("_around")
    rare = sparse * n / length
    at = lambda part: F.element_at("_around", F.least(F.floor(part * n), n - 1).cast("int") + 1)
    placed = frames.withColumn("_around", around).withColumn("_noise", at(rare)).withColumn("_speech", at(1 - rare))
    low = F.col("_noise") + min_snr
    threshold = F.when(F.col("_speech") > low, F.greatest((1 - share) * F.col("_noise") + share * F.col("_speech"), low)).otherwise(low)
    flagged = runs(placed.withColumn("_raw", F.col("x") < threshold).drop("_around", "_noise", "_speech"), ["segment_id"], ["tick", *order], "_raw", "_run")
    size = F.count("*").over(Window.partitionBy("segment_id", "_run"))
    accepted = F.when(size >= F.when(F.col("_raw"), min_silence).otherwise(min_speech), F.col("_raw"))
    decided = F.last("_accepted", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return flagged.withColumn("_accepted", accepted).withColumn("silent", F.coalesce(decided, F.lit(True))).select(*frames.columns, "silent")


def mean_over(frames: DataFrame, key: str) -> DataFrame:
    return frames.groupBy(key).agg(F.avg("x").alias("mean"), F.count("*").alias("n"))


def activity_sessions(frames: DataFrame, gap: int, order: list) -> DataFrame:
    """Runs of frames that are at most ``gap`` ticks apart."""
    w = _by_time(order)
    new = F.coalesce(F.col("tick") - F.lag("tick").over(w) > gap, F.lit(True)).cast("int")
    marked = frames.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("segment_id", "session").agg(F.min("tick").alias("start"), F.max("tick").alias("end"), F.count("*").alias("n"))


def windowed_energy(frames: DataFrame, width: int) -> DataFrame:
    return frames.groupBy("segment_id", F.floor(F.col("tick") / width).alias("window")).agg(F.sum(F.abs("x")).alias("energy"), F.count("*").alias("n"))


# vectors in a column


def adjacent_difference(x: Column) -> Column:
    n = F.size(x)
    return F.zip_with(F.slice(x, 2, F.greatest(n - 1, F.lit(0))), F.slice(x, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda a, b: a - b)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def energy(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b * b)


def norm(x: Column, p: float) -> Column:
    return F.pow(F.aggregate(x, F.lit(0.0), lambda a, b: a + F.pow(F.abs(b), F.lit(float(p)))), F.lit(1.0 / p))


def vector_normalise(x: Column, kind: str) -> Column:
    by = {"energy": F.sqrt(energy(x)), "maximum": F.array_max(x), "mean-energy": F.sqrt(energy(x) / F.size(x))}
    if kind == "mean":
        return _once(total(x) / F.size(x), lambda mean: F.transform(x, lambda v: v - mean))
    return _once(by[kind], lambda unit: F.transform(x, lambda v: v / unit))


def products(x: Column) -> Column:
    """All ``x_i x_j`` with i <= j."""
    return F.flatten(F.transform(x, lambda v, i: F.transform(F.slice(x, i + 1, F.size(x)), lambda u: v * u)))


def nth_order_features(x: Column, orders: list[str], selection: tuple[list[int], list[int]] = ((), ())) -> Column:
    """One vector of the wanted features in the order asked for; ``selected`` are the products ``x_i x_j`` of i <= j from the two lists."""
    third = lambda inner: F.flatten(F.transform(x, lambda v, i: F.transform(inner(i), lambda p: v * p)))
    make = {
        "first": lambda: x,
        "squares": lambda: F.transform(x, lambda v: v * v),
        "second": lambda: products(x),
        "selected": lambda: F.array(*(F.element_at(x, i + 1) * F.element_at(x, j + 1) for i in selection[0] for j in selection[1] if i <= j)),
        "cubes": lambda: F.transform(x, lambda v: v * v * v),
        "third": lambda: third(lambda i: products(F.slice(x, i + 1, F.size(x)))),
        "asymmetric_third": lambda: third(lambda i: products(x)),
        "fourths": lambda: F.transform(x, lambda v: v * v * v * v),
    }
    return F.concat(*(make[o]() for o in orders))


def matrix_multiply(x: Column, matrix: list[list[float]]) -> Column:
    return F.array(*(sum((F.element_at(x, j + 1) * v for j, v in enumerate(row)), F.lit(0.0)) for row in matrix))


def cosine_transform(d: int, k: int) -> list[list[float]]:
    return [[math.cos(math.pi * i * (j + 0.5) / d) for j in range(d)] for i in range(k)]


def _once(value: Column, then) -> Column:
    """``then(value)`` with the value computed once a row, not once for each component."""
    return F.transform(F.array(value), then)[0]


def softmax(x: Column) -> Column:
    shifted = _once(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))
    return _once(shifted, lambda s: _once(total(s), lambda t: F.transform(s, lambda v: v / t)))


def peak(x: Column) -> Column:
    """Position (from 0) and value of the maximum, and its height confidence."""
    top = F.array_max(x)
    mean = total(x) / F.size(x)
    return F.struct((F.array_position(x, top) - 1).alias("position"), top.alias("value"), (F.least(F.try_divide(top, mean), F.lit(2.0)) - 1).alias("confidence"))
