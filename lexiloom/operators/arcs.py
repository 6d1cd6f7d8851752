"""Arc tables ``segment_id, src, dst, label, ...`` of many lattices at once: scores, labels, unions, chains. Scores are maps of costs (see ``slots.score_map``)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.tables import written

from .lattice import best_path

EPSILON = "*EPS*"


def score_update(scores: Column, key: str, change) -> Column:
    """``change`` applied to the score of one key."""
    return F.transform_values(scores, lambda k, v: F.when(k == key, change(v)).otherwise(v))


def score_add(scores: Column, key: str, c: float) -> Column:
    return score_update(scores, key, lambda v: v + c)


def score_multiply(scores: Column, key: str, c: float) -> Column:
    return score_update(scores, key, lambda v: v * c)


def score_exp(scores: Column, key: str, c: float = 1.0) -> Column:
    return score_update(scores, key, lambda v: F.exp(v * c))


def score_log(scores: Column, key: str, c: float = 1.0) -> Column:
    return score_update(scores, key, lambda v: c * F.ln(v))


def append_scores(a: DataFrame, b: DataFrame) -> DataFrame:
    """The score maps of two lattices of equal topology as one; of equal keys b's score counts."""
    keys = ["segment_id", "src", "dst", "label"]
    merged = F.map_concat(F.map_filter("scores", lambda k, v: ~F.map_contains_key(F.col("_more"), k)), F.col("_more"))
    return a.join(b.select(*keys, F.col("scores").alias("_more")), keys).withColumn("scores", merged).drop("_more")


def arc_penalty(arcs: DataFrame, classes: DataFrame, default: float, scale: float = 1.0, key: str = "penalty") -> DataFrame:
    """Adds ``scale * penalty``: that of the label's class ``classes(label, penalty)``, else the default. A small list of labels is expected, but not assumed: it is written, so that Spark knows
    its size and moves no arcs to their labels, which are few, if it is small."""
    joined = arcs.join(written(classes.select("label", F.col("penalty").alias("_p")), "classes"), "label", "left")
    return joined.withColumn("scores", F.map_concat("scores", F.create_map(F.lit(key), scale * F.coalesce("_p", F.lit(default))))).drop("_p")


def pronunciation_score(arcs: DataFrame, lexicon: DataFrame, scale: float = 1.0, key: str = "pron") -> DataFrame:
    """Adds the scaled pronunciation score of ``lexicon(label, score)``; labels without one add nothing."""
    joined = arcs.join(lexicon.select("label", F.col("score").alias("_s")), "label", "left")
    return joined.withColumn("scores", F.map_concat("scores", F.create_map(F.lit(key), scale * F.coalesce("_s", F.lit(0.0))))).drop("_s")


def map_alphabet(arcs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Labels of one alphabet to another: ``lexicon(label, to)``, one row for each target; labels that it lacks become epsilon."""
    return arcs.join(lexicon.select("label", "to"), "label", "left").withColumn("label", F.coalesce("to", F.lit(EPSILON))).drop("to")


def map_arc_labels(arcs: DataFrame, mapping: DataFrame | None = None, lower: bool = True, split: str = r"[ _-]+", nonword: str = r"^\[.*\]$") -> DataFrame:
    """Lower case, non-words to epsilon, ``mapping(label, to)`` to other words, compounds to chains of arcs.

    An arc of n words becomes n arcs over new states ``(src, dst, label, k)``; scores stay on the first, times are shared evenly.
    ``src`` and ``dst`` come back as strings, since new states lie between old ones.
    """
    label = F.when(F.col("label").rlike(nonword), EPSILON).otherwise(F.lower("label") if lower else F.col("label"))
    rows = arcs.withColumn("label", label)
    if mapping is not None:
        rows = rows.join(mapping.select("label", "to"), "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")
    words = F.when(F.col("label") == EPSILON, F.array("label")).otherwise(F.filter(F.split("label", split), lambda w: w != ""))
    words = F.when(F.size(words) == 0, F.array(F.lit(EPSILON))).otherwise(words)
    old = rows.withColumn("_arc", F.concat_ws("/", F.col("src").cast("string"), F.col("dst").cast("string"), "label")).withColumn("_n", F.size(words)).select("*", F.posexplode(words).alias("_k", "_word"))
    state = lambda k, end, whole: F.when(k == whole, F.col(end).cast("string")).otherwise(F.concat_ws("/", "_arc", k.cast("string")))
    length = (F.col("end_t") - F.col("start_t")) / F.col("_n")
    return old.select(
        "segment_id", state(F.col("_k"), "src", F.lit(0)).alias("src"), state(F.col("_k") + 1, "dst", F.col("_n")).alias("dst"), F.col("_word").alias("label"),
        (F.col("start_t") + F.col("_k") * length).alias("start_t"), (F.col("start_t") + (F.col("_k") + 1) * length).alias("end_t"), F.when(F.col("_k") == 0, F.col("score")).otherwise(0.0).alias("score"),
    )


def valid_arcs(arcs: DataFrame) -> DataFrame:
    """Without self-loops, arcs that go back in time, null labels and scores that are no finite numbers."""
    s = F.col("score")
    return arcs.filter((F.col("src") < F.col("dst")) & (F.col("end_t") >= F.col("start_t")) & F.col("label").isNotNull() & s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf")))


def trim(arcs: DataFrame, initial: DataFrame, final: DataFrame, rounds: int) -> DataFrame:
    """Arcs on a way from ``initial(segment_id, state)`` to ``final``. Each round of semi joins doubles nothing but follows one arc more; ``rounds`` bounds the path length."""

    def reach(edges: DataFrame, start: DataFrame) -> DataFrame:
        seen = start.select("segment_id", "state")
        for _ in range(rounds):
            seen = seen.union(edges.join(seen, ["segment_id", "state"]).select("segment_id", F.col("to").alias("state"))).distinct()
        return seen

    ahead = reach(arcs.select("segment_id", F.col("src").alias("state"), F.col("dst").alias("to")), initial)
    behind = reach(arcs.select("segment_id", F.col("dst").alias("state"), F.col("src").alias("to")), final)
    kept = arcs.join(ahead.withColumnRenamed("state", "src"), ["segment_id", "src"], "left_semi")
    return kept.join(behind.withColumnRenamed("state", "dst"), ["segment_id", "dst"], "left_semi").select(*arcs.columns)


def trim_ordered(arcs: DataFrame) -> DataFrame:
    """Arcs on a way from the least to the largest state of a segment, where arcs lead to larger states: one pass over each segment's sorted arcs in arrays."""
    rows = F.sort_array(F.collect_list(F.struct("src", "dst")))
    least, most = F.array_min(F.transform("_arcs", lambda a: a["src"])), F.array_max(F.transform("_arcs", lambda a: a["dst"]))

    def walk(order: Column, start: Column, come: str, go: str) -> Column:
        return F.aggregate(order, F.array(start), lambda seen, a: F.when(F.array_contains(seen, a[come]) & ~F.array_contains(seen, a[go]), F.array_append(seen, a[go])).otherwise(seen))

    backwards = F.reverse(F.array_sort(F.transform("_arcs", lambda a: F.struct(a["dst"].alias("dst"), a["src"].alias("src")))))
    grouped = arcs.groupBy("segment_id").agg(rows.alias("_arcs")).select("segment_id", walk(F.col("_arcs"), least, "src", "dst").alias("_from"), walk(backwards, most, "dst", "src").alias("_to"))
    return arcs.join(grouped, "segment_id").filter(F.array_contains("_from", F.col("src")) & F.array_contains("_to", F.col("dst"))).drop("_from", "_to")


def clean_up(arcs: DataFrame) -> DataFrame:
    return trim_ordered(valid_arcs(arcs))


def remove_null_arcs(arcs: DataFrame) -> DataFrame:
    """Arcs of no length and epsilon label are taken out: their end states count as their begin states. Chains of them are followed to their head."""
    null = (F.col("start_t") == F.col("end_t")) & (F.col("label") == EPSILON)
    pairs = arcs.filter(null).groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("_null"))
    head = lambda state: F.aggregate(F.reverse(F.coalesce("_null", F.array().cast(pairs.schema["_null"].dataType))), state, lambda s, a: F.when(s == a["dst"], a["src"]).otherwise(s))
    rest = arcs.filter(~null).join(pairs, "segment_id", "left")
    return rest.withColumn("src", head(F.col("src"))).withColumn("dst", head(F.col("dst"))).drop("_null").filter("src <> dst")


def fit(arcs: DataFrame, bounds: DataFrame) -> DataFrame:
    """Times clamped to ``bounds(segment_id, start, end)``; states at its begin become the one initial state (the least), states at its end the one final state."""
    states = arcs.groupBy("segment_id").agg(F.least(F.min("src"), F.min("dst")).alias("_first"), F.greatest(F.max("src"), F.max("dst")).alias("_last"))
    placed = arcs.join(bounds.select("segment_id", F.col("start").alias("_s"), F.col("end").alias("_e")), "segment_id").join(states, "segment_id")
    placed = placed.withColumn("start_t", F.greatest("start_t", "_s")).withColumn("end_t", F.least("end_t", "_e")).filter("start_t <= end_t")
    at_start, at_end = F.col("start_t") == F.col("_s"), F.col("end_t") == F.col("_e")
    return placed.withColumn("src", F.when(at_start, F.col("_first")).otherwise(F.col("src"))).withColumn("dst", F.when(at_end, F.col("_last")).otherwise(F.col("dst"))).filter("src <> dst").select(*arcs.columns)


def unite(*lattices: DataFrame) -> DataFrame:
    """The union of lattices of one segment, with ``system``; states of the k-th are ``n * state + k``, so none are shared."""
    n = len(lattices)
    parts = [x.withColumn("src", F.col("src") * n + k).withColumn("dst", F.col("dst") * n + k).withColumn("system", F.lit(k)) for k, x in enumerate(lattices)]
    return reduce(DataFrame.unionByName, parts)


def concatenate(arcs: DataFrame, order: DataFrame) -> DataFrame:
    """The lattices of a recording's segments one after the other: ``order(segment_id, recording_id, seq)``. The end of one is the begin of the next."""
    sizes = arcs.groupBy("segment_id").agg(F.max("dst").alias("n"))
    w = Window.partitionBy("recording_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.join(order, "segment_id").select("segment_id", "recording_id", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_ahead"))
    return arcs.join(ahead, "segment_id").select("recording_id", "segment_id", (F.col("src") + F.col("_ahead")).alias("src"), (F.col("dst") + F.col("_ahead")).alias("dst"), *[c for c in arcs.columns if c not in ("segment_id", "src", "dst")])


def strings_to_lattice(segments: DataFrame, words: Column) -> DataFrame:
    """A chain of arcs for each segment's words."""
    return segments.select("segment_id", F.posexplode(words).alias("src", "label")).select("segment_id", F.col("src").cast("long").alias("src"), (F.col("src") + 1).cast("long").alias("dst"), "label")


def prune_by_posterior(arcs: DataFrame, threshold: float, most: int | None = None) -> DataFrame:
    """Arcs whose posterior is within a factor of ``exp(-threshold)`` of their segment's best, and of these the ``most`` best."""
    w = Window.partitionBy("segment_id")
    kept = arcs.withColumn("_best", F.max("posterior").over(w)).filter(F.col("posterior") >= F.col("_best") * F.exp(F.lit(-float(threshold)))).drop("_best")
    if most is None:
        return kept
    return kept.withColumn("_rank", F.row_number().over(w.orderBy(F.desc("posterior"), "src", "dst", "label"))).filter(F.col("_rank") <= most).drop("_rank")


def prune_by_rate(arcs: DataFrame, threshold: float, min_rate: float = 0.0, max_rate: float | None = None, most: int | None = None, per_second: float = 100.0) -> DataFrame:
    """Arcs whose ``-ln posterior`` is within a threshold of their segment's least, by rates of arcs for each second of a segment; ``per_second`` ticks make one.

    A segment that has no more than ``min_rate`` arcs a second is left as it is. Elsewhere the threshold (at most the segment's range) shrinks by tenths while more than ``max_rate``
    a second, or ``most``, are left, down to 0.1, and then grows by fifths while there are fewer than ``min_rate``, up to 100. A threshold of 0 or less keeps the best path alone, by ``score``.
    Scores of a segment lie on one row.
    """
    if threshold <= 0:
        path = best_path(arcs.select("segment_id", "src", "dst", "label", "score")).select("segment_id", "src", "dst", "label")
        return arcs.join(path, ["segment_id", "src", "dst", "label"], "left_semi")
    cost = -F.ln("posterior")
    w = arcs.groupBy("segment_id").agg(F.sort_array(F.collect_list(cost)).alias("_s"), ((F.max("end_t") - F.min("start_t")) / per_second).alias("_seconds"))
    least = F.element_at("_s", 1)
    few = F.floor(min_rate * F.col("_seconds"))
    many = F.lit(2**31 - 1 if most is None else most)
    if max_rate is not None:
        many = F.least(F.floor(max_rate * F.col("_seconds")), many)
    n = lambda t: F.size(F.filter("_s", lambda c: c - least <= t))
    steps = lambda ratio, end: F.sequence(F.lit(1), F.lit(max(1, math.ceil(abs(math.log(end / threshold) / math.log(ratio))) + 1)))
    shrunk = F.aggregate(steps(0.9, min(0.1, threshold)), F.least(F.lit(float(threshold)), F.element_at("_s", -1) - least), lambda t, _: F.when((n(t) > F.col("_many")) & (t > 0.1), t * 0.9).otherwise(t))
    grown = F.aggregate(steps(1.2, 100.0 * threshold / min(threshold, 0.09)), F.col("_t"), lambda t, _: F.when((n(t) < F.col("_few")) & (t < 100.0) & (t > 0), t * 1.2).otherwise(t))
    limits = w.withColumns({"_few": few, "_many": many}).withColumn("_t", shrunk)
    limits = limits.withColumn("_t", F.when(F.col("_few") > 0, grown).otherwise(F.col("_t"))).select("segment_id", ((F.lit(min_rate) > 0) & (F.size("_s") <= F.col("_few"))).alias("_whole"), least.alias("_least"), "_t")
    return arcs.join(limits, "segment_id").filter(F.col("_whole") | (cost - F.col("_least") <= F.col("_t"))).drop("_whole", "_least", "_t")


def merge_states(arcs: DataFrame, kind: str = "time") -> DataFrame:
    """Arcs between the states of equal ``time``, or of equal time and context (``full``: columns ``src_context`` and ``dst_context``); of equal arcs the one of least score is left.

    States are numbered from 0 by time and context within a segment, so arcs still lead to larger states. Arcs that begin where they end go. A segment's boundaries lie on one row.
    """
    if kind not in ("time", "full"):
        raise ValueError("states merge by time or full")
    context = (lambda side: [F.col(f"{side}_context").alias("c")]) if kind == "full" else (lambda side: [])
    begin, end = F.struct(F.col("start_t").alias("t"), *context("src")), F.struct(F.col("end_t").alias("t"), *context("dst"))
    bounds = arcs.groupBy("segment_id").agg(F.array_sort(F.array_union(F.collect_set(begin), F.collect_set(end))).alias("_bounds"))
    placed = arcs.join(bounds, "segment_id").withColumn("src", F.array_position("_bounds", begin) - 1).withColumn("dst", F.array_position("_bounds", end) - 1).drop("_bounds").filter("start_t < end_t")
    return placed.groupBy("segment_id", "src", "dst", "label").agg(F.first("start_t").alias("start_t"), F.first("end_t").alias("end_t"), F.min("score").alias("score"))


def rescore_with_lm(nbest: DataFrame, lm_scores: DataFrame, scale: float) -> DataFrame:
    """Hypotheses ``segment_id, rank, score`` ranked anew by ``score + scale * lm``: ``lm_scores(segment_id, rank, lm)``."""
    joined = nbest.join(lm_scores, ["segment_id", "rank"]).withColumn("total", F.col("score") + scale * F.col("lm"))
    return joined.withColumn("new_rank", (F.row_number().over(Window.partitionBy("segment_id").orderBy("total", "rank")) - 1).cast("long"))


def traceback_words(path: DataFrame, epsilon: str = EPSILON) -> DataFrame:
    """Timed words of a best path ``segment_id, pos, label, start_t, end_t, score``; the confidence is ``exp(-score)``."""
    return path.filter(F.col("label") != epsilon).select("segment_id", F.col("start_t").alias("start"), F.col("end_t").alias("end"), F.col("label").alias("word"), F.exp(-F.col("score")).alias("conf"), (F.row_number().over(Window.partitionBy("segment_id").orderBy("pos")) - 1).cast("long").alias("i"))


def lattice_density(arcs: DataFrame, reference: DataFrame, epsilon: str = EPSILON) -> DataFrame:
    """Arcs that are no epsilons for each token of ``reference(segment_id, n_tokens)``."""
    n = arcs.filter(F.col("label") != epsilon).groupBy("segment_id").agg(F.count("*").alias("n_arcs"))
    return reference.join(n, "segment_id", "left").select("segment_id", F.coalesce("n_arcs", F.lit(0)).alias("n_arcs"), "n_tokens", F.try_divide(F.coalesce("n_arcs", F.lit(0)), F.col("n_tokens")).alias("density"))
