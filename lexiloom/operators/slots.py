"""Alignment tables ``segment_id, t, label, weight``, confusion slots ``segment_id, slot, label, posterior`` and arc scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.tables import dealt, written
from lexiloom.functions.windows import runs


def combine_items(alignment: DataFrame, how: str = "sum") -> DataFrame:
    """Collapse equal (t, label): ``sum``, ``min`` or ``log`` (-ln of the sum of exp(-w))."""
    w = {"sum": F.sum("weight"), "min": F.min("weight"), "log": F.min("weight") - F.ln(F.sum(F.exp(-F.col("weight"))) / F.exp(-F.min("weight")))}[how]
    return alignment.groupBy("segment_id", "t", "label").agg(w.alias("weight"))


def expm(weight: Column) -> Column:
    return F.when(weight == float("inf"), 0.0).otherwise(F.exp(-weight))


def filter_weights(alignment: DataFrame, low: float, high: float) -> DataFrame:
    return alignment.filter(F.col("weight").between(low, high))


def add_weight(weight: Column, c: float) -> Column:
    return weight + c


def multiply_weights(weight: Column, c: float) -> Column:
    return weight * c


def reset_weights(weight: Column, value: float = 1.0) -> Column:
    """Every weight becomes the value; a missing one stays missing."""
    return F.when(weight.isNotNull(), F.lit(value))


def clip_weights(weight: Column, low: float, high: float) -> Column:
    return F.when(weight < low, F.lit(low)).when(weight > high, F.lit(high)).otherwise(weight)


def gamma_correct(weight: Column, gamma: float) -> Column:
    return F.when(weight == 0, 0.0).otherwise(F.pow(weight, F.lit(gamma)))


def normalise_weights(alignment: DataFrame) -> DataFrame:
    return alignment.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy("segment_id", "t")))


def shift_min_to_zero(alignment: DataFrame) -> DataFrame:
    return alignment.withColumn("weight", F.col("weight") - F.min("weight").over(Window.partitionBy("segment_id", "t")))


def multiply_alignments(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("weight", "_w"), ["segment_id", "t", "label"]).select("segment_id", "t", "label", (F.col("weight") * F.col("_w")).alias("weight"))


def map_labels(alignment: DataFrame, mapping: DataFrame) -> DataFrame:
    """Weights summed by the mapped labels ``mapping(label, to)``. The mapping is written, so that Spark knows its size and moves no rows to their labels, which are few, if it is small."""
    return dealt(alignment.join(written(mapping, "labels"), "label"), "segment_id").groupBy("segment_id", "t", F.col("to").alias("label")).agg(F.sum("weight").alias("weight"))


def set_weights_by_tied_state(single: DataFrame, multiple: DataFrame, tied: DataFrame) -> DataFrame:
    """Items of the ``single`` path weighted by all items of ``multiple`` at their time whose labels share their ``tied(label, state)``; 0 without such."""
    keys, tied = ["segment_id", "t", "state"], written(tied, "states")  # Spark then knows its size, as in map_labels
    sums = dealt(multiple.join(tied, "label"), *keys).groupBy(*keys).agg(F.sum("weight").alias("_sum"))
    own = dealt(single.drop("weight").join(tied, "label", "left"), *keys).join(sums, keys, "left")
    return own.select("segment_id", "t", "label", F.coalesce("_sum", F.lit(0.0)).alias("weight"))


def time_offset(alignment: DataFrame, k: int) -> DataFrame:
    return alignment.withColumn("t", F.col("t") + k)


def confidence_mask(alignment: DataFrame, threshold: float) -> DataFrame:
    return alignment.withColumn("mask", (F.col("weight") >= threshold).cast("int"))


def label_selection(alignment: DataFrame, keep: list[str]) -> DataFrame:
    """Share of kept frames for each segment."""
    return alignment.groupBy("segment_id").agg(F.count_if(F.col("label").isin(keep)).alias("kept"), F.count("*").alias("n"))


def word_spans(alignment: DataFrame) -> DataFrame:
    """Runs of equal labels as spans ``[start, end)``."""
    numbered = runs(alignment, ["segment_id"], ["t"], "label")
    return numbered.groupBy("segment_id", "run").agg(F.first("label").alias("label"), F.min("t").alias("start"), (F.max("t") + 1).alias("end"))


def posteriors_to_alignment(arcs: DataFrame) -> DataFrame:
    """Arc posteriors on every frame they cover, summed for each (t, label)."""
    return arcs.filter("end_t > start_t").select("segment_id", "label", "posterior", F.explode(F.sequence("start_t", F.col("end_t") - 1)).alias("t")).groupBy("segment_id", "t", "label").agg(F.sum("posterior").alias("weight"))


# confusion slots


def normalise_cn(cn: DataFrame) -> DataFrame:
    return cn.withColumn("posterior", F.col("posterior") / F.sum("posterior").over(Window.partitionBy("segment_id", "slot")))


def frame_cn(arcs: DataFrame) -> DataFrame:
    """``p(label | t)``: posteriors of the arcs that cover a frame, normalised."""
    return normalise_cn(posteriors_to_alignment(arcs).select("segment_id", F.col("t").alias("slot"), "label", F.col("weight").alias("posterior")))


def decode_cn(cn: DataFrame) -> DataFrame:
    """Best label of every slot; of equals the first in the alphabet."""
    return cn.groupBy("segment_id", "slot").agg(F.min(F.struct((-F.col("posterior")).alias("p"), "label")).alias("m")).select("segment_id", "slot", "m.label", (-F.col("m.p")).alias("posterior"))


def prune_cn(cn: DataFrame, mass: float, most: int, renormalise: bool = True) -> DataFrame:
    """Keep entries while the mass before them is below ``mass`` and there are fewer than ``most``."""
    w = Window.partitionBy("segment_id", "slot").orderBy(F.desc("posterior"), "label")
    kept = cn.withColumn("_before", F.coalesce(F.sum("posterior").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("_rank", F.row_number().over(w)).filter((F.col("_before") < mass) & (F.col("_rank") <= most)).drop("_before", "_rank")
    return normalise_cn(kept) if renormalise else kept


def drop_epsilon_slots(cn: DataFrame, epsilon: str, threshold: float) -> DataFrame:
    """Remove slots whose epsilon mass is above the threshold and renumber the rest from 0."""
    w = Window.partitionBy("segment_id", "slot")
    kept = cn.withColumn("_e", F.sum(F.when(F.col("label") == epsilon, F.col("posterior")).otherwise(0.0)).over(w)).filter(F.col("_e") <= threshold).drop("_e")
    return kept.withColumn("slot", F.dense_rank().over(Window.partitionBy("segment_id").orderBy("slot")) - 1)


def slot_entropy(cn: DataFrame) -> DataFrame:
    p = F.col("posterior")
    return cn.groupBy("segment_id", "slot").agg(F.sum(F.when(p > 0, -p * F.log2(p)).otherwise(0.0)).alias("entropy"))


def combine_cns(cns: list[DataFrame], weights: list[float], how: str = "sum") -> DataFrame:
    """Weighted sum or maximum of the posteriors of several systems over equal slots."""
    parts = [c.withColumn("posterior", F.col("posterior") * w) for c, w in zip(cns, weights, strict=True)]
    value = F.sum("posterior") if how == "sum" else F.max("posterior")
    return normalise_cn(dealt(reduce(DataFrame.unionByName, parts), "segment_id").groupBy("segment_id", "slot", "label").agg(value.alias("posterior")))


def gamma_correct_cn(cn: DataFrame, gamma: float) -> DataFrame:
    return normalise_cn(cn.withColumn("posterior", F.pow("posterior", F.lit(gamma))))


def cn_features(cn: DataFrame) -> DataFrame:
    """Each entry's confidence, -ln, entropy of its slot and rank in it."""
    w = Window.partitionBy("segment_id", "slot")
    p = F.col("posterior")
    return cn.withColumn("score", -F.ln(p)).withColumn("entropy", F.sum(F.when(p > 0, -p * F.log2(p)).otherwise(0.0)).over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("posterior"), "label")))


def concatenate_cns(cn: DataFrame, order: DataFrame) -> DataFrame:
    """Stack the slots of a recording's segments; ``order(segment_id, recording_id, seq)``."""
    sizes = cn.groupBy("segment_id").agg((F.max("slot") + 1).alias("n")).join(order, "segment_id")
    w = Window.partitionBy("recording_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select("segment_id", "recording_id", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("ahead"))
    return cn.join(ahead, "segment_id").select("recording_id", (F.col("slot") + F.col("ahead")).alias("slot"), "label", "posterior")


# arcs with score maps


def score_map(arcs: DataFrame, keys: dict[str, str]) -> DataFrame:
    return arcs.withColumn("scores", F.create_map(*(x for k, c in keys.items() for x in (F.lit(k), F.col(c).cast("double")))))


def rescale(scores: Column, scales: dict[str, float]) -> Column:
    """Multiply by the key's scale; keys without one go."""
    return F.transform_values(F.map_filter(scores, lambda k, v: k.isin(list(scales))), lambda k, v: v * reduce(lambda e, kv: F.when(k == kv[0], kv[1]).otherwise(e), scales.items(), F.lit(1.0)))


def change_semiring(scores: Column, keys: list[str], missing: float = 0.0) -> Column:
    """The scores of the new dimensions ``keys`` by name, untouched; those that there were not have ``missing``, old ones that are not asked for go."""
    return F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*(F.coalesce(F.try_element_at(scores, F.lit(k)), F.lit(float(missing))) for k in keys)))


def project_score(scores: Column, scales: dict[str, float]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.element_at(scores, k), F.lit(0.0)) * s for k, s in scales.items()])


def score_reduce(scores: Column, first: str, others: dict[str, float], first_scale: float = 1.0) -> Column:
    """The scaled scores of the others are added to the first (in its scale), the others become 0: the total stays."""
    moved = F.element_at(scores, first) + project_score(scores, others) / first_scale
    return F.transform_values(scores, lambda k, v: F.when(k == first, moved).otherwise(F.when(k.isin(list(others)), 0.0).otherwise(v)))


def prune_by_score(arcs: DataFrame, score: str, threshold: float) -> DataFrame:
    """Arcs within ``threshold`` of their segment's least score."""
    return arcs.filter(F.lit(True)).withColumn("_least", F.min(score).over(Window.partitionBy("segment_id"))).filter(F.col(score) <= F.col("_least") + threshold).drop("_least")


def lattice_info(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy("segment_id").agg(F.count("*").alias("n_arcs"), F.count_distinct("slot").alias("n_slots"), F.min("w").alias("best"))


def mesh(arcs: DataFrame) -> DataFrame:
    """One arc for each (slot, label) with its least score."""
    return arcs.groupBy("segment_id", "slot", "label").agg(F.min("w").alias("w"))


def filter_arcs(arcs: DataFrame, labels: DataFrame, invert: bool = False) -> DataFrame:
    return arcs.join(labels.select("label"), "label", "left_anti" if invert else "left_semi")


def vocab_of(arcs: DataFrame) -> DataFrame:
    return arcs.select("label").distinct()
