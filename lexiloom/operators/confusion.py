"""Errors and decisions over frame-wise posteriors, confusion slots and n-best lists.

``words(segment_id, start, end, word)`` have whole-number times, ``end`` exclusive; ``frame_cn(segment_id, slot, label, posterior)`` has one slot a frame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.tables import dealt, slices

EPSILON = "*EPS*"


def smoothed(errors: Column, duration: Column, alpha: float) -> Column:
    """``e / (1 + alpha (d - 1))``; nothing for an empty span."""
    return F.when(duration > 0, errors / (1 + alpha * (duration - 1))).otherwise(0.0)


def frame_error(hyp: DataFrame, ref: DataFrame, alpha: float, width: int = 1000) -> DataFrame:
    """For each hypothesis word the frames whose reference label differs, and the smoothed error.

    Words meet where they share a time bucket and the label; the part of a pair in a bucket counts there, so no overlap counts twice.
    """
    bucket = lambda df: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.greatest(F.col("end"), F.col("start") + 1) - 1) / width))))
    r = bucket(ref.filter("end > start")).select("segment_id", "_b", "word", F.col("start").alias("_s"), F.col("end").alias("_e"))
    low, high = F.greatest("start", "_s", F.col("_b") * width), F.least("end", "_e", (F.col("_b") + 1) * width)
    same = bucket(hyp).join(r, ["segment_id", "_b", "word"]).groupBy("segment_id", "start", "end", "word").agg(F.sum(F.greatest(high - low, F.lit(0))).alias("same"))
    out = hyp.join(same, ["segment_id", "start", "end", "word"], "left")
    duration = F.col("end") - F.col("start")
    errors = duration - F.coalesce("same", F.lit(0))
    return out.select("segment_id", "start", "end", "word", errors.alias("errors"), smoothed(errors, duration, alpha).alias("error"))


def _over_frames(words: DataFrame, frame_cn: DataFrame, *sums: Column) -> DataFrame:
    """Words with aggregates of the posterior of their own label over their frames (``posterior`` is 0 where the label is absent)."""
    keys = ["segment_id", "start", "end", "word"]
    frames = words.select(*keys).distinct().filter("end > start").withColumn("slot", F.explode(F.sequence("start", F.col("end") - 1)))
    own = frame_cn.select("segment_id", F.col("slot"), F.col("label").alias("word"), "posterior")
    found = frames.join(own, ["segment_id", "slot", "word"], "left").fillna(0.0, "posterior").groupBy(*keys).agg(*sums)
    return words.join(found, keys, "left")


def expected_frame_error(words: DataFrame, frame_cn: DataFrame, alpha: float) -> DataFrame:
    """``duration - sum of the label's posteriors``, smoothed."""
    duration = F.col("end") - F.col("start")
    out = _over_frames(words, frame_cn, F.sum("posterior").alias("_mass"))
    return out.withColumn("error", smoothed(duration - F.coalesce("_mass", F.lit(0.0)), duration, alpha)).drop("_mass")


def word_confidence(words: DataFrame, frame_cn: DataFrame) -> DataFrame:
    """The greatest posterior of the word's label over its frames; 1 for an empty span."""
    out = _over_frames(words, frame_cn, F.max("posterior").alias("confidence"))
    return out.withColumn("confidence", F.when(F.col("end") <= F.col("start"), 1.0).otherwise(F.coalesce("confidence", F.lit(0.0))))


def frame_cn_features(words: DataFrame, frame_cn: DataFrame, gamma: float = 1.0, alpha: float = 0.05) -> DataFrame:
    """Both of them in one pass, after an optional gamma correction of the slots."""
    if gamma != 1.0:
        raised = frame_cn.withColumn("posterior", F.pow("posterior", F.lit(gamma)))
        frame_cn = raised.withColumn("posterior", F.col("posterior") / F.sum("posterior").over(Window.partitionBy("segment_id", "slot")))
    duration = F.col("end") - F.col("start")
    out = _over_frames(words, frame_cn, F.sum("posterior").alias("_mass"), F.max("posterior").alias("confidence"))
    out = out.withColumn("error", smoothed(duration - F.coalesce("_mass", F.lit(0.0)), duration, alpha)).drop("_mass")
    return out.withColumn("confidence", F.when(duration <= 0, 1.0).otherwise(F.coalesce("confidence", F.lit(0.0))))


def min_frame_error_decode(nbest: DataFrame, frame_cn: DataFrame, alpha: float = 0.05, nonwords: list[str] | None = None, nonword_alpha: float = 0.05) -> DataFrame:
    """Of each segment's hypotheses ``segment_id, rank, start, end, word`` the one with the least expected smoothed frame error; of equals the better rank."""
    words = expected_frame_error(nbest.select("segment_id", "start", "end", "word").distinct(), frame_cn, alpha)
    if nonwords:
        other = expected_frame_error(words.filter(F.col("word").isin(nonwords)).drop("error"), frame_cn, nonword_alpha)
        words = words.filter(~F.col("word").isin(nonwords)).unionByName(other)
    totals = nbest.join(words, ["segment_id", "start", "end", "word"]).groupBy("segment_id", "rank").agg(F.sum("error").alias("error"))
    return totals.groupBy("segment_id").agg(F.min(F.struct("error", "rank")).alias("m")).select("segment_id", "m.rank", "m.error")


def mbr_nbest(nbest: DataFrame) -> DataFrame:
    """The hypothesis ``segment_id, rank, words, posterior`` with the least posterior-weighted letter distance to the others; of equals the better rank.

    Lists are short (their length is an argument of the n-best search), so pairs are made within a segment's list alone.
    """
    # distances take long and rows are few: as many tasks as shuffles have, whatever the size of the rows; every pair is compared once
    tasks = int(nbest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = nbest.select("segment_id", "rank", "words", "posterior").repartition(tasks, "segment_id")
    b = a.select("segment_id", F.col("rank").alias("_r"), F.col("words").alias("_w"), F.col("posterior").alias("_p"))
    pairs = a.join(b, "segment_id").filter((F.struct("rank", "words") < F.struct(F.col("_r").alias("rank"), F.col("_w").alias("words"))) & (F.col("words") != F.col("_w")))
    pairs = pairs.withColumn("_d", F.levenshtein("words", "_w"))
    both = F.array(F.struct("rank", "words", (F.col("_p") * F.col("_d")).alias("risk")), F.struct(F.col("_r").alias("rank"), F.col("_w").alias("words"), (F.col("posterior") * F.col("_d")).alias("risk")))
    own = nbest.select("segment_id", "rank", "words", F.when(F.col("words").isNotNull(), F.col("posterior") * 0.0).alias("risk"))
    parts = pairs.select("segment_id", F.explode(both).alias("x")).select("segment_id", "x.*").unionByName(own)
    risk = parts.groupBy("segment_id", "rank", "words").agg(F.sum("risk").alias("risk"))
    return risk.groupBy("segment_id").agg(F.min(F.struct("risk", "rank", "words")).alias("m")).select("segment_id", "m.rank", "m.words", "m.risk")


def word_slots(arcs: DataFrame, frame_cn: DataFrame) -> DataFrame:
    """A slot for each word arc ``segment_id, label, start_t, end_t``: its frame with the greatest posterior of the label is its centre; words with overlapping
    centres of one segment, no further than a frame apart, share a slot."""
    words = arcs.select("segment_id", F.col("start_t").alias("start"), F.col("end_t").alias("end"), F.col("label").alias("word"))
    centred = _over_frames(words, frame_cn, F.max(F.struct("posterior", (-F.col("slot")).alias("t"))).alias("_c")).filter("_c IS NOT NULL")
    centred = centred.select("segment_id", "start", "end", "word", (-F.col("_c.t")).alias("centre"), F.col("_c.posterior").alias("posterior"))
    # the slots of a segment are runs of its distinct centres
    centres = centred.select("segment_id", "centre").distinct()
    w = Window.partitionBy("segment_id").orderBy("centre")
    far = F.coalesce(F.col("centre") - F.lag("centre").over(w) > 1, F.lit(True)).cast("int")
    numbered = centres.withColumn("_new", far).withColumn("slot", (F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long")).drop("_new")
    return centred.join(numbered, ["segment_id", "centre"])


def slot_costs(cn_labels: list[dict[str, float]], word: str, kind: str, alpha: float) -> np.ndarray:
    """The cost of a reference word in every slot; slots are maps of labels to posteriors."""
    out = np.empty(len(cn_labels))
    for k, slot in enumerate(cn_labels):
        if kind == "oracle-error":
            out[k] = 0.0 if word in slot else 1.0
        elif kind == "weighted":
            out[k] = (1 + sum(p > slot[word] or (p == slot[word] and w < word) for w, p in slot.items())) ** alpha if word in slot else 100.0
        else:
            out[k] = 1.0 - slot[word] if word in slot else 100.0
    return out


def oracle_error(cn: DataFrame, ref: DataFrame, kind: str = "oracle-error", alpha: float = 1.0, epsilon: str = EPSILON) -> DataFrame:
    """``segment_id, cost``: the least cost of aligning ``ref(segment_id, words)`` with the slots. A slot without a word costs what epsilon costs there, a word without a slot 1 (or 100).

    Slots and words of a segment lie on one row; a batch of segments goes through numpy at a time, one row of costs in memory.
    """
    slots = cn.groupBy("segment_id", "slot").agg(F.map_from_entries(F.collect_list(F.struct("label", "posterior"))).alias("entries"))
    lined = slots.groupBy("segment_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", F.map_entries("entries").alias("e")))), lambda s: s["e"]).alias("slots"))
    joined = ref.select("segment_id", "words").join(lined, "segment_id", "left")
    missing = 1.0 if kind == "oracle-error" else 100.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            costs = []
            for words, entries in zip(batch.column("words").to_pylist(), batch.column("slots").to_pylist(), strict=True):
                found = [{e["key"]: e["value"] for e in s} for s in entries or []]
                skip = np.cumsum(np.concatenate([[0.0], slot_costs(found, epsilon, kind, alpha)]))
                row = skip
                for word in words or []:
                    best = row + missing
                    best[1:] = np.minimum(best[1:], row[:-1] + slot_costs(found, word, kind, alpha))
                    row = np.minimum.accumulate(best - skip) + skip
                costs.append(float(row[-1]))
            yield pa.RecordBatch.from_arrays([batch.column("segment_id"), pa.array(costs, pa.float64())], names=["segment_id", "cost"])

    return joined.select("segment_id", "words", "slots").mapInArrow(run, f"segment_id {cn.schema['segment_id'].dataType.simpleString()}, cost double")


def graph_error_rate(arcs: DataFrame, ref: DataFrame) -> DataFrame:
    """``segment_id, errors, n_tokens``: the least edit distance of ``ref(segment_id, words)`` to any path from a segment's least to its largest state.

    Arcs lead to larger states; a segment's arcs lie sorted on one row, with a vector of costs by reference position for each state.
    """
    lined = arcs.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "label"))).alias("arcs"))
    joined = ref.select("segment_id", "words").join(lined, "segment_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            errors, sizes = [], []
            for words, found in zip(batch.column("words").to_pylist(), batch.column("arcs").to_pylist(), strict=True):
                steps, ref_words = np.arange(len(words) + 1), np.array(words, object)
                state = {found[0]["src"]: steps.astype(np.int64)}
                for arc in found:
                    here = state.get(arc["src"])
                    if here is None:
                        continue
                    best = here + 1
                    best[1:] = np.minimum(best[1:], here[:-1] + (ref_words != arc["label"]))
                    best = np.minimum.accumulate(best - steps) + steps
                    state[arc["dst"]] = np.minimum(best, state[arc["dst"]]) if arc["dst"] in state else best
                errors.append(int(state[max(a["dst"] for a in found)][-1]))
                sizes.append(len(words))
            yield pa.RecordBatch.from_arrays([batch.column("segment_id"), pa.array(errors, pa.int64()), pa.array(sizes, pa.int64())], names=["segment_id", "errors", "n_tokens"])

    return joined.select("segment_id", "words", "arcs").mapInArrow(run, f"segment_id {arcs.schema['segment_id'].dataType.simpleString()}, errors long, n_tokens long")


def oov_split_errors(alignment: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Errors of ``segment_id, pos, a, b, op`` in regions next to words outside the vocabulary (``oov``) and elsewhere (``iv``).

    A reference word is in the region if it is outside; the flag spreads from there over insertions on both sides.
    """
    known = vocabulary.select(F.col("token").alias("a"), F.lit(True).alias("_known"))
    own = alignment.join(known, "a", "left").withColumn("_out", F.when(F.col("a").isNotNull(), F.col("_known").isNull()))
    w = Window.partitionBy("segment_id")
    before = F.last("_out", ignorenulls=True).over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("_out", ignorenulls=True).over(w.orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0))
    flagged = own.withColumn("_before", before).withColumn("_after", after)
    region = F.when(F.coalesce("_before", F.lit(False)) | F.when(F.col("a").isNull(), F.coalesce("_after", F.lit(False))).otherwise(F.lit(False)), "oov").otherwise("iv")
    counted = flagged.withColumn("region", F.when(F.col("a").isNotNull(), F.when(F.col("_out"), "oov").otherwise("iv")).otherwise(region))
    return counted.groupBy("region").agg(*(F.count_if(F.col("op") == o).alias(f"n_{o}") for o in ("ins", "del", "sub")), F.count_if(F.col("a").isNotNull()).alias("n_tokens"))


#: Cells of a slot alignment that are kept at once; beyond, some rows are kept and those between made again. Segments of at most ``BAND`` words in all systems are aligned many at a time.
SLOT_CELLS, BAND = 1 << 24, 1000


def align_slots(sub: Callable[[int], np.ndarray], ins: np.ndarray, dele: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost pairs (word, slot), -1 for none: ``sub(i)`` are word i's costs in all slots, ``ins`` those of words without slot, ``dele`` those of slots without word.

    Of equal ways a pair comes before a slot alone, that before a word alone. Every word may meet every slot; ``sub`` may be asked for a word more than once.
    """
    i, j = len(ins), len(dele)
    skip = np.concatenate([[0.0], np.cumsum(dele)])

    def after(row: np.ndarray, word: int) -> tuple[np.ndarray, np.ndarray]:
        """The row of costs after a word, and those of ways that end with a pair."""
        paired = np.concatenate([[np.inf], row[:-1] + sub(word)[: len(row) - 1]])
        return np.minimum.accumulate(np.minimum(paired, row + ins[word]) - skip[: len(row)]) + skip[: len(row)], paired

    out, kept = [], [(0, skip)]  # rows from which the way back is still to be found, with the words before them
    while kept:
        start, row = kept.pop()
        row = row[: j + 1]  # no cell depends on one behind it
        if i - start > 1 and (i - start) * len(row) > SLOT_CELLS:
            gap = -(-(i - start) // max(2, SLOT_CELLS // (8 * len(row))))  # a kept cell has eight bytes
            for word in range(start, i):
                if (word - start) % gap == 0:
                    kept.append((word, row))
                    if word + gap >= i:
                        break
                row, _ = after(row, word)
            continue
        back = []
        for word in range(start, i):
            new, paired = after(row, word)
            left = np.concatenate([[np.inf], new[:-1] + dele[: len(new) - 1]])
            near = lambda x: (new == x) | (np.abs(new - x) <= 1e-9)  # noqa: B023, E731  differences of a thousandth count
            back.append(np.where(near(paired), 0, np.where(near(left), 1, 2)).astype(np.int8))
            row = new
        while i > start:
            step = int(back[i - 1 - start][j])
            i, j = i - (step != 1), j - (step != 2)
            out.append((i if step != 1 else -1, j if step != 2 else -1))
    return [(-1, k) for k in range(j)] + out[::-1]


def align_many(sub: Callable[[int], np.ndarray], ins: np.ndarray, dele: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``align_slots`` of many pairs at once, as rows: the words and the slots of the pairs, -1 for none and after the last, and the numbers of pairs.

    Rows are padded to the most words and slots; a cell depends on none behind it, so what stands there does not matter.
    """
    each, skip = np.arange(len(n)), np.concatenate([np.zeros((len(n), 1)), np.cumsum(dele, axis=1)], axis=1)
    never, row = np.full((len(n), 1), np.inf), skip
    back = np.empty((ins.shape[1], *skip.shape), np.int8)
    for i in range(ins.shape[1]):
        paired = np.concatenate([never, row[:, :-1] + sub(i)], axis=1)
        new = np.minimum.accumulate(np.minimum(paired, row + ins[:, i, None]) - skip, axis=1) + skip
        left = np.concatenate([never, new[:, :-1] + dele], axis=1)
        back[i] = np.where(np.abs(new - paired) <= 1e-9, 0, np.where(np.abs(new - left) <= 1e-9, 1, 2))
        row = new
    i, j, words, slots = n.copy(), m.copy(), [], []
    while (going := (i > 0) | (j > 0)).any():
        step = np.where(i == 0, 1, back[i - 1, each, j] if len(back) else 1)
        i, j = i - (going & (step != 1)), j - (going & (step != 2))
        words.append(np.where(going & (step != 1), i, -1))
        slots.append(np.where(going & (step != 2), j, -1))
    if not words:
        return np.zeros((len(n), 0), np.int64), np.zeros((len(n), 0), np.int64), np.zeros(len(n), np.int64)
    words, slots = np.stack(words, axis=1), np.stack(slots, axis=1)
    sizes = ((words >= 0) | (slots >= 0)).sum(axis=1)
    at = sizes[:, None] - 1 - np.arange(words.shape[1])  # pairs were found from the end
    turned = lambda x: np.where(at >= 0, np.take_along_axis(x, np.maximum(at, 0), axis=1), -1)
    return turned(words), turned(slots), sizes


def alike(sizes: np.ndarray, cells: int = 1 << 20) -> Iterator[np.ndarray]:
    """Places of segments of like ``sizes``, so that a group padded to its largest has about ``cells`` cells of a square of that size."""
    order, at = np.argsort(sizes, kind="stable")[::-1], 0
    while at < len(order):
        step = max(1, cells // (int(sizes[order[at]]) + 1) ** 2)
        yield order[at : at + step]
        at += step


def rover(hyps: DataFrame, weights: list[float], alpha: float = 0.0, null_confidence: float = 0.7, cost: str = "unit", per_second: float = 100.0) -> DataFrame:
    """Combination of systems ``segment_id, system, words, confidences[, starts, ends]`` (arrays) by progressive alignment: the words of the best score in each slot.

    Each system is aligned to the slots so far. Costs are of ``unit`` (a word that a slot has 0, else 1), of ``words`` (another word 4, a word or slot alone 3, a slot that may be empty 0.001 alone) or of
    ``times``: the seconds between the words' begins and their ends, 0.001 more for another word; alone a word costs its length and 0.003, a slot the least of its entries, 0.002 for an empty one.
    With the latter two, a slot of nothing but empty entries costs 0.001 less than the word alone. In a slot, system i scores its word with
    ``alpha w_i + (1 - alpha) w_i c_i / sum_j w_j c_j``, a missing word with the null confidence. Of equal scores the first word wins, nothing before words.
    """
    if cost not in ("unit", "words", "times"):
        raise ValueError("costs are unit, words or times")
    fields = ["system", "words", "confidences", *(["starts", "ends"] if cost == "times" else [])]
    systems = F.array_sort(F.collect_list(F.struct(*fields)))
    grouped = dealt(hyps, "segment_id").groupBy("segment_id").agg(systems.alias("systems"))  # tasks by rows of work, not by bytes of shuffles

    def combine(systems: list[dict]) -> list[str]:
        number = {w: k for k, w in enumerate(dict.fromkeys(["", *(w for s in systems for w in s["words"])]))}
        names = list(number)
        # a slot is a column: the word (0 for none), confidence, begin and end of every system so far
        words, sure = np.zeros((0, 0), np.int64), np.zeros((0, 0))
        begin, end = np.zeros((0, 0)), np.zeros((0, 0))
        for k, system in enumerate(systems):
            own = np.array([number[w] for w in system["words"]], np.int64)
            c = np.array(system["confidences"], float)
            s, e = (np.array(system[f], float) / per_second if cost == "times" else np.zeros(len(own)) for f in ("starts", "ends"))
            empty = words == 0
            if cost == "unit":
                ins, dele = np.ones(len(own)), np.where(empty.any(axis=0), 0.0, 1.0)
                sub = lambda i: np.where((words == own[i]).any(axis=0), 0.0, 1.0)  # noqa: B023, E731
            else:
                ins = np.full(len(own), 3.0) if cost == "words" else e - s + 0.003
                each = np.where(empty, 0.001, 3.0) if cost == "words" else np.where(empty, 0.002, end - begin + 0.003)
                dele = each.min(axis=0, initial=np.inf)

                def sub(i: int) -> np.ndarray:
                    other = words != own[i]  # noqa: B023
                    between = 4.0 * other if cost == "words" else np.abs(begin - s[i]) + np.abs(end - e[i]) + 0.001 * other  # noqa: B023
                    least = np.where(empty, np.inf, between).min(axis=0, initial=np.inf)  # noqa: B023
                    return np.where(np.isinf(least), ins[i] - 0.001, least)  # noqa: B023

            pairs = align_slots(sub, ins, dele) if k else [(i, -1) for i in range(len(own))]
            at_word, at_slot = np.array(pairs, np.int64).reshape(-1, 2).T
            grown = lambda old, new, missing: np.concatenate([np.where(at_slot >= 0, old[:, at_slot], missing) if old.size else np.full((k, len(pairs)), missing), np.where(at_word >= 0, new[at_word], missing)[None] if len(new) else np.full((1, len(pairs)), missing)])  # noqa: B023, E731
            words, sure, begin, end = grown(words, own, 0), grown(sure, c, null_confidence), grown(begin, s, 0.0), grown(end, e, 0.0)
        out = []
        for slot, confidence in zip(words.T.tolist(), sure.T.tolist(), strict=True):
            total = sum(w * c for w, c in zip(weights, confidence, strict=True)) or 1.0
            scores: dict[str, float] = {}
            for w, word, c in zip(weights, slot, confidence, strict=True):
                scores[names[word]] = scores.get(names[word], 0.0) + alpha * w + (1 - alpha) * w * c / total
            word = min(scores, key=lambda x: (-round(scores[x], 12), x))
            out += [word] if word else []
        return out

    def combine_units(group: list[list[dict]]) -> list[list[str]]:
        """``combine`` of segments of all systems at unit costs, as rows."""
        number = {w: k for k, w in enumerate(dict.fromkeys(["", *(w for systems in group for s in systems for w in s["words"])]))}
        names, each = list(number), np.arange(len(group))[:, None]
        words, sure, m = np.zeros((0, len(group), 0), np.int64), np.zeros((0, len(group), 0)), np.zeros(len(group), np.int64)
        for k in range(len(weights)):
            n = np.array([len(systems[k]["words"]) for systems in group])
            own, c = np.zeros((len(group), n.max()), np.int64), np.zeros((len(group), n.max()))
            filled = np.arange(n.max()) < n[:, None]
            own[filled] = [number[w] for systems in group for w in systems[k]["words"]]
            c[filled] = [x for systems in group for x in systems[k]["confidences"]]
            if k:
                sub = lambda i: np.where((words == own[:, i, None]).any(axis=0), 0.0, 1.0)  # noqa: B023, E731
                at_word, at_slot, m = align_many(sub, np.ones(own.shape), np.where((words == 0).any(axis=0), 0.0, 1.0), n, m)
            else:
                at_word, at_slot, m = np.where(filled, np.arange(n.max()), -1), np.full(own.shape, -1), n

            def grown(old: np.ndarray, new: np.ndarray, missing: float) -> np.ndarray:
                padded = [np.concatenate([x, np.full((len(group), 1), missing)], axis=1) for x in (*old, new)]  # place -1 is the missing one
                return np.stack([*(x[each, at_slot] for x in padded[:-1]), padded[-1][each, at_word]])  # noqa: B023

            words, sure = grown(words, own, 0).astype(np.int64), grown(sure, c, null_confidence)
        total = sum(w * c for w, c in zip(weights, sure, strict=True))
        total = np.where(total == 0, 1.0, total)
        votes = [alpha * w + (1 - alpha) * w * c / total for w, c in zip(weights, sure, strict=True)]
        scores = np.stack([sum(np.where(other == word, vote, 0.0) for other, vote in zip(words, votes, strict=True)) for word in words])
        best = np.take_along_axis(words, scores.argmax(axis=0)[None], axis=0)[0]
        for b, slot in zip(*np.nonzero(((scores >= scores.max(axis=0) - 1e-11) & (words != best)).any(axis=0) & (np.arange(best.shape[1]) < m[:, None])), strict=True):  # nearly equal scores
            best[b, slot] = min(words[:, b, slot], key=lambda x: (-round(float(scores[list(words[:, b, slot]).index(x), b, slot]), 12), names[x]))  # noqa: B023
        return [[names[w] for w in row[:size] if w] for row, size in zip(best.tolist(), m.tolist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = batch.column("systems").to_pylist()
            sizes = np.array([sum(len(s["words"]) for s in systems) for systems in rows])
            together = np.array([cost == "unit" and len(systems) == len(weights) for systems in rows]) & (sizes <= BAND)
            found: list[list[str]] = [[]] * len(rows)
            for k in np.flatnonzero(~together):
                found[k] = combine(rows[k])
            small = np.flatnonzero(together)
            for group in alike(sizes[small]):
                for k, words in zip(small[group], combine_units([rows[k] for k in small[group]]), strict=True):
                    found[k] = words
            yield pa.RecordBatch.from_arrays([batch.column("segment_id"), pa.array(found, pa.list_(pa.string()))], names=["segment_id", "words"])

    return grouped.mapInArrow(run, f"segment_id {hyps.schema['segment_id'].dataType.simpleString()}, words array<string>")


def _over_labels(slots: list[dict[str, float]], number: dict[str, int]) -> np.ndarray:
    out = np.zeros((len(slots), len(number)))
    for k, slot in enumerate(slots):
        out[k, [number[x] for x in slot]] = list(slot.values())
    return out


def combine_aligned_cns(cns: list[DataFrame], weights: list[float], epsilon: str = EPSILON) -> DataFrame:
    """``segment_id, slot, label, posterior`` of several systems whose slots are aligned first: the weighted sum of posteriors, normalised, in slots from 0.

    Systems are aligned one after the other to the slots so far. Two slots cost one less the chance that they agree; a slot without partner costs one less
    its share of ``epsilon``, which then takes the weight of the system that has nothing there. Of equal ways slots are paired first. A segment's slots are small and in one row.
    """
    marked = [c.select("segment_id", F.lit(k).alias("system"), "slot", "label", "posterior") for k, c in enumerate(cns)]
    whole = F.array_sort(F.collect_list(F.struct("system", "slot", "label", "posterior")))
    grouped = dealt(reduce(DataFrame.unionByName, marked), "segment_id").groupBy("segment_id").agg(whole.alias("entries"))

    def combine(entries: list[dict]) -> list[dict[str, float]]:
        so_far: list[dict[str, float]] = []
        weight_so_far = 0.0
        for system, own in groupby(entries, key=lambda e: e["system"]):
            new = [{e["label"]: e["posterior"] for e in slot} for _, slot in groupby(own, key=lambda e: e["slot"])]
            weight = weights[system]
            if not so_far:  # nothing to align with
                so_far, weight_so_far = [{label: weight * p for label, p in slot.items()} for slot in new], weight
                continue
            before = weight_so_far or 1.0
            a, b = so_far[0], new[0]
            if len(so_far) == len(new) == 1 and sum(p * b.get(label, 0.0) for label, p in a.items()) / before >= a.get(epsilon, 0.0) / before + b.get(epsilon, 0.0) - 1:  # a pair costs no more than both alone
                pairs = [(0, 0)]
            else:
                # slots as rows over the labels that both have: all pair costs are one product
                number = {label: k for k, label in enumerate(dict.fromkeys([epsilon, *(x for slot in (*so_far, *new) for x in slot)]))}
                old, own_slots = _over_labels(so_far, number) / before, _over_labels(new, number)
                agree = old @ own_slots.T
                pairs = align_slots(lambda j: 1 - agree[:, j], 1 - own_slots[:, 0], 1 - old[:, 0])  # noqa: B023
            merged = []
            for j, i in pairs:
                a = so_far[i] if i >= 0 else {epsilon: weight_so_far} if weight_so_far else {}
                b = new[j] if j >= 0 else {epsilon: 1.0}
                merged.append({label: a.get(label, 0.0) + weight * b.get(label, 0.0) for label in {**a, **b}})
            so_far, weight_so_far = merged, weight_so_far + weight
        return so_far

    kind = cns[0].schema["segment_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = zip(batch.column("segment_id").to_pylist(), map(combine, batch.column("entries").to_pylist()), strict=True)
            rows = [(segment, k, label, p) for segment, slots in found for k, slot in enumerate(slots) for label, p in slot.items() if p > 0]
            columns = zip(*rows, strict=True) if rows else ([], [], [], [])
            types = (batch.schema.field("segment_id").type, pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["segment_id", "slot", "label", "posterior"])

    out = grouped.mapInArrow(run, f"segment_id {kind}, slot long, label string, posterior double")
    return out.withColumn("posterior", F.col("posterior") / F.sum("posterior").over(Window.partitionBy("segment_id", "slot")))
