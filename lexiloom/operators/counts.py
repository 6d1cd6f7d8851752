"""Token, character and vocabulary statistics; back-off n-gram models as tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.tables import slices, written

from . import packed_ngrams


def tokens(text: Column) -> Column:
    """The tokens between runs of spaces, tabs and line breaks; empty ones are left out."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n]+"), lambda t: t != "")


#: Tokens that a task counts before it hands them on.
TOKENS = 1 << 21


def token_counts(segments: DataFrame) -> DataFrame:
    """Counts of ``tokens``. Arrow counts those of some megabytes of text at once, so no row is made for each occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 6 * TOKENS):  # about six letters a token
            text = part.column("orth")
            for blank in "\t\n":
                text = pc.replace_substring(text, blank, " ")
            token, n = pc.split_pattern(text, " ").flatten().value_counts().flatten()
            yield pa.RecordBatch.from_arrays([token, n], names=["token", "n"]).filter(pc.not_equal(token, ""))

    return segments.select("orth").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def add_counts(*counts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, counts).groupBy("token").agg(F.sum("n").alias("n"))


def count_summary(counts: DataFrame) -> DataFrame:
    return counts.agg(F.count("*").alias("n_distinct"), F.sum("n").alias("n_running"), F.count_if(F.col("n") == 1).alias("n_single"))


def cutoff_counts(counts: DataFrame, least: int) -> DataFrame:
    return counts.filter(F.col("n") >= least)


def coverage_curve(counts: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Rank by (count, token), both falling, with cumulative coverage, coverage without singletons and in-vocabulary coverage.

    One range shuffle sorts the vocabulary; each task runs sums over its own part, which is written, and then the sums of the parts before it are added: a row for each part.
    """
    known = counts.withColumn("known", F.lit(1)) if vocabulary is None else counts.join(vocabulary.select("token", F.lit(1).alias("known")), "token", "left").fillna(0, "known")
    order = [F.desc("n"), F.desc("token")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums = TaskContext.get().partitionId(), np.zeros(3, np.int64)
        for batch in batches:
            n = batch.column("n").to_numpy()
            steps = np.stack([np.ones_like(n), n, n * batch.column("known").to_numpy()]).cumsum(axis=1) + sums[:, None]
            if len(n):
                sums = steps[:, -1]
                yield pa.RecordBatch.from_arrays([batch.column("token"), pa.array(n), pa.array(np.full(len(n), part, np.int32)), *map(pa.array, steps)], names=["token", "n", "part", "rank", "covered", "seen"])

    ordered = known.select("token", F.col("n").cast("long").alias("n"), F.col("known").cast("long").alias("known")).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ordered.mapInArrow(run, "token string, n long, part int, rank long, covered long, seen long"), "coverage")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = placed.groupBy("part").agg(*(F.max(c).alias(c) for c in ("rank", "covered", "seen")))
    ahead = ends.select("part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("rank", "covered", "seen")))
    totals = placed.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeated"))
    joined = placed.join(F.broadcast(ahead), "part").crossJoin(F.broadcast(totals))  # a row for each part; one row
    covered = F.col("covered") + F.col("covered0")
    share = lambda x, of: F.round(F.try_divide(x, F.col(of)), 6)
    return joined.select("token", "n", (F.col("rank") + F.col("rank0")).alias("rank"), share(covered, "total").alias("coverage"), share(F.least(covered, F.col("repeated")), "repeated").alias("coverage_repeated"), share(F.col("seen") + F.col("seen0"), "total").alias("coverage_known"))


def vocabulary_by_coverage(counts: DataFrame, target: float) -> DataFrame:
    """Tokens of the smallest count cut whose cumulative sum reaches ``target`` of the tokens that are not singletons; ties stay."""
    levels = counts.groupBy("n").agg((F.count("*") * F.col("n")).alias("mass"))
    running = F.sum("mass").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0))
    goal = levels.agg((F.sum(F.when(F.col("n") > 1, F.col("mass")).otherwise(0)) * target).alias("goal"))
    cut = levels.withColumn("running", running).crossJoin(F.broadcast(goal)).filter("running >= goal").agg(F.max("n").alias("cut"))
    return counts.crossJoin(F.broadcast(cut)).filter(F.col("n") >= F.col("cut")).select("token", "n")


def character_report(counts: DataFrame, charset: str) -> DataFrame:
    """Characters weighted by word counts; ``outside`` flags those not in ``charset``."""
    chars = counts.select(F.explode(F.split("token", "")).alias("c"), "n")
    return chars.groupBy("c").agg(F.sum("n").alias("n")).withColumn("outside", ~F.lit(charset).contains(F.col("c")))


def missing_words(counts: DataFrame, lexicon: DataFrame) -> DataFrame:
    return counts.join(lexicon.select("token"), "token", "left_anti")


def oov_report(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Out-of-vocabulary tokens and rate: one row."""
    marked = counts.join(vocabulary.select("token", F.lit(True).alias("known")), "token", "left")
    unknown = F.col("known").isNull()
    return marked.agg(F.sum(F.when(unknown, F.col("n")).otherwise(0)).alias("n_unknown"), F.sum("n").alias("n_tokens"), F.count_if(unknown).alias("unknown_types")).withColumn("rate", F.round(F.col("n_unknown") / F.col("n_tokens"), 6))


# n-gram models: ngrams(order, history, word, n | score, backoff); histories are joined by a blank, scores are -ln


def _unkeyed(keyed: DataFrame) -> DataFrame:
    single = F.col("order") == 1
    return keyed.select("order", F.when(single, F.col("last")).otherwise(F.col("key")).alias("history"), F.when(single, F.col("key")).otherwise(F.col("last")).alias("word"), *(c for c in keyed.columns if c not in ("order", "key", "last")))


def _totals(keyed: DataFrame) -> DataFrame:
    own = Window.partitionBy("order", "key")
    return _unkeyed(keyed.withColumn("total", F.sum("n").over(own)).withColumn("types", F.count("*").over(own)))


def _words(segments: DataFrame) -> packed_ngrams.Words:
    return packed_ngrams.Words(unigram_counts(token_counts(segments), segments))


def ngram_counts(segments: DataFrame, order: int) -> DataFrame:
    """Counts of all n-grams up to ``order`` over token sequences padded with ``<s>`` and ``</s>``."""
    return packed_ngrams.ngram_counts(segments, order, _words(segments))


def unigram_counts(counts: DataFrame, segments: DataFrame) -> DataFrame:
    """``ngram_counts`` of order 1 from the token counts of the segments, each of which has one end."""
    ends = segments.agg(F.count("*").alias("n")).filter("n > 0").select(F.lit("</s>").alias("token"), "n")
    return add_counts(counts, ends).select(F.lit(1).alias("order"), F.lit("").alias("history"), F.col("token").alias("word"), "n")


def count_of_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("order", "n").agg(F.count("*").alias("types"))


def history_totals(counts: DataFrame) -> DataFrame:
    """Counts with the ``total`` and the ``types`` of the n-gram's history, but for the empty history; written, as a model reads them several times."""
    single = F.col("order") == 1
    keyed = counts.select("order", F.when(single, F.col("word")).otherwise(F.col("history")).alias("key"), F.when(single, F.col("history")).otherwise(F.col("word")).alias("last"), "n")
    return written(_totals(keyed.repartition("order", "key")), "ngrams")


def backoff_lm(segments: DataFrame, order: int) -> DataFrame:
    """``estimate_backoff_lm`` of the ``ngram_counts`` of segments."""
    return packed_ngrams.backoff_lm(segments, order, _words(segments))


def estimate_backoff_lm(counts: DataFrame, order: int) -> DataFrame:
    """Absolute discounting, ``d = n1 / (n1 + 2 n2)`` for each order; the mass that is freed goes to the next shorter history.

    ``score`` is -ln p(word | history) with the back-off estimate interpolated, ``backoff`` is -ln of the weight of the n-gram as a history.
    The longest n-grams, which are most, are shuffled once, to meet their shorter ones: no n-gram is longer, so they are no histories.
    """
    counts = history_totals(counts)
    sums = counts.groupBy("order").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"))
    empty = counts.filter("order = 1").agg(F.sum("n").alias("total"), F.count("*").alias("types"))
    return _estimated(counts, counts.select("order", "history", "total", "types"), sums, empty, order)


def _estimated(counts: DataFrame, totals: DataFrame, sums: DataFrame, empty: DataFrame, order: int) -> DataFrame:
    """The model of some n-grams, among which are the shorter ones of each: ``counts`` with the totals of their histories, ``totals`` of histories, ``n1`` and ``n2`` of each order, totals of the empty history."""
    discounts = F.broadcast(sums.select("order", F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.0).alias("d")))  # a row for each order
    own, weight = (F.col("n") - F.col("d")) / F.col("total"), F.col("d") * F.col("types") / F.col("total")
    empty = F.broadcast(empty)  # one row
    single = counts.filter("order = 1").select("order", "history", "word", "n").crossJoin(empty).join(discounts, "order")
    done = single.select("history", "word", (own + weight / F.col("types")).alias("p"))
    longer = F.instr("history", " ") > 0
    out = []
    for k in range(1, order + 1):
        if k > 1:
            first, short = F.substring_index("history", " ", 1), F.when(longer, F.expr("substring(history, instr(history, ' ') + 1)")).otherwise("")
            here = counts.filter(F.col("order") == k).select(first.alias("first"), short.alias("short"), "word", "n", "total", "types")
            joined = here.join(done.select(F.col("history").alias("short"), "word", F.col("p").alias("p_short")), ["short", "word"]).withColumn("order", F.lit(k)).join(discounts, "order")
            done = joined.select(F.concat_ws(" ", "first", F.nullif("short", F.lit(""))).alias("history"), "word", (own + weight * F.col("p_short")).alias("p"))
        scored = done
        if k < order:
            # the n-gram as a history: one row for each history of the next order, which splits into history and word
            last = F.substring_index("history", " ", -1)
            rest = F.when(longer, F.expr("substring(history, 1, length(history) - length(substring_index(history, ' ', -1)) - 1)")).otherwise("")
            weights = totals.filter(F.col("order") == k + 1).select(rest.alias("history"), last.alias("word"), "total", "types").distinct().withColumn("order", F.lit(k + 1)).join(discounts, "order")
            scored = done.join(weights.select("history", "word", weight.alias("weight")), ["history", "word"], "left")
        else:
            scored = done.withColumn("weight", F.lit(None).cast("double"))
        out.append(scored.select(F.lit(k).alias("order"), "history", "word", (-F.ln("p")).alias("score"), F.coalesce(-F.ln("weight"), F.lit(0.0)).alias("backoff")))
    return reduce(DataFrame.unionByName, out)


def _asked_model(counts: DataFrame, order: int) -> DataFrame:
    """The model of ``packed_ngrams.asked_counts``."""
    sums = counts.filter("history IS NULL")
    empty = sums.filter("order = 1").agg(F.sum("n").alias("total"), F.sum("grams").alias("types"))
    sums = sums.groupBy("order").agg(F.sum("total").alias("n1"), F.sum("types").alias("n2"))
    return _estimated(counts.filter("word IS NOT NULL"), counts.filter("history IS NOT NULL AND word IS NULL"), sums, empty, order)


def score_segments(segments: DataFrame, training: DataFrame, order: int) -> DataFrame:
    """``segment_id, pos, word, score`` by the model of ``training``, of which only the n-grams that the segments ask for are scored and kept."""
    asked = packed_ngrams.asked_counts(training, order, _words(training), segments)
    return lm_score(lm_events(segments, order), written(_asked_model(asked, order), "model"), order, lambda joined: written(joined, "events"))


def successors(training: DataFrame, order: int, history: str) -> DataFrame:
    """``history_successors`` of the model of ``training``, of which only the n-grams of the history and its shorter ones are kept: ``order, history, word, score``."""
    words = history.split(" ") if history else []
    asked = packed_ngrams.asked_counts(training, order, _words(training), histories=[" ".join(words[i:]) for i in range(len(words) + 1)])
    return history_successors(_asked_model(asked, order).drop("backoff"), history)


def lm_events(segments: DataFrame, order: int) -> DataFrame:
    """``segment_id, pos, word, history`` (of at most order - 1 words) of all predicted words."""
    padded = segments.select("segment_id", F.concat(F.array(F.lit("<s>")), tokens(F.col("orth")), F.array(F.lit("</s>"))).alias("w"))
    events = F.transform(F.sequence(F.lit(2), F.size("w")), lambda e: F.struct(F.element_at("w", e).alias("word"), F.array_join(F.slice("w", F.greatest(F.lit(1), e - order + 1), F.least(F.lit(order - 1), e - 1)), " ").alias("history")))
    return padded.select("segment_id", F.posexplode(events).alias("pos", "e")).select("segment_id", "pos", "e.word", "e.history")


def lm_score(events: DataFrame, ngrams: DataFrame, order: int, between: Callable[[DataFrame], DataFrame] = lambda joined: joined) -> DataFrame:
    """Back-off score of every event: the longest history with the word wins; each shortening adds the back-off weight of the history left.

    A history without a weight adds nothing; a word that no history has scores the back-off sum alone. One join for each order, only on rows that are still open.
    ``between`` may write what each join makes, so that its shuffles are not kept beside those of the next.
    """
    models = ngrams.select("history", "word", "score")
    weights = ngrams.select(F.when(F.col("history") == "", F.col("word")).otherwise(F.concat_ws(" ", "history", "word")).alias("history"), F.col("backoff").alias("weight"))
    open_events = events.withColumn("spent", F.lit(0.0))
    done = []
    for _ in range(order):
        joined = between(open_events.join(models, ["history", "word"], "left"))
        ended = F.col("score").isNotNull() | (F.col("history") == "")
        done.append(joined.filter(ended).withColumn("score", F.col("spent") + F.coalesce("score", F.lit(0.0))))
        shorter = F.when(F.instr("history", " ") > 0, F.expr("substring(history, instr(history, ' ') + 1)")).otherwise("")
        open_events = joined.filter(~ended).drop("score").join(weights, "history", "left").withColumn("spent", F.col("spent") + F.coalesce("weight", F.lit(0.0))).drop("weight").withColumn("history", shorter)
    return reduce(DataFrame.unionByName, [d.select("segment_id", "pos", "word", "score") for d in done])


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity overall and without sentence ends, and the number of lines: one row."""
    inner = F.col("word") != "</s>"
    return scores.agg(F.round(F.exp(F.avg("score")), 4).alias("ppl"), F.round(F.exp(F.avg(F.when(inner, F.col("score")))), 4).alias("ppl_inner"), F.count_if(~inner).alias("n_lines"), F.count("*").alias("n_events"))


def sentence_perplexity(scores: DataFrame) -> DataFrame:
    """Per sentence, with its end counted, and its entropy in bits."""
    return scores.groupBy("segment_id").agg(F.round(F.exp(F.avg("score")), 4).alias("ppl"), F.round(F.avg("score") / F.ln(F.lit(2.0)), 6).alias("bits"))


def interpolate_linear(scores: list[Column], weights: list[float]) -> Column:
    return -F.ln(reduce(lambda a, b: a + b, [w * F.exp(-s) for s, w in zip(scores, weights, strict=True)]))


def interpolate_loglinear(scores: list[Column], scales: list[float]) -> Column:
    return reduce(lambda a, b: a + b, [w * s for s, w in zip(scores, scales, strict=True)])


def skip_threshold_combine(scores: list[Column], scales: list[float], threshold: float) -> Column:
    """Log-linear sum in which, once a raw score reaches the threshold, all later models reuse it."""
    used, total = scores[0], scales[0] * scores[0]
    for s, w in zip(scores[1:], scales[1:], strict=True):
        used = F.when(used >= threshold, used).otherwise(s)
        total = total + w * used
    return total


def zerogram_score(events: DataFrame, vocabulary: DataFrame) -> DataFrame:
    return events.crossJoin(F.broadcast(vocabulary.agg(F.ln(F.count("*")).alias("score"))))  # one row


def map_oov_to_unk(events: DataFrame, vocabulary: DataFrame, unk: str = "<unk>") -> DataFrame:
    known = vocabulary.select(F.col("token").alias("word"), F.lit(True).alias("_known"))
    return events.join(known, "word", "left").withColumn("word", F.when(F.col("_known"), F.col("word")).otherwise(unk)).drop("_known")


def history_successors(ngrams: DataFrame, history: str) -> DataFrame:
    return ngrams.filter(F.col("history") == history)
