"""Transcripts with alternatives and optional parts, and their match against a lexicon.

A transcript is a text in which ``{a|b|c}`` stands for one of several readings and ``[a]`` for a part that may be left out; both nest. Texts are
expanded innermost first, by one regular expression a level.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.tables import dealt

from .counts import tokens

_INNER = r"\{([^{}\[\]]*)\}|\[([^{}\[\]]*)\]"


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _steps(text: Column) -> Column:
    """As many numbers as a text has brackets, so that one step for each resolves all of them."""
    n = F.length(text) - F.length(F.translate(text, "{[", ""))
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def orth_text(orth: Column) -> Column:
    """The reading of first alternatives, optional parts present, white space normalised; nesting of any depth."""
    inner = lambda t: F.regexp_replace(F.regexp_replace(t, r"\{([^{}\[\]|]*)(?:\|[^{}\[\]]*)?\}", " $1 "), r"\[([^{}\[\]]*)\]", " $1 ")
    return _squeezed(F.aggregate(_steps(orth), orth, lambda t, _: inner(t)))


def orth_variants(segments: DataFrame, column: str = "orth", most: int | None = None) -> DataFrame:
    """A row for each reading, ``variant`` numbered from 0 in the order of the alternatives, absence last.

    A step resolves the first innermost choice of every reading, and a text takes as many steps as it has brackets. A text of more than ``most`` readings, if that is given, raises an error:
    none is ever left out. A text's readings are in one row until they are spread.
    """

    def options(text: Column) -> Column:
        found = F.regexp_extract(text, _INNER, 0)
        inner = F.substring(found, F.lit(2), F.length(found) - 2)
        values = F.when(F.startswith(found, F.lit("{")), F.split(inner, r"\|")).otherwise(F.array(inner, F.lit("")))
        at = F.position(found, text)
        before, after = F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(found), F.length(text))
        return F.when(found == "", F.array(text)).otherwise(F.transform(values, lambda v: F.concat(before, F.lit(" "), v, F.lit(" "), after)))

    readings = F.aggregate(_steps(F.col(column)), F.array(F.col(column)), lambda all_of, _: F.flatten(F.transform(all_of, options)))
    if most is not None:
        readings = F.transform(F.array(readings), lambda r: F.when(F.size(r) <= most, r).otherwise(F.raise_error(F.lit(f"a text has more than {most} readings")).cast("array<string>")))[0]
    return segments.select("segment_id", F.posexplode(F.array_distinct(F.transform(readings, _squeezed))).alias("variant", "text"))


def orth_matches(segments: DataFrame, lexicon: DataFrame, longest: int) -> DataFrame:
    """Where lemmas match: ``segment_id, pos, n, lemma`` for all matches of ``lexicon(lemma, orth)`` of up to ``longest`` words at reachable positions.

    A position is reachable if a match ends before it or if the position before is reachable and no lemma matches there: such a word is skipped and shows as a row
    without lemma. Positions are swept from left to right, segment after segment; a sweep holds no more than the next ``longest`` positions.
    """
    words = segments.select("segment_id", tokens(F.col("orth")).alias("w")).filter(F.size("w") > 0)
    spans = F.flatten(F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - i)), lambda n: F.struct(i.alias("pos"), n.alias("n"), F.array_join(F.slice("w", i + 1, n), " ").alias("orth")))))
    found = words.select("segment_id", F.explode(spans).alias("x")).select("segment_id", "x.*").join(lexicon.select("lemma", "orth"), "orth", "left")
    # every position has the row of its one word, match or not
    lined = found.filter("n = 1 OR lemma IS NOT NULL").select("segment_id", "pos", "n", "lemma").repartition("segment_id").sortWithinPartitions("segment_id", "pos", "n", "lemma")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, at, ahead, kept, skipped = None, -1, set(), False, False
        for batch in batches:
            take = []
            for k, (segment, pos, n, lemma) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("segment_id", "pos", "n", "lemma")), strict=True)):
                if segment != here:
                    here, at, ahead, skipped = segment, -1, {0}, False
                if pos != at:
                    if skipped:  # the position before had no match
                        ahead.add(at + 1)
                    at, kept = pos, pos in ahead
                    ahead.discard(pos)
                    skipped = kept
                if kept and lemma is not None:
                    ahead.add(pos + n)
                    skipped = False
                if kept:
                    take.append(k)
            yield batch.take(pa.array(take, pa.int64()))

    reached = lined.mapInArrow(run, lined.schema)
    # a word's empty row stays only where nothing at all begins
    w = F.count("lemma").over(Window.partitionBy("segment_id", "pos"))
    return reached.withColumn("_n", w).filter("lemma IS NOT NULL OR _n = 0").drop("_n").select("segment_id", "pos", "n", "lemma")


def lexical_statistics(matches: DataFrame, pronunciations: DataFrame) -> DataFrame:
    """For each lemma how often it matched, its number of pronunciations and their average number of phonemes: ``pronunciations(lemma, phon)``."""
    counts = matches.filter("lemma IS NOT NULL").groupBy("lemma").agg(F.count("*").alias("n"))
    sounds = pronunciations.groupBy("lemma").agg(F.count("*").alias("n_prons"), F.avg(F.size(F.split("phon", " "))).alias("phonemes"))
    return counts.join(sounds, "lemma", "left").fillna(0, ["n_prons"])


def strange_words(counts: DataFrame, order: int, discount: float = 0.5) -> DataFrame:
    """``token, n, perplexity, rarest``: how little a word looks like the others, by an interpolated letter model with absolute discounting, trained on the types.

    ``rarest`` is one over the least letter probability. Each letter's context counts are joined order by order; the letters of a word come together once.
    """
    letters = F.concat(F.array(F.lit("<")), F.filter(F.split("token", ""), lambda c: c != ""), F.array(F.lit(">")))
    spread = counts.select("token", "n", letters.alias("l")).select("token", "n", "l", F.explode(F.sequence(F.lit(2), F.size("l"))).alias("e"))
    places = spread.select("token", "n", "e", F.element_at("l", F.col("e")).alias("c"), *(F.array_join(F.slice("l", F.greatest(F.lit(1), F.col("e") - k), F.least(F.lit(k), F.col("e") - 1)), "").alias(f"h{k}") for k in range(1, order)))
    kinds = places.agg(F.count_distinct("c").alias("_v"))  # one row
    scored = places.crossJoin(F.broadcast(kinds)).withColumn("p", 1.0 / F.col("_v")).drop("_v")
    for k in range(order):
        history = F.lit("") if k == 0 else F.col(f"h{k}")
        grams = places.groupBy(history.alias("_h"), F.col("c").alias("_c")).agg(F.count("*").alias("_n"))
        contexts = grams.groupBy(F.col("_h").alias("_g")).agg(F.sum("_n").alias("_total"), F.count("*").alias("_types"))
        joined = scored.join(grams, (history == F.col("_h")) & (F.col("c") == F.col("_c"))).join(contexts, F.col("_h") == F.col("_g"))
        scored = joined.withColumn("p", (F.col("_n") - discount) / F.col("_total") + discount * F.col("_types") / F.col("_total") * F.col("p")).drop("_h", "_c", "_n", "_g", "_total", "_types")
    return scored.groupBy("token", "n").agg(F.exp(-F.avg(F.ln("p"))).alias("perplexity"), (1 / F.min("p")).alias("rarest"))


def min_avg_max(metrics: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``keys, metric, least, mean, most, n`` of several metric columns; values that are no finite numbers are left out."""
    long = metrics.select(*keys, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(keys, columns, "metric", "value")
    good = long.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    return good.groupBy(*keys, "metric").agg(F.min("value").alias("least"), F.avg("value").alias("mean"), F.max("value").alias("most"), F.count("*").alias("n"))


def real_time_factor(runs: DataFrame) -> DataFrame:
    return runs.agg((F.sum("cpu") / F.sum("duration")).alias("factor"))


def nonspeech_parts(words: DataFrame, keys: list[str], nonspeech: list[str], min_length: float, where: Column | None = None) -> DataFrame:
    """``words`` with ``part`` from 0 within ``keys``: cut in the middle of runs of non-speech tokens, measured from the run's begin to the next speech word; only ``where`` that holds, if given."""
    w = Window.partitionBy(*keys).orderBy("start")
    quiet = F.col("word").isin(nonspeech)
    first = quiet & ~F.coalesce(F.lag(quiet).over(w), F.lit(False))
    later = Window.partitionBy(*keys).orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, -1)
    # what is later first: the other windows then share one sort
    marked = words.withColumn("_quiet", quiet).withColumn("_next", F.last(F.when(~quiet, F.col("start")), ignorenulls=True).over(later)).withColumn("_first", first)
    cut = (F.lit(True) if where is None else where) & F.col("_first") & (F.col("_next") - F.col("start") > min_length)
    middle = F.when(cut, F.col("start") + (F.col("_next") - F.col("start")) / 2)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    placed = marked.withColumn("_mid", middle).withColumn("_cuts", F.count("_mid").over(upto)).withColumn("_last", F.last("_mid", ignorenulls=True).over(upto))
    # non-speech before the middle still belongs to the part before
    part = F.when(F.col("start") < F.col("_last"), F.col("_cuts") - 1).otherwise(F.col("_cuts"))
    return placed.withColumn("part", part).drop("_quiet", "_first", "_next", "_mid", "_cuts", "_last")


def segment_at_nonspeech(words: DataFrame, nonspeech: list[str], min_length: float) -> DataFrame:
    """``recording_id, part, start, end, n_words`` of the parts of recordings between long runs of non-speech tokens, as ``nonspeech_parts`` has them."""
    parts = nonspeech_parts(words, ["recording_id"], nonspeech, min_length)
    return parts.groupBy("recording_id", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count_if(~F.col("word").isin(nonspeech)).alias("n_words"))


def segment_max_length(words: DataFrame, nonspeech: list[str], most: float, lengths: list[float]) -> DataFrame:
    """As above with falling thresholds ``lengths``: only parts that are still longer than ``most`` are cut again. ``path`` has the numbers of a word's parts, and every word is in one."""
    here = dealt(words, "recording_id").withColumn("path", F.lit("")).withColumn("_long", F.lit(True))
    for least in lengths:
        parts = nonspeech_parts(here, ["recording_id", "path"], nonspeech, least, F.col("_long"))
        here = parts.withColumn("path", F.when(F.col("_long"), F.concat_ws(".", F.nullif("path", F.lit("")), F.col("part").cast("string"))).otherwise(F.col("path"))).drop("part")
        # ordered as the next cut needs it
        w = Window.partitionBy("recording_id", "path").orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        here = here.withColumn("_long", F.col("_long") & (F.max("end").over(w) - F.min("start").over(w) > most))
    return here.groupBy("recording_id", "path").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count_if(~F.col("word").isin(nonspeech)).alias("n_words"))
