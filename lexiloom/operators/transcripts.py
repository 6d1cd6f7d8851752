"""Filters and re-segmentation of transcripts: ``segments(segment_id, orth, ...)`` and ``words(recording_id, start, end, word, conf)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .counts import tokens


def strip_noise(text: Column, fillers: tuple[str, ...] = ("uh",)) -> Column:
    """Without ``[tags]`` and filler words, blanks squeezed."""
    text = F.regexp_replace(text, r"\[[^\]\[]*\]", " ")
    for filler in fillers:
        text = F.regexp_replace(text, rf"(^|[ \t\n]){filler}(?=$|[ \t\n])", "$1")
    return F.trim(F.regexp_replace(text, r"[ \t\n]+", " "))


def drop_noise_segments(segments: DataFrame) -> DataFrame:
    return segments.filter(strip_noise(F.col("orth")) != "")


def drop_empty_segments(segments: DataFrame, words: DataFrame) -> DataFrame:
    return segments.join(words.select("segment_id"), "segment_id", "left_semi")


def drop_segments_with_inner_silence(segments: DataFrame, silence: str = "[SILENCE]") -> DataFrame:
    """Drop where the silence token stands between words."""
    quoted = "\\Q" + silence + "\\E"
    return segments.filter(~F.col("orth").rlike(rf"[^ ] {quoted} [^ ]"))


def drop_low_confidence(words: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Words of segments whose mean confidence is above the threshold (a mean equal to it is dropped)."""
    good = words.groupBy("segment_id").agg(F.avg("conf").alias("mean")).filter(F.col("mean") > threshold).select("segment_id")
    return words.join(good, "segment_id", "left_semi")


def mask_low_confidence(words: DataFrame, threshold: float, mask: str = "[IGNORE]", lexicon: DataFrame | None = None) -> DataFrame:
    """Words below the threshold become the mask, once for each word of the form; with ``lexicon(orth, pron)``, once for each phoneme of the least pronunciation.

    Forms are looked up in upper case with single spaces; those that the lexicon lacks become one mask.
    """
    n = F.size(tokens(F.col("word")))
    if lexicon is not None:
        sizes = lexicon.groupBy(F.col("orth").alias("_form")).agg(F.size(F.split(F.min("pron"), " ")).alias("_n"))
        form = F.upper(F.trim(F.regexp_replace("word", " +", " ")))
        masked = F.array_join(F.array_repeat(F.lit(mask), F.coalesce("_n", F.lit(1))), " ")
        return words.withColumn("_form", form).join(sizes, "_form", "left").withColumn("word", F.when(F.col("conf") < threshold, masked).otherwise(F.col("word"))).select(*words.columns)
    return words.withColumn("word", F.when(F.col("conf") < threshold, F.array_join(F.array_repeat(F.lit(mask), n), " ")).otherwise(F.col("word")))


def map_to_unknown(words: DataFrame, threshold: float = 0.5, min_length: float = 0.2, unknown: str = "[UNKNOWN]") -> DataFrame:
    doubtful = (F.col("conf") < threshold) & (F.col("end") - F.col("start") > min_length)
    return words.withColumn("word", F.when(doubtful, unknown).otherwise(F.col("word")))


def mean_segment_confidence(words: DataFrame) -> DataFrame:
    return words.withColumn("conf", F.avg("conf").over(Window.partitionBy("segment_id")))


def covered_share(segments: DataFrame, grams: DataFrame, order: int) -> DataFrame:
    """``segment_id, coverage``: share (2 places) of words inside windows of ``order`` words that ``grams(g)`` has."""
    words = segments.select("segment_id", tokens(strip_noise(F.col("orth"))).alias("w"))
    windows = F.transform(F.sequence(F.lit(1), F.size("w") - order + 1), lambda i: F.struct(i.alias("i"), F.array_join(F.slice("w", i, order), " ").alias("g")))
    hits = words.filter(F.size("w") >= order).select("segment_id", F.size("w").alias("n"), F.explode(windows).alias("x")).select("segment_id", "n", "x.i", "x.g").join(grams, "g", "left_semi")
    starts = hits.groupBy("segment_id").agg(F.max("n").alias("n"), F.array_sort(F.collect_list("i")).alias("starts"))
    # segments without hits meet the others by id alone: words are made once
    return segments.select("segment_id").join(starts, "segment_id", "left").select("segment_id", F.coalesce(F.round(marked(F.col("starts"), order) / F.col("n"), 2), F.lit(0.0)).alias("coverage"))


def marked(starts: Column, order: int) -> Column:
    """How many places the windows from sorted starts cover: each adds its length, less what overlaps with the one before."""
    before = lambda i: F.when(i > 0, starts[F.greatest(i - 1, F.lit(0))] + order).otherwise(0)
    return F.aggregate(F.transform(starts, lambda s, i: s + order - F.greatest(s, before(i))), F.lit(0), lambda a, b: a + b)


def ngram_coverage(segments: DataFrame, reference: DataFrame, order: int) -> DataFrame:
    """``segment_id, coverage``: share (2 places) of words in windows of ``order`` words that the reference text has; shorter segments 0."""
    windows = F.transform(F.sequence(F.lit(1), F.size("w") - order + 1), lambda i: F.array_join(F.slice("w", i, order), " "))
    known = reference.select(tokens(F.col("text")).alias("w")).filter(F.size("w") >= order).select(F.explode(windows).alias("g")).distinct()
    return covered_share(segments, known, order)


def drop_uncovered_by_text(segments: DataFrame, reference: DataFrame, order: int = 3, threshold: float = 0.5, invert: bool = False) -> DataFrame:
    covered = ngram_coverage(segments, reference, order).filter(F.col("coverage") < threshold if invert else F.col("coverage") >= threshold)
    return segments.join(covered.select("segment_id"), "segment_id", "left_semi")


def drop_in_intervals(words: DataFrame, intervals: DataFrame, width: int) -> DataFrame:
    """Words that overlap no interval of their recording. Both sides are dealt to time buckets of ``width``, so nothing is a pairwise loop."""
    near = lambda df: df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    w, i = near(words.withColumn("_id", F.struct("recording_id", "start", "end", "word"))), near(intervals.select("recording_id", "start", "end")).select("recording_id", "_bucket", F.col("start").alias("_s"), F.col("end").alias("_e"))
    hit = w.join(i, ["recording_id", "_bucket"]).filter((F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end"))).select("recording_id", "start", "end", "word").distinct()
    return words.join(hit, ["recording_id", "start", "end", "word"], "left_anti")


def filter_by_score(words: DataFrame, low: float, high: float, key: str = "conf") -> DataFrame:
    return words.filter(F.col(key).between(low, high))


def filter_by_duration(segments: DataFrame, low: float, high: float) -> DataFrame:
    return segments.filter((F.col("end") - F.col("start")).between(low, high))


def keep_in_vocabulary(segments: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Segments whose every word is known."""
    unknown = segments.select("segment_id", F.explode(tokens(F.col("orth"))).alias("token")).join(vocabulary.select("token"), "token", "left_anti").select("segment_id").distinct()
    return segments.join(unknown, "segment_id", "left_anti")


def distribute_words(segments: DataFrame) -> DataFrame:
    """Words spread evenly over their segment."""
    spread = segments.select("segment_id", "start", "end", F.size(tokens(F.col("orth"))).alias("n"), F.posexplode(tokens(F.col("orth"))).alias("i", "word"))
    step = (F.col("end") - F.col("start")) / F.col("n")
    return spread.select("segment_id", "i", "word", F.round(F.col("start") + F.col("i") * step, 4).alias("start"), F.round(F.col("start") + (F.col("i") + 1) * step, 4).alias("end"))


def filter_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Number and length of removed segments and the percentage by length: one row."""
    a, b = (df.agg(F.count("*").alias(f"n_{k}"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias(f"len_{k}")) for df, k in ((before, "before"), (after, "after")))
    return a.crossJoin(b).select((F.col("n_before") - F.col("n_after")).alias("n_removed"), (F.col("len_before") - F.col("len_after")).alias("length_removed"), F.round(100 * (F.col("len_before") - F.col("len_after")) / F.col("len_before"), 4).alias("percent_removed"))


def merge_segments(segments: DataFrame, gap: float = 0) -> DataFrame:
    """The longest merges of neighbours of a recording that are at most ``gap`` apart and not empty."""
    w = Window.partitionBy("recording_id").orderBy("start")
    full = segments.filter(F.trim("orth") != "")
    far = F.coalesce(F.col("start") - F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)) > gap, F.lit(True))
    grouped = full.withColumn("_new", far.cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "orth"))), lambda x: x["orth"]), " ")
    return grouped.groupBy("recording_id", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_merged"), text.alias("orth")).drop("_run")


def segment_at_silence(words: DataFrame, silence: str, min_length: float) -> DataFrame:
    """Cut recordings in the middle of silence tokens longer than ``min_length``: ``recording_id, part, start, end, n_words``."""
    w = Window.partitionBy("recording_id").orderBy("start")
    cut = (F.col("word") == silence) & (F.col("end") - F.col("start") > min_length)
    middle = F.round(F.col("start") + (F.col("end") - F.col("start")) / 2, 4)
    marked = words.withColumn("_cut", cut).withColumn("part", F.sum(F.col("_cut").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # the first half of a cut token belongs to the part before it
    halves = marked.withColumn("_x", F.explode(F.when(F.col("_cut"), F.array(F.struct((F.col("part") - 1).alias("part"), F.col("start").cast("double").alias("s"), middle.alias("e")), F.struct(F.col("part"), middle.alias("s"), F.col("end").cast("double").alias("e")))).otherwise(F.array(F.struct(F.col("part"), F.col("start").cast("double").alias("s"), F.col("end").cast("double").alias("e"))))))
    return halves.groupBy("recording_id", "_x.part").agg(F.min("_x.s").alias("start"), F.max("_x.e").alias("end"), F.count_if(F.col("word") != silence).alias("n_words"))


def split_at_sentences(words: DataFrame, marks: list[str]) -> DataFrame:
    """Number the sentences of a recording; a mark ends its sentence."""
    w = Window.partitionBy("recording_id").orderBy("start")
    ends = F.substring("word", -1, 1).isin(marks).cast("int")
    return words.withColumn("sentence", F.coalesce(F.sum(ends).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def orth_to_phon(segments: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Words replaced by their pronunciation ``lexicon(token, phon)``; words without one are dropped."""
    spread = segments.select("segment_id", F.posexplode(tokens(F.col("orth"))).alias("i", "token")).join(lexicon.select("token", "phon"), "token")
    return spread.groupBy("segment_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "phon"))), lambda x: x["phon"]), " ").alias("phon"))
