"""Readers of corpus and lexicon files in XML. Corpora nest and go through ``nested_corpora``; speakers and lemmas are flat and go through Spark's own XML source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import nested_corpora

_SPEAKER = "_name string, gender string, `native-language` string, age string"
_LEMMA = "_special string, _name string, orth array<string>, phon array<struct<_VALUE: string, _score: string, _weight: string>>, synt array<struct<tok: array<string>>>, eval array<struct<tok: array<string>>>"


def _rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "_").option("valueTag", "_VALUE").option("ignoreSurroundingSpaces", "true").schema(schema).load(path)


def squeezed(text: Column) -> Column:
    """White space at the ends removed, inside as one blank."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _full_names(rows: DataFrame, corpus: str | None, remove_prefix: str) -> DataFrame:
    """``corpus_id`` and ``recording_id`` with another name of the outermost corpus, then without the prefix."""
    place = F.col("corpus_id")
    if corpus is not None:
        place = F.concat(F.lit(corpus), F.regexp_replace(place, "^[^/]*", ""))
    if remove_prefix:
        place = F.when(F.startswith(place, F.lit(remove_prefix)), F.substring(place, F.lit(len(remove_prefix) + 1), F.length(place))).otherwise(place)
    name = F.substring("recording_id", F.length("corpus_id") + 1, F.length("recording_id"))
    return rows.withColumns({"recording_id": F.concat(place, name), "corpus_id": place})


def read_corpus(spark: SparkSession, path: str, corpus: str | None = None, speaker: str | None = None, condition: str | None = None, remove_prefix: str = "", audio_dir: str | None = None) -> DataFrame:
    """Segments ``segment_id, recording_id, corpus_id, audio, i, seq, start, end, track, speaker_id, condition_id, orth, left_orth, right_orth`` of a corpus file or folder of such.

    Full names are those of all sections around: ``corpus/subcorpus/recording/segment``; ``corpus`` may rename the outermost corpus, and ``remove_prefix`` is cut off the
    corpora's part. A segment without a name is numbered from 1 within its recording, with ``+`` for each name in the way. What a segment does not name itself (speaker, condition)
    comes from the nearest section that has a default, as it is where the segment stands, else from the arguments; a speaker without a name is called by its section and ``ANONYMOUS``.
    Included files continue the section that includes them. ``i`` numbers the segments of a recording, ``seq`` all of them in file order.
    Times are seconds; an absent start is 0, an absent or infinite end null. ``audio_dir`` stands before relative names of audio files. Recordings without segments give no row.
    """
    s = _full_names(nested_corpora.sections(spark, path).filter("kind = 'segment'"), corpus, remove_prefix)
    time = lambda c: F.when(F.col(c).rlike(r"^\s*-?[0-9.]+([eE][-+]?\d+)?\s*$"), F.trim(c).cast("double"))
    audio = F.col("audio") if audio_dir is None else F.when(F.startswith("audio", F.lit("/")), F.col("audio")).otherwise(F.concat(F.lit(audio_dir.rstrip("/") + "/"), "audio"))
    return s.select(
        F.concat_ws("/", "recording_id", "name").alias("segment_id"), "recording_id", "corpus_id", audio.alias("audio"), "i", "seq", F.when(F.col("start").isNull(), 0.0).otherwise(time("start")).alias("start"), time("end").alias("end"),
        F.coalesce(F.col("track").try_cast("int"), F.lit(0)).alias("track"), F.coalesce("speaker_id", F.lit(speaker)).alias("speaker_id"), F.coalesce("condition_id", F.lit(condition)).alias("condition_id"), "orth", "left_orth", "right_orth",
    )


def read_recordings(spark: SparkSession, path: str, corpus: str | None = None, remove_prefix: str = "") -> DataFrame:
    """``recording_id, corpus_id, audio, n_segments`` of all recordings, those without segments too."""
    rows = _full_names(nested_corpora.sections(spark, path), corpus, remove_prefix)
    own = rows.groupBy("recording_id", "corpus_id").agg(F.max(F.when(F.col("kind") == "recording", F.col("audio"))).alias("audio"), F.count_if(F.col("kind") == "segment").cast("int").alias("n_segments"))
    return own.select("recording_id", "corpus_id", "audio", "n_segments")


def read_speakers(spark: SparkSession, path: str) -> DataFrame:
    """``speaker_id, gender, language, age`` of the described speakers; mere references to them have no gender and are left out."""
    s = _rows(spark, path, "speaker-description", _SPEAKER)
    return s.select(F.col("_name").alias("speaker_id"), "gender", F.col("native-language").alias("language"), F.col("age").cast("int").alias("age")).filter("speaker_id IS NOT NULL")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Lemmas ``lemma, special, orths, prons (phon, score), synt, evals``: the lemma's name is given or its first form.

    Scores may stand as ``score`` (-ln) or ``weight`` (a probability). A lemma without ``synt`` has its name as its one syntactic token; an empty one has none.
    """
    x = _rows(spark, path, "lemma", _LEMMA)
    orths = F.filter(F.transform(F.coalesce("orth", F.array().cast("array<string>")), squeezed), lambda o: o != "")
    prons = F.transform(F.coalesce("phon", F.array().cast("array<struct<_VALUE: string, _score: string, _weight: string>>")), lambda p: F.struct(squeezed(p["_VALUE"]).alias("phon"), F.coalesce(p["_score"].cast("double"), -F.ln(p["_weight"].cast("double")), F.lit(0.0)).alias("score")))
    lemma = F.coalesce(F.col("_name"), F.get(orths, 0), F.col("_special"))
    synt = F.when(F.col("synt").isNull(), F.array(lemma)).otherwise(F.coalesce(F.get("synt", 0)["tok"], F.array().cast("array<string>")))
    evals = F.transform(F.coalesce("eval", F.array().cast("array<struct<tok: array<string>>>")), lambda e: F.coalesce(e["tok"], F.array().cast("array<string>")))
    return x.select(lemma.alias("lemma"), F.col("_special").alias("special"), orths.alias("orths"), prons.alias("prons"), synt.alias("synt"), evals.alias("evals"))
