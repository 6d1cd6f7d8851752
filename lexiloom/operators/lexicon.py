"""Lexicon tables: ``lexicon(lemma, orths, prons)`` with arrays of orthographic forms and pronunciations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lexicon_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of lemmas; forms and pronunciations of common lemmas are united and sorted."""
    both = a.unionByName(b)
    return both.groupBy("lemma").agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("orths", "prons")))


def lexicon_add(a: DataFrame, b: DataFrame) -> DataFrame:
    """The union of lemmas alone: the phoneme inventory stays that of ``a``, while a merge also takes ``merge_phonemes``."""
    return lexicon_merge(a, b)


def merge_phonemes(a: DataFrame, b: DataFrame) -> DataFrame:
    """``phoneme`` of both inventories."""
    return a.select("phoneme").union(b.select("phoneme")).distinct()


def add_phrases(lexicon: DataFrame, phrases: DataFrame) -> DataFrame:
    """The lexicon and a lemma for each of ``phrases(phrase)`` all of whose words it has, with every sequence of their pronunciations.

    A phrase that is a lemma already adds nothing; a word's pronunciations are those of all lemmas with that form.
    """
    forms = lexicon.select(F.explode("orths").alias("word"), "prons").groupBy("word").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("prons")))).alias("prons"))
    words = F.split(F.trim("phrase"), r"\s+")
    parts = phrases.select("phrase").distinct().withColumn("n", F.size(words)).select("phrase", "n", F.posexplode(words).alias("i", "word")).join(forms, "word")
    whole = parts.groupBy("phrase", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "prons"))), lambda p: p["prons"]).alias("parts")).filter(F.size("parts") == F.col("n"))
    longer = lambda heads, tails: F.flatten(F.transform(heads, lambda h: F.transform(tails, lambda t: F.concat_ws(" ", h, t))))
    prons = F.aggregate(F.slice("parts", F.lit(2), F.size("parts")), F.element_at("parts", 1), longer)
    new = whole.select(F.col("phrase").alias("lemma"), F.array("phrase").alias("orths"), prons.alias("prons")).join(lexicon.select("lemma"), "lemma", "left_anti")
    return lexicon.unionByName(new)


def lexicon_intersect(lexicon: DataFrame, words: DataFrame) -> DataFrame:
    """Lemmas one of whose forms is listed in ``words(token)``."""
    hit = lexicon.select("lemma", F.explode("orths").alias("token")).join(words.select("token"), "token", "left_semi").select("lemma").distinct()
    return lexicon.join(hit, "lemma", "left_semi")


def lexicon_remove(lexicon: DataFrame, words: DataFrame) -> DataFrame:
    hit = lexicon.select("lemma", F.explode("orths").alias("token")).join(words.select("token"), "token", "left_semi").select("lemma").distinct()
    return lexicon.join(hit, "lemma", "left_anti")


def lexicon_case(lexicon: DataFrame, case: str) -> DataFrame:
    return lexicon.withColumn("orths", F.transform("orths", F.lower if case == "lower" else F.upper))


def lexicon_statistics(lexicon: DataFrame) -> DataFrame:
    """Numbers of lemmas, forms and pronunciations: one row."""
    return lexicon.agg(F.count("*").alias("n_lemmas"), F.sum(F.size("orths")).alias("n_orths"), F.sum(F.size("prons")).alias("n_prons"), F.max(F.size("prons")).alias("most_prons"))


def phoneme_counts(lexicon: DataFrame, counts: DataFrame) -> DataFrame:
    """Phonemes of the first pronunciation, weighted by ``counts(token, n)`` of the lemma's first form."""
    first = lexicon.select(F.element_at("orths", 1).alias("token"), F.explode(F.split(F.element_at("prons", 1), " ")).alias("phoneme"))
    return first.join(counts, "token").groupBy("phoneme").agg(F.sum("n").alias("n"))


def pronunciation_update(counts: DataFrame, old: DataFrame, tau: float, floor: float = 0.0001) -> DataFrame:
    """New probabilities ``lambda c / C + (1 - lambda) old`` with ``lambda = C / (tau + C)``; a lemma that was not seen keeps its own.

    ``counts(lemma, pron, c)`` are posterior-weighted, ``old(lemma, pron, p)`` the present probabilities.
    """
    summed = counts.groupBy("lemma", "pron").agg(F.sum("c").alias("c"))
    joined = old.join(summed, ["lemma", "pron"], "left").withColumn("c", F.coalesce("c", F.lit(0.0)))
    total = F.sum("c").over(Window.partitionBy("lemma"))
    share = total / (tau + total)
    return joined.select("lemma", "pron", F.greatest(F.when(total > 0, share * F.col("c") / total + (1 - share) * F.col("p")).otherwise(F.col("p")), F.lit(floor)).alias("p"))
