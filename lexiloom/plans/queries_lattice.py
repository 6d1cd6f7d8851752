"""Queries of the lattice and lexicon operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.operators import counts, lattice, lexicon

from . import views
from .catalogue import query
from .queries_counts import _COUNTS


def _lattice(spark, sf_dir):
    """The slots of an order, one after the other: every arc of a slot leads from its state to the next."""
    a = views.arcs(spark, sf_dir).groupBy("segment_id", "slot", "label").agg(F.min("w").alias("w"))
    slots = a.select("segment_id", "slot").distinct().groupBy("segment_id").agg(F.array_sort(F.collect_list("slot")).alias("all"))
    return a.join(slots, "segment_id").select("segment_id", (F.array_position("all", F.col("slot")) - 1).alias("src"), F.array_position("all", F.col("slot")).alias("dst"), "label", F.col("w").cast("double").alias("score"))


_LATTICE = "lat AS (SELECT segment_id, dense_rank() OVER (PARTITION BY segment_id ORDER BY slot) - 1 AS src, label, w::DOUBLE AS score FROM (SELECT segment_id, slot, label, min(w) AS w FROM arcs GROUP BY ALL))"


@query(f"WITH {_LATTICE} SELECT segment_id, src AS pos, src, src + 1 AS dst, arg_min(label, (score, label)) AS label, min(score) AS score FROM lat GROUP BY segment_id, src", "arcs")
def best_path(spark, sf_dir):
    return lattice.best_path(_lattice(spark, sf_dir))


@query(f"WITH {_LATTICE}, b AS (SELECT segment_id, src, min(score) AS s FROM lat GROUP BY 1, 2) SELECT segment_id, sum(s) AS score FROM b GROUP BY 1", "arcs")
def n_best_first(spark, sf_dir):
    return lattice.n_best(_lattice(spark, sf_dir), 3).filter("rank = 0").select("segment_id", "score")


@query(f"WITH {_LATTICE} SELECT segment_id, src, label, round(exp(-0.1 * score) / sum(exp(-0.1 * score)) OVER (PARTITION BY segment_id, src), 5) AS posterior FROM lat", "arcs")
def arc_posteriors(spark, sf_dir):
    return lattice.arc_posteriors(_lattice(spark, sf_dir), 0.1).select("segment_id", "src", "label", F.round("posterior", 5).alias("posterior"))


_LEX = "lex AS (SELECT p_brand AS lemma, list_sort(list(DISTINCT p_name)) AS orths, list_sort(list(DISTINCT p_type)) AS prons FROM part GROUP BY 1)"


def _lexicon(spark, sf_dir, where="true"):
    p = views.read(spark, sf_dir, "part").filter(where)
    return p.groupBy(F.col("p_brand").alias("lemma")).agg(F.array_sort(F.collect_set("p_name")).alias("orths"), F.array_sort(F.collect_set("p_type")).alias("prons"))


def _flat(lex):
    return lex.select("lemma", F.array_join("orths", "|").alias("orths"), F.array_join("prons", "|").alias("prons"))


@query(f"WITH {_LEX} SELECT lemma, array_to_string(orths, '|') AS orths, array_to_string(prons, '|') AS prons FROM lex")
def lexicon_merge(spark, sf_dir):
    return _flat(lexicon.lexicon_merge(_lexicon(spark, sf_dir, "p_partkey % 2 = 0"), _lexicon(spark, sf_dir, "p_partkey % 3 > 0 OR p_partkey % 2 = 1")))


_LISTED = "(SELECT p_name FROM part WHERE p_retailprice < 910)"


@query(f"WITH {_LEX} SELECT lemma FROM lex WHERE len(list_filter(orths, lambda o: o IN {_LISTED})) > 0".replace(f"len(list_filter(orths, lambda o: o IN {_LISTED})) > 0", f"lemma IN (SELECT p_brand FROM part WHERE p_name IN {_LISTED})"))
def lexicon_intersect(spark, sf_dir):
    words = views.read(spark, sf_dir, "part").filter("p_retailprice < 910").select(F.col("p_name").alias("token"))
    return lexicon.lexicon_intersect(_lexicon(spark, sf_dir), words).select("lemma")


@query(f"WITH {_LEX} SELECT lemma FROM lex WHERE lemma NOT IN (SELECT p_brand FROM part WHERE p_name IN {_LISTED})")
def lexicon_remove(spark, sf_dir):
    words = views.read(spark, sf_dir, "part").filter("p_retailprice < 910").select(F.col("p_name").alias("token"))
    return lexicon.lexicon_remove(_lexicon(spark, sf_dir), words).select("lemma")


@query(f"WITH {_LEX} SELECT lemma, upper(array_to_string(orths, '|')) AS orths, array_to_string(prons, '|') AS prons FROM lex")
def lexicon_case(spark, sf_dir):
    return _flat(lexicon.lexicon_case(_lexicon(spark, sf_dir), "upper"))


@query(f"WITH {_LEX} SELECT count(*) AS n_lemmas, sum(len(orths))::BIGINT AS n_orths, sum(len(prons))::BIGINT AS n_prons, max(len(prons)) AS most_prons FROM lex")
def lexicon_statistics(spark, sf_dir):
    return lexicon.lexicon_statistics(_lexicon(spark, sf_dir))


@query(f"WITH {_COUNTS} SELECT c AS phoneme, sum(n)::BIGINT AS n FROM (SELECT n, unnest(string_split(token, '')) AS c FROM counts) GROUP BY 1", "doc_segments")
def phoneme_counts(spark, sf_dir):
    c = counts.token_counts(views.doc_segments(spark, sf_dir))
    lex = c.select(F.array("token").alias("orths"), F.array(F.array_join(F.split("token", ""), " ")).alias("prons"))
    return lexicon.phoneme_counts(lex, c)


@query("""WITH o AS (SELECT n_nationkey AS lemma, s AS pron, 0.2::DOUBLE AS p FROM nation, unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS t(s)), c AS (SELECT c_nationkey AS lemma, o_orderpriority AS pron, count(*)::DOUBLE AS c FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
j AS (SELECT o.lemma, o.pron, p, coalesce(c, 0) AS c, sum(coalesce(c, 0)) OVER (PARTITION BY o.lemma) AS t FROM o LEFT JOIN c USING (lemma, pron)) SELECT lemma, pron, round(greatest(CASE WHEN t > 0 THEN t / (50 + t) * c / t + (1 - t / (50 + t)) * p ELSE p END, 0.0001), 6) AS p FROM j""")
def pronunciation_update(spark, sf_dir):
    o = views.read(spark, sf_dir, "orders").join(views.read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    c = o.select(F.col("c_nationkey").alias("lemma"), F.col("o_orderpriority").alias("pron"), F.lit(1.0).alias("c"))
    names = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
    old = views.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("lemma"), F.explode(names).alias("pron"), F.lit(0.2).alias("p"))
    return lexicon.pronunciation_update(c, old, 50.0).withColumn("p", F.round("p", 6))
