"""Queries of frame errors, confidences and system combination. Words are the lines of an order, three frames apart and up to six long."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.operators import confusion as op
from lexiloom.operators import counts, evaluate, slots

from . import views
from .catalogue import query

_W = """w AS (SELECT l_orderkey AS segment_id, l_linenumber * 3 AS start, l_linenumber * 3 + min(l_partkey) % 7 AS "end", max(l_returnflag) AS word, sum(l_quantity::BIGINT)::BIGINT AS q FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
_FRAMES = f"""{_W}, fw AS (SELECT segment_id, t AS slot, word AS label, sum(q)::BIGINT AS q FROM w, unnest(range(start::BIGINT, "end"::BIGINT)) AS u(t) GROUP BY ALL), cn AS (SELECT segment_id, slot, label, q / sum(q) OVER (PARTITION BY segment_id, slot) AS posterior FROM fw)"""
_ERRORS = f"""{_FRAMES}, ex AS (SELECT segment_id, start, "end", word, t FROM w, unnest(range(start::BIGINT, "end"::BIGINT)) AS u(t)), f AS (SELECT ex.segment_id, start, "end", word, sum(coalesce(posterior, 0)) AS mass, max(coalesce(posterior, 0)) AS top FROM ex LEFT JOIN cn ON cn.segment_id = ex.segment_id AND cn.slot = t AND cn.label = word GROUP BY ALL),
e AS (SELECT w.segment_id, w.start, w."end", w.word, coalesce(top, 1.0) AS confidence, coalesce(("end" - start - mass) / (1 + 0.05 * ("end" - start - 1)), 0.0) AS error FROM w LEFT JOIN f USING (segment_id, start, "end", word))"""


def _words(spark, sf_dir):
    li = views.order_lines(spark, sf_dir)
    start = (F.col("l_linenumber") * 3).cast("long")
    return li.select(F.col("l_orderkey").alias("segment_id"), start.alias("start"), (start + F.col("part") % 7).alias("end"), F.col("flag").alias("word"), "quantity")


def _frame_cn(spark, sf_dir):
    w = _words(spark, sf_dir)
    return slots.frame_cn(w.select("segment_id", F.col("word").alias("label"), F.col("start").alias("start_t"), F.col("end").alias("end_t"), F.col("quantity").alias("posterior")))


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"""WITH {_W}, h AS (SELECT segment_id, start + 1 AS start, "end" + 1 AS "end", word FROM w), hit AS (SELECT h.segment_id, h.start, h."end", h.word, sum(greatest(least(h."end", w."end") - greatest(h.start, w.start), 0)) AS same FROM h JOIN w ON w.segment_id = h.segment_id AND w.word = h.word AND w."end" > w.start GROUP BY ALL)
SELECT segment_id, start, "end", word, ("end" - start - coalesce(same, 0))::BIGINT AS errors, round(CASE WHEN "end" > start THEN ("end" - start - coalesce(same, 0)) / (1 + 0.1 * ("end" - start - 1)) ELSE 0.0 END, 6) AS error FROM h LEFT JOIN hit USING (segment_id, start, "end", word)""")
def frame_error(spark, sf_dir):
    w = _words(spark, sf_dir).drop("quantity")
    moved = w.withColumn("start", F.col("start") + 1).withColumn("end", F.col("end") + 1)
    return _rounded(op.frame_error(moved, w, 0.1, 8), "error")


@query(f'WITH {_ERRORS} SELECT segment_id, start, "end", word, round(error, 6) AS error FROM e')
def expected_frame_error(spark, sf_dir):
    return _rounded(op.expected_frame_error(_words(spark, sf_dir).drop("quantity"), _frame_cn(spark, sf_dir), 0.05), "error")


@query(f'WITH {_ERRORS} SELECT segment_id, start, "end", word, round(confidence, 6) AS confidence FROM e')
def word_confidence(spark, sf_dir):
    return _rounded(op.word_confidence(_words(spark, sf_dir).drop("quantity"), _frame_cn(spark, sf_dir)), "confidence")


@query(f'WITH {_ERRORS} SELECT segment_id, start, "end", word, round(error, 6) AS error, round(confidence, 6) AS confidence FROM e')
def frame_cn_features(spark, sf_dir):
    return _rounded(op.frame_cn_features(_words(spark, sf_dir).drop("quantity"), _frame_cn(spark, sf_dir)), "error", "confidence")


@query(f"""WITH {_ERRORS}, n AS (SELECT segment_id, (start // 3 + k) % 2 AS rank, error FROM e, unnest([0, 1]) AS t(k) WHERE k = 0 OR start % 2 = 0), t AS (SELECT segment_id, rank, round(sum(error), 6) AS error FROM n GROUP BY 1, 2)
SELECT segment_id, arg_min(rank, (error, rank))::BIGINT AS rank, min(error) AS error FROM t GROUP BY 1""")
def min_frame_error_decode(spark, sf_dir):
    w = _words(spark, sf_dir).drop("quantity")
    both = w.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).filter("k = 0 OR start % 2 = 0").withColumn("rank", ((F.floor(F.col("start") / 3) + F.col("k")) % 2).cast("long")).drop("k")
    return _rounded(op.min_frame_error_decode(both, _frame_cn(spark, sf_dir), 0.05), "error")


@query("""WITH n AS (SELECT conv_id AS segment_id, turn AS rank, regexp_replace(text, '[^ -~]', '', 'g') AS words FROM conversations), p AS (SELECT *, 1.0::DOUBLE / (1 + rank) AS posterior FROM n), r AS (SELECT a.segment_id, a.rank, a.words, sum(b.posterior * levenshtein(a.words, b.words)) AS risk FROM p a JOIN p b USING (segment_id) GROUP BY 1, 2, 3)
SELECT segment_id, arg_min(rank, (round(risk, 6), rank)) AS rank, round(min(risk), 4) AS risk FROM r GROUP BY 1""")
def mbr_nbest(spark, sf_dir):
    c = views.read(spark, sf_dir, "conversations")
    n = c.select(F.col("conv_id").alias("segment_id"), F.col("turn").alias("rank"), F.regexp_replace("text", "[^ -~]", "").alias("words"), (F.lit(1.0) / (1 + F.col("turn"))).alias("posterior"))
    return op.mbr_nbest(n).select("segment_id", "rank", F.round("risk", 4).alias("risk"))


@query(f"""WITH {_FRAMES}, ex AS (SELECT segment_id, start, "end", word, t FROM w, unnest(range(start::BIGINT, "end"::BIGINT)) AS u(t)), c AS (SELECT ex.segment_id, start, "end", word, arg_min(t, (-coalesce(posterior, 0), t)) AS centre FROM ex LEFT JOIN cn ON cn.segment_id = ex.segment_id AND cn.slot = t AND cn.label = word GROUP BY ALL),
d AS (SELECT DISTINCT segment_id, centre FROM c), g AS (SELECT *, coalesce(centre - lag(centre) OVER w > 1, true)::INT AS n FROM d WINDOW w AS (PARTITION BY segment_id ORDER BY centre)), s AS (SELECT segment_id, centre, (sum(n) OVER (PARTITION BY segment_id ORDER BY centre) - 1)::BIGINT AS slot FROM g)
SELECT segment_id, start, "end", word, centre, slot FROM c JOIN s USING (segment_id, centre)""")
def word_slots(spark, sf_dir):
    w = _words(spark, sf_dir).select("segment_id", F.col("word").alias("label"), F.col("start").alias("start_t"), F.col("end").alias("end_t"))
    return op.word_slots(w, _frame_cn(spark, sf_dir)).select("segment_id", "start", "end", "word", "centre", "slot")


def _pairs(spark, sf_dir):
    s = views.segments(spark, sf_dir).select("segment_id", "speaker_id", "condition_id", counts.tokens(F.col("orth")).alias("ref"))
    return s.withColumn("hyp", F.transform(F.filter("ref", lambda w: F.length(w) != 4), lambda w: F.when(F.length(w) == 3, F.upper(w)).otherwise(w)))


_T = r"list_filter(regexp_split_to_array(orth, '[ \t\n]+'), lambda x: x <> '')"


@query(f"""WITH p AS (SELECT segment_id, {_T} AS r FROM segments), x AS (SELECT segment_id, i, r[i] AS a, len(r[i]) AS n FROM p, unnest(range(1, len(r) + 1)) AS t(i)), v AS (SELECT DISTINCT r FROM (SELECT unnest({_T}) AS r FROM doc_segments)),
m AS (SELECT a NOT IN (SELECT r FROM v) AS o, n = 4 AS d, n = 3 AND upper(a) <> a AS s FROM x) SELECT CASE WHEN o THEN 'oov' ELSE 'iv' END AS region, 0 AS n_ins, count(*) FILTER (d) AS n_del, count(*) FILTER (s) AS n_sub, count(*) AS n_tokens FROM m GROUP BY 1""", "segments", "doc_segments")
def oov_split_errors(spark, sf_dir):
    """The hypothesis lacks words of length 4 and changes those of length 3; the alignment is made of the words themselves, so the errors are known."""
    words = views.segments(spark, sf_dir).select("segment_id", F.posexplode(counts.tokens(F.col("orth"))).alias("pos", "a"))
    n = F.length("a")
    kind = F.when(n == 4, "del").when((n == 3) & (F.upper("a") != F.col("a")), "sub").otherwise("ok")
    vocabulary = counts.token_counts(views.doc_segments(spark, sf_dir)).select("token")
    return op.oov_split_errors(words.withColumn("op", kind), vocabulary)


@query(f"""WITH p AS (SELECT segment_id, {_T} AS r FROM segments), x AS (SELECT segment_id, len(list_filter(r, lambda w: length(w) % 3 = 1)) AS bad, len(r) AS n FROM p) SELECT segment_id, bad::DOUBLE AS cost FROM x""", "segments")
def oracle_error(spark, sf_dir):
    """A slot for each word, with the word in upper case and, for two of three lengths, itself. Words of length 1, 4, 7, ... are missed where they stand."""
    s = views.segments(spark, sf_dir).select("segment_id", counts.tokens(F.col("orth")).alias("words"))
    spread = s.select("segment_id", F.posexplode("words").alias("slot", "w"))
    entries = F.when(F.length("w") % 3 == 1, F.array(F.concat(F.lit("#"), "w"))).otherwise(F.array("w", F.concat(F.lit("#"), "w")))
    cn = spread.select("segment_id", F.col("slot").cast("long").alias("slot"), F.explode(entries).alias("label"), F.lit(0.5).alias("posterior"))
    return op.oracle_error(cn, s)


@query(f"""WITH p AS (SELECT segment_id, {_T} AS r FROM segments) SELECT segment_id, len(list_filter(r, lambda w: length(w) % 3 = 1)) AS errors, len(r) AS n_tokens FROM p WHERE len(r) > 0""", "segments")
def graph_error_rate(spark, sf_dir):
    """Two arcs for each word: the word marked, and, for two of three lengths, the word itself: the best path misses the others."""
    s = views.segments(spark, sf_dir).select("segment_id", counts.tokens(F.col("orth")).alias("words"))
    spread = s.select("segment_id", F.posexplode("words").alias("src", "w"))
    entries = F.when(F.length("w") % 3 == 1, F.array(F.concat(F.lit("#"), "w"))).otherwise(F.array("w", F.concat(F.lit("#"), "w")))
    arcs = spread.select("segment_id", F.col("src").cast("long").alias("src"), (F.col("src") + 1).cast("long").alias("dst"), F.explode(entries).alias("label"))
    return op.graph_error_rate(arcs, s)


@query(f"""WITH p AS (SELECT segment_id, {_T} AS r FROM segments) SELECT segment_id, array_to_string(r, ' ') AS words FROM p""", "segments")
def rover(spark, sf_dir):
    """Three systems, each of which has other words wrong: two of three are right everywhere."""
    s = views.segments(spark, sf_dir).select("segment_id", counts.tokens(F.col("orth")).alias("ref"))
    wrong = lambda k: F.transform("ref", lambda w, i: F.when(i % 3 == k, F.concat(F.lit(f"#{k}"), w)).otherwise(w))
    hyps = s.select("segment_id", F.posexplode(F.array(*(wrong(k) for k in range(3)))).alias("system", "words"))
    hyps = hyps.withColumn("confidences", F.transform("words", lambda w: F.lit(0.9)))
    return op.rover(hyps, [1.0, 1.0, 1.0]).select("segment_id", F.array_join("words", " ").alias("words"))


@query(f"""WITH p AS (SELECT segment_id, {_T} AS r FROM segments), x AS (SELECT segment_id, list_filter(r, lambda w: length(w) <> 4) AS h, r FROM p) SELECT segment_id, len(r) AS n_tokens, len(r) - len(h) AS errors FROM x""", "segments")
def phoneme_errors(spark, sf_dir):
    """Phonemes are the words of the orthography here: a lexicon maps every word to itself, and words of length 4 are not pronounced by the hypothesis."""
    p = _pairs(spark, sf_dir).withColumn("hyp", F.filter("ref", lambda w: F.length(w) != 4))
    lexicon = counts.token_counts(views.segments(spark, sf_dir)).select("token", F.col("token").alias("phon"))
    e = evaluate.phoneme_errors(p, lexicon)
    return e.select("segment_id", "n_tokens", (F.col("n_ins") + F.col("n_del") + F.col("n_sub")).alias("errors"))
