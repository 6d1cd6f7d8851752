"""Queries of the count and n-gram operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.operators import counts

from . import views
from .catalogue import query

_TOKENS = r"list_filter(regexp_split_to_array(orth, '[ \t\n]+'), lambda x: x <> '')"
_COUNTS = f"counts AS (SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS token FROM doc_segments) GROUP BY 1)"
_VOCAB = f"vocab AS (SELECT DISTINCT unnest({_TOKENS}) AS token FROM segments)"


def _doc_counts(spark, sf_dir):
    return counts.token_counts(views.doc_segments(spark, sf_dir))


def _vocabulary(spark, sf_dir):
    return counts.token_counts(views.segments(spark, sf_dir)).select("token")


@query(f"WITH {_COUNTS} SELECT * FROM counts", "doc_segments")
def token_counts(spark, sf_dir):
    return _doc_counts(spark, sf_dir)


@query(f"WITH {_COUNTS}, b AS (SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS token FROM segments) GROUP BY 1) SELECT token, sum(n)::BIGINT AS n FROM (SELECT * FROM counts UNION ALL SELECT * FROM b) GROUP BY 1", "doc_segments", "segments")
def add_counts(spark, sf_dir):
    return counts.add_counts(_doc_counts(spark, sf_dir), counts.token_counts(views.segments(spark, sf_dir)))


@query(f"WITH {_COUNTS} SELECT count(*) AS n_distinct, sum(n)::BIGINT AS n_running, count(*) FILTER (n = 1) AS n_single FROM counts", "doc_segments")
def count_summary(spark, sf_dir):
    return counts.count_summary(_doc_counts(spark, sf_dir))


@query(f"WITH {_COUNTS} SELECT * FROM counts WHERE n >= 5", "doc_segments")
def cutoff_counts(spark, sf_dir):
    return counts.cutoff_counts(_doc_counts(spark, sf_dir), 5)


@query(f"""WITH {_COUNTS}, {_VOCAB}, r AS (SELECT token, n, row_number() OVER w AS rank, sum(n) OVER w AS covered, sum(CASE WHEN token IN (SELECT token FROM vocab) THEN n ELSE 0 END) OVER w AS known,
 sum(n) OVER () AS total, sum(CASE WHEN n > 1 THEN n ELSE 0 END) OVER () AS repeated FROM counts WINDOW w AS (ORDER BY n DESC, token DESC ROWS UNBOUNDED PRECEDING))
SELECT token, n, rank, round(covered / total, 6) AS coverage, round(least(covered, repeated) / repeated, 6) AS coverage_repeated, round(known / total, 6) AS coverage_known FROM r""", "doc_segments", "segments")
def coverage_curve(spark, sf_dir):
    return counts.coverage_curve(_doc_counts(spark, sf_dir), _vocabulary(spark, sf_dir))


@query(f"""WITH {_COUNTS}, l AS (SELECT n, sum(count(*) * n) OVER (ORDER BY n DESC) AS running FROM counts GROUP BY n), g AS (SELECT sum(n) FILTER (n > 1) * 0.9 AS goal FROM counts),
cut AS (SELECT max(n) AS cut FROM l, g WHERE running >= goal) SELECT token, n FROM counts, cut WHERE n >= cut""", "doc_segments")
def vocabulary_by_coverage(spark, sf_dir):
    return counts.vocabulary_by_coverage(_doc_counts(spark, sf_dir), 0.9)


@query(f"WITH {_COUNTS} SELECT c, sum(n)::BIGINT AS n, instr('abcdefghijklmnopqrstuvwxyz', c) = 0 AS outside FROM (SELECT unnest(string_split(token, '')) AS c, n FROM counts) GROUP BY 1", "doc_segments")
def character_report(spark, sf_dir):
    return counts.character_report(_doc_counts(spark, sf_dir), "abcdefghijklmnopqrstuvwxyz")


@query(f"WITH {_COUNTS}, {_VOCAB} SELECT token, n FROM counts WHERE token NOT IN (SELECT token FROM vocab)", "doc_segments", "segments")
def missing_words(spark, sf_dir):
    return counts.missing_words(_doc_counts(spark, sf_dir), _vocabulary(spark, sf_dir))


@query(f"WITH {_COUNTS}, {_VOCAB}, m AS (SELECT n, token NOT IN (SELECT token FROM vocab) AS u FROM counts) SELECT sum(CASE WHEN u THEN n ELSE 0 END)::BIGINT AS n_unknown, sum(n)::BIGINT AS n_tokens, count(*) FILTER (u) AS unknown_types, round(sum(CASE WHEN u THEN n ELSE 0 END) / sum(n), 6) AS rate FROM m", "doc_segments", "segments")
def oov_report(spark, sf_dir):
    return counts.oov_report(_doc_counts(spark, sf_dir), _vocabulary(spark, sf_dir))


_PADDED = f"padded AS (SELECT segment_id, list_concat(['<s>'], {_TOKENS}, ['</s>']) AS w FROM SOURCE)"
_GRAMS = """grams AS (SELECT 1 AS "order", '' AS history, w[e] AS word FROM padded, unnest(range(2, len(w) + 1)) AS t(e)
 UNION ALL SELECT 2, w[e - 1], w[e] FROM padded, unnest(range(2, len(w) + 1)) AS t(e)
 UNION ALL SELECT 3, concat(w[e - 2], ' ', w[e - 1]), w[e] FROM padded, unnest(range(3, len(w) + 1)) AS t(e)),
ngrams AS MATERIALIZED (SELECT "order", history, word, count(*) AS n FROM grams GROUP BY ALL)"""
_NGRAMS = f"{_PADDED.replace('SOURCE', 'doc_segments')}, {_GRAMS}"
_LM = f"""{_NGRAMS}, d AS (SELECT "order", CASE WHEN count(*) FILTER (n = 1) > 0 THEN count(*) FILTER (n = 1) / (count(*) FILTER (n = 1) + 2 * count(*) FILTER (n = 2)) ELSE 0.0 END AS d FROM ngrams GROUP BY 1),
h AS (SELECT "order", history, sum(n) AS total, count(*) AS types FROM ngrams GROUP BY 1, 2),
parts AS (SELECT ngrams.*, (n - d) / total AS own, d * types / total AS weight FROM ngrams JOIN d USING ("order") JOIN h USING ("order", history)),
p1 AS (SELECT history, word, own + weight / (SELECT count(*) FROM ngrams WHERE "order" = 1) AS p FROM parts WHERE "order" = 1),
p2 AS (SELECT parts.history, word, own + weight * p1.p AS p FROM parts JOIN p1 USING (word) WHERE "order" = 2),
p3 AS (SELECT parts.history, parts.word, own + weight * p2.p AS p FROM parts JOIN p2 ON parts.word = p2.word AND split_part(parts.history, ' ', 2) = p2.history WHERE "order" = 3),
scored AS (SELECT 1 AS "order", * FROM p1 UNION ALL SELECT 2, * FROM p2 UNION ALL SELECT 3, * FROM p3),
lm AS MATERIALIZED (SELECT s."order", s.history, s.word, -ln(p) AS score, coalesce(-ln(w.weight), 0.0) AS backoff FROM scored s LEFT JOIN (SELECT DISTINCT "order", history, weight FROM parts) w
 ON w."order" = s."order" + 1 AND w.history = CASE WHEN s.history = '' THEN s.word ELSE concat(s.history, ' ', s.word) END)"""
_EVENTS = f"""q AS (SELECT segment_id, list_concat(['<s>'], {_TOKENS}, ['</s>']) AS w FROM segments),
events AS MATERIALIZED (SELECT segment_id, e - 2 AS pos, w[e] AS word, w[e - 1] AS h1, CASE WHEN e > 2 THEN concat(w[e - 2], ' ', w[e - 1]) END AS h2 FROM q, unnest(range(2, len(w) + 1)) AS t(e))"""
_SCORES = f"""{_LM}, {_EVENTS}, bo AS MATERIALIZED (SELECT CASE WHEN history = '' THEN word ELSE concat(history, ' ', word) END AS gram, backoff FROM lm),
scores AS (SELECT segment_id, pos, e.word, CASE WHEN a.score IS NOT NULL THEN a.score WHEN b.score IS NOT NULL THEN coalesce(ba.backoff, 0) + b.score ELSE coalesce(ba.backoff, 0) + coalesce(bb.backoff, 0) + coalesce(c.score, 0) END AS score FROM events e
 LEFT JOIN lm a ON a.history = e.h2 AND a.word = e.word AND a."order" = 3 LEFT JOIN lm b ON b.history = e.h1 AND b.word = e.word AND b."order" = 2 LEFT JOIN lm c ON c.history = '' AND c.word = e.word AND c."order" = 1
 LEFT JOIN bo ba ON ba.gram = e.h2 LEFT JOIN bo bb ON bb.gram = e.h1)"""


def _ngrams(spark, sf_dir):
    return counts.ngram_counts(views.doc_segments(spark, sf_dir), 3)


def _model(spark, sf_dir):
    return counts.backoff_lm(views.doc_segments(spark, sf_dir), 3)


def _scores(spark, sf_dir):
    return counts.score_segments(views.segments(spark, sf_dir), views.doc_segments(spark, sf_dir), 3)


@query(f"WITH {_NGRAMS} SELECT * FROM ngrams", "doc_segments")
def ngram_counts(spark, sf_dir):
    return _ngrams(spark, sf_dir)


@query(f'WITH {_NGRAMS} SELECT "order", n, count(*) AS types FROM ngrams GROUP BY 1, 2', "doc_segments")
def count_of_counts(spark, sf_dir):
    return counts.count_of_counts(_ngrams(spark, sf_dir))


@query(f'WITH {_LM} SELECT "order", history, word, round(score, 4) AS score, round(backoff, 4) AS backoff FROM lm', "doc_segments")
def estimate_backoff_lm(spark, sf_dir):
    return _model(spark, sf_dir).select("order", "history", "word", F.round("score", 4).alias("score"), F.round("backoff", 4).alias("backoff"))


@query(f"WITH {_SCORES} SELECT segment_id, pos, word, round(score, 4) AS score FROM scores", "doc_segments", "segments")
def lm_score(spark, sf_dir):
    return _scores(spark, sf_dir).withColumn("score", F.round("score", 4))


@query(f"WITH {_SCORES} SELECT round(exp(avg(score)), 4) AS ppl, round(exp(avg(score) FILTER (word <> '</s>')), 4) AS ppl_inner, count(*) FILTER (word = '</s>') AS n_lines, count(*) AS n_events FROM scores", "doc_segments", "segments")
def perplexity(spark, sf_dir):
    return counts.perplexity(_scores(spark, sf_dir))


@query(f"WITH {_SCORES} SELECT segment_id, round(exp(avg(score)), 4) AS ppl, round(avg(score) / ln(2.0), 6) AS bits FROM scores GROUP BY 1", "doc_segments", "segments")
def sentence_perplexity(spark, sf_dir):
    return counts.sentence_perplexity(_scores(spark, sf_dir))


@query(f"""WITH {_SCORES}, s AS (SELECT segment_id, pos, score AS a, 9.0::DOUBLE AS b FROM scores) SELECT segment_id, pos, round(-ln(0.7 * exp(-a) + 0.3 * exp(-b)), 4) AS linear, round(0.7 * a + 0.3 * b, 4) AS loglinear,
 round(0.7 * a + 0.3 * CASE WHEN a >= 8 THEN a ELSE b END, 4) AS skipped FROM s""", "doc_segments", "segments")
def interpolate_scores(spark, sf_dir):
    a, b = F.col("score"), F.lit(9.0)
    return _scores(spark, sf_dir).select("segment_id", "pos", F.round(counts.interpolate_linear([a, b], [0.7, 0.3]), 4).alias("linear"), F.round(counts.interpolate_loglinear([a, b], [0.7, 0.3]), 4).alias("loglinear"), F.round(counts.skip_threshold_combine([a, b], [0.7, 0.3], 8.0), 4).alias("skipped"))


@query(f"WITH {_EVENTS}, {_COUNTS} SELECT segment_id, pos, word, round(ln((SELECT count(*) FROM counts)), 6) AS score FROM events", "doc_segments", "segments")
def zerogram_score(spark, sf_dir):
    e = counts.lm_events(views.segments(spark, sf_dir), 2).drop("history")
    return counts.zerogram_score(e, _doc_counts(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"WITH {_EVENTS}, {_COUNTS} SELECT segment_id, pos, CASE WHEN word IN (SELECT token FROM counts WHERE n >= 3) THEN word ELSE '<unk>' END AS word FROM events", "doc_segments", "segments")
def map_oov_to_unk(spark, sf_dir):
    e = counts.lm_events(views.segments(spark, sf_dir), 2).drop("history")
    return counts.map_oov_to_unk(e, counts.cutoff_counts(_doc_counts(spark, sf_dir), 3))


@query(f"WITH {_LM} SELECT \"order\", word, round(score, 4) AS score FROM lm WHERE history = 'of the'", "doc_segments")
def history_successors(spark, sf_dir):
    return counts.successors(views.doc_segments(spark, sf_dir), 3, "of the").select("order", "word", F.round("score", 4).alias("score"))
