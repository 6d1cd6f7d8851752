"""Queries of the transcript operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.operators import counts, transcripts

from . import views
from .catalogue import query
from .queries_counts import _COUNTS, _TOKENS

_STRIP = r"trim(regexp_replace(regexp_replace(regexp_replace(orth, '\[[^\]\[]*\]', ' ', 'g'), '(^|[ \t\n])the($|[ \t\n])', '\1\2', 'g'), '[ \t\n]+', ' ', 'g'))"


def _words(spark, sf_dir):
    """Order lines as timed words of their order: confidence = 1 - 5 x discount, silence where the line was returned."""
    li = views.order_lines(spark, sf_dir)
    start = F.col("l_linenumber").cast("long") * 100
    return li.select(
        F.col("l_orderkey").alias("recording_id"), F.col("l_orderkey").alias("segment_id"), start.alias("start"), (start + F.col("quantity")).alias("end"),
        F.when(F.col("flag") == "R", "[SILENCE]").otherwise(F.concat(F.lit("w"), (F.col("part") % 50).cast("string"))).alias("word"), F.round(1 - 5 * F.col("discount"), 2).alias("conf"),
    )


_WORDS = f"""{views.ORDER_LINES}, words AS (SELECT l_orderkey AS recording_id, l_orderkey AS segment_id, l_linenumber::BIGINT * 100 AS start, l_linenumber::BIGINT * 100 + quantity AS "end",
 CASE WHEN flag = 'R' THEN '[SILENCE]' ELSE concat('w', part % 50) END AS word, round(1 - 5 * discount, 2) AS conf FROM order_lines)"""


@query(r"""SELECT segment_id, trim(regexp_replace(regexp_replace(orth, '\[[^\]\[]*\]', ' ', 'g'), '[ \t\n]+', ' ', 'g')) AS orth FROM doc_segments""", "doc_segments")
def strip_noise(spark, sf_dir):
    return views.doc_segments(spark, sf_dir).select("segment_id", transcripts.strip_noise(F.col("orth"), ()).alias("orth"))


@query(r"""SELECT segment_id FROM (SELECT page_id AS segment_id, regexp_replace(html, '<', '[', 'g') AS orth FROM pages) WHERE trim(regexp_replace(regexp_replace(regexp_replace(orth, '>', ']', 'g'), '\[[^\]\[]*\]', ' ', 'g'), '[ \t\n]+', ' ', 'g')) <> ''""")
def drop_noise_segments(spark, sf_dir):
    p = views.read(spark, sf_dir, "pages").select(F.col("page_id").alias("segment_id"), F.translate("html", "<>", "[]").alias("orth"))
    return transcripts.drop_noise_segments(p).select("segment_id")


@query(f"WITH {_WORDS} SELECT o_orderkey AS segment_id FROM orders WHERE o_orderkey IN (SELECT segment_id FROM words WHERE word = 'w7')")
def drop_empty_segments(spark, sf_dir):
    s = views.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("segment_id"))
    return transcripts.drop_empty_segments(s, _words(spark, sf_dir).filter("word = 'w7'"))


@query(rf"""WITH {_WORDS}, s AS (SELECT segment_id, string_agg(word, ' ' ORDER BY start) AS orth FROM words GROUP BY 1) SELECT * FROM s WHERE NOT regexp_matches(orth, '[^ ] \[SILENCE\] [^ ]')""")
def drop_segments_with_inner_silence(spark, sf_dir):
    w = _words(spark, sf_dir).groupBy("segment_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "word"))), lambda x: x["word"]), " ").alias("orth"))
    return transcripts.drop_segments_with_inner_silence(w)


@query(f"WITH {_WORDS} SELECT segment_id, start, word FROM words WHERE segment_id IN (SELECT segment_id FROM words GROUP BY 1 HAVING round(avg(conf), 9) > 0.77)")
def drop_low_confidence(spark, sf_dir):
    w = _words(spark, sf_dir)
    good = w.groupBy("segment_id").agg(F.round(F.avg("conf"), 9).alias("conf"))
    return w.join(transcripts.drop_low_confidence(good, 0.77).select("segment_id"), "segment_id", "left_semi").select("segment_id", "start", "word")


@query(f"WITH {_WORDS} SELECT segment_id, start, CASE WHEN conf < 0.7 THEN '[IGNORE]' ELSE word END AS word FROM words")
def mask_low_confidence(spark, sf_dir):
    return transcripts.mask_low_confidence(_words(spark, sf_dir), 0.7).select("segment_id", "start", "word")


@query(f'WITH {_WORDS} SELECT segment_id, start, CASE WHEN conf < 0.7 AND "end" - start > 20 THEN \'[UNKNOWN]\' ELSE word END AS word FROM words')
def map_to_unknown(spark, sf_dir):
    return transcripts.map_to_unknown(_words(spark, sf_dir), 0.7, 20).select("segment_id", "start", "word")


@query(f"WITH {_WORDS} SELECT segment_id, start, round(avg(conf) OVER (PARTITION BY segment_id), 6) AS conf FROM words")
def mean_segment_confidence(spark, sf_dir):
    return transcripts.mean_segment_confidence(_words(spark, sf_dir)).select("segment_id", "start", F.round("conf", 6).alias("conf"))


_COVERAGE = rf"""ref AS (SELECT list_filter(regexp_split_to_array(text, '[ \t\n]+'), lambda x: x <> '') AS w FROM benchmark), known AS (SELECT DISTINCT array_to_string(w[i:i+2], ' ') AS g FROM ref, unnest(range(1, len(w) - 1)) AS t(i)),
c AS (SELECT segment_id, {_TOKENS.replace('orth', 'o')} AS w FROM (SELECT segment_id, regexp_replace(orth, '\[[^\]\[]*\]', ' ', 'g') AS o FROM doc_segments)),
hit AS (SELECT DISTINCT segment_id, i + k AS k FROM c, unnest(range(1, len(w) - 1)) AS t(i), unnest([0, 1, 2]) AS u(k) WHERE array_to_string(w[i:i+2], ' ') IN (SELECT g FROM known)),
coverage AS (SELECT segment_id, CASE WHEN len(w) = 0 THEN 0.0 ELSE round(coalesce(n, 0) / len(w), 2) END AS coverage FROM c LEFT JOIN (SELECT segment_id, count(*) AS n FROM hit GROUP BY 1) USING (segment_id))"""


@query(f"WITH {_COVERAGE} SELECT * FROM coverage", "doc_segments")
def ngram_coverage(spark, sf_dir):
    return transcripts.ngram_coverage(views.doc_segments(spark, sf_dir), views.read(spark, sf_dir, "benchmark"), 3)


@query(f"WITH {_COVERAGE} SELECT segment_id FROM coverage WHERE coverage < 0.1", "doc_segments")
def drop_contaminated(spark, sf_dir):
    return transcripts.drop_uncovered_by_text(views.doc_segments(spark, sf_dir), views.read(spark, sf_dir, "benchmark"), 3, 0.1, invert=True).select("segment_id")


@query(f"""WITH {_WORDS}, i AS (SELECT recording_id, start AS s, "end" AS e FROM words WHERE word = '[SILENCE]') SELECT recording_id, start, word FROM words w WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.recording_id = w.recording_id AND w.start < e AND s < w."end")""")
def drop_in_intervals(spark, sf_dir):
    w = _words(spark, sf_dir)
    return transcripts.drop_in_intervals(w, w.filter("word = '[SILENCE]'"), 200).select("recording_id", "start", "word")


@query(f"WITH {_WORDS} SELECT segment_id, start FROM words WHERE conf BETWEEN 0.6 AND 0.8")
def filter_by_score(spark, sf_dir):
    return transcripts.filter_by_score(_words(spark, sf_dir), 0.6, 0.8).select("segment_id", "start")


@query('SELECT segment_id FROM doc_segments WHERE "end" - start BETWEEN 500 AND 2000', "doc_segments")
def filter_by_duration(spark, sf_dir):
    return transcripts.filter_by_duration(views.doc_segments(spark, sf_dir), 500, 2000).select("segment_id")


@query(f"WITH {_COUNTS}, bad AS (SELECT DISTINCT segment_id FROM (SELECT segment_id, unnest({_TOKENS}) AS token FROM doc_segments) WHERE token NOT IN (SELECT token FROM counts WHERE n >= 2)) SELECT segment_id FROM doc_segments WHERE segment_id NOT IN (SELECT segment_id FROM bad)", "doc_segments")
def keep_in_vocabulary(spark, sf_dir):
    s = views.doc_segments(spark, sf_dir)
    return transcripts.keep_in_vocabulary(s, counts.cutoff_counts(counts.token_counts(s), 2)).select("segment_id")


@query(f"""WITH q AS (SELECT segment_id, start, "end", {_TOKENS} AS w FROM segments) SELECT segment_id, i - 1 AS i, w[i] AS word, round(start + (i - 1) * (("end" - start) / len(w)), 4) AS start, round(start + i * (("end" - start) / len(w)), 4) AS "end" FROM q, unnest(range(1, len(w) + 1)) AS t(i)""", "segments")
def distribute_words(spark, sf_dir):
    return transcripts.distribute_words(views.segments(spark, sf_dir))


@query('SELECT count(*) FILTER ("end" < 500) AS n_removed, (sum("end") FILTER ("end" < 500))::BIGINT AS length_removed, round(100 * sum("end") FILTER ("end" < 500) / sum("end"), 4) AS percent_removed FROM doc_segments', "doc_segments")
def filter_report(spark, sf_dir):
    s = views.doc_segments(spark, sf_dir)
    return transcripts.filter_report(s, transcripts.filter_by_duration(s, 500, 10**9))


@query(f"""WITH {_WORDS}, f AS (SELECT *, coalesce(start - max("end") OVER (PARTITION BY recording_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 80, true) AS n FROM words),
r AS (SELECT *, sum(n::INT) OVER (PARTITION BY recording_id ORDER BY start) AS run FROM f) SELECT recording_id, min(start) AS start, max("end") AS "end", count(*) AS n_merged, string_agg(word, ' ' ORDER BY start) AS orth FROM r GROUP BY recording_id, run""")
def merge_segments(spark, sf_dir):
    return transcripts.merge_segments(_words(spark, sf_dir).withColumnRenamed("word", "orth"), 80)


@query(f"""WITH {_WORDS}, m AS (SELECT *, word = '[SILENCE]' AND "end" - start > 30 AS cut, round(start + ("end" - start) / 2, 4) AS mid, sum((word = '[SILENCE]' AND "end" - start > 30)::INT) OVER (PARTITION BY recording_id ORDER BY start) AS part FROM words),
h AS (SELECT recording_id, part, CASE WHEN cut THEN mid ELSE start END AS s, "end"::DOUBLE AS e, word FROM m UNION ALL SELECT recording_id, part - 1, start, mid, word FROM m WHERE cut)
SELECT recording_id, part, min(s)::DOUBLE AS start, max(e)::DOUBLE AS "end", count(*) FILTER (word <> '[SILENCE]') AS n_words FROM h GROUP BY 1, 2""")
def segment_at_silence(spark, sf_dir):
    return transcripts.segment_at_silence(_words(spark, sf_dir), "[SILENCE]", 30).withColumn("part", F.col("part").cast("long"))


@query(f"""WITH q AS (SELECT segment_id AS recording_id, {_TOKENS} AS w FROM segments), t AS (SELECT recording_id, i AS start, w[i] AS word FROM q, unnest(range(1, len(w) + 1)) AS t(i))
SELECT recording_id, start, word, coalesce(sum((word[-1:] IN ('.', '?'))::INT) OVER (PARTITION BY recording_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sentence FROM t""", "segments")
def split_at_sentences(spark, sf_dir):
    w = views.segments(spark, sf_dir).select(F.col("segment_id").alias("recording_id"), F.posexplode(counts.tokens(F.col("orth"))).alias("start", "word")).withColumn("start", F.col("start") + 1)
    return transcripts.split_at_sentences(w, [".", "?"])


@query(f"WITH {_COUNTS}, x AS (SELECT segment_id, i, w[i] AS token FROM (SELECT segment_id, {_TOKENS} AS w FROM doc_segments), unnest(range(1, len(w) + 1)) AS t(i)) SELECT segment_id, string_agg(concat('/', token, '/'), ' ' ORDER BY i) AS phon FROM x WHERE token IN (SELECT token FROM counts WHERE n >= 20) GROUP BY 1", "doc_segments")
def orth_to_phon(spark, sf_dir):
    s = views.doc_segments(spark, sf_dir)
    lexicon = counts.cutoff_counts(counts.token_counts(s), 20).select("token", F.concat(F.lit("/"), "token", F.lit("/")).alias("phon"))
    return transcripts.orth_to_phon(s, lexicon)
