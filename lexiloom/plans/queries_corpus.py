"""Queries of the corpus operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lexiloom.operators import corpus

from . import views
from .catalogue import query

def _bucket():
    return F.floor(F.col("seq") / 100_000)



def _names(spark, sf_dir):
    """The segments of assistants."""
    return views.segments(spark, sf_dir).filter("speaker_id = 'assistant'").select(F.col("segment_id").alias("name"))


_NAMES = "names AS (SELECT segment_id AS name FROM segments WHERE speaker_id = 'assistant')"


@query(f"WITH {_NAMES} SELECT segment_id, seq FROM segments WHERE segment_id IN (SELECT name FROM names)", "segments")
def keep_segments(spark, sf_dir):
    return corpus.keep_segments(views.segments(spark, sf_dir), _names(spark, sf_dir)).select("segment_id", "seq")


@query(f"WITH {_NAMES} SELECT segment_id, seq FROM segments WHERE segment_id NOT IN (SELECT name FROM names)", "segments")
def skip_segments(spark, sf_dir):
    return corpus.skip_segments(views.segments(spark, sf_dir), _names(spark, sf_dir)).select("segment_id", "seq")


@query("SELECT segment_id FROM (SELECT segment_id, row_number() OVER (ORDER BY seq) - 1 AS i FROM segments) WHERE i % 5 = 3", "segments")
def partition_by_segment(spark, sf_dir):
    return corpus.partition_segments(views.segments(spark, sf_dir), 5, 3, _bucket()).select("segment_id")


@query("SELECT segment_id FROM (SELECT segment_id, dense_rank() OVER (ORDER BY recording_id) AS i FROM segments) WHERE i % 4 = 0", "segments")
def partition_by_recording(spark, sf_dir):
    return corpus.partition_segments(views.segments(spark, sf_dir), 4, 4, _bucket(), by="recording").select("segment_id")


@query("SELECT segment_id FROM (SELECT segment_id, row_number() OVER (ORDER BY seq) - 1 AS i FROM segments) WHERE i // 7 >= 20", "segments")
def skip_first(spark, sf_dir):
    return corpus.skip_first(views.segments(spark, sf_dir), 20, 7, _bucket()).select("segment_id")


@query("WITH o AS (SELECT -seq AS pos, segment_id FROM segments WHERE speaker_id = 'user') SELECT pos, segment_id, orth FROM o JOIN segments USING (segment_id)", "segments")
def order_by_list(spark, sf_dir):
    s = views.segments(spark, sf_dir)
    order = s.filter("speaker_id = 'user'").select((-F.col("seq")).alias("pos"), "segment_id")
    return corpus.order_by_list(s, order).select("pos", "segment_id", "orth")


@query("SELECT concat(name, '!') AS segment_id FROM (SELECT segment_id AS name FROM segments WHERE turn_odd = 1) WHERE concat(name, '!') NOT IN (SELECT segment_id FROM segments)".replace("turn_odd = 1", "condition_id = 1"), "segments")
def unknown_in_list(spark, sf_dir):
    s = views.segments(spark, sf_dir)
    order = s.filter("condition_id = 1").select(F.concat("segment_id", F.lit("!")).alias("segment_id"))
    return corpus.unknown_in_list(s, order)


@query("SELECT segment_id, md5(concat('7/', segment_id)) AS shuffle_key FROM segments", "segments")
def shuffle_segments(spark, sf_dir):
    return corpus.shuffle_segments(views.segments(spark, sf_dir), 7).select("segment_id", "shuffle_key")


@F.pandas_udf(LongType())
def _words(text: pd.Series) -> pd.Series:
    """A user's own key: segments with many words first."""
    return -text.fillna("").str.split().str.len()


@query("SELECT segment_id, -len(list_filter(string_split_regex(coalesce(orth, ''), '\\s+'), lambda w: w <> '')) AS order_key FROM segments", "segments")
def custom_order(spark, sf_dir):
    return corpus.custom_order(views.segments(spark, sf_dir), _words, "orth").select("segment_id", "order_key")


@query('SELECT segment_id, row_number() OVER (ORDER BY "end" - start, seq) - 1 AS rank FROM segments', "segments")
def sort_by_length(spark, sf_dir):
    return corpus.sort_by_length(views.segments(spark, sf_dir), _bucket()).select("segment_id", "rank")


@query('SELECT segment_id, chunk, row_number() OVER (PARTITION BY chunk ORDER BY "end" - start, i) - 1 AS rank FROM (SELECT *, i // 50 AS chunk FROM (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS i FROM segments))', "segments")
def sort_by_length_in_chunks(spark, sf_dir):
    return corpus.sort_by_length(views.segments(spark, sf_dir), _bucket(), 50).select("segment_id", "chunk", "rank")


@query("SELECT segment_id, concat(speaker_id, '-', condition_id) AS key FROM segments", "segments")
def corpus_key(spark, sf_dir):
    return corpus.corpus_key(views.segments(spark, sf_dir), ["speaker_id", F.col("condition_id").cast("string")]).select("segment_id", "key")


@query("SELECT c_custkey, c_nationkey, coalesce(n_name, 'none') AS value FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey")
def map_corpus_key(spark, sf_dir):
    mapping = views.read(spark, sf_dir, "nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    return corpus.map_corpus_key(views.read(spark, sf_dir, "customer").withColumn("key", F.col("c_nationkey")), mapping, "none").select("c_custkey", "c_nationkey", "value")


@query("SELECT c_nationkey AS key, count(*) AS n FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2) GROUP BY 1")
def unmapped_keys(spark, sf_dir):
    mapping = views.read(spark, sf_dir, "nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("key"))
    return corpus.unmapped_keys(views.read(spark, sf_dir, "customer").withColumn("key", F.col("c_nationkey")), mapping)


@query("SELECT segment_id, orth FROM segments UNION ALL SELECT segment_id, orth FROM doc_segments", "segments", "doc_segments")
def merge_corpora(spark, sf_dir):
    return corpus.merge_corpora(views.segments(spark, sf_dir), views.doc_segments(spark, sf_dir).drop("recording_id", "condition_id")).select("segment_id", "orth")


@query("SELECT segment_id, count(*) AS n FROM (SELECT segment_id FROM segments UNION ALL SELECT segment_id FROM segments WHERE condition_id = 1) GROUP BY 1 HAVING count(*) > 1", "segments")
def duplicate_segments(spark, sf_dir):
    s = views.segments(spark, sf_dir).select("segment_id", "condition_id")
    return corpus.duplicate_segments(corpus.merge_corpora(s, s.filter("condition_id = 1")))


@query("WITH a AS (SELECT doc_id, n_chars FROM documents WHERE lang <> 'fr'), b AS (SELECT doc_id, quality FROM labels) SELECT doc_id AS segment_id, coalesce(n_chars, 0) AS n_chars, coalesce(quality, -1) AS quality FROM a FULL JOIN b USING (doc_id)")
def build_segments(spark, sf_dir):
    a = views.read(spark, sf_dir, "documents").filter("lang <> 'fr'").select(F.col("doc_id").alias("segment_id"), "n_chars")
    b = views.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("segment_id"), "quality")
    return corpus.build_segments(a, b, {"n_chars": 0, "quality": -1})


@query("SELECT doc_id AS segment_id FROM documents INTERSECT SELECT doc_id FROM labels")
def common_segments(spark, sf_dir):
    a, b = (views.read(spark, sf_dir, t).select(F.col("doc_id").alias("segment_id")) for t in ("documents", "labels"))
    return corpus.common_segments(a, b)


@query("SELECT doc_id AS segment_id FROM documents EXCEPT SELECT doc_id FROM labels")
def missing_segments(spark, sf_dir):
    a, b = (views.read(spark, sf_dir, t).select(F.col("doc_id").alias("segment_id")) for t in ("documents", "labels"))
    return corpus.missing_segments(a, b)


@query("SELECT segment_id, seq FROM segments ORDER BY seq LIMIT 100", "segments")
def take_batch(spark, sf_dir):
    return corpus.take_batch(views.segments(spark, sf_dir), 100).select("segment_id", "seq")


@query("""WITH r AS (SELECT recording_id, max("end") AS duration FROM segments GROUP BY 1)
SELECT (SELECT count(*) FROM r) AS n_recordings, (SELECT sum(duration) FROM r)::BIGINT AS gross, count(*) FILTER (is_speech) AS n_speech, count(*) FILTER (NOT is_speech) AS n_other, sum("end" - start)::BIGINT AS net FROM segments""", "segments")
def size_statistics(spark, sf_dir):
    s = views.segments(spark, sf_dir)
    return corpus.size_statistics(s.groupBy("recording_id").agg(F.max("end").alias("duration")), s)


@query("""SELECT c_custkey_ AS speaker_id, seg AS gender, grouping_id(c_custkey_, seg) AS level, count(*) AS n_segments, sum("end" - start)::BIGINT AS seconds, count(DISTINCT who) AS n_speakers
FROM (SELECT o_custkey AS c_custkey_, c_mktsegment AS seg, o_custkey AS who, 0 AS start, round(o_totalprice)::BIGINT AS "end" FROM orders JOIN customer ON o_custkey = c_custkey)
GROUP BY GROUPING SETS ((c_custkey_), (seg), ())""")
def speaker_statistics(spark, sf_dir):
    o = views.read(spark, sf_dir, "orders").join(views.read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    s = o.select(F.col("o_custkey").alias("speaker_id"), F.col("o_custkey").alias("who"), F.col("c_mktsegment").alias("gender"), F.lit(0).alias("start"), F.round("o_totalprice").cast("long").alias("end"))
    return corpus.speaker_statistics(s)


@query('SELECT condition_id, count(*) AS n_segments, sum("end" - start)::BIGINT AS seconds FROM doc_segments GROUP BY 1', "doc_segments")
def condition_statistics(spark, sf_dir):
    return corpus.condition_statistics(views.doc_segments(spark, sf_dir))


@query('SELECT ("end" - start) // 500 AS bin, count(*) AS n FROM doc_segments GROUP BY 1', "doc_segments")
def duration_histogram(spark, sf_dir):
    return corpus.duration_histogram(views.doc_segments(spark, sf_dir), 500)


@query('SELECT segment_id, "end" - start AS length FROM doc_segments WHERE "end" - start >= 8000', "doc_segments")
def long_segments(spark, sf_dir):
    return corpus.long_segments(views.doc_segments(spark, sf_dir), 8000).select("segment_id", (F.col("end") - F.col("start")).alias("length"))
