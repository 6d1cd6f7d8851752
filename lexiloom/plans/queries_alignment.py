"""Queries of the alignment joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.operators import alignment_frames as op

from . import views
from .catalogue import query


def _lines(spark, sf_dir):
    return views.order_lines(spark, sf_dir).select(F.col("l_orderkey").alias("segment_id"), F.col("l_linenumber").alias("t"), F.col("quantity").alias("x"), F.col("flag").alias("label"), F.col("discount").alias("weight"))


_L = "l AS (SELECT l_orderkey AS segment_id, l_linenumber AS t, quantity AS x, flag AS label, discount AS weight FROM order_lines)"


@query(f"WITH {_L} SELECT a.segment_id, a.t, a.x, b.label, b.weight FROM l a JOIN l b USING (segment_id, t) WHERE b.label <> 'N'", "order_lines")
def label_frames(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return op.label_frames(lines.select("segment_id", "t", "x"), lines.filter("label <> 'N'"))


@query(f"WITH {_L} SELECT segment_id, t, x FROM l WHERE label = 'N'", "order_lines")
def uncovered_frames(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return op.uncovered_frames(lines.select("segment_id", "t", "x"), lines.filter("label <> 'N'").select("segment_id", "t"))


@query(f"""WITH {_L}, s AS (SELECT segment_id, t * 100 AS start, t * 100 + least(x, 90) AS "end" FROM l) SELECT segment_id, start, (first_value(start) OVER w + coalesce(sum("end" - start) OVER (PARTITION BY segment_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS warped FROM s WINDOW w AS (PARTITION BY segment_id ORDER BY start)""", "order_lines")
def warp_time(spark, sf_dir):
    s = _lines(spark, sf_dir).select("segment_id", (F.col("t") * 100).alias("start"), (F.col("t") * 100 + F.least("x", F.lit(90))).alias("end"))
    return op.warp_time(s).select("segment_id", "start", F.col("warped").cast("long").alias("warped"))


@query(f"""WITH {_L}, f AS (SELECT *, coalesce(abs(x - lag(x) OVER (PARTITION BY segment_id ORDER BY t)) <= 10, false) AS flat FROM l), c AS (SELECT *, (flat IS DISTINCT FROM lag(flat) OVER (PARTITION BY segment_id ORDER BY t))::INT AS n FROM f), r AS (SELECT *, sum(n) OVER (PARTITION BY segment_id ORDER BY t) AS run FROM c)
SELECT segment_id, min(t) AS start, max(t) AS "end", count(*) AS n FROM r WHERE flat GROUP BY segment_id, run HAVING count(*) >= 2""", "order_lines")
def constant_runs(spark, sf_dir):
    return op.constant_runs(_lines(spark, sf_dir), 10, 2)


@query(f"WITH {_L}, s AS (SELECT segment_id, count(*) AS n FROM l GROUP BY 1) SELECT segment_id, t, floor(4 * t / greatest(n - 1, 1) + 0.5)::BIGINT AS state FROM s, unnest(range(n)) AS u(t)", "order_lines")
def linear_alignment(spark, sf_dir):
    s = _lines(spark, sf_dir).groupBy("segment_id").agg(F.count("*").alias("n_frames"))
    return op.linear_alignment(s, 5)
