"""Queries of the frame and vector operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.operators import frames as op

from . import views
from .catalogue import query

_E = ["event_id"]


def _clicks(spark, sf_dir):
    """Frames and the target times of another event type; one frame for each user and tick."""
    f = views.frames(spark, sf_dir)
    one = f.groupBy("segment_id", "tick").agg(F.min("x").alias("x"))
    target = f.filter("label = 'purchase'").select("segment_id", (F.col("tick") + 1_000_000).alias("tick")).distinct()
    return one, target


_CLICKS = """one AS (SELECT segment_id, tick, min(x) AS x FROM frames GROUP BY 1, 2), target AS (SELECT DISTINCT segment_id, tick + 1000000 AS tick FROM frames WHERE label = 'purchase')"""


@query("SELECT event_id FROM frames WHERE (segment_id, tick) IN (SELECT (segment_id, tick) FROM frames WHERE label = 'click')", "frames")
def sync(spark, sf_dir):
    f = views.frames(spark, sf_dir)
    return op.sync(f, f.filter("label = 'click'")).select("event_id")


@query(f"WITH {_CLICKS} SELECT * FROM target WHERE (segment_id, tick) NOT IN (SELECT (segment_id, tick) FROM one)", "frames")
def unmatched_targets(spark, sf_dir):
    return op.unmatched_targets(*_clicks(spark, sf_dir))


@query("WITH a AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY tick, event_id) AS i FROM frames WHERE label = 'click'), b AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY tick, event_id) AS i FROM frames WHERE label <> 'click') SELECT a.event_id, b.tick FROM a JOIN b USING (segment_id, i)", "frames")
def copy_timestamps(spark, sf_dir):
    f = views.frames(spark, sf_dir)
    return op.copy_timestamps(f.filter("label = 'click'"), f.filter("label <> 'click'"), ["event_id"]).select("event_id", "tick")


@query(f"WITH {_CLICKS} SELECT t.segment_id, t.tick, coalesce(o.x, (SELECT arg_min(x, tick) FROM one WHERE one.segment_id = t.segment_id)) AS x FROM target t ASOF LEFT JOIN one o ON t.segment_id = o.segment_id AND t.tick >= o.tick", "frames")
def predict_frames(spark, sf_dir):
    return op.predict_frames(*_clicks(spark, sf_dir))


@query(f"""WITH {_CLICKS}, ab AS (SELECT t.segment_id, t.tick, o.tick AS ta, o.x AS xa FROM target t ASOF JOIN one o ON t.segment_id = o.segment_id AND t.tick >= o.tick), abc AS (SELECT ab.*, o.tick AS tb, o.x AS xb FROM ab ASOF LEFT JOIN one o ON ab.segment_id = o.segment_id AND ab.tick <= o.tick)
SELECT segment_id, tick, round(CASE WHEN ta = tick THEN xa ELSE xa + ((tick - ta) / (tb - ta)) * (xb - xa) END, 6) AS x FROM abc WHERE ta = tick OR tb IS NOT NULL""", "frames")
def interpolate_frames(spark, sf_dir):
    return op.interpolate_frames(*_clicks(spark, sf_dir)).withColumn("x", F.round("x", 6))


def _polynomial(order: int) -> str:
    """SQL of the interpolation of one order: control points by rank, Lagrange's formula over them."""
    return f"""SELECT {order} AS degree, segment_id, tick, CASE WHEN inside THEN round(coalesce(max(CASE WHEN t = tick THEN x END), sum(x * coalesce(w, 1))), 3) END AS x FROM (
    SELECT c.*, a.tick AS t, a.x, (SELECT product((c.tick - b.tick) / (a.tick - b.tick)) FROM num b WHERE b.segment_id = c.segment_id AND b.i BETWEEN c.f AND c.l AND b.i <> a.i) AS w
    FROM (SELECT *, greatest(l - {order}, 0) AS f FROM (SELECT *, least(greatest(i + {order // 2}, {order}), n - 1) AS l FROM near)) c LEFT JOIN num a ON a.segment_id = c.segment_id AND a.i BETWEEN c.f AND c.l) GROUP BY segment_id, tick, inside"""


@query(f"""WITH {_CLICKS}, num AS (SELECT segment_id, tick, x::DOUBLE AS x, row_number() OVER (PARTITION BY segment_id ORDER BY tick) - 1 AS i, count(*) OVER (PARTITION BY segment_id) AS n FROM one),
near AS (SELECT t.segment_id, t.tick, o.i, o.n, o.i IS NOT NULL AND (o.i > 0 OR o.tick = t.tick) AS inside FROM target t ASOF LEFT JOIN num o ON t.segment_id = o.segment_id AND t.tick <= o.tick)
{' UNION ALL '.join(_polynomial(k) for k in (1, 2, 3))}""", "frames")
def interpolate_polynomial(spark, sf_dir):
    """Orders 1 to 3; targets outside have no value."""
    one, target = _clicks(spark, sf_dir)
    out = None
    for k in (1, 2, 3):
        found = op.interpolate_polynomial(one, target, k, "flag").select(F.lit(k).alias("degree"), "segment_id", "tick", F.round("x", 3).alias("x"))
        out = found if out is None else out.unionByName(found)
    return out


@query("SELECT DISTINCT f.event_id FROM frames f JOIN (SELECT segment_id, tick AS s, tick + 600000000 AS e FROM frames WHERE label = 'purchase') i ON f.segment_id = i.segment_id AND f.tick >= s AND f.tick < e", "frames")
def select_in_intervals(spark, sf_dir):
    f = views.frames(spark, sf_dir)
    intervals = f.filter("label = 'purchase'").select("segment_id", F.col("tick").alias("start"), (F.col("tick") + 600_000_000).alias("end"))
    return op.select_in_intervals(f, intervals, 3_600_000_000).select("event_id")


@query("WITH m AS (SELECT min(tick) AS a, max(tick) AS b FROM frames) SELECT event_id FROM frames, m WHERE tick BETWEEN 1704067200000000 AND 1706745600000000", "frames")
def cut_frames(spark, sf_dir):
    return op.cut(views.frames(spark, sf_dir), 1704067200000000, 1706745600000000).select("event_id")


@query("SELECT event_id, coalesce(lag(x, 2) OVER w, first_value(x) OVER w) AS x_m2, coalesce(lead(x, 1) OVER w, last_value(x) OVER (PARTITION BY segment_id ORDER BY tick, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS x_p1 FROM frames WINDOW w AS (PARTITION BY segment_id ORDER BY tick, event_id)", "frames")
def delay(spark, sf_dir):
    return op.delay(views.frames(spark, sf_dir), [-2, 1], _E).select("event_id", "x_m2", "x_p1")


@query("SELECT event_id, array_to_string(list(x) OVER (PARTITION BY segment_id ORDER BY tick, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), ',') AS spliced FROM frames", "frames")
def splice(spark, sf_dir):
    return op.splice(views.frames(spark, sf_dir), 2, 1, _E).select("event_id", F.array_join("spliced", ",").alias("spliced"))


@query("SELECT segment_id, packet, string_agg(x, ',' ORDER BY i) AS xs FROM (SELECT segment_id, x, i, i // 4 AS packet FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY tick, event_id) - 1 AS i FROM frames)) GROUP BY 1, 2", "frames")
def aggregate_sequence(spark, sf_dir):
    return op.aggregate_sequence(views.frames(spark, sf_dir), 4, _E).withColumn("xs", F.array_join("xs", ","))


@query("SELECT segment_id, i // 4 AS packet, i % 4 AS i, x FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY tick, event_id) - 1 AS i FROM frames)", "frames")
def disaggregate(spark, sf_dir):
    return op.disaggregate(op.aggregate_sequence(views.frames(spark, sf_dir), 4, _E)).withColumn("i", F.col("i").cast("long"))


@query("""WITH w AS (SELECT event_id, x, coalesce(lag(x, 2) OVER w, first_value(x) OVER w) AS a, coalesce(lag(x, 1) OVER w, first_value(x) OVER w) AS b, coalesce(lead(x, 1) OVER w, last_value(x) OVER v) AS c, coalesce(lead(x, 2) OVER w, last_value(x) OVER v) AS d FROM frames
 WINDOW w AS (PARTITION BY segment_id ORDER BY tick, event_id), v AS (PARTITION BY segment_id ORDER BY tick, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT event_id, round((-2 * a - b + c + 2 * d) / 10, 6) AS slope FROM w""", "frames")
def regression(spark, sf_dir):
    return op.regression(views.frames(spark, sf_dir), 2, _E).select("event_id", F.round("slope", 6).alias("slope"))


@query("""WITH s AS (SELECT *, row_number() OVER w - 1 AS t, count(*) OVER (PARTITION BY segment_id) AS n, sum(x) OVER w AS s, sum(x * x) OVER w AS q FROM frames WINDOW w AS (PARTITION BY segment_id ORDER BY tick, event_id)),
p AS (SELECT s.event_id, s.x, e.t AS et, e.s - coalesce(b.s, 0) AS ss, e.q - coalesce(b.q, 0) AS qq FROM s JOIN s e ON e.segment_id = s.segment_id AND e.t = least(s.t + 2, s.n - 1) LEFT JOIN s b ON b.segment_id = s.segment_id AND b.t = least(s.t + 2, s.n - 1) - 5),
m AS (SELECT event_id, x, ss / least(5, et + 1) AS mean, qq / least(5, et + 1) AS sq FROM p), d AS (SELECT event_id, x, mean, sqrt(greatest(sq - mean * mean, 0.0)) AS dev FROM m)
SELECT event_id, round((x - mean) / CASE WHEN dev > 0 THEN dev ELSE 1.0 END, 5) AS normalised FROM d""", "frames")
def sliding_normalise(spark, sf_dir):
    return op.sliding_normalise(views.frames(spark, sf_dir), 5, 2, _E).select("event_id", F.round("normalised", 5).alias("normalised"))


@query("SELECT event_id, round((x - avg(x) OVER w) / CASE WHEN stddev_pop(x) OVER w > 0 THEN stddev_pop(x) OVER w ELSE 1.0 END, 5) AS normalised FROM frames WINDOW w AS (PARTITION BY segment_id)", "frames")
def segment_normalise(spark, sf_dir):
    return op.segment_normalise(views.frames(spark, sf_dir)).select("event_id", F.round("normalised", 5).alias("normalised"))


@query("SELECT label, floor(x / 500)::BIGINT AS bin, count(*) AS n FROM frames GROUP BY 1, 2", "frames")
def histogram(spark, sf_dir):
    return op.histogram(views.frames(spark, sf_dir), 500)


@query("SELECT label, round(avg(x), 6) AS mean, count(*) AS n FROM frames GROUP BY 1", "frames")
def mean_over(spark, sf_dir):
    return op.mean_over(views.frames(spark, sf_dir), "label").withColumn("mean", F.round("mean", 6))


@query("""WITH g AS (SELECT *, coalesce(tick - lag(tick) OVER w > 86400000000, true)::INT AS n FROM frames WINDOW w AS (PARTITION BY segment_id ORDER BY tick, event_id)), s AS (SELECT *, sum(n) OVER (PARTITION BY segment_id ORDER BY tick, event_id)::BIGINT AS session FROM g)
SELECT segment_id, session, min(tick) AS start, max(tick) AS "end", count(*) AS n FROM s GROUP BY 1, 2""", "frames")
def activity_sessions(spark, sf_dir):
    return op.activity_sessions(views.frames(spark, sf_dir), 86_400_000_000, _E)


@query("SELECT segment_id, tick // 86400000000 AS window, sum(abs(x))::BIGINT AS energy, count(*) AS n FROM frames GROUP BY 1, 2".replace("AS window", 'AS "window"'), "frames")
def windowed_energy(spark, sf_dir):
    return op.windowed_energy(views.frames(spark, sf_dir), 86_400_000_000)


@query("SELECT vec_id, list_sum(list_transform(x, lambda v: abs(v)))::DOUBLE AS l1, list_sum(list_transform(x, lambda v: v * v))::DOUBLE AS energy, round(sqrt(list_sum(list_transform(x, lambda v: v * v))), 6) AS l2 FROM vectors", "vectors")
def vector_norms(spark, sf_dir):
    x = F.col("x")
    return views.vectors(spark, sf_dir).select("vec_id", op.norm(x, 1).alias("l1"), op.energy(x).alias("energy"), F.round(op.norm(x, 2), 6).alias("l2"))


@query("SELECT vec_id, array_to_string([x[i + 1] - x[i] FOR i IN range(1, len(x))], ',') AS diff FROM vectors", "vectors")
def adjacent_difference(spark, sf_dir):
    return views.vectors(spark, sf_dir).select("vec_id", F.array_join(op.adjacent_difference(F.col("x")).cast("array<string>"), ",").alias("diff"))


@query("SELECT vec_id, i - 1 AS i, round(x[i] / sqrt(list_sum(list_transform(x, lambda v: v * v))), 6) AS energy, round(x[i] - list_sum(x) / len(x), 6) AS mean, round(x[i] / list_max(x), 6) AS maximum FROM vectors, unnest(range(1, len(x) + 1)) AS t(i) WHERE list_max(x) <> 0", "vectors")
def vector_normalise(spark, sf_dir):
    x = F.col("x")
    v = views.vectors(spark, sf_dir).filter(F.array_max("x") != 0)
    z = v.select("vec_id", F.posexplode(F.arrays_zip(*(op.vector_normalise(x, k).alias(k) for k in ("energy", "mean", "maximum")))).alias("i", "z"))
    return z.select("vec_id", F.col("i").cast("long").alias("i"), *(F.round(F.col("z")[k], 6).alias(n) for k, n in (("0", "energy"), ("1", "mean"), ("2", "maximum"))) if "0" in z.schema["z"].dataType.names else [F.round(F.col("z")[k], 6).alias(k) for k in ("energy", "mean", "maximum")])


@query("SELECT vec_id, ((list_sum(x) * list_sum(x) + list_sum(list_transform(x, lambda v: v * v))) // 2)::BIGINT AS s FROM vectors", "vectors")
def second_order_products(spark, sf_dir):
    return views.vectors(spark, sf_dir).select("vec_id", op.total(op.products(F.col("x"))).cast("long").alias("s"))


@query("SELECT vec_id, round(list_sum([x[j] * cos(pi() * 1 * (j - 0.5) / len(x)) FOR j IN range(1, len(x) + 1)]), 4) AS c1, round(list_sum([x[j] * cos(pi() * 2 * (j - 0.5) / len(x)) FOR j IN range(1, len(x) + 1)]), 4) AS c2 FROM vectors", "vectors")
def cosine_transform(spark, sf_dir):
    c = op.matrix_multiply(F.col("x"), op.cosine_transform(views.DIMENSIONS, 3))
    return views.vectors(spark, sf_dir).select("vec_id", F.round(c[1], 4).alias("c1"), F.round(c[2], 4).alias("c2"))


@query("SELECT vec_id, i - 1 AS i, round(exp(x[i] / 1000) / list_sum(list_transform(x, lambda v: exp(v / 1000))), 6) AS p FROM vectors, unnest(range(1, len(x) + 1)) AS t(i)", "vectors")
def softmax(spark, sf_dir):
    x = F.transform("x", lambda v: v / 1000)
    return views.vectors(spark, sf_dir).select("vec_id", F.posexplode(op.softmax(x)).alias("i", "p")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("p", 6).alias("p"))


@query("SELECT vec_id, list_position(x, list_max(x))::BIGINT - 1 AS position, list_max(x) AS value FROM vectors", "vectors")
def peak(spark, sf_dir):
    return views.vectors(spark, sf_dir).select("vec_id", op.peak(F.col("x")).alias("p")).select("vec_id", "p.position", "p.value")
