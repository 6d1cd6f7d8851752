"""Queries of the vector, scalar and matrix functions, on whole embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import aggregates, quantiles
from lexiloom.operators import frames, models
from lexiloom.operators import vectors as op

from . import views
from .catalogue import query

_E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda v: round(v::DOUBLE * 1000)::DOUBLE) AS x, list_transform(list_reverse(embedding), lambda v: round(v::DOUBLE * 1000)::DOUBLE) AS y FROM embeddings)"


def _e(spark, sf_dir):
    x = lambda c: F.transform(c, lambda v: F.round(v.cast("double") * 1000))
    return views.read(spark, sf_dir, "embeddings").select("vec_id", "label", x(F.col("embedding")).alias("x"), x(F.reverse("embedding")).alias("y"))


def _flat(df, **columns):
    return df.select("vec_id", *(F.array_join(F.transform(c, lambda v: v.cast("long")), ",").alias(n) for n, c in columns.items()))


def _text(expression: str) -> str:
    return f"array_to_string(list_transform({expression}, lambda v: v::BIGINT), ',')"


@query(f"WITH {_E} SELECT vec_id, {_text('list_concat(x, y)')} AS joined, {_text('flatten([[x[i], y[i]] FOR i IN range(1, len(x) + 1)])')} AS woven, {_text('x[4:8]')} AS part, {_text('[x[i] + y[i] FOR i IN range(1, len(x) + 1)]')} AS added, {_text('[x[i] * y[i] FOR i IN range(1, len(x) + 1)]')} AS multiplied, {_text('x[1:10]')} AS shorter, {_text('list_concat(x, [0.0, 0.0])')} AS longer, {_text('[x[i] FOR i IN range(2, len(x) + 1, 3)]')} AS channel FROM e")
def vector_algebra(spark, sf_dir):
    e, x, y = _e(spark, sf_dir), F.col("x"), F.col("y")
    return _flat(e, joined=op.concat(x, y), woven=op.interleave(x, y), part=op.select(x, 3, 5), added=op.add(x, y), multiplied=op.multiply(x, y), shorter=op.resize(x, 10), longer=op.resize(x, 66), channel=op.demultiplex(x, 3, 1))


@query(f"WITH {_E} SELECT vec_id, k - 1 AS part, {_text('x[(k - 1) * 10 + 1:k * 10]')} AS x FROM e, unnest(range(1, ceil(len(x) / 10)::BIGINT + 1)) AS t(k)")
def split_vector(spark, sf_dir):
    parts = _e(spark, sf_dir).select("vec_id", F.posexplode(op.split(F.col("x"), 10)).alias("part", "x"))
    return parts.select("vec_id", F.col("part").cast("long").alias("part"), F.array_join(F.transform("x", lambda v: v.cast("long")), ",").alias("x"))


@query(f"""WITH {_E}, s AS (SELECT vec_id, i, x[i] AS v, sum(abs(x[i])) OVER (PARTITION BY vec_id ORDER BY i) / sum(abs(x[i])) OVER (PARTITION BY vec_id) AS r FROM e, unnest(range(1, len(x) + 1)) AS t(i)),
u AS (SELECT vec_id, string_agg(v::BIGINT, ',' ORDER BY i) AS surface FROM (SELECT *, coalesce(lag(r) OVER (PARTITION BY vec_id ORDER BY i), -1) AS b FROM s) WHERE r > 0.25 AND b < 0.75 GROUP BY 1)
SELECT vec_id, {_text('x[6:11]')} AS position, {_text('x[round_even((len(x) - 1) * 0.25, 0)::BIGINT + 1:round_even((len(x) - 1) * 0.75, 0)::BIGINT + 1]')} AS relative, surface FROM e JOIN u USING (vec_id)""")
def cut_vector(spark, sf_dir):
    x = F.col("x")
    return _flat(_e(spark, sf_dir), position=op.cut_vector(x, 5, 10), relative=op.cut_vector(x, 0.25, 0.75, "relative"), surface=op.cut_vector(x, 0.25, 0.75, "surface"))


@query(f"""WITH {_E} SELECT vec_id, k - 1 AS k, round(sqrt(x[2 * k - 1] ** 2 + x[2 * k] ** 2), 6) AS amplitude, x[2 * k - 1] ** 2 + x[2 * k] ** 2 AS square, round(atan2(x[2 * k] + 0.0, x[2 * k - 1] + 0.0), 6) AS phase, x[2 * k - 1] AS re, x[2 * k] AS im FROM e, unnest(range(1, len(x) // 2 + 1)) AS t(k)""")
def complex_functions(spark, sf_dir):
    x = F.col("x")
    e = _e(spark, sf_dir).select("vec_id", op.complex_amplitude(x).alias("a"), op.abs_square(x).alias("s"), op.phase(x).alias("p"), op.real(x).alias("r"), op.imaginary(x).alias("i"))
    z = e.select("vec_id", F.posexplode(F.arrays_zip("a", "s", "p", "r", "i")).alias("k", "z"))
    return z.select("vec_id", F.col("k").cast("long").alias("k"), F.round("z.a", 6).alias("amplitude"), F.col("z.s").alias("square"), F.round("z.p", 6).alias("phase"), F.col("z.r").alias("re"), F.col("z.i").alias("im"))


@query("SELECT event_id, x + 3 AS plus, x * 2 AS times, round(abs(x) ** 0.5, 6) AS power, round(ln(abs(x) + 1), 6) AS lnplus, round(log10(abs(x) + 1), 6) AS log10, round(exp(x / 100000), 6) AS exp, round(sqrt(abs(x)), 6) AS sqrt, round(cos(x), 6) AS cos, abs(x) AS abs, floor(x / 50) * 50 AS quantised FROM frames", "frames")
def scalar_functions(spark, sf_dir):
    x = F.col("x")
    a = F.abs(x)
    s = lambda c, kind, k=1.0: op.scalar(c, kind, k)
    return views.frames(spark, sf_dir).select("event_id", s(x, "add", 3).alias("plus"), s(x, "multiply", 2).alias("times"), F.round(s(a, "power", 0.5), 6).alias("power"), F.round(s(a, "log-plus", 1), 6).alias("lnplus"), F.round(s(a + 1, "log10"), 6).alias("log10"), F.round(s(x / 100000, "exp"), 6).alias("exp"), F.round(s(a, "sqrt"), 6).alias("sqrt"), F.round(s(x, "cos"), 6).alias("cos"), s(x, "abs").alias("abs"), s(x, "quantise", 50).alias("quantised"))


_BROKEN = "b AS (SELECT segment_id, event_id, tick, CASE WHEN label = 'click' THEN NULL ELSE x::DOUBLE END AS x FROM frames)"


@query(f"WITH {_BROKEN} SELECT event_id, last_value(x IGNORE NULLS) OVER (PARTITION BY segment_id ORDER BY tick, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS previous, coalesce(x, -1.0) AS floored, x IS NOT NULL AS good FROM b", "frames")
def malformed_vectors(spark, sf_dir):
    f = views.frames(spark, sf_dir)
    bad = F.when(F.col("label") == "click", F.lit(float("nan"))).otherwise(F.col("x").cast("double"))
    f = f.select("segment_id", "tick", "event_id", F.array(bad).alias("x"))
    order = ["tick", "event_id"]
    one = lambda policy: op.malformed(f, policy, order, -1.0)
    good = one("dismiss").select("event_id", F.lit(True).alias("good"))
    joined = one("previous").select("event_id", op.to_scalar(F.col("x")).alias("previous")).join(one("floor").select("event_id", op.to_scalar(F.col("x")).alias("floored")), "event_id")
    return joined.join(good, "event_id", "left").fillna(False, "good")


@query(f"WITH {_E} SELECT vec_id, {_text('x')}.replace(',', ' ') AS text, list_sum(x) AS total, x[3] AS third FROM e".replace(f"{_text('x')}.replace(',', ' ')", "array_to_string(list_transform(x, lambda v: v::BIGINT), ' ')"))
def cast_vectors(spark, sf_dir):
    e = _e(spark, sf_dir).select("vec_id", op.cast_vector(op.cast_vector(F.col("x"), "bigint"), "string").alias("text"))
    back = op.cast_vector(F.col("text"), "vector")
    return e.select("vec_id", "text", frames.total(back).alias("total"), op.to_scalar(back, 2).alias("third"))


@query("SELECT segment_id, concat('/', speaker_id, '/', recording_id, '#', condition_id, '.txt') AS name FROM segments", "segments")
def string_expression(spark, sf_dir):
    name = op.string_expression("/$(speaker)/$(recording)#$(condition).txt", speaker=F.col("speaker_id"), recording=F.col("recording_id"), condition=F.col("condition_id"))
    return views.segments(spark, sf_dir).select("segment_id", name.alias("name"))


@query("""WITH w AS (SELECT event_id, list(x) OVER (PARTITION BY segment_id ORDER BY tick, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS w FROM frames), p AS (SELECT event_id, list_concat([w[1] FOR i IN range(0, 5 - len(w))], w) AS w FROM w)
SELECT event_id, round(list_sum(w), 3) AS c0, round(list_sum([w[j] * cos(pi() * (j - 0.5) / 5) FOR j IN range(1, 6)]), 3) AS c1 FROM p""", "frames")
def temporal_pattern(spark, sf_dir):
    f = views.frames(spark, sf_dir).withColumn("x", F.array(F.col("x").cast("double")))
    p = op.temporal_pattern(f, 5, 2, ["tick", "event_id"])
    return p.select("event_id", F.round(F.col("pattern")[0][0], 3).alias("c0"), F.round(F.col("pattern")[0][1], 3).alias("c1"))


@query("""WITH s AS (SELECT *, row_number() OVER w - 1 AS t, count(*) OVER (PARTITION BY segment_id) AS n, sum(x) OVER w AS s FROM frames WINDOW w AS (PARTITION BY segment_id ORDER BY tick, event_id))
SELECT s.event_id, round(s.x - (e.s - coalesce(b.s, 0)) / least(4, e.t + 1), 5) AS normalised FROM s JOIN s e ON e.segment_id = s.segment_id AND e.t = least(s.t + 1, s.n - 1) LEFT JOIN s b ON b.segment_id = s.segment_id AND b.t = least(s.t + 1, s.n - 1) - 4""", "frames")
def sample_normalise(spark, sf_dir):
    return op.sample_normalise(views.frames(spark, sf_dir), 4, 1, ["event_id"]).select("event_id", F.round("normalised", 5).alias("normalised"))


@query("""WITH m AS (SELECT segment_id, list(label = 'view' ORDER BY event_id) AS mask FROM frames GROUP BY 1), n AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY tick, event_id) AS i FROM frames) SELECT event_id FROM n JOIN m USING (segment_id) WHERE mask[i]""", "frames")
def select_by_mask(spark, sf_dir):
    f = views.frames(spark, sf_dir)
    masks = f.groupBy("segment_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", (F.col("label") == "view").alias("m")))), lambda s: s["m"]).alias("mask"))
    return op.select_by_mask(f, masks, ["tick", "event_id"]).select("event_id")


@query("""WITH q AS (SELECT segment_id, quantile_cont(x, [0.0, 0.25, 0.5, 0.75, 1.0]) AS o FROM frames GROUP BY 1), g AS (SELECT quantile_cont(x, [0.0, 0.25, 0.5, 0.75, 1.0]) AS g FROM frames),
k AS (SELECT event_id, x, o, g, least(greatest(len(list_filter(o, lambda v: v <= x)), 1), 4) AS k FROM frames JOIN q USING (segment_id), g) SELECT event_id, round(CASE WHEN o[k + 1] > o[k] THEN g[k] + (x - o[k]) / (o[k + 1] - o[k]) * (g[k + 1] - g[k]) ELSE g[k] END, 4) AS equalised FROM k""", "frames")
def quantile_equalise(spark, sf_dir):
    return op.quantile_equalise(views.frames(spark, sf_dir), 4).select("event_id", F.round("equalised", 4).alias("equalised"))


_WINDOWS = """num AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY tick, event_id) - 1 AS t, count(*) OVER (PARTITION BY segment_id) AS n FROM frames),
ends AS (SELECT *, least(t + 5, n - 1) AS e FROM num), w AS (SELECT a.event_id, a.segment_id, a.x, list_sort(list(b.x)) AS s FROM ends a JOIN num b ON a.segment_id = b.segment_id AND b.t BETWEEN a.e - 24 AND a.e GROUP BY ALL),
q AS (SELECT event_id, x, [s[k * (len(s) - 1) // 4 + 1] for k in range(5)] AS q FROM w)"""


@query(f"WITH {_WINDOWS} SELECT event_id, array_to_string(q, ' ') AS quantiles FROM q", "frames")
def window_quantiles(spark, sf_dir):
    """Quarters of the 25 frames around each, 5 of them later."""
    q = op.window_quantiles(views.frames(spark, sf_dir).drop("label"), 4, 25, 5, ["event_id"], block=64)
    return q.select("event_id", F.array_join("quantiles", " ").alias("quantiles"))


@query(f"""WITH {_WINDOWS}, g AS (SELECT [avg(q[1]), avg(q[2]), avg(q[3]), avg(q[4]), avg(q[5])] AS g FROM q), p AS (SELECT event_id, x, q, g, least(greatest(len(list_filter(q, lambda v: v <= x)), 1), 4) AS k FROM q, g)
SELECT event_id, round(CASE WHEN q[k + 1] > q[k] THEN g[k] + (x - q[k]) / (q[k + 1] - q[k]) * (g[k + 1] - g[k]) ELSE g[k] END, 4) AS equalised FROM p""", "frames")
def quantile_equalise_windows(spark, sf_dir):
    f = views.frames(spark, sf_dir)
    train = op.train_quantiles(op.window_quantiles(f, 4, 25, 5, ["event_id"]), 4)
    return op.quantile_equalise_windows(f, train, 25, 5, ["event_id"]).select("event_id", F.round("equalised", 4).alias("equalised"))


@query("SELECT k, quantile_cont(l_extendedprice, k / 10.0) AS v FROM lineitem, unnest(range(11)) AS t(k) GROUP BY 1".replace("quantile_cont(l_extendedprice, k / 10.0)", "round(any_value(q[k + 1]), 6)").replace("FROM lineitem, unnest", "FROM (SELECT quantile_cont(l_extendedprice, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS q FROM lineitem), unnest"))
def exact_percentiles(spark, sf_dir):
    """Deciles of all prices, from counts of ranges."""
    li = views.read(spark, sf_dir, "lineitem")
    found = quantiles.exact_percentiles(li, "l_extendedprice", [k / 10 for k in range(11)])
    return spark.createDataFrame(list(enumerate(found)), "k long, v double").withColumn("v", F.round("v", 6))


@query("SELECT vec_id, array_to_string(list_transform(x, lambda v: printf('%.5f', round(1 / (1 + exp(-v / 1000.0)) + tanh(v / 1000.0) + ln(greatest(v / 1000.0, 0.01)) + least(v / 1000.0, 0.1) + greatest(v / 1000.0, -0.1) + 2 * (v / 1000.0) + 1, 5) + 0.0)), ' ') AS y FROM vectors", "vectors")
def scalar_functions(spark, sf_dir):
    """Sigmoid, hyperbolic tangent, logarithm over a floor, minimum, maximum and a linear function of every component, added up."""
    y = lambda v: op.scalar(v, "sigmoid") + op.scalar(v, "tanh") + op.scalar(v, "safe-ln", 0.01) + op.scalar(v, "minimum", 0.1) + op.scalar(v, "maximum", -0.1) + op.linear(v, 2.0, 1.0)
    return views.vectors(spark, sf_dir).select("vec_id", F.array_join(F.transform("x", lambda v: F.format_string("%.5f", F.round(y(v / 1000.0), 5) + 0.0)), " ").alias("y"))


_VECTOR_WINDOWS = """num AS (SELECT segment_id, event_id, [x::DOUBLE, (x % 100)::DOUBLE] AS v, row_number() OVER (PARTITION BY segment_id ORDER BY tick, event_id) - 1 AS t, count(*) OVER (PARTITION BY segment_id) AS n FROM frames),
ends AS (SELECT *, least(t + 3, n - 1) AS e FROM num), w AS (SELECT a.event_id, a.v, list(b.v) AS w FROM ends a JOIN num b ON a.segment_id = b.segment_id AND b.t BETWEEN a.e - 9 AND a.e GROUP BY ALL),
m AS (SELECT event_id, v, len(w) AS c, list_max(list_transform(w, lambda u: u[1])) AS top, list_avg(list_transform(w, lambda u: u[1])) AS m1, list_avg(list_transform(w, lambda u: u[2])) AS m2, list_avg(list_transform(w, lambda u: sqrt(u[1] * u[1] + u[2] * u[2]))) AS nm,
  sqrt(greatest(list_avg(list_transform(w, lambda u: u[1] * u[1])) - list_avg(list_transform(w, lambda u: u[1])) ** 2, 0)) AS s1, sqrt(greatest(list_avg(list_transform(w, lambda u: u[2] * u[2])) - list_avg(list_transform(w, lambda u: u[2])) ** 2, 0)) AS s2,
  list_avg(list_transform(w, lambda u: (u[1] + u[2]) / 2)) AS m, sqrt(greatest(list_avg(list_transform(w, lambda u: (u[1] * u[1] + u[2] * u[2]) / 2)) - list_avg(list_transform(w, lambda u: (u[1] + u[2]) / 2)) ** 2, 0)) AS s FROM w)"""


@query(f"""WITH {_VECTOR_WINDOWS} SELECT event_id, 'level' AS kind, round(v[1] - top, 4) AS a, round(v[2], 4) AS b FROM m UNION ALL SELECT event_id, 'mean', round(v[1] - m1, 4), round(v[2] - m2, 4) FROM m
UNION ALL SELECT event_id, 'mean-and-variance-1D', round((v[1] - m) / CASE WHEN s > 1e-6 THEN s ELSE 1 END, 4), round((v[2] - m) / CASE WHEN s > 1e-6 THEN s ELSE 1 END, 4) FROM m UNION ALL SELECT event_id, 'mean-norm', round(v[1] / nm, 4), round(v[2] / nm, 4) FROM m
UNION ALL SELECT event_id, 'mean-and-variance', CASE WHEN s1 > 1e-6 THEN round((v[1] - m1) / s1, 4) ELSE 0 END, CASE WHEN s2 > 1e-6 THEN round((v[2] - m2) / s2, 4) ELSE 0 END FROM m WHERE c >= 5 UNION ALL SELECT event_id, 'divide-by-mean', round(v[1] / m1, 4), round(v[2] / m2, 4) FROM m WHERE c >= 5""", "frames")
def window_normalise(spark, sf_dir):
    """All kinds, over windows of 10 frames of two components, 3 of them later; the last two without the beginnings, where windows of few frames may have means of 0."""
    f = views.frames(spark, sf_dir)
    v = f.select("segment_id", "tick", "event_id", F.array(F.col("x").cast("double"), (F.col("x") % 100).cast("double")).alias("x"))
    kinds = {"level": 1, "mean": 1, "mean-and-variance-1D": 1, "mean-norm": 1, "mean-and-variance": 5, "divide-by-mean": 5}
    n = op.window_normalise_kinds(v, kinds, 10, 3, ["event_id"], block=64)
    each = n.select("event_id", F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(f"`{kind}`").alias("y")) for kind in kinds))).alias("k"))
    return each.filter("k.y IS NOT NULL").select("event_id", "k.kind", F.round(F.get("k.y", F.lit(0)), 4).alias("a"), F.round(F.get("k.y", F.lit(1)), 4).alias("b"))


@query("""SELECT event_type AS label, count(*)::DOUBLE AS n, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance FROM events GROUP BY 1""")
def weighted_stats(spark, sf_dir):
    return aggregates.weighted_stats(views.read(spark, sf_dir, "events"), ["event_type"], "value").select(F.col("event_type").alias("label"), "n", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))


@query("""SELECT l_returnflag AS label, sum(l_quantity)::DOUBLE AS n, round(sum(l_quantity * l_discount) / sum(l_quantity), 8) AS mean FROM lineitem GROUP BY 1""")
def weighted_stats_sql(spark, sf_dir):
    """The steps by name: states for each supplier, merged for each flag."""
    aggregates.register(spark)
    views.read(spark, sf_dir, "lineitem").createOrReplaceTempView("lexiloom_lines")
    return spark.sql("""WITH s AS (SELECT l_returnflag AS label, l_suppkey, stats_state(l_discount, l_quantity) AS state FROM lexiloom_lines GROUP BY 1, 2), m AS (SELECT label, stats_merge(state) AS state FROM s GROUP BY 1),
        v AS (SELECT label, stats_value(state) AS v FROM m) SELECT label, v.n, round(v.mean, 8) AS mean FROM v""")


_COV = "cov AS (SELECT i, j, (sum(x[i + 1] * x[j + 1]) - sum(x[i + 1]) * sum(x[j + 1]) / count(*)) / count(*) AS v FROM (SELECT [l_quantity::BIGINT, round(l_discount * 100)::BIGINT, round(l_tax * 100)::BIGINT] AS x FROM lineitem), unnest([0, 1, 2]) AS a(i), unnest([0, 1, 2]) AS b(j) WHERE j <= i GROUP BY 1, 2)"


def _cov(spark, sf_dir):
    li = views.read(spark, sf_dir, "lineitem")
    x = F.array(F.col("l_quantity").cast("long"), F.round(F.col("l_discount") * 100).cast("long"), F.round(F.col("l_tax") * 100).cast("long"))
    return models.covariance(li.select(x.alias("x")), 3)


@query(f"WITH {_COV}, f AS (SELECT i, j, v FROM cov UNION ALL SELECT j, i, v FROM cov WHERE i <> j) SELECT i, j, round(3 * v, 5) AS scaled, round(exp(v / 100), 5) AS e, round(ln(greatest(v, 0.001)), 5) AS l, round((SELECT max(abs(v)) FROM f), 5) AS most, round((SELECT sqrt(sum(v * v)) FROM f), 5) AS l2 FROM f")
def matrix_functions(spark, sf_dir):
    full = op.matrix_expand(_cov(spark, sf_dir))
    scaled = op.matrix_add(op.matrix_scale(full, 2.0), full)
    out = scaled.withColumnRenamed("v", "s").join(op.matrix_map(op.matrix_scale(full, 0.01), "exp").withColumnRenamed("v", "e"), ["i", "j"]).join(op.matrix_map(full, "log", 0.001).withColumnRenamed("v", "l"), ["i", "j"])
    norms = op.matrix_norms(full)  # one row
    return out.crossJoin(F.broadcast(norms)).select("i", "j", F.round("s", 5).alias("scaled"), F.round("e", 5).alias("e"), F.round("l", 5).alias("l"), F.round("max_abs", 5).alias("most"), F.round("l2", 5).alias("l2"))


@query(f"WITH {_COV} SELECT i AS dim, round(1 / sqrt(v), 6) AS scale FROM cov WHERE i = j")
def diagonal_normalisation(spark, sf_dir):
    return op.diagonal_normalisation(_cov(spark, sf_dir)).withColumn("scale", F.round("scale", 6))
