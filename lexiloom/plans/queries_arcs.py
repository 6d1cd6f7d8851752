"""Queries of the arc table operators. The lattices are the lines of an order: line k leads from state k - 1 or k - 2 to state k, so paths branch and join."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions.tables import dealt
from lexiloom.operators import arcs as op
from lexiloom.operators import counts, lattice, slots

from . import views
from .catalogue import query

_LINKS = f"""{views.ORDER_LINES}, arc AS (SELECT l_orderkey AS segment_id, greatest(l_linenumber - 1 - k, 0)::BIGINT AS src, l_linenumber::BIGINT AS dst, flag AS label, greatest(l_linenumber - 1 - k, 0) * 10 AS start_t, l_linenumber * 10 AS end_t, quantity::DOUBLE + 3 * k AS score, part, discount
 FROM order_lines, unnest([0, 1]) AS t(k) WHERE k = 0 OR l_linenumber > 1)"""


def _arcs(spark, sf_dir):
    """Two arcs into every line's state: from the state before it, and past that one."""
    li = views.order_lines(spark, sf_dir)
    k = li.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).filter("k = 0 OR l_linenumber > 1")
    src = F.greatest(F.col("l_linenumber") - 1 - F.col("k"), F.lit(0))
    return k.select(F.col("l_orderkey").alias("segment_id"), src.cast("long").alias("src"), F.col("l_linenumber").cast("long").alias("dst"), F.col("flag").alias("label"), (src * 10).alias("start_t"), (F.col("l_linenumber") * 10).alias("end_t"), (F.col("quantity").cast("double") + 3 * F.col("k")).alias("score"), "part", "discount")


def _scored(spark, sf_dir):
    return slots.score_map(_arcs(spark, sf_dir), {"am": "score", "lm": "discount"})


@query(f"WITH {_LINKS} SELECT segment_id, src, dst, score + 1.5 AS added, 2 * score AS multiplied, round(exp(score / 100), 6) AS e, round(2 * ln(score), 6) AS l, discount AS other FROM arc")
def score_functions(spark, sf_dir):
    a, am = _scored(spark, sf_dir), lambda c: F.element_at(c, "am")
    s = F.col("scores")
    return a.select("segment_id", "src", "dst", am(op.score_add(s, "am", 1.5)).alias("added"), am(op.score_multiply(s, "am", 2.0)).alias("multiplied"), F.round(am(op.score_exp(s, "am", 0.01)), 6).alias("e"), F.round(am(op.score_log(s, "am", 2.0)), 6).alias("l"), F.element_at(op.score_add(s, "am", 1.5), "lm").alias("other"))


@query(f"WITH {_LINKS} SELECT segment_id, src, dst, label, score AS am, part::DOUBLE AS x FROM arc")
def append_scores(spark, sf_dir):
    a = _scored(spark, sf_dir)
    b = slots.score_map(_arcs(spark, sf_dir), {"x": "part", "am": "score"})
    return op.append_scores(a, b).select("segment_id", "src", "dst", "label", F.element_at("scores", "am").alias("am"), F.element_at("scores", "x").alias("x"))


@query(f"WITH {_LINKS}, c AS (SELECT label, count(*) / 1000.0::DOUBLE AS p FROM arc GROUP BY 1 HAVING label <> 'N') SELECT segment_id, src, dst, round(0.5 * coalesce(p, 2.5), 6) AS penalty FROM arc LEFT JOIN c USING (label)")
def arc_penalty(spark, sf_dir):
    a = _scored(spark, sf_dir)
    classes = a.filter("label <> 'N'").groupBy("label").agg((F.count("*") / 1000.0).alias("penalty"))
    return op.arc_penalty(a, classes, 2.5, 0.5).select("segment_id", "src", "dst", F.round(F.element_at("scores", "penalty"), 6).alias("penalty"))


@query(f"WITH {_LINKS} SELECT segment_id, src, dst, label, round(0.1 * coalesce(p_retailprice, 0), 4) AS pron FROM (SELECT segment_id, src, dst, concat('p', part) AS label, part FROM arc) LEFT JOIN part ON p_partkey = part")
def pronunciation_score(spark, sf_dir):
    a = _scored(spark, sf_dir).withColumn("label", F.concat(F.lit("p"), F.col("part").cast("string")))
    lexicon = views.read(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("label"), F.col("p_retailprice").alias("score"))
    return op.pronunciation_score(a, lexicon, 0.1).select("segment_id", "src", "dst", "label", F.round(F.element_at("scores", "pron"), 4).alias("pron"))


@query(f"WITH {_LINKS} SELECT segment_id, src, dst, coalesce(p_name, '*EPS*') AS label FROM arc LEFT JOIN (SELECT p_partkey, p_name FROM part WHERE p_size > 10) ON p_partkey = part")
def map_alphabet(spark, sf_dir):
    a = _arcs(spark, sf_dir).withColumn("label", F.col("part").cast("string"))
    names = views.read(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").cast("string").alias("label"), F.col("p_name").alias("to"))
    return op.map_alphabet(a, names).select("segment_id", "src", "dst", "label")


@query(f"""WITH {_LINKS}, w AS (SELECT segment_id, src, dst, start_t, end_t, score, CASE WHEN p_size > 40 THEN ['*EPS*'] ELSE string_split(lower(p_type), ' ') END AS ws FROM arc JOIN part ON p_partkey = part)
SELECT segment_id, start_t + (k - 1) * ((end_t - start_t) / len(ws)) AS start_t, start_t + k * ((end_t - start_t) / len(ws)) AS end_t, ws[k] AS label, CASE WHEN k = 1 THEN score ELSE 0.0 END AS score FROM w, unnest(range(1, len(ws) + 1)) AS t(k)""")
def map_arc_labels(spark, sf_dir):
    p = views.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.when(F.col("p_size") > 40, F.lit("[noise]")).otherwise(F.col("p_type")).alias("type"))
    a = _arcs(spark, sf_dir).join(p, "part").withColumn("label", F.col("type"))
    out = op.map_arc_labels(a, split=" ").select("segment_id", "start_t", "end_t", "label", "score")
    return out.withColumn("start_t", F.round("start_t", 9)).withColumn("end_t", F.round("end_t", 9))


@query(f"""WITH {_LINKS}, ok AS (SELECT * FROM arc WHERE discount < 0.08), s AS (SELECT segment_id, min(src) AS a, max(dst) AS b FROM ok GROUP BY 1),
ahead AS (WITH RECURSIVE r AS (SELECT segment_id, a AS state FROM s UNION SELECT ok.segment_id, ok.dst FROM ok JOIN r ON r.segment_id = ok.segment_id AND r.state = ok.src) SELECT * FROM r),
behind AS (WITH RECURSIVE r AS (SELECT segment_id, b AS state FROM s UNION SELECT ok.segment_id, ok.src FROM ok JOIN r ON r.segment_id = ok.segment_id AND r.state = ok.dst) SELECT * FROM r)
SELECT ok.segment_id, src, dst, label FROM ok JOIN ahead x ON x.segment_id = ok.segment_id AND x.state = ok.src JOIN behind y ON y.segment_id = ok.segment_id AND y.state = ok.dst""")
def clean_up(spark, sf_dir):
    a = _arcs(spark, sf_dir)
    broken = a.withColumn("score", F.when(F.col("discount") >= 0.08, float("inf")).otherwise(F.col("score")))
    return op.clean_up(broken).select("segment_id", "src", "dst", "label")


@query(f"WITH {_LINKS}, m AS (SELECT segment_id, CASE WHEN src = 2 THEN 1 ELSE src END AS src, CASE WHEN dst = 2 THEN 1 ELSE dst END AS dst, label, NOT (src = 1 AND dst = 2) AS k FROM arc) SELECT segment_id, src, dst, label FROM m WHERE k AND src <> dst AND segment_id IN (SELECT segment_id FROM arc WHERE src = 1 AND dst = 2) UNION ALL SELECT segment_id, src, dst, label FROM arc WHERE segment_id NOT IN (SELECT segment_id FROM arc WHERE src = 1 AND dst = 2)")
def remove_null_arcs(spark, sf_dir):
    a = _arcs(spark, sf_dir)
    null = (F.col("src") == 1) & (F.col("dst") == 2)
    marked = a.withColumn("label", F.when(null, op.EPSILON).otherwise(F.col("label"))).withColumn("end_t", F.when(null, F.col("start_t")).otherwise(F.col("end_t")))
    return op.remove_null_arcs(marked).select("segment_id", "src", "dst", "label")


@query(f"""WITH {_LINKS}, b AS (SELECT segment_id, min(least(src, dst)) AS a, max(greatest(src, dst)) AS z, 10 AS s, 40 AS e FROM arc GROUP BY 1), c AS (SELECT segment_id, src, dst, label, greatest(start_t, s) AS start_t, least(end_t, e) AS end_t, a, z, s, e FROM arc JOIN b USING (segment_id)),
d AS (SELECT segment_id, CASE WHEN start_t = s THEN a ELSE src END AS src, CASE WHEN end_t = e THEN z ELSE dst END AS dst, label, start_t, end_t FROM c WHERE start_t <= end_t) SELECT * FROM d WHERE src <> dst""")
def fit(spark, sf_dir):
    a = _arcs(spark, sf_dir)
    bounds = a.select("segment_id", F.lit(10).alias("start"), F.lit(40).alias("end")).distinct()
    return op.fit(a, bounds).select("segment_id", "src", "dst", "label", "start_t", "end_t")


@query(f"WITH {_LINKS} SELECT segment_id, system, count(*) AS n, min(src) AS first, max(dst) AS last FROM (SELECT segment_id, 2 * src AS src, 2 * dst AS dst, 0 AS system FROM arc UNION ALL SELECT segment_id, 2 * src + 1, 2 * dst + 1, 1 FROM arc WHERE score < 30) GROUP BY 1, 2")
def unite(spark, sf_dir):
    a = _arcs(spark, sf_dir)
    return dealt(op.unite(a, a.filter("score < 30")), "segment_id").groupBy("segment_id", "system").agg(F.count("*").alias("n"), F.min("src").alias("first"), F.max("dst").alias("last"))


@query(f"""WITH {_LINKS}, n AS (SELECT segment_id, o_custkey AS recording_id, max(dst) AS n FROM arc JOIN orders ON o_orderkey = segment_id GROUP BY 1, 2), h AS (SELECT segment_id, recording_id, coalesce(sum(n) OVER (PARTITION BY recording_id ORDER BY segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM n)
SELECT recording_id, segment_id, src + a AS src, dst + a AS dst, label FROM arc JOIN h USING (segment_id)""")
def concatenate(spark, sf_dir):
    order = views.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("segment_id"), F.col("o_custkey").alias("recording_id"), F.col("o_orderkey").alias("seq"))
    return op.concatenate(_arcs(spark, sf_dir), order).select("recording_id", "segment_id", "src", "dst", "label")


_WORDS = r"list_filter(regexp_split_to_array(orth, '[ \t\n]+'), lambda x: x <> '')"


@query(f"WITH w AS (SELECT segment_id, {_WORDS} AS w FROM segments) SELECT segment_id, i - 1 AS src, i AS dst, w[i] AS label FROM w, unnest(range(1, len(w) + 1)) AS t(i)", "segments")
def strings_to_lattice(spark, sf_dir):
    return op.strings_to_lattice(views.segments(spark, sf_dir), counts.tokens(F.col("orth")))


@query(f"WITH {_LINKS}, p AS (SELECT segment_id, src, dst, label, score AS posterior FROM arc), b AS (SELECT *, max(posterior) OVER (PARTITION BY segment_id) AS m FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY posterior DESC, src, dst, label) AS r FROM b WHERE posterior >= m * exp(-0.5)) SELECT segment_id, src, dst, label FROM k WHERE r <= 4")
def prune_by_posterior(spark, sf_dir):
    a = _arcs(spark, sf_dir).withColumn("posterior", F.col("score"))
    return op.prune_by_posterior(a, 0.5, 4).select("segment_id", "src", "dst", "label")


_PATHS = f"""{_LINKS}, m AS (SELECT segment_id, min(src) AS a, max(dst) AS z FROM arc GROUP BY 1),
paths AS (WITH RECURSIVE r AS (SELECT segment_id, a AS state, '' AS words, 0.0::DOUBLE AS score FROM m UNION ALL SELECT r.segment_id, arc.dst, CASE WHEN words = '' THEN label ELSE concat(words, ' ', label) END, r.score + arc.score FROM r JOIN arc ON arc.segment_id = r.segment_id AND arc.src = r.state) SELECT * FROM r),
ends AS (SELECT segment_id, words, min(score) AS score FROM paths JOIN m USING (segment_id) WHERE state = z GROUP BY 1, 2)"""


@query(f"WITH {_PATHS}, k AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY score, words) - 1 AS rank FROM ends) SELECT segment_id, rank, words, score FROM k WHERE rank < 5")
def n_best(spark, sf_dir):
    return lattice.n_best(_arcs(spark, sf_dir), 5)


@query(f"WITH {_PATHS} SELECT segment_id, min(score) AS score FROM ends GROUP BY 1")
def best_path_branching(spark, sf_dir):
    return lattice.best_path(_arcs(spark, sf_dir)).groupBy("segment_id").agg(F.sum("score").alias("score"))


@query(f"""WITH {_LINKS}, m AS (SELECT segment_id, min(src) AS a, max(dst) AS z FROM arc GROUP BY 1),
f AS (WITH RECURSIVE r AS (SELECT segment_id, a AS state, 1.0::DOUBLE AS p FROM m UNION ALL SELECT r.segment_id, arc.dst, p * exp(-0.05 * arc.score) FROM r JOIN arc ON arc.segment_id = r.segment_id AND arc.src = r.state) SELECT segment_id, state, sum(p) AS p FROM r GROUP BY 1, 2),
b AS (WITH RECURSIVE r AS (SELECT segment_id, z AS state, 1.0::DOUBLE AS p FROM m UNION ALL SELECT r.segment_id, arc.src, p * exp(-0.05 * arc.score) FROM r JOIN arc ON arc.segment_id = r.segment_id AND arc.dst = r.state) SELECT segment_id, state, sum(p) AS p FROM r GROUP BY 1, 2),
t AS (SELECT segment_id, p AS total FROM f JOIN m USING (segment_id) WHERE state = z)
SELECT arc.segment_id, src, dst, label, round(coalesce(f.p, 0) * exp(-0.05 * score) * coalesce(b.p, 0) / total, 6) AS posterior FROM arc LEFT JOIN f ON f.segment_id = arc.segment_id AND f.state = src LEFT JOIN b ON b.segment_id = arc.segment_id AND b.state = dst JOIN t ON t.segment_id = arc.segment_id""")
def arc_posteriors_branching(spark, sf_dir):
    return lattice.arc_posteriors(_arcs(spark, sf_dir), 0.05).withColumn("posterior", F.round("posterior", 6))


@query(f"""WITH {_PATHS}, k AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY score, words) - 1 AS rank FROM ends), n AS (SELECT segment_id, rank, words, score, score - 2 * length(words) AS total FROM k WHERE rank < 5)
SELECT segment_id, rank, total, row_number() OVER (PARTITION BY segment_id ORDER BY total, rank) - 1 AS new_rank FROM n""")
def rescore_with_lm(spark, sf_dir):
    best = lattice.n_best(_arcs(spark, sf_dir), 5)
    lm = best.select("segment_id", "rank", (-F.length("words")).cast("double").alias("lm"))
    return op.rescore_with_lm(best, lm, 2.0).select("segment_id", "rank", "total", "new_rank")


@query(f"WITH {_LINKS}, p AS (SELECT segment_id, dst - 1 AS pos, label, start_t, end_t, score FROM arc WHERE src = dst - 1 AND label <> 'N') SELECT segment_id, start_t AS start, end_t AS \"end\", label AS word, round(exp(-score), 9) AS conf, row_number() OVER (PARTITION BY segment_id ORDER BY pos) - 1 AS i FROM p")
def traceback_words(spark, sf_dir):
    path = _arcs(spark, sf_dir).filter("src = dst - 1").withColumn("pos", F.col("src"))
    return op.traceback_words(path, "N").withColumn("conf", F.round("conf", 9))


@query(f"WITH {_LINKS}, r AS (SELECT segment_id, max(dst) AS n_tokens, count(*) FILTER (label <> 'N') AS n_arcs FROM arc GROUP BY 1) SELECT segment_id, n_arcs, n_tokens, round(n_arcs / n_tokens, 6) AS density FROM r")
def lattice_density(spark, sf_dir):
    a = _arcs(spark, sf_dir)
    return op.lattice_density(a, a.groupBy("segment_id").agg(F.max("dst").alias("n_tokens")), "N").withColumn("density", F.round("density", 6))


@query(f"""WITH {_LINKS}, u AS (SELECT segment_id, start_t, end_t, label, score FROM arc UNION ALL SELECT segment_id, start_t, end_t, label || '2', score / 2 FROM arc UNION ALL SELECT segment_id, start_t, end_t, label, score - 1 FROM arc WHERE label <> 'N'),
b AS (SELECT segment_id, t, row_number() OVER (PARTITION BY segment_id ORDER BY t) - 1 AS k FROM (SELECT segment_id, start_t AS t FROM u UNION SELECT segment_id, end_t FROM u))
SELECT segment_id, x.k AS src, y.k AS dst, label, start_t, end_t, min(score) AS score FROM u JOIN b x USING (segment_id) JOIN b y USING (segment_id) WHERE x.t = start_t AND y.t = end_t AND start_t < end_t GROUP BY ALL""")
def merge_states(spark, sf_dir):
    """Three lattices of each order side by side, with states of their own; those of equal time become one."""
    a = _arcs(spark, sf_dir)
    other = a.withColumn("label", F.concat("label", F.lit("2"))).withColumn("score", F.col("score") / 2)
    third = a.filter("label <> 'N'").withColumn("score", F.col("score") - 1)
    return op.merge_states(op.unite(a, other, third))


@query(f"""WITH {_LINKS}, u AS (SELECT *, src % 2 AS sc, dst % 3 AS dc FROM arc), b AS (SELECT segment_id, t, c, row_number() OVER (PARTITION BY segment_id ORDER BY t, c) - 1 AS k FROM (SELECT segment_id, start_t AS t, sc AS c FROM u UNION SELECT segment_id, end_t, dc FROM u))
SELECT segment_id, x.k AS src, y.k AS dst, label, start_t, end_t, min(score) AS score FROM u JOIN b x USING (segment_id) JOIN b y USING (segment_id) WHERE x.t = start_t AND x.c = sc AND y.t = end_t AND y.c = dc AND start_t < end_t GROUP BY ALL""")
def merge_states_full(spark, sf_dir):
    """States of equal time and context; an arc's begin and end have contexts of their own here."""
    a = _arcs(spark, sf_dir).withColumn("src_context", F.col("src") % 2).withColumn("dst_context", F.col("dst") % 3)
    return op.merge_states(a, "full")


def _rates(lower: str, upper: str, threshold: float) -> str:
    """SQL of the pruning by rates: thresholds shrink and then grow in steps."""
    return f"""f AS (SELECT *, score / 20 AS c FROM arc), s AS (SELECT segment_id, list(c) AS s, min(c) AS least, max(c) - min(c) AS span, (max(end_t) - min(start_t)) / 100.0 AS sec FROM f GROUP BY 1),
    l AS (SELECT *, floor({lower} * sec) AS few, floor({upper} * sec) AS many, least({threshold}, span) AS t0 FROM s),
    d AS (SELECT *, list_reduce(list_prepend(t0, list_transform(range(80), lambda i: 0.0)), lambda t, i: CASE WHEN len(list_filter(s, lambda x: x - least <= t)) > many AND t > 0.1 THEN t * 0.9 ELSE t END) AS t1 FROM l),
    g AS (SELECT *, CASE WHEN {lower} > 0 THEN list_reduce(list_prepend(t1, list_transform(range(60), lambda i: 0.0)), lambda t, i: CASE WHEN len(list_filter(s, lambda x: x - least <= t)) < few AND t < 100 AND t > 0 THEN t * 1.2 ELSE t END) ELSE t1 END AS t2 FROM d)
    SELECT f.segment_id, src, dst, label FROM f JOIN g USING (segment_id) WHERE ({lower} > 0 AND len(s) <= few) OR c - least <= t2"""


@query(f"WITH {_LINKS}, {_rates('8.0', '12.0', 1.51)}")
def prune_by_rate(spark, sf_dir):
    """Between 8 and 12 arcs a second: some orders stay whole, some lose arcs by the threshold, some more, some fewer."""
    a = _arcs(spark, sf_dir).withColumn("posterior", F.exp(-F.col("score") / 20))
    return op.prune_by_rate(a, 1.51, 8.0, 12.0).select("segment_id", "src", "dst", "label")


@query(f"WITH {_LINKS}, {_rates('0.0', '9.0', 0.81)}")
def prune_by_most(spark, sf_dir):
    a = _arcs(spark, sf_dir).withColumn("posterior", F.exp(-F.col("score") / 20))
    return op.prune_by_rate(a, 0.81, 0.0, 9.0).select("segment_id", "src", "dst", "label")


@query(f"WITH {_LINKS} SELECT segment_id, src, dst, label, score AS am, 0.5::DOUBLE AS other FROM arc")
def change_semiring(spark, sf_dir):
    s = slots.change_semiring(F.col("scores"), ["other", "am"], 0.5)
    return _scored(spark, sf_dir).select("segment_id", "src", "dst", "label", F.element_at(s, "am").alias("am"), F.element_at(s, "other").alias("other"))
