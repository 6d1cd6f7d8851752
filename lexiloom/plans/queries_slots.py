"""Queries of alignment, slot, arc and evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions.tables import dealt
from lexiloom.operators import counts, evaluate, slots

from . import views
from .catalogue import query
from .queries_counts import _TOKENS

_AL = f"{views.ORDER_LINES}, al AS (SELECT l_orderkey AS segment_id, l_linenumber AS t, flag AS label, quantity::DOUBLE AS weight FROM order_lines)"
_CN0 = "cn0 AS (SELECT segment_id, slot, label, sum(w)::DOUBLE AS posterior FROM arcs GROUP BY ALL)"
_CN = f"{_CN0}, cn AS (SELECT segment_id, slot, label, posterior / sum(posterior) OVER (PARTITION BY segment_id, slot) AS posterior FROM cn0)"


def _alignment(spark, sf_dir):
    li = views.order_lines(spark, sf_dir)
    return li.select(F.col("l_orderkey").alias("segment_id"), F.col("l_linenumber").alias("t"), F.col("flag").alias("label"), F.col("quantity").cast("double").alias("weight"))


def _cn(spark, sf_dir):
    raw = dealt(views.arcs(spark, sf_dir), "segment_id").groupBy("segment_id", "slot", "label").agg(F.sum("w").cast("double").alias("posterior"))
    return slots.normalise_cn(raw)


def _rounded(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query(f"WITH {_AL} SELECT segment_id, t // 2 AS t, label, sum(weight) AS weight FROM al GROUP BY 1, 2, 3")
def combine_items_sum(spark, sf_dir):
    a = _alignment(spark, sf_dir).withColumn("t", F.floor(F.col("t") / 2).cast("int"))
    return slots.combine_items(a, "sum")


@query(f"WITH {_AL} SELECT segment_id, t // 2 AS t, label, round(min(weight) - ln(sum(exp(-weight)) / exp(-min(weight))), 6) AS weight FROM al GROUP BY 1, 2, 3")
def combine_items_log(spark, sf_dir):
    a = _alignment(spark, sf_dir).withColumn("t", F.floor(F.col("t") / 2).cast("int"))
    return _rounded(slots.combine_items(a, "log"), "weight")


@query(f"WITH {_AL} SELECT segment_id, t, round(exp(-weight / 50), 6) AS p, round(CASE WHEN weight = 0 THEN 0.0 ELSE weight ** 0.5 END, 6) AS g FROM al")
def expm_and_gamma(spark, sf_dir):
    return _alignment(spark, sf_dir).select("segment_id", "t", F.round(slots.expm(F.col("weight") / 50), 6).alias("p"), F.round(slots.gamma_correct(F.col("weight"), 0.5), 6).alias("g"))


@query(f"WITH {_AL} SELECT segment_id, t FROM al WHERE weight BETWEEN 10 AND 20")
def filter_weights(spark, sf_dir):
    return slots.filter_weights(_alignment(spark, sf_dir), 10, 20).select("segment_id", "t")


@query(f"WITH {_AL}, h AS (SELECT segment_id, t, t // 3 AS f, weight FROM al) SELECT segment_id, t, round(weight / sum(weight) OVER w, 6) AS share, weight - min(weight) OVER w AS shifted FROM h WINDOW w AS (PARTITION BY segment_id, f)")
def normalise_weights(spark, sf_dir):
    a = _alignment(spark, sf_dir).withColumn("line", F.col("t")).withColumn("t", F.floor(F.col("t") / 3))
    share = slots.normalise_weights(a).select("segment_id", F.col("line").alias("t"), F.round("weight", 6).alias("share"))
    return share.join(slots.shift_min_to_zero(a).select("segment_id", F.col("line").alias("t"), F.col("weight").alias("shifted")), ["segment_id", "t"])


@query(f"WITH {_AL} SELECT a.segment_id, a.t + 2 AS t, a.label, a.weight * b.weight AS weight FROM al a JOIN al b ON a.segment_id = b.segment_id AND a.t + 2 = b.t AND a.label = b.label")
def multiply_alignments(spark, sf_dir):
    a = _alignment(spark, sf_dir)
    return slots.multiply_alignments(slots.time_offset(a, 2), a)


@query(f"WITH {_AL} SELECT segment_id, t, CASE WHEN label = 'N' THEN 'n' ELSE 'x' END AS label, sum(weight) AS weight FROM al GROUP BY 1, 2, 3")
def map_labels(spark, sf_dir):
    a = _alignment(spark, sf_dir)
    return slots.map_labels(a, slots.vocab_of(a).withColumn("to", F.when(F.col("label") == "N", "n").otherwise("x")))


@query(f"WITH {_AL} SELECT segment_id, t, (weight >= 25)::INT AS mask FROM al")
def confidence_mask(spark, sf_dir):
    return slots.confidence_mask(_alignment(spark, sf_dir), 25).select("segment_id", "t", "mask")


@query(f"WITH {_AL} SELECT segment_id, count(*) FILTER (label IN ('A', 'N')) AS kept, count(*) AS n FROM al GROUP BY 1")
def label_selection(spark, sf_dir):
    return slots.label_selection(_alignment(spark, sf_dir), ["A", "N"])


@query(f"""WITH {_AL}, c AS (SELECT *, (label IS DISTINCT FROM lag(label) OVER w OR row_number() OVER w = 1)::INT AS n FROM al WINDOW w AS (PARTITION BY segment_id ORDER BY t)), r AS (SELECT *, sum(n) OVER (PARTITION BY segment_id ORDER BY t) - 1 AS run FROM c)
SELECT segment_id, run::BIGINT AS run, min(label) AS label, min(t) AS start, max(t) + 1 AS "end" FROM r GROUP BY segment_id, run""")
def word_spans(spark, sf_dir):
    return slots.word_spans(_alignment(spark, sf_dir))


def _timed(spark, sf_dir):
    li = views.read(spark, sf_dir, "lineitem")
    start = (F.col("l_linenumber") * 3).cast("long")
    return li.select(F.col("l_orderkey").alias("segment_id"), F.col("l_returnflag").alias("label"), start.alias("start_t"), (start + F.col("l_partkey") % 7).alias("end_t"), F.col("l_quantity").cast("long").alias("posterior"))


_TIMED = "timed AS (SELECT l_orderkey AS segment_id, l_returnflag AS label, l_linenumber * 3 AS start_t, l_linenumber * 3 + l_partkey % 7 AS end_t, l_quantity::BIGINT AS posterior FROM lineitem), fr AS (SELECT segment_id, t, label, sum(posterior)::BIGINT AS weight FROM timed, unnest(range(start_t::BIGINT, end_t::BIGINT)) AS u(t) GROUP BY ALL)"


@query(f"WITH {_TIMED} SELECT segment_id, t, label, weight FROM fr")
def posteriors_to_alignment(spark, sf_dir):
    return slots.posteriors_to_alignment(_timed(spark, sf_dir))


@query(f"WITH {_TIMED} SELECT segment_id, t AS slot, label, round(weight / sum(weight) OVER (PARTITION BY segment_id, t), 6) AS posterior FROM fr")
def frame_cn(spark, sf_dir):
    return _rounded(slots.frame_cn(_timed(spark, sf_dir)), "posterior")


@query(f"WITH {_CN} SELECT segment_id, slot, label, round(posterior, 6) AS posterior FROM cn", "arcs")
def normalise_cn(spark, sf_dir):
    return _rounded(_cn(spark, sf_dir), "posterior")


@query(f"WITH {_CN} SELECT segment_id, slot, label, round(posterior, 6) AS posterior FROM (SELECT *, row_number() OVER (PARTITION BY segment_id, slot ORDER BY posterior DESC, label) AS r FROM cn) WHERE r = 1", "arcs")
def decode_cn(spark, sf_dir):
    return _rounded(slots.decode_cn(_cn(spark, sf_dir)), "posterior")


@query(f"""WITH {_CN}, k AS (SELECT *, coalesce(sum(posterior) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, row_number() OVER w AS r FROM cn WINDOW w AS (PARTITION BY segment_id, slot ORDER BY posterior DESC, label)),
p AS (SELECT * FROM k WHERE b < 0.61803 AND r <= 2) SELECT segment_id, slot, label, round(posterior / sum(posterior) OVER (PARTITION BY segment_id, slot), 6) AS posterior FROM p""", "arcs")
def prune_cn(spark, sf_dir):
    return _rounded(slots.prune_cn(_cn(spark, sf_dir), 0.61803, 2), "posterior")


@query(f"""WITH {_CN}, e AS (SELECT *, sum(CASE WHEN label = 'R1' THEN posterior ELSE 0.0 END) OVER (PARTITION BY segment_id, slot) AS e FROM cn) SELECT segment_id, dense_rank() OVER (PARTITION BY segment_id ORDER BY slot) - 1 AS slot, label FROM e WHERE e <= 0.31415""", "arcs")
def drop_epsilon_slots(spark, sf_dir):
    return slots.drop_epsilon_slots(_cn(spark, sf_dir), "R1", 0.31415).select("segment_id", F.col("slot").cast("long").alias("slot"), "label")


@query(f"WITH {_CN} SELECT segment_id, slot, round(sum(CASE WHEN posterior > 0 THEN -posterior * log2(posterior) ELSE 0.0 END), 5) + 0.0 AS entropy FROM cn GROUP BY 1, 2", "arcs")
def slot_entropy(spark, sf_dir):
    return slots.slot_entropy(_cn(spark, sf_dir)).withColumn("entropy", F.round("entropy", 5) + 0.0)


@query(f"""WITH {_CN}, a AS (SELECT segment_id, slot, label, sum(p) AS p FROM (SELECT segment_id, slot, label, 0.7071067811865476 * posterior AS p FROM cn UNION ALL SELECT segment_id, slot, upper(left(label, 1)), 0.2928932188134524 * posterior FROM cn) GROUP BY ALL)
SELECT segment_id, slot, label, round(p / sum(p) OVER (PARTITION BY segment_id, slot), 6) AS posterior FROM a""", "arcs")
def combine_cns(spark, sf_dir):
    cn = _cn(spark, sf_dir)
    other = cn.withColumn("label", F.upper(F.left("label", F.lit(1))))
    return _rounded(slots.combine_cns([cn, other], [0.7071067811865476, 0.2928932188134524]), "posterior")


@query(f"WITH {_CN} SELECT segment_id, slot, label, round(posterior ** 0.7 / sum(posterior ** 0.7) OVER (PARTITION BY segment_id, slot), 6) AS posterior FROM cn", "arcs")
def gamma_correct_cn(spark, sf_dir):
    return _rounded(slots.gamma_correct_cn(_cn(spark, sf_dir), 0.7), "posterior")


@query(f"WITH {_CN} SELECT segment_id, slot, label, round(-ln(posterior), 5) + 0.0 AS score, row_number() OVER (PARTITION BY segment_id, slot ORDER BY posterior DESC, label) AS rank FROM cn", "arcs")
def cn_features(spark, sf_dir):
    return slots.cn_features(_cn(spark, sf_dir)).select("segment_id", "slot", "label", (F.round("score", 5) + 0.0).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_CN}, s AS (SELECT segment_id, max(slot) + 1 AS n FROM cn GROUP BY 1), a AS (SELECT segment_id, o_custkey AS recording_id, coalesce(sum(n) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM s JOIN orders ON o_orderkey = segment_id)
SELECT recording_id, (slot + ahead)::BIGINT AS slot, label, round(posterior, 6) AS posterior FROM cn JOIN a USING (segment_id)""", "arcs")
def concatenate_cns(spark, sf_dir):
    order = views.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("segment_id"), F.col("o_custkey").alias("recording_id"), F.col("o_orderkey").alias("seq"))
    return _rounded(slots.concatenate_cns(_cn(spark, sf_dir), order), "posterior")


@query("SELECT l_orderkey AS segment_id, l_linenumber AS line, round(2 * l_quantity + 0.5 * l_tax, 6) AS total, round(l_quantity + 0.5 * l_tax / 2, 6) AS reduced FROM lineitem")
def arc_scores(spark, sf_dir):
    a = slots.score_map(views.read(spark, sf_dir, "lineitem"), {"am": "l_quantity", "lm": "l_tax", "x": "l_discount"})
    kept = a.withColumn("kept", slots.rescale(F.col("scores"), {"am": 2.0, "lm": 0.5})).withColumn("reduced", slots.score_reduce(F.col("scores"), "am", {"lm": 0.5}, 2.0))
    return kept.select(F.col("l_orderkey").alias("segment_id"), F.col("l_linenumber").alias("line"), F.round(slots.project_score(F.col("kept"), {"am": 1.0, "lm": 1.0}), 6).alias("total"), F.round(F.element_at("reduced", "am"), 6).alias("reduced"))


@query("SELECT segment_id, slot, label, w FROM (SELECT *, min(w) OVER (PARTITION BY segment_id) AS m FROM arcs) WHERE w <= m + 5", "arcs")
def prune_by_score(spark, sf_dir):
    return slots.prune_by_score(views.arcs(spark, sf_dir), "w", 5)


@query("SELECT segment_id, count(*) AS n_arcs, count(DISTINCT slot) AS n_slots, min(w) AS best FROM arcs GROUP BY 1", "arcs")
def lattice_info(spark, sf_dir):
    return slots.lattice_info(views.arcs(spark, sf_dir))


@query("SELECT segment_id, slot, label, min(w) AS w FROM arcs GROUP BY 1, 2, 3", "arcs")
def mesh(spark, sf_dir):
    return slots.mesh(views.arcs(spark, sf_dir))


@query("SELECT segment_id, slot, label, w FROM arcs WHERE label NOT IN (SELECT concat('A', s_suppkey) FROM supplier)", "arcs")
def filter_arcs(spark, sf_dir):
    labels = views.read(spark, sf_dir, "supplier").select(F.concat(F.lit("A"), F.col("s_suppkey").cast("string")).alias("label"))
    return slots.filter_arcs(views.arcs(spark, sf_dir), labels, invert=True).select("segment_id", "slot", "label", "w")


@query("SELECT DISTINCT label FROM arcs", "arcs")
def vocab_of(spark, sf_dir):
    return slots.vocab_of(views.arcs(spark, sf_dir))


def _pairs(spark, sf_dir):
    """Turns as references; the hypothesis lacks every word of length 4 and has words of length 3 in upper case."""
    s = views.segments(spark, sf_dir).select("segment_id", "speaker_id", "condition_id", counts.tokens(F.col("orth")).alias("ref"))
    return s.withColumn("hyp", F.transform(F.filter("ref", lambda w: F.length(w) != 4), lambda w: F.when(F.length(w) == 3, F.upper(w)).otherwise(w)))


@query(None)
def word_errors(spark, sf_dir):
    return evaluate.word_errors(_pairs(spark, sf_dir))


def _least_costs(pairs: str, same: str) -> str:
    """SQL tables that align ``r`` and ``h`` of every segment word by word: ``rows`` has a row of costs for each beginning of ``r``."""
    return f"""p AS (SELECT segment_id, {_TOKENS} AS w FROM segments), pairs AS MATERIALIZED ({pairs}), costs AS (
    SELECT segment_id, r, h, 0 AS i, range(0, len(h) + 1) AS c FROM pairs
    UNION ALL SELECT segment_id, r, h, i + 1, list_reduce(list_prepend([(i + 1)::BIGINT], list_transform(range(1, len(h) + 1), lambda j: [least(c[j + 1] + 1, c[j] + CASE WHEN {same} THEN 0 ELSE 1 END)])), lambda a, x: list_append(a, least(a[-1] + 1, x[1]))) FROM costs WHERE i < len(r))"""


#: Turns against themselves with words of length 4 left out, of length 3 doubled, of length 6 in upper case.
_OTHER = "flatten(list_transform(list_filter(w, lambda x: length(x) <> 4), lambda x: CASE length(x) WHEN 3 THEN [x, x] WHEN 6 THEN [upper(x)] ELSE [x] END))"


def _unequal(spark, sf_dir):
    s = views.segments(spark, sf_dir).select("segment_id", counts.tokens(F.col("orth")).alias("ref"))
    other = F.transform(F.filter("ref", lambda w: F.length(w) != 4), lambda w: F.when(F.length(w) == 3, F.array(w, w)).when(F.length(w) == 6, F.array(F.upper(w))).otherwise(F.array(w)))
    return s.withColumn("hyp", F.flatten(other))


@query(f"WITH RECURSIVE {_least_costs(f'SELECT segment_id, w AS r, {_OTHER} AS h FROM p', 'r[i + 1] = h[j]')} SELECT segment_id, len(r) AS n_tokens, c[-1] AS errors FROM costs WHERE i = len(r)", "segments")
def word_error_totals(spark, sf_dir):
    """Least numbers of errors between texts of unequal lengths."""
    e = evaluate.word_errors(_unequal(spark, sf_dir))
    return e.select("segment_id", "n_tokens", (F.col("n_ins") + F.col("n_del") + F.col("n_sub")).alias("errors"))


#: Words of length 5 broken off before the last two letters, of length 7 without their first two.
_BROKEN = "list_transform(w, lambda x: CASE length(x) WHEN 5 THEN x[1:3] || '-' WHEN 7 THEN '-' || x[3:7] ELSE x END)"
_MATCH = """CASE WHEN r[i + 1][1] <> '-' THEN r[i + 1] = h[j] OR (r[i + 1][-1] = '-' AND starts_with(h[j], r[i + 1][:-2]) AND NOT starts_with(h[j], r[i + 1]))
    WHEN length(r[i + 1]) > 1 AND r[i + 1][-1] = '-' AND strlen(h[j]) >= strlen(r[i + 1]) - 2 THEN strlen(h[j]) >= strlen(r[i + 1]) AND instr(h[j], r[i + 1][2:-2]) BETWEEN 1 AND strlen(h[j]) - strlen(r[i + 1]) + 1 ELSE ends_with(h[j], r[i + 1][2:]) END"""


@query(f"WITH RECURSIVE {_least_costs(f'SELECT segment_id, {_BROKEN} AS r, {_OTHER} AS h FROM p', _MATCH)} SELECT segment_id, len(r) AS n_tokens, c[-1] AS errors FROM costs WHERE i = len(r)", "segments")
def broken_word_errors(spark, sf_dir):
    """The same hypotheses against references with broken words."""
    broken = F.transform("ref", lambda w: F.when(F.length(w) == 5, F.concat(F.substring(w, 1, 3), F.lit("-"))).when(F.length(w) == 7, F.concat(F.lit("-"), F.substring(w, 3, 5))).otherwise(w))
    e = evaluate.word_errors(_unequal(spark, sf_dir).withColumn("ref", broken), broken=True)
    return e.select("segment_id", "n_tokens", (F.col("n_ins") + F.col("n_del") + F.col("n_sub")).alias("errors"))


@query(None)
def confusion_pairs(spark, sf_dir):
    return evaluate.confusion_pairs(evaluate.edit_alignment(_pairs(spark, sf_dir)))


@query("""SELECT segment_id, levenshtein(regexp_replace(lower(orth), '[^a-z]', '', 'g'), regexp_replace(lower(orth), '[^a-dg-z]', '', 'g')) AS distance FROM segments""", "segments")
def letter_errors(spark, sf_dir):
    s = views.segments(spark, sf_dir)
    d = evaluate.letter_distance(F.regexp_replace(F.lower("orth"), "[^a-z]", ""), F.regexp_replace(F.lower("orth"), "[^a-dg-z]", ""))
    return s.select("segment_id", d.cast("long").alias("distance"))


@query(f"""WITH e AS (SELECT speaker_id, condition_id, len(w) AS n_tokens, len(list_filter(w, lambda x: length(x) = 4)) AS n_del, 0 AS n_ins, len(list_filter(w, lambda x: length(x) = 3 AND upper(x) <> x)) AS n_sub FROM (SELECT *, {_TOKENS} AS w FROM segments))
SELECT speaker_id, condition_id, grouping_id(speaker_id, condition_id) AS level, sum(n_del + n_ins + n_sub)::BIGINT AS errors, sum(n_tokens)::BIGINT AS tokens, count(*) AS segments, count(*) FILTER (n_del + n_ins + n_sub > 0) AS wrong_segments,
 round(100 * sum(n_del + n_ins + n_sub) / sum(n_tokens), 4) AS rate, round(100 * count(*) FILTER (n_del + n_ins + n_sub > 0) / count(*), 4) AS segment_rate FROM e GROUP BY GROUPING SETS ((speaker_id), (condition_id), ())""", "segments")
def error_rate(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    lengths = lambda n: F.size(F.filter("ref", lambda w: n(w))).cast("long")
    e = p.select("speaker_id", "condition_id", F.size("ref").cast("long").alias("n_tokens"), lengths(lambda w: F.length(w) == 4).alias("n_del"), F.lit(0).alias("n_ins"), lengths(lambda w: (F.length(w) == 3) & (F.upper(w) != w)).alias("n_sub"))
    return evaluate.error_rate(e, ["speaker_id", "condition_id"])


@query(f"WITH w AS (SELECT segment_id, lower(unnest({_TOKENS})) AS word FROM segments), m AS (SELECT segment_id, CASE WHEN word = 'the' THEN '' WHEN word = 'and' THEN '&' ELSE word END AS word FROM w) SELECT word, count(*) AS n FROM m WHERE word <> '' GROUP BY 1", "segments")
def normalise_for_eval(spark, sf_dir):
    w = views.segments(spark, sf_dir).select("segment_id", F.explode(counts.tokens(F.col("orth"))).alias("word"))
    rules = spark.createDataFrame([("the", ""), ("and", "&")], "word string, to string")
    return evaluate.normalise_for_eval(w, rules).groupBy("word").agg(F.count("*").alias("n"))
