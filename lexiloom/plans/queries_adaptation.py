"""Queries of the operators on segment and speaker models, of users' functions, and of further forms of frame, slot and lexicon operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lexiloom.functions import scorers
from lexiloom.operators import adaptation, confusion, frames, lexicon, models, slots, transcripts, vectors

from . import views
from .catalogue import query
from .queries_frames import _E
from .queries_models import _DENSITIES, _LINES, _densities, _lines
from .queries_slots import _AL, _CN, _alignment, _cn
from .queries_transcripts import _WORDS, _words

_EDGES = "w AS (PARTITION BY segment_id ORDER BY tick, event_id), v AS (PARTITION BY segment_id ORDER BY tick, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


@query(f"""WITH s AS (SELECT event_id, x, coalesce(lag(x, 2) OVER w, first_value(x) OVER w) AS a, coalesce(lag(x, 1) OVER w, first_value(x) OVER w) AS b, coalesce(lead(x, 1) OVER w, last_value(x) OVER v) AS c, coalesce(lead(x, 2) OVER w, last_value(x) OVER v) AS d FROM frames WINDOW {_EDGES})
SELECT event_id, round((-10 * a + 5 * b + 10 * x + 5 * c - 10 * d) / -35, 6) AS curve FROM s""", "frames")
def regression_second_order(spark, sf_dir):
    return frames.regression(views.frames(spark, sf_dir), 2, _E, degree=2).select("event_id", F.round("curve", 6).alias("curve"))


@query("""WITH t AS (SELECT label, floor(x / 500)::BIGINT AS bin, count(*) AS n FROM frames GROUP BY ALL), c AS (SELECT label, bin, sum(n) OVER (PARTITION BY label ORDER BY bin) / sum(n) OVER (PARTITION BY label) AS p FROM t),
g AS (SELECT bin, sum(n) AS n FROM t GROUP BY 1), h AS (SELECT bin, sum(n) OVER (ORDER BY bin) / sum(n) OVER () AS p FROM g), m AS (SELECT label, c.bin, min(h.bin) AS goal FROM c JOIN h ON h.p >= c.p GROUP BY 1, 2)
SELECT event_id, x + (goal - bin) * 500 AS normalised FROM frames f JOIN m ON f.label = m.label AND floor(x / 500) = bin""", "frames")
def histogram_normalise(spark, sf_dir):
    f = views.frames(spark, sf_dir)
    train = frames.histogram(f, 500).groupBy("bin").agg(F.sum("n").alias("n"))
    return frames.histogram_normalise(f, train, 500).select("event_id", "normalised")


@query(f"""WITH a AS (SELECT *, list_sort(list(x) OVER (PARTITION BY segment_id ORDER BY tick, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS e FROM frames), r AS (SELECT *, len(e) AS n, 0.2::DOUBLE * len(e) / 5 AS p FROM a),
q AS (SELECT *, e[least(floor(p * n), n - 1)::INT + 1] AS noise, e[least(floor((1 - p) * n), n - 1)::INT + 1] AS speech FROM r),
z AS (SELECT segment_id, tick, event_id, x < CASE WHEN speech > noise + 500 THEN greatest(0.5 * noise + 0.5 * speech, noise + 500) ELSE noise + 500 END AS raw FROM q),
c AS (SELECT *, (raw IS DISTINCT FROM lag(raw) OVER w OR row_number() OVER w = 1)::INT AS new FROM z WINDOW w AS (PARTITION BY segment_id ORDER BY tick, event_id)), u AS (SELECT *, sum(new) OVER (PARTITION BY segment_id ORDER BY tick, event_id) AS run FROM c),
s AS (SELECT *, count(*) OVER (PARTITION BY segment_id, run) AS size FROM u), k AS (SELECT *, CASE WHEN size >= CASE WHEN raw THEN 3 ELSE 2 END THEN raw END AS accepted FROM s)
SELECT event_id, coalesce(last_value(accepted IGNORE NULLS) OVER (PARTITION BY segment_id ORDER BY tick, event_id), true) AS silent FROM k""", "frames")
def silence_flags(spark, sf_dir):
    return frames.silence_flags(views.frames(spark, sf_dir), 5, 2, _E, sparse=0.2, min_snr=500.0, min_speech=2, min_silence=3).select("event_id", "silent")


_NEST = "flatten([[[x[i] * x[j] * x[k] for k in range(j, 5)] for j in range({first}, 5)] for i in range(1, 5)])"


@query(f"""WITH {_LINES} SELECT l_orderkey, l_linenumber, array_to_string(x || [v * v for v in x] || flatten([[x[i] * x[j] for j in range(i, 5)] for i in range(1, 5)]) || [x[1] * x[2], x[1] * x[4], x[3] * x[4]] || [v * v * v for v in x]
 || flatten({_NEST.format(first='i')}) || flatten({_NEST.format(first='1')}) || [v * v * v * v for v in x], ',') AS features FROM lines""")
def nth_order_features(spark, sf_dir):
    orders = ["first", "squares", "second", "selected", "cubes", "third", "asymmetric_third", "fourths"]
    x = frames.nth_order_features(F.col("x"), orders, ([0, 2], [1, 3]))
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", F.array_join(x, ",").alias("features"))


@query(f"WITH {_AL} SELECT segment_id, t, weight + 2 AS added, weight * 3 AS multiplied, 1.0 AS reset, CASE WHEN weight < 10 THEN 10.0 WHEN weight > 40 THEN 40.0 ELSE weight END AS clipped FROM al")
def change_weights(spark, sf_dir):
    w = F.col("weight")
    return _alignment(spark, sf_dir).select("segment_id", "t", slots.add_weight(w, 2.0).alias("added"), slots.multiply_weights(w, 3.0).alias("multiplied"), slots.reset_weights(w).alias("reset"), slots.clip_weights(w, 10.0, 40.0).alias("clipped"))


@query(f"""WITH {_AL}, m AS (SELECT l_orderkey AS segment_id, l_linenumber AS t, l_returnflag <> 'N' AS state, sum(l_quantity) AS s FROM lineitem GROUP BY ALL)
SELECT al.segment_id, al.t, label, coalesce(s, 0) AS weight FROM al LEFT JOIN m ON m.segment_id = al.segment_id AND m.t = al.t AND m.state = (label <> 'N')""")
def set_weights_by_tied_state(spark, sf_dir):
    """The path has the last flag of a line, the items are all its rows; the flags A and R share a state."""
    li = views.read(spark, sf_dir, "lineitem")
    items = li.select(F.col("l_orderkey").alias("segment_id"), F.col("l_linenumber").alias("t"), F.col("l_returnflag").alias("label"), F.col("l_quantity").alias("weight"))
    tied = items.select("label").distinct().withColumn("state", F.col("label") != "N")
    return slots.set_weights_by_tied_state(_alignment(spark, sf_dir), items, tied)


_NAMED = "named AS (SELECT word, list_sort(list(DISTINCT p_type)) AS prons FROM (SELECT unnest(string_split(p_name, ' ')) AS word, p_type FROM part) GROUP BY 1)"


@query(f"""WITH {_NAMED}, p AS (SELECT DISTINCT p_name AS lemma FROM part), x AS (SELECT lemma, a.prons AS a, b.prons AS b FROM p JOIN named a ON a.word = split_part(lemma, ' ', 1) JOIN named b ON b.word = split_part(lemma, ' ', 2))
SELECT word AS lemma, array_to_string(prons, '|') AS prons FROM named UNION ALL SELECT lemma, array_to_string(flatten([[concat(u, ' ', v) for v in b] for u in a]), '|') FROM x""")
def add_phrases(spark, sf_dir):
    """The words of part names are a lexicon, their types its pronunciations; the names are phrases."""
    part = views.read(spark, sf_dir, "part")
    lex = part.select(F.explode(F.split("p_name", " ")).alias("lemma"), "p_type").groupBy("lemma").agg(F.array_sort(F.collect_set("p_type")).alias("prons")).select("lemma", F.array("lemma").alias("orths"), "prons")
    return lexicon.add_phrases(lex, part.select(F.col("p_name").alias("phrase"))).select("lemma", F.array_join("prons", "|").alias("prons"))


@query(f"WITH {_WORDS} SELECT segment_id, start, CASE WHEN conf >= 0.7 THEN word WHEN length(word) = 3 THEN '[IGNORE] [IGNORE] [IGNORE]' ELSE '[IGNORE]' END AS word FROM words")
def mask_by_phonemes(spark, sf_dir):
    """Words of three letters are in the lexicon, with a phoneme for each letter."""
    w = _words(spark, sf_dir)
    lex = w.filter(F.length("word") == 3).select(F.upper("word").alias("orth")).distinct().withColumn("pron", F.array_join(F.split("orth", ""), " "))
    return transcripts.mask_low_confidence(w, 0.7, lexicon=lex).select("segment_id", "start", "word")


@query(f"""WITH {_CN}, b AS (SELECT segment_id, slot, arg_min(label, (-posterior, label)) AS label FROM cn GROUP BY 1, 2)
SELECT cn.segment_id, dense_rank() OVER (PARTITION BY cn.segment_id ORDER BY cn.slot) - 1 AS slot, cn.label, round(0.6 * posterior + CASE WHEN b.label = cn.label THEN 0.4 ELSE 0 END, 12) AS posterior FROM cn JOIN b ON b.segment_id = cn.segment_id AND b.slot = cn.slot""", "arcs")
def combine_aligned_cns(spark, sf_dir):
    """Two systems: all entries of the slots, and the best entry of each alone."""
    cn = _cn(spark, sf_dir)
    best = slots.decode_cn(cn).withColumn("posterior", F.lit(1.0))
    return confusion.combine_aligned_cns([cn, best], [0.6, 0.4]).withColumn("posterior", F.round("posterior", 12))


@query(f"""WITH {_DENSITIES}, l AS (SELECT vec_id, label FROM vectors), s AS (SELECT label, vec_id, density, sum(score) OVER (PARTITION BY label, density ORDER BY vec_id ROWS 2 PRECEDING) AS score FROM scores JOIN l USING (vec_id))
SELECT vec_id, arg_min(density, score) AS density, round(min(score), 3) AS score FROM s GROUP BY 1""", "vectors")
def bayes_window(spark, sf_dir):
    v = views.vectors(spark, sf_dir).withColumnRenamed("label", "segment_id")
    return models.bayes_window(v, _densities(spark, sf_dir), 3, ["vec_id"]).select("vec_id", "density", F.round("score", 3).alias("score"))


def _cluster_rounds(k: int) -> str:
    out = [_DENSITIES, "c0 AS (SELECT density, dim, mean FROM dens)"]
    for r in range(1, k + 1):
        out += [
            f"d{r} AS MATERIALIZED (SELECT vec_id, density, sum((v - mean) ** 2) AS far FROM cells JOIN c{r - 1} USING (dim) GROUP BY 1, 2)",
            f"n{r} AS MATERIALIZED (SELECT vec_id, arg_min(density, far) AS density FROM d{r} GROUP BY 1)",
            f"c{r} AS MATERIALIZED (SELECT density, dim, coalesce(m.mean, c.mean) AS mean FROM c{r - 1} c LEFT JOIN (SELECT density, dim, avg(v) AS mean FROM cells JOIN n{r} USING (vec_id) GROUP BY 1, 2) m USING (density, dim))",
        ]
    return ", ".join(out)


@query(f"WITH {_cluster_rounds(2)} SELECT density, dim, round(mean, 4) AS mean FROM c2", "vectors")
def density_clusters(spark, sf_dir):
    c = models.density_clusters(views.vectors(spark, sf_dir), _densities(spark, sf_dir), 2)
    return c.select("density", F.col("dim").cast("long").alias("dim"), F.round("mean", 4).alias("mean"))


@query(None)
def cart_train(spark, sf_dir):
    """A tree for the quality of labelled documents by language, source and length, and the documents of each leaf."""
    d = views.read(spark, sf_dir, "documents").join(views.read(spark, sf_dir, "labels").filter("quality IS NOT NULL"), "doc_id").withColumn("size", F.floor(F.log2(F.col("n_chars") + 1)))
    asks = {f"lang={v}": F.col("lang") == v for v in ("de", "en", "es", "fr")} | {f"size>{k}": F.col("size") > k for k in (6, 8, 10, 12)}
    tree = models.cart_train(models.cart_examples(d, ["lang", "size"], "quality"), asks, "quality", min_obs=5, min_gain=1e-3, max_leaves=8)
    return models.cart_apply(d, tree).groupBy("leaf").agg(F.count("*").alias("n"), F.sum("quality").alias("good"))


@query(None)
def segment_clusters(spark, sf_dir):
    """Suppliers as segments of the three recordings that return flags make."""
    li = views.read(spark, sf_dir, "lineitem")
    x = F.array("l_quantity", "l_discount", "l_tax")
    return adaptation.segment_clusters(li.select(F.col("l_returnflag").alias("recording_id"), F.col("l_suppkey").alias("segment_id"), x.alias("x")), 3)


@query("""WITH p AS (SELECT vec_id, i, coalesce(list_sum(x[1:i]), 0)::DOUBLE AS s, coalesce(list_sum(list_transform(x[1:i], lambda v: v * v)), 0)::DOUBLE AS q FROM vectors, unnest(range(0, 65)) AS t(i)),
e AS (SELECT a.vec_id, a.i AS a, b.i AS b, b.q - a.q - (b.s - a.s) ** 2 / (b.i - a.i) AS e FROM p a JOIN p b ON a.vec_id = b.vec_id AND a.i < b.i),
two AS (SELECT u.vec_id, v.b AS b, min(round(u.e + v.e, 6)) AS e, arg_min(u.b, (round(u.e + v.e, 6), u.b)) AS first FROM e u JOIN e v ON u.vec_id = v.vec_id AND u.b = v.a WHERE u.a = 0 GROUP BY 1, 2)
SELECT t.vec_id, round(min(round(t.e + w.e, 6)), 2) AS error, arg_min(t.first || ' ' || t.b || ' 64', (round(t.e + w.e, 6), t.b)) AS ends FROM two t JOIN e w ON w.vec_id = t.vec_id AND w.a = t.b WHERE w.b = 64 GROUP BY 1""", "vectors")
def change_points(spark, sf_dir):
    """Embeddings cut into three pieces. Of equal cuts the earliest last one counts, then the earliest first one."""
    return adaptation.change_points(views.vectors(spark, sf_dir), "vec_id", 3).select("vec_id", F.round("error", 2).alias("error"), F.array_join("ends", " ").alias("ends"))


@query("""WITH l AS (SELECT concat('s', l_suppkey) AS leaf, concat('n', s_nationkey) AS nation, concat('r', n_regionkey) AS region, l_quantity::BIGINT AS x FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
a AS (SELECT leaf AS node, count(*) AS n, sum(x - 25) AS s FROM l GROUP BY 1), b AS (SELECT nation AS node, count(*) AS n, sum(x - 25) AS s FROM l GROUP BY 1), c AS (SELECT region AS node, count(*) AS n, sum(x - 25) AS s FROM l GROUP BY 1)
SELECT leaf, CASE WHEN a.n > 600 THEN a.node WHEN b.n > 600 THEN b.node ELSE c.node END AS node, round(CASE WHEN a.n > 600 THEN a.s / a.n WHEN b.n > 600 THEN b.s / b.n ELSE c.s / c.n END, 6) AS shift
FROM (SELECT DISTINCT leaf, nation, region FROM l) k JOIN a ON a.node = leaf JOIN b ON b.node = nation JOIN c ON c.node = region WHERE a.n > 600 OR b.n > 600 OR c.n > 600""")
def mean_shift(spark, sf_dir):
    """Quantities against a mean of 25 with variance 4; suppliers with few lines take the shift of their nation or region."""
    place = views.read(spark, sf_dir, "supplier").join(views.read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    name = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    tree = place.select(name("s", "s_suppkey").alias("node"), name("n", "s_nationkey").alias("parent")).union(place.select(name("n", "s_nationkey"), name("r", "n_regionkey")).distinct())
    li = views.read(spark, sf_dir, "lineitem")
    acc = li.groupBy(name("s", "l_suppkey").alias("leaf")).agg(F.count("*").alias("n"), (F.count("*") / 4).alias("beta"), (F.sum(F.col("l_quantity") - 25) / 4).alias("s")).withColumn("dim", F.lit(0))
    return adaptation.mean_shift(acc, tree, 600, 2).select("leaf", "node", F.round("shift", 6).alias("shift"))


@query(None)
def affine_transform(spark, sf_dir):
    """Return flags as speakers, line states as densities."""
    v = _lines(spark, sf_dir)
    dens = models.gaussian_estimate(models.accumulate(v, ["status"]), 1.0).select(F.col("status").alias("density"), "dim", "mean", "var")
    return adaptation.affine_transform(v.withColumnRenamed("status", "density"), dens, "label", 4)


@query(None)
def mfcc(spark, sf_dir):
    return adaptation.mfcc(views.frames(spark, sf_dir), 16, 6, 8, 5, ["tick", "event_id"])


@query("SELECT vec_id, list_sum(list_transform(x, lambda v: v * v))::DOUBLE AS score FROM vectors", "vectors")
def batch_score(spark, sf_dir):
    return scorers.batch_score(views.vectors(spark, sf_dir), lambda: lambda x: (x * x).sum(axis=1), views.DIMENSIONS).select("vec_id", "score")


@query("SELECT vec_id, list_max(x)::DOUBLE AS score FROM vectors", "vectors")
def registered_scorer(spark, sf_dir):
    """A scorer that SQL calls by its name."""
    scorers.register_scorer(spark, "largest_component", lambda x: x.max(axis=1))
    return views.vectors(spark, sf_dir).selectExpr("vec_id", "largest_component(x) AS score")


@query("SELECT event_id, sum(x) OVER (PARTITION BY segment_id ORDER BY tick, event_id)::BIGINT AS total FROM frames", "frames")
def for_each_segment(spark, sf_dir):
    def running(segment, parts):
        total = 0
        for part in parts:
            sums = total + np.cumsum(part["x"].to_numpy())
            yield pd.DataFrame({"event_id": part["event_id"], "total": sums})
            total = int(sums[-1])

    return scorers.for_each_segment(views.frames(spark, sf_dir), running, "event_id long, total long", ["tick", "event_id"])


@query("""WITH h AS (SELECT vec_id, k, md5('7/' || vec_id || '/' || k) AS m FROM vectors, unnest(range(64)) AS t(k)), u AS (SELECT vec_id, k, (('0x' || m[1:13])::BIGINT + 0.5) / 4503599627370496.0 AS a, (('0x' || m[14:26])::BIGINT + 0.5) / 4503599627370496.0 AS b FROM h)
SELECT vec_id, list(round(sqrt(-2 * ln(a)) * cos(2 * pi() * b), 6) ORDER BY k)::VARCHAR AS x FROM u GROUP BY 1""".replace("list(round", "array_to_string(list(printf('%.6f', round").replace(", 6) ORDER BY k)::VARCHAR", ", 6) + 0.0) ORDER BY k), ' ')"), "vectors")
def random_vectors(spark, sf_dir):
    v = vectors.random_vectors(views.vectors(spark, sf_dir).select("vec_id"), views.DIMENSIONS, 7, ["vec_id"])
    return v.select("vec_id", F.array_join(F.transform("x", lambda c: F.format_string("%.6f", F.round(c, 6) + 0.0)), " ").alias("x"))
