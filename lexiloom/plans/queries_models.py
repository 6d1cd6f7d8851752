"""Queries of the statistics and model operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.operators import mixtures, models, trees

from . import views
from .catalogue import query

_LINES = 'lines AS (SELECT l_orderkey, l_linenumber, l_returnflag AS label, l_linestatus AS status, [l_quantity::BIGINT, round(l_extendedprice / 100)::BIGINT, round(l_discount * 100)::BIGINT, round(l_tax * 100)::BIGINT] AS x FROM lineitem)'
_CELLS = f"{_LINES}, cells AS (SELECT l_orderkey, label, status, d - 1 AS dim, x[d] AS v FROM lines, unnest([1, 2, 3, 4]) AS t(d))"


def _lines(spark, sf_dir):
    li = views.read(spark, sf_dir, "lineitem")
    x = F.array(F.col("l_quantity").cast("long"), F.round(F.col("l_extendedprice") / 100).cast("long"), F.round(F.col("l_discount") * 100).cast("long"), F.round(F.col("l_tax") * 100).cast("long"))
    return li.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("status"), x.alias("x"))


def _acc(spark, sf_dir, keys=("label",)):
    return models.accumulate(_lines(spark, sf_dir), list(keys)).withColumn("dim", F.col("dim").cast("long"))


@query(f"WITH {_CELLS} SELECT label, dim, count(*) AS n, sum(v)::BIGINT AS s, sum(v * v)::BIGINT AS q FROM cells GROUP BY 1, 2")
def gaussian_accumulate(spark, sf_dir):
    return _acc(spark, sf_dir)


@query(f"WITH {_CELLS} SELECT label, status, dim, count(*) AS n, sum(v)::BIGINT AS s, sum(v * v)::BIGINT AS q FROM cells GROUP BY 1, 2, 3")
def keyed_accumulate(spark, sf_dir):
    return _acc(spark, sf_dir, ("label", "status"))


@query(f"WITH {_CELLS} SELECT label, dim, 2 * count(*) AS n, (2 * sum(v))::BIGINT AS s, (2 * sum(v * v))::BIGINT AS q FROM cells GROUP BY 1, 2")
def combine_accumulators(spark, sf_dir):
    return models.combine_accumulators(_acc(spark, sf_dir), _acc(spark, sf_dir))


@query(f"WITH {_CELLS} SELECT label, dim, round(avg(v), 6) AS mean, round(greatest(sum(v * v) / count(*) - (sum(v) / count(*)) * (sum(v) / count(*)), 9.0), 4) AS var FROM cells GROUP BY 1, 2")
def gaussian_estimate(spark, sf_dir):
    return models.gaussian_estimate(_acc(spark, sf_dir), 9.0).select("label", "dim", F.round("mean", 6).alias("mean"), F.round("var", 4).alias("var"))


@query(f"WITH {_CELLS} SELECT dim, round(avg(v), 6) AS mean, round(sqrt(sum(v * v) / count(*) - (sum(v) / count(*)) * (sum(v) / count(*))), 6) AS std FROM cells GROUP BY 1")
def feature_mean_std(spark, sf_dir):
    return models.gaussian_estimate(_acc(spark, sf_dir, ())).select("dim", F.round("mean", 6).alias("mean"), F.round(F.sqrt("var"), 6).alias("std"))


_PAIRS = "unnest([0, 1, 2, 3]) AS a(i), unnest([0, 1, 2, 3]) AS b(j)"


@query(f"WITH {_LINES} SELECT i, j, round((sum(x[i + 1] * x[j + 1]) - sum(x[i + 1]) * sum(x[j + 1]) / count(*)) / count(*), 3) AS v FROM lines, {_PAIRS} WHERE j <= i GROUP BY 1, 2")
def covariance(spark, sf_dir):
    return models.covariance(_lines(spark, sf_dir), 4).withColumn("v", F.round("v", 3))


@query(f"WITH {_LINES} SELECT i, j, round(greatest((sum(x[i + 1] * x[j + 1]) - sum(x[i + 1]) * sum(x[j + 1]) / count(*)) / count(*), 5.0), 3) AS v FROM lines, {_PAIRS} WHERE j <= i GROUP BY 1, 2")
def covariance_floored(spark, sf_dir):
    return models.covariance(_lines(spark, sf_dir), 4, floor=5.0).withColumn("v", F.round("v", 3))


@query(f"""WITH {_LINES}, c AS (SELECT label, i, j, sum(x[i + 1]) * sum(x[j + 1]) / count(*) AS c, sum(x[i + 1] * x[j + 1]) AS p FROM lines, {_PAIRS} WHERE j <= i GROUP BY ALL), g AS (SELECT i, j, sum(x[i + 1]) * sum(x[j + 1]) / count(*) AS g FROM lines, {_PAIRS} WHERE j <= i GROUP BY ALL)
SELECT i, j, round(sum(c) - g, 1) AS between, round(sum(p) - sum(c), 1) AS within, round(sum(p) - g, 1) AS total FROM c JOIN g USING (i, j) GROUP BY i, j, g""".replace("AS between", 'AS "between"'))
def scatter_matrices(spark, sf_dir):
    return models.scatter_matrices(_lines(spark, sf_dir), 4).select("i", "j", *(F.round(c, 1).alias(c) for c in ("between", "within", "total")))


@query("SELECT label, count(*) AS n FROM vectors GROUP BY 1", "vectors")
def class_counts(spark, sf_dir):
    return models.class_counts(views.vectors(spark, sf_dir))


@query("WITH c AS (SELECT label, greatest(count(*)::DOUBLE, 20.0) AS n FROM vectors GROUP BY 1) SELECT label, round(ln(n / (SELECT sum(n) FROM c)), 6) AS log_prior FROM c", "vectors")
def log_prior(spark, sf_dir):
    return models.log_prior(models.class_counts(views.vectors(spark, sf_dir)), 20.0).withColumn("log_prior", F.round("log_prior", 6))


@query("SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS mapped FROM (SELECT DISTINCT label FROM vectors WHERE label <> 5)", "vectors")
def map_class_labels(spark, sf_dir):
    v = views.vectors(spark, sf_dir)
    return models.map_class_labels(models.class_counts(v), v.filter("label = 5").select("label").distinct()).withColumn("mapped", F.col("mapped").cast("long"))


_DENSITIES = "cells AS (SELECT vec_id, label, d - 1 AS dim, x[d] AS v FROM vectors, unnest(range(1, len(x) + 1)) AS t(d)), dens AS (SELECT label AS density, dim, avg(v) AS mean, greatest(sum(v * v) / count(*) - (sum(v) / count(*)) * (sum(v) / count(*)), 1.0) AS var FROM cells GROUP BY 1, 2), scores AS (SELECT vec_id, density, 0.5 * sum((v - mean) ** 2 / var + ln(2 * pi() * var)) AS score FROM cells JOIN dens USING (dim) GROUP BY 1, 2)"


def _densities(spark, sf_dir):
    v = views.vectors(spark, sf_dir)
    return models.gaussian_estimate(models.accumulate(v, ["label"]), 1.0).select(F.col("label").alias("density"), "dim", "mean", "var")


@query(f"WITH {_DENSITIES} SELECT vec_id, density, round(score, 4) AS score FROM scores", "vectors")
def density_scores(spark, sf_dir):
    return models.density_scores(views.vectors(spark, sf_dir), _densities(spark, sf_dir), ["vec_id"]).withColumn("score", F.round("score", 4))


@query(f"WITH {_DENSITIES} SELECT vec_id, arg_min(density, score) AS density, round(min(score), 4) AS score FROM scores GROUP BY 1", "vectors")
def bayes_classify(spark, sf_dir):
    best = models.best_density(views.vectors(spark, sf_dir), _densities(spark, sf_dir))
    return best.select("vec_id", "density", F.round("score", 4).alias("score"))


@query(f"WITH {_DENSITIES}, low AS (SELECT *, score + ln(10) AS s, min(score + ln(10)) OVER (PARTITION BY vec_id) AS m FROM scores) SELECT vec_id, round(m - ln(sum(exp(m - s))), 4) AS score FROM low GROUP BY vec_id, m", "vectors")
def mixture_scores(spark, sf_dir):
    model = _densities(spark, sf_dir).withColumn("weight", F.lit(0.1))
    return models.mixture_scores(views.vectors(spark, sf_dir), model).select("vec_id", F.round("score", 4).alias("score"))


@query(f"WITH {_DENSITIES} SELECT density, round(avg(score), 4) AS activation FROM scores GROUP BY 1", "vectors")
def score_activation(spark, sf_dir):
    s = models.density_scores(views.vectors(spark, sf_dir), _densities(spark, sf_dir), ["vec_id"])
    return s.groupBy("density").agg(F.round(F.avg("score"), 4).alias("activation"))


def _rounds(k: int) -> str:
    """SQL tables m0 to mk: the model after each round of training."""
    out = [_DENSITIES, "m0 AS (SELECT *, 1.0 AS weight FROM dens)"]
    for r in range(1, k + 1):
        out += [
            f"s{r} AS MATERIALIZED (SELECT vec_id, density, 0.5 * sum((v - mean) ** 2 / var + ln(2 * pi() * var)) - ln(any_value(weight)) AS score FROM cells JOIN m{r - 1} USING (dim) GROUP BY 1, 2)",
            f"b{r} AS MATERIALIZED (SELECT vec_id, arg_min(density, score) AS density FROM s{r} GROUP BY 1)",
            f"m{r} AS MATERIALIZED (SELECT density, dim, avg(v) AS mean, greatest(sum(v * v) / count(*) - (sum(v) / count(*)) * (sum(v) / count(*)), 0.001) AS var, count(*) / (SELECT count(*) FROM b{r}) AS weight FROM cells JOIN b{r} USING (vec_id) GROUP BY 1, 2)",
        ]
    return ", ".join(out)


@query(f"WITH {_rounds(3)} SELECT density, dim, round(mean, 4) AS mean, round(var, 2) AS var, round(weight, 6) AS weight FROM m3", "vectors")
def gmm_train(spark, sf_dir):
    m = models.gmm_train(views.vectors(spark, sf_dir), _densities(spark, sf_dir), 3)
    return m.select("density", F.col("dim").cast("long").alias("dim"), F.round("mean", 4).alias("mean"), F.round("var", 2).alias("var"), F.round("weight", 6).alias("weight"))


@query("SELECT l_linestatus AS label, round(ln(count(*) / (SELECT count(*) FROM lineitem)), 6) AS log_prior FROM (SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS l_linestatus FROM lineitem) GROUP BY 1")
def mixture_prior(spark, sf_dir):
    acc = views.read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("mixture"), F.col("l_partkey").alias("density")).agg(F.count("*").alias("n"))
    label_map = acc.select("mixture").distinct().withColumn("label", F.when(F.col("mixture") % 2 == 0, "even").otherwise("odd"))
    return models.mixture_prior(acc, label_map).withColumn("log_prior", F.round("log_prior", 6))


@query(f"WITH {_DENSITIES} SELECT density * 2 + k AS density, dim, round(mean + (2 * k - 1) * 0.5 * sqrt(var), 4) AS mean FROM dens, unnest([0, 1]) AS t(k)", "vectors")
def gmm_split(spark, sf_dir):
    return models.gmm_split(_densities(spark, sf_dir)).select("density", F.col("dim").cast("long").alias("dim"), F.round("mean", 4).alias("mean"))


@query("WITH a AS (SELECT l_returnflag AS mixture, l_suppkey AS density, count(*) AS n FROM lineitem GROUP BY 1, 2), b AS (SELECT *, n >= greatest(10.0, sum(n) OVER (PARTITION BY mixture) * 0.0101) OR row_number() OVER (PARTITION BY mixture ORDER BY n DESC, density) = 1 AS k FROM a) SELECT mixture, density, n FROM b WHERE k")
def gmm_prune(spark, sf_dir):
    acc = views.read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("mixture"), F.col("l_suppkey").alias("density")).agg(F.count("*").alias("n"))
    return models.gmm_prune(acc, 10.0, 0.0101)


@query(f"WITH {_CELLS} SELECT CASE WHEN label = 'R' THEN 'A' ELSE label END AS target, dim, count(*) AS n, sum(v)::BIGINT AS s, sum(v * v)::BIGINT AS q FROM cells GROUP BY 1, 2")
def map_accumulators(spark, sf_dir):
    acc = _acc(spark, sf_dir)
    mapping = acc.select("label").distinct().withColumn("target", F.when(F.col("label") == "R", "A").otherwise(F.col("label")))
    return models.map_accumulators(acc, mapping, "label")


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
def cart_examples(spark, sf_dir):
    return models.cart_examples(views.read(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus")


@query("""WITH e AS (SELECT lang, source, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL), a AS (SELECT 'en' AS question, lang = 'en' AS yes, quality, n FROM e UNION ALL SELECT 'src0', source = 'src0', quality, n FROM e),
c AS (SELECT question, yes, quality, sum(n)::DOUBLE AS n, count(*) AS rows_ FROM a GROUP BY ALL), s AS (SELECT question, yes, sum(rows_) AS r, sum(n) AS t FROM c GROUP BY 1, 2), h AS (SELECT c.question, c.yes, -sum(n / t * log2(n / t)) AS h FROM c JOIN s USING (question, yes) GROUP BY 1, 2),
g AS (SELECT question, quality, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY question) AS t FROM c GROUP BY 1, 2), gh AS (SELECT question, -sum(n / t * log2(n / t)) AS h FROM g GROUP BY 1)
SELECT question, round(gh.h - sum(h.h * r) / sum(r), 6) AS gain FROM gh JOIN h USING (question) JOIN s USING (question, yes) GROUP BY question, gh.h""")
def split_gain(spark, sf_dir):
    d = views.read(spark, sf_dir, "documents").join(views.read(spark, sf_dir, "labels"), "doc_id")
    e = models.cart_examples(d, ["lang", "source"], "quality")
    return models.split_gain(e, {"en": F.col("lang") == "en", "src0": F.col("source") == "src0"}, "quality").withColumn("gain", F.round("gain", 6))


@query("SELECT leaf, count(*) AS n FROM (SELECT CASE WHEN lang = 'en' THEN CASE WHEN n_chars > 1000 THEN 1 ELSE 2 END ELSE 3 END AS leaf FROM documents) GROUP BY 1")
def cart_apply(spark, sf_dir):
    tree = {"question": F.col("lang") == "en", "yes": {"question": F.col("n_chars") > 1000, "yes": 1, "no": 2}, "no": 3}
    return models.cart_apply(views.read(spark, sf_dir, "documents"), tree).groupBy("leaf").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS leaf, quality, source, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY ALL),
c AS (SELECT leaf, quality, sum(n) AS n, count(*) AS r FROM e GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY leaf) AS t FROM c)
SELECT leaf, sum(n)::BIGINT AS n, sum(r)::BIGINT AS rows, count(*) AS classes, round(-sum(n / t * log2(n / t)), 6) AS entropy, arg_min(quality, (-n, quality)) AS best FROM t GROUP BY 1""".replace("AS rows", 'AS "rows"'))
def cart_leaf_report(spark, sf_dir):
    d = views.read(spark, sf_dir, "documents").join(views.read(spark, sf_dir, "labels").filter("quality IS NOT NULL"), "doc_id")
    e = models.cart_examples(models.cart_apply(d, {"question": F.col("lang") == "en", "yes": 1, "no": 2}), ["leaf", "source"], "quality")
    return models.cart_leaf_report(e, "quality").withColumn("entropy", F.round("entropy", 6))


@query(None)
def pca(spark, sf_dir):
    v = views.vectors(spark, sf_dir)
    return models.project(v, models.pca(models.covariance(v, views.DIMENSIONS), 2), ["vec_id"])


@query("SELECT vec_id, list_sum(list_transform(x, lambda v: v * v))::BIGINT AS energy FROM vectors", "vectors")
def pca_energy(spark, sf_dir):
    """All components together keep the length of every vector."""
    v = views.vectors(spark, sf_dir)
    y = models.project(v, models.pca(models.covariance(v, views.DIMENSIONS)), ["vec_id"])
    return y.groupBy("vec_id").agg(F.round(F.sum(F.col("y") * F.col("y"))).cast("long").alias("energy"))


@query("""WITH m AS (SELECT d, sum(x[d] * x[d]) / count(*) - (sum(x[d]) / count(*)) * (sum(x[d]) / count(*)) AS var FROM vectors, unnest(range(1, len(x) + 1)) AS t(d) GROUP BY 1) SELECT round(sum(var), 2) AS variance FROM m""", "vectors")
def pca_variance(spark, sf_dir):
    """The variances along all components add up to that of the vectors."""
    v = views.vectors(spark, sf_dir)
    y = models.project(v, models.pca(models.covariance(v, views.DIMENSIONS)), [])
    return y.groupBy("component").agg(F.var_pop("y").alias("var")).agg(F.round(F.sum("var"), 2).alias("variance"))


@query(None)
def lda(spark, sf_dir):
    v = views.vectors(spark, sf_dir)
    return models.project(v, models.lda(models.scatter_matrices(v, views.DIMENSIONS), 2), ["vec_id"])


def _soft_rounds(k: int) -> str:
    """SQL tables t0 to tk: two densities for each label, trained by posteriors within the label."""
    out = [_DENSITIES.split(", dens AS")[0], "base AS (SELECT label, dim, avg(v) AS mean, greatest(sum(v * v) / count(*) - (sum(v) / count(*)) * (sum(v) / count(*)), 100.0) AS var FROM cells GROUP BY 1, 2)"]
    out.append("t0 AS (SELECT label, z AS density, dim, mean + (2 * z - 1) * 0.05 * sqrt(var) AS mean, var, 0.5 AS weight FROM base, unnest([0, 1]) AS u(z))")
    for r in range(1, k + 1):
        out += [
            f"u{r} AS MATERIALIZED (SELECT vec_id, c.label, density, 0.5 * sum((v - mean) ** 2 / var + ln(2 * pi() * var)) - ln(any_value(weight)) AS score FROM cells c JOIN t{r - 1} m ON c.label = m.label AND c.dim = m.dim GROUP BY 1, 2, 3)",
            f"p{r} AS MATERIALIZED (SELECT *, exp(m - score) / sum(exp(m - score)) OVER (PARTITION BY vec_id) AS p, m - ln(sum(exp(m - score)) OVER (PARTITION BY vec_id)) AS total FROM (SELECT *, min(score) OVER (PARTITION BY vec_id) AS m FROM u{r}))",
            f"t{r} AS MATERIALIZED (SELECT label, density, dim, s / n AS mean, greatest(q / n - (s / n) * (s / n), 100.0) AS var, n / sum(n) OVER (PARTITION BY label, dim) AS weight FROM (SELECT c.label, density, dim, sum(p) AS n, sum(p * v) AS s, sum(p * v * v) AS q FROM cells c JOIN p{r} USING (vec_id) WHERE p > 0.001 GROUP BY 1, 2, 3))",
        ]
    return ", ".join(out)


def _mixtures(spark, sf_dir):
    v = views.vectors(spark, sf_dir)
    base = models.gaussian_estimate(models.accumulate(v, ["label"]), 100.0)
    start = base.select("label", F.explode(F.array(F.lit(0), F.lit(1))).alias("density"), "dim", "mean", "var").select("label", "density", "dim", (F.col("mean") + (2 * F.col("density") - 1) * 0.05 * F.sqrt("var")).alias("mean"), "var", F.lit(0.5).alias("weight"))
    return v, start


@query(f"WITH {_soft_rounds(2)} SELECT label, density, dim, round(mean, 3) AS mean, round(var, 1) AS var, round(weight, 5) AS weight FROM t2", "vectors")
def mixtures_by_label(spark, sf_dir):
    """Two rounds of soft counts over a mixture of two densities for each label."""
    m = mixtures.train_mixtures(*_mixtures(spark, sf_dir), 2, viterbi=False, weight_threshold=0.001, min_variance=100.0)
    return m.select("label", "density", F.col("dim").cast("long").alias("dim"), F.round("mean", 3).alias("mean"), F.round("var", 1).alias("var"), F.round("weight", 5).alias("weight"))


@query(f"WITH {_soft_rounds(1)} SELECT label, count(*)::DOUBLE AS n, round(-avg(total), 4) AS likelihood FROM p1 WHERE density = 0 GROUP BY 1".replace("m - ln(sum(exp(m - score))", "m - ln(sum(exp(m - score))"), "vectors")
def mixture_likelihood(spark, sf_dir):
    l = mixtures.log_likelihood(*_mixtures(spark, sf_dir))  # noqa: E741
    return l.select("label", "n", F.round("likelihood", 4).alias("likelihood"))


@query("""WITH e AS (SELECT l_returnflag = 'R' AS a, l_linestatus = 'O' AS b, l_quantity > 25 AS c, l_quantity::BIGINT AS x, round(l_extendedprice / 100)::BIGINT AS y FROM lineitem), s AS (SELECT 0 AS k, a AS yes, x, y FROM e UNION ALL SELECT 1, b, x, y FROM e UNION ALL SELECT 2, c, x, y FROM e),
g AS (SELECT k, yes, count(*) AS n, avg(x) AS mx, avg(y) AS my, sum(x * x) / count(*) AS qx, sum(y * y) / count(*) AS qy FROM s GROUP BY GROUPING SETS ((k, yes), (k))),
l AS (SELECT k, yes, 0.5 * n * (2 * (1 + ln(2 * pi())) + ln(greatest(qx - mx * mx, 0.001)) + ln(greatest(qy - my * my, 0.001))) AS c FROM g)
SELECT k, round(sum(CASE WHEN yes IS NULL THEN c ELSE -c END), 2) AS gain FROM l GROUP BY 1""")
def gaussian_gain(spark, sf_dir):
    """The gains of three questions at the root, each found by growing a tree of two leaves with that question alone."""
    li = views.read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", F.array(F.col("l_quantity").cast("long"), F.round(F.col("l_extendedprice") / 100).cast("long")).alias("s"))
    examples = li.withColumn("q", F.transform("s", lambda v: v * v)).withColumn("n", F.lit(1))
    asks = [F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", F.col("l_quantity") > 25]
    placed = examples.withColumn("node", F.lit(0)).withColumn("answers", F.array(*asks))
    out = None
    for k in range(3):
        found = trees._gaussian_questions(placed.withColumn("answers", F.slice("answers", k + 1, 1)), 1, 2, 1.0, 0.0, 1e-3).select(F.lit(k).alias("k"), F.round("gain", 2).alias("gain"))
        out = found if out is None else out.unionByName(found)
    return out


@query(None)
def grow_tree(spark, sf_dir):
    """Order lines by Gaussians of quantity and price: two steps of a plan; the leaf of every kind of line."""
    li = views.read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount", F.array(F.col("l_quantity").cast("long"), F.round(F.col("l_extendedprice") / 100).cast("long")).alias("s"))
    examples = li.withColumn("q", F.transform("s", lambda v: v * v)).withColumn("n", F.lit(1))
    plan = [trees.Step({f"q{k}": F.col("l_quantity") > k for k in range(5, 50, 5)}, "split", 100.0, 10.0), trees.Step({"o": F.col("l_linestatus") == "O", "d": F.col("l_discount") > 0.05}, "split", 10.0, 0.0)]
    leaf = models.cart_apply(examples, trees.grow_tree(examples, plan, max_leaves=16))
    return leaf.groupBy("leaf").agg(F.count("*").alias("n"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"))
