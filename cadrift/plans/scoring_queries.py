"""Queries over maps and vectors: reductions, distances, fitted scorers, vector statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadrift.operators import kernels, learned, registry, scale, scoring, search, stats
from cadrift.plans import views as V
from cadrift.plans.prepare_queries import _FUSED, components
from cadrift.plans.registry import query
from cadrift.plans.search_queries import WIN, rnd

_K = "greatest(1, round_even(count(*) OVER (PARTITION BY cadence_idx, f_start) * {f}::DOUBLE, 0))"


@query("scr6_reduce_map_recon", f"WITH {V.CELLS} SELECT cadence_idx, f_start, round(avg(v), 6) AS score FROM cells GROUP BY 1, 2")
def _(spark, d):
    return rnd(scoring.reduce_maps(V.map_rows(spark, d), WIN, "recon"), "score")


@query("scr6_reduce_map_topk", f"""WITH {V.CELLS}, r AS (SELECT *, row_number() OVER (PARTITION BY cadence_idx, f_start ORDER BY v DESC) AS r,
   {_K.format(f=0.02)} AS k FROM cells) SELECT cadence_idx, f_start, round(avg(v), 6) AS score FROM r WHERE r <= k GROUP BY 1, 2""")
def _(spark, d):
    return rnd(scoring.reduce_maps(V.map_rows(spark, d), WIN, "topk", 0.02), "score")


@query("scr6_reduce_map_max", f"WITH {V.CELLS} SELECT cadence_idx, f_start, max(v) AS score FROM cells GROUP BY 1, 2")
def _(spark, d):
    return scoring.reduce_maps(V.map_rows(spark, d), WIN, "max")


@query("udf2_anomaly_score_dispatch", """WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings),
  r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC) AS r FROM c)
  SELECT vec_id, round(avg(x), 6) AS recon, round(avg(x) FILTER (r <= 3), 6) AS topk, max(x) AS top FROM r GROUP BY 1""")
def _(spark, d):
    v = V.vectors(spark, d).select(F.col("id").alias("vec_id"), "vec")
    for m, out in (("recon", "recon"), ("topk", "topk"), ("max", "top")):
        v = registry.anomaly_score(v, "vec", m, 0.05, out)
    return rnd(v.drop("vec"), "recon", "topk")


@query("udf1_scorer_registry", """WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings)
  SELECT vec_id, max(x) AS max_pixel, round(max(x) / (stddev_pop(x) + 1e-9), 6) AS peak_snr, round(max(x * x), 6) AS top1pct_energy FROM c GROUP BY 1""")
def _(spark, d):
    v = V.vectors(spark, d).select(F.col("id").alias("vec_id"), "vec")
    return rnd(registry.apply_scorers(v, "vec").drop("vec"), "peak_snr", "top1pct_energy")


_TRI = """tri AS (SELECT a.vec_id, unnest(a.embedding)::DOUBLE AS t, unnest(b.embedding)::DOUBLE AS s1, unnest(c.embedding)::DOUBLE AS s2
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2)"""


def _triples(spark, d):
    v = V.vectors(spark, d)
    s1 = v.select((F.col("id") - 1).alias("id"), F.col("vec").alias("s1"))
    s2 = v.select((F.col("id") - 2).alias("id"), F.col("vec").alias("s2"))
    return v.select("id", F.col("vec").alias("t")).join(s1, "id").join(s2, "id").withColumnRenamed("id", "vec_id")


@query("scr7_disagreement_map", f"""WITH {_TRI}, m AS (SELECT vec_id, avg((t - s1) ** 2) AS a, avg((t - s2) ** 2) AS b, avg((s1 - s2) ** 2) AS c FROM tri GROUP BY 1)
  SELECT vec_id, round(a, 6) AS st1, round(b, 6) AS st2, round(c, 6) AS ss, round(0.5::DOUBLE * a + 0.5::DOUBLE * b + 0.5::DOUBLE * c, 6) AS cob FROM m""")
def _(spark, d):
    x = scoring.disagreement(_triples(spark, d), "t", "s1", "s2").select("vec_id", "st1", "st2", "ss", "cob")
    return rnd(x, "st1", "st2", "ss", "cob")


@query("scr8_recon_error", f"""WITH {_TRI}, q AS (SELECT vec_id, (t - s1) ** 2 AS e, (s2 > 0)::INT AS m, row_number() OVER (PARTITION BY vec_id ORDER BY (t - s1) ** 2 DESC) AS r FROM tri)
  SELECT vec_id, round(avg(e), 6) AS mse, round(avg(e) FILTER (r <= 3), 6) AS topk, round(sum(e * m) / (sum(m) + 1e-8), 6) AS masked FROM q GROUP BY 1""")
def _(spark, d):
    t = _triples(spark, d).withColumn("m", F.transform("s2", lambda x: (x > 0).cast("double")))
    out = t.select("vec_id", scoring.recon_error("t", "s1").alias("mse"), scoring.recon_error("t", "s1", "topk", 0.05).alias("topk"),
                   scoring.recon_error("t", "s1", "masked", mask="m").alias("masked"))
    return rnd(out, "mse", "topk", "masked")


_E = "e AS (SELECT vec_id, label, unnest(range(64)) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings)"


@query("scr10_batch_mean_mse", f"""WITH {_E}, m AS (SELECT d, avg(x) AS m FROM e GROUP BY 1), s AS (SELECT vec_id, avg((x - m) ** 2) AS mse FROM e JOIN m USING (d) GROUP BY 1)
  SELECT vec_id, round(mse, 6) AS mse FROM s""")
def _(spark, d):
    s = scoring.batch_mean_mse(V.vectors(spark, d)).select(F.col("id").alias("vec_id"), "mse")
    return rnd(s, "mse")


@query("scr11_whitened_distance", f"""WITH {_E}, m AS (SELECT d, avg(x) AS m, stddev_pop(x) AS s FROM e WHERE label < 3 GROUP BY 1)
  SELECT vec_id, round(sqrt(sum(((x - m) / CASE WHEN s < 1e-6 THEN 1 ELSE s END) ** 2)), 6) AS distance FROM e JOIN m USING (d) GROUP BY 1""")
def _(spark, d):
    v = V.vectors(spark, d)
    w = scoring.whitened_distance(v, v.filter("label < 3"))
    return rnd(w.select(F.col("id").alias("vec_id"), "distance"), "distance")


@query("scr12_mahalanobis")
def _(spark, d):
    v = V.vectors(spark, d)
    fitted = learned.fit_mahalanobis(v.filter("label < 5"))
    return rnd(learned.mahalanobis(v, fitted).select("id", "distance"), "distance")


@query("scr13_isolation_forest")
def _(spark, d):
    v = V.vectors(spark, d)
    forest = learned.IsolationForest(trees=50).fit(v.filter("label < 5"))
    return rnd(forest.score(v).select("id", "score"), "score")


@query("scr14_mixture_density")
def _(spark, d):
    v = V.vectors(spark, d)
    return rnd(learned.MixtureDensity(3).fit(v).score(v).select("id", "score"), "score")


_MEM = f"""{_E}, pr AS (SELECT label AS slot, d, avg(x) * 8 AS p FROM e GROUP BY 1, 2),
  sim AS (SELECT vec_id, slot, sum(x * 8 * p) AS sim FROM e JOIN pr USING (d) GROUP BY 1, 2),
  ex AS (SELECT *, exp(sim - max(sim) OVER (PARTITION BY vec_id)) AS ex FROM sim),
  att AS (SELECT *, ex / sum(ex) OVER (PARTITION BY vec_id) AS w FROM ex),
  sh AS (SELECT *, greatest(w - 0.1::DOUBLE, 0) * w / (abs(w - 0.1::DOUBLE) + 1e-12::DOUBLE) AS s FROM att),
  mem AS (SELECT vec_id, slot::BIGINT AS slot, s / (sum(s) OVER (PARTITION BY vec_id) + 1e-12::DOUBLE) AS weight FROM sh)"""


def _memory(spark, d):
    """Memory of ten given prototypes (eight times the label means) over eight times the vectors."""
    v = V.vectors(spark, d)
    mean = (v.select("label", F.posexplode("vec").alias("d", "x")).groupBy("label", "d").agg((F.avg("x") * 8).alias("p"))
            .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "p"))).alias("p")))  # 64 entries per label
    rows = mean.select("label", F.transform("p", lambda r: r["p"]).alias("p")).orderBy("label").collect()  # ten prototypes
    slots = np.array([r.p for r in rows])
    m = learned.prototype_memory(v.withColumn("vec", F.transform("vec", lambda x: x * 8)), slots, 0.1)
    return m.withColumn("slots", F.array(*[F.lit(r.label).cast("long") for r in rows]))


def _weights(spark, d):
    """One row per vector and slot."""
    return _memory(spark, d).select("id", "label", F.explode(F.arrays_zip("slots", "weights")).alias("s")).select(
        "id", "label", F.col("s.slots").alias("slot"), F.col("s.weights").alias("weight"))


@query("scr15_prototype_memory", f"WITH {_MEM} SELECT vec_id, slot, round(weight, 6) AS weight FROM mem")
def _(spark, d):
    return rnd(_weights(spark, d).select(F.col("id").alias("vec_id"), "slot", "weight"), "weight")


@query("scr16_memory_residual", f"""WITH {_MEM}, rc AS (SELECT vec_id, d, sum(weight * p) AS xh FROM mem JOIN pr USING (slot) GROUP BY 1, 2)
  SELECT vec_id, round(avg((x * 8 - xh) ** 2), 6) AS residual FROM e JOIN rc USING (vec_id, d) GROUP BY 1""")
def _(spark, d):
    return rnd(_memory(spark, d).select(F.col("id").alias("vec_id"), "residual"), "residual")


@query("scr16_kmeans_memory")
def _(spark, d):
    v = V.vectors(spark, d)
    slots = learned.fit_prototypes(v, 8)
    m = learned.prototype_memory(v, slots)
    return rnd(m.select("id", "residual", "entropy"), "residual", "entropy")


@query("scr17_slot_usage", f"""WITH {_MEM}, w AS (SELECT vec_id, first(slot ORDER BY weight DESC, slot) AS slot FROM mem GROUP BY 1)
  SELECT label::BIGINT AS label, slot, count(*) AS n_wins FROM w JOIN embeddings USING (vec_id) GROUP BY 1, 2""")
def _(spark, d):
    u = scoring.slot_usage(_weights(spark, d), "id", ["label"])
    return u.withColumn("label", F.col("label").cast("long"))


@query("scr18_ridge_student")
def _(spark, d):
    t = _triples(spark, d)
    fitted = learned.fit_ridge(t, "s1", "t", 1.0)
    return rnd(learned.ridge_residual(t, fitted, "s1", "t").select("vec_id", "residual"), "residual")


@query("scr19_pca_residual")
def _(spark, d):
    v = V.vectors(spark, d)
    return rnd(learned.pca_residual(v, learned.fit_pca(v, 8)).select("id", "residual"), "residual")


# The same scorers on the first dimensions, where the fit has a closed form.

_TWO = "e2 AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"


def _two(spark, d):
    return V.vectors(spark, d).withColumn("vec", F.slice("vec", 1, 2))


@query("scr12_mahalanobis_2d", f"""WITH {_TWO}, m AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS c FROM e2 WHERE label < 5),
  f AS (SELECT avg(((x - mx) ** 2 + (y - my) ** 2) ** 2) AS fourth FROM e2, m WHERE label < 5),
  g AS (SELECT *, (a + c) / 2 AS mu, (a - (a + c) / 2) ** 2 + 2 * b * b + (c - (a + c) / 2) ** 2 AS spread, (fourth - (a * a + 2 * b * b + c * c)) / n AS error FROM m, f),
  s AS (SELECT *, CASE WHEN spread = 0 THEN 0 ELSE least(error, spread) / spread END AS s FROM g),
  h AS (SELECT mx, my, (1 - s) * a + s * mu AS a, (1 - s) * b AS b, (1 - s) * c + s * mu AS c FROM s)
  SELECT vec_id AS id, round(sqrt(greatest((c * (x - mx) ** 2 - 2 * b * (x - mx) * (y - my) + a * (y - my) ** 2) / (a * c - b * b), 0)), 6) AS distance FROM e2, h""")
def _(spark, d):
    v = _two(spark, d)
    return rnd(learned.mahalanobis(v, learned.fit_mahalanobis(v.filter("label < 5"))).select("id", "distance"), "distance")


@query("scr14_single_gaussian_2d", f"""WITH {_TWO}, m AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) + 1e-9::DOUBLE AS a, covar_pop(x, y) AS b, var_pop(y) + 1e-9::DOUBLE AS c FROM e2)
  SELECT vec_id AS id, round(ln(2 * pi()) + 0.5::DOUBLE * ln(a * c - b * b) + 0.5::DOUBLE * (c * (x - mx) ** 2 - 2 * b * (x - mx) * (y - my) + a * (y - my) ** 2) / (a * c - b * b), 6) AS score FROM e2, m""")
def _(spark, d):
    v = _two(spark, d)
    return rnd(learned.MixtureDensity(1).fit(v).score(v).select("id", "score"), "score")


@query("scr18_ridge_one_input", f"""WITH {_TWO}, m AS (SELECT avg(x) AS mx, avg(y) AS my, stddev_pop(x) + 1e-6::DOUBLE AS sx, stddev_pop(y) + 1e-6::DOUBLE AS sy FROM e2),
  z AS (SELECT vec_id, (x - mx) / sx AS u, (y - my) / sy AS t FROM e2, m),
  n AS (SELECT sum(u * u) + 1 AS a, sum(u) AS b, count(*) + 1.0::DOUBLE AS c, sum(u * t) AS p, sum(t) AS q FROM z),
  w AS (SELECT (c * p - b * q) / (a * c - b * b) AS w, (a * q - b * p) / (a * c - b * b) AS k FROM n)
  SELECT vec_id AS id, round((t - u * w - k) ** 2, 6) AS residual FROM z, w""")
def _(spark, d):
    v = V.vectors(spark, d).select("id", F.slice("vec", 1, 1).alias("x"), F.slice("vec", 2, 1).alias("y"))
    return rnd(learned.ridge_residual(v, learned.fit_ridge(v, "x", "y", 1.0), "x", "y").select("id", "residual"), "residual")


@query("scr19_pca_residual_2d", f"""WITH {_TWO}, m AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM e2),
  l AS (SELECT *, ((a + c) + sqrt((a - c) ** 2 + 4 * b * b)) / 2 AS l FROM m),
  v AS (SELECT mx, my, b / sqrt(b * b + (l - a) ** 2) AS vx, (l - a) / sqrt(b * b + (l - a) ** 2) AS vy FROM l)
  SELECT vec_id AS id, round(((x - mx) ** 2 + (y - my) ** 2 - ((x - mx) * vx + (y - my) * vy) ** 2) / 2, 6) AS residual FROM e2, v""")
def _(spark, d):
    v = _two(spark, d)
    return rnd(learned.pca_residual(v, learned.fit_pca(v, 1)).select("id", "residual"), "residual")


@query("scr20_off_context_score", f"""WITH {V.CELLS}, p AS (SELECT cadence_idx, f_start, col, avg(v) AS p FROM cells WHERE obs_idx % 2 = 1 GROUP BY 1, 2, 3)
  SELECT cadence_idx, f_start, round(avg((v - p) ** 2), 6) AS score FROM cells JOIN p USING (cadence_idx, f_start, col) WHERE obs_idx % 2 = 0 GROUP BY 1, 2""")
def _(spark, d):
    return rnd(scoring.off_context_score(V.map_rows(spark, d), WIN), "score")


@query("scr21_self_match_score", """WITH p AS (SELECT a.vec_id // 12 AS snippet, a.vec_id % 12 AS patch, a.vec_id AS i, a.embedding AS q, b.embedding AS p FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
  g AS (SELECT unnest([0, 1, 2]) AS g), m AS (SELECT * FROM p, g WHERE patch % 3 <> g),
  l AS (SELECT a.snippet, a.g, a.patch, b.patch AS other, list_cosine_similarity(a.p::DOUBLE[], b.q::DOUBLE[]) / 0.07::DOUBLE AS z FROM m a JOIN m b ON a.snippet = b.snippet AND a.g = b.g),
  n AS (SELECT snippet, g, patch, ln(sum(exp(z))) - any_value(z) FILTER (patch = other) AS nll FROM l GROUP BY 1, 2, 3),
  s AS (SELECT snippet, g, avg(nll) AS m FROM n GROUP BY 1, 2) SELECT snippet, round(avg(m), 4) AS score FROM s GROUP BY 1""")
def _(spark, d):
    v = V.vectors(spark, d)
    nxt = v.select((F.col("id") - 1).alias("id"), F.col("vec").alias("pred"))
    p = v.join(nxt, "id").select(F.floor(F.col("id") / 12).alias("snippet"), F.pmod("id", F.lit(12)).alias("patch"),
                                 "pred", F.col("vec").alias("target"))
    return rnd(scoring.self_match_score(p, "snippet", 3), "score", digits=4)


def linear_model():
    """A small supplied model: weighted sum and its absolute value."""
    w = np.array([(i % 7) / 7.0 for i in range(64)])

    def predict(x: np.ndarray) -> np.ndarray:
        return x @ w
    return predict


@query("scr22_score_with_model", f"""WITH {_E} SELECT vec_id, round(sum(x * (d % 7) / 7.0::DOUBLE), 4) AS prediction FROM e GROUP BY 1""")
def _(spark, d):
    v = V.vectors(spark, d).select(F.col("id").alias("vec_id"), "vec")
    s = kernels.score_with_model(v, linear_model, ["vec"], T.DoubleType(), input_tensor_shapes=[[64]])
    return rnd(s.drop("vec"), "prediction", digits=4)


# ------------------------------------------------------------------ vector and class statistics

@query("agg9_ks_two_sample", """WITH a AS (SELECT l_extendedprice AS x, (l_returnflag = 'A')::INT AS c FROM lineitem),
  v AS (SELECT x, count(*) FILTER (c = 0) AS a, count(*) FILTER (c = 1) AS b FROM a GROUP BY 1),
  r AS (SELECT sum(a) OVER (ORDER BY x) / (SELECT sum(a) FROM v) AS ca, sum(b) OVER (ORDER BY x) / (SELECT sum(b) FROM v) AS cb FROM v)
  SELECT round(max(abs(ca - cb)), 6) AS d, (SELECT sum(a) FROM v)::BIGINT AS n_a, (SELECT sum(b) FROM v)::BIGINT AS n_b FROM r""")
def _(spark, d):
    li = V.table(spark, d, "lineitem").select((F.col("l_returnflag") == "A").cast("int").alias("c"), F.col("l_extendedprice").alias("x"))
    return rnd(stats.ks_two_sample(li, "c", "x").drop("p_asymptotic"), "d")


@query("agg9_ks_equal_samples", """WITH a AS (SELECT doc_id AS id, n_chars::DOUBLE AS x, (source = (SELECT min(source) FROM documents))::INT AS c FROM documents),
  k AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY c ORDER BY md5('0|' || id), id) <= 100),
  v AS (SELECT x, count(*) FILTER (c = 0) AS a, count(*) FILTER (c = 1) AS b FROM k GROUP BY 1),
  r AS (SELECT sum(a) OVER (ORDER BY x) / (SELECT sum(a) FROM v) AS ca, sum(b) OVER (ORDER BY x) / (SELECT sum(b) FROM v) AS cb FROM v)
  SELECT round(max(abs(ca - cb)), 6) AS d, (SELECT sum(a) FROM v)::BIGINT AS n_a, (SELECT sum(b) FROM v)::BIGINT AS n_b FROM r""")
def _(spark, d):
    doc = V.table(spark, d, "documents")
    first = doc.agg(F.min("source").alias("_f"))
    a = scale.attach(doc.select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("x"), "source"), first, [])
    a = a.select("id", "x", (F.col("source") == F.col("_f")).cast("int").alias("c"))
    return rnd(stats.ks_two_sample(a, "c", "x", 100).drop("p_asymptotic"), "d")


@query("agg12_cohens_d", f"""WITH {V.LABELLED}, g AS (SELECT lang, avg(score) FILTER (quality = 1) AS m1, avg(score) FILTER (quality = 0) AS m0,
   var_samp(score) FILTER (quality = 1) AS v1, var_samp(score) FILTER (quality = 0) AS v0, count(*) FILTER (quality = 1) AS n1, count(*) FILTER (quality = 0) AS n0 FROM labelled GROUP BY 1)
  SELECT lang, CASE WHEN n0 > 1 AND n1 > 1 THEN round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) + 1e-12), 6) END AS cohens_d FROM g""")
def _(spark, d):
    return rnd(stats.cohens_d(V.labelled(spark, d), ["lang"], "quality", "score"), "cohens_d")


@query("agg13_eta_squared", """WITH g AS (SELECT l_returnflag AS method, l_suppkey AS c, count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) * count(*) AS ss FROM lineitem GROUP BY 1, 2),
  t AS (SELECT method, sum(n * m) / sum(n) AS gm FROM g GROUP BY 1)
  SELECT method, round(sum(n * (m - gm) ** 2) / (sum(n * (m - gm) ** 2) + sum(ss)), 6) AS eta2, sum(n)::BIGINT AS n, count(*) AS n_groups FROM g JOIN t USING (method) GROUP BY 1""")
def _(spark, d):
    return rnd(stats.eta_squared(V.plain_scores(spark, d), ["method"], "cadence_idx", "score"), "eta2")


_DIM = "dm AS (SELECT d, avg(x) AS mu, sqrt(greatest(var_pop(x), 0)) AS sd FROM e GROUP BY 1)"


@query("agg14_vector_moments", f"WITH {_E}, {_DIM} SELECT d::BIGINT AS dim, round(mu, 6) AS mu, round(sd, 6) AS sd FROM dm")
def _(spark, d):
    m = stats.vector_moments(V.vectors(spark, d))
    return rnd(m.withColumn("dim", F.col("dim").cast("long")), "mu", "sd")


@query("agg14_per_channel_norm", f"WITH {_E}, {_DIM} SELECT vec_id, d::BIGINT AS dim, round((x - mu) / (sd + 1e-6::DOUBLE), 6) AS z FROM e JOIN dm USING (d)")
def _(spark, d):
    n = stats.per_channel_norm(V.vectors(spark, d))
    x = n.select(F.col("id").alias("vec_id"), F.posexplode("vec").alias("dim", "z"))
    return rnd(x.withColumn("dim", F.col("dim").cast("long")), "z")


@query("agg15_onoff_heterogeneity", f"""WITH {V.CELLS}, r AS (SELECT cadence_idx, f_start, obs_idx, avg(v) AS m FROM cells GROUP BY 1, 2, 3),
  w AS (SELECT cadence_idx, f_start, avg(m) FILTER (obs_idx % 2 = 0) AS o, avg(m) FILTER (obs_idx % 2 = 1) AS f FROM r GROUP BY 1, 2), b AS (SELECT * FROM w WHERE o IS NOT NULL AND f IS NOT NULL)
  SELECT count(*) AS n, round(avg(o), 6) AS on_mean, round(avg(f), 6) AS off_mean, round(avg((f > o)::INT) * 100, 6) AS pct_off_gt_on,
   round((avg(f) - avg(o)) / sqrt(((count(*) - 1) * var_samp(f) + (count(*) - 1) * var_samp(o)) / (2 * count(*) - 2) + 1e-12), 6) AS cohens_d FROM b""")
def _(spark, d):
    r = V.map_rows(spark, d).select(*WIN, "obs_idx", scoring.array_mean(F.col("cells")).alias("m"))
    return rnd(stats.onoff_heterogeneity(r, WIN), "on_mean", "off_mean", "pct_off_gt_on", "cohens_d")


@query("agg16_component_budget", f"""WITH {_FUSED}, u AS (SELECT unnest(st1) AS a, unnest(st2) AS b, unnest(ss) AS c FROM comp),
  m AS (SELECT avg(a) AS a, avg(b) AS b, avg(c) AS c, corr(a, b) AS r FROM u), f AS (SELECT *, 0.5::DOUBLE * a + 0.3::DOUBLE * b + 0.2::DOUBLE * c AS f FROM m)
  SELECT round(0.5::DOUBLE * a / f, 6) AS share_st1, round(0.3::DOUBLE * b / f, 6) AS share_st2, round(0.2::DOUBLE * c / f, 6) AS share_ss, round(r, 6) AS corr_st1_st2, round(c / a, 6) AS ss_over_st1 FROM f""")
def _(spark, d):
    c = components(spark, d).select(F.explode(F.arrays_zip("st1", "st2", "ss")).alias("s")).select("s.*")
    out = stats.component_budget(c, (0.5, 0.3, 0.2))
    return rnd(out, *out.columns)


@query("agg17_collapse_check", f"""WITH {_E}, {_DIM}, ce AS (SELECT a.d AS i, b.d AS j, covar_samp(a.x, b.x) AS c FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2),
  pm AS (SELECT label, d, avg(x) AS m FROM e GROUP BY 1, 2), ec AS (SELECT vec_id, d, x - m AS x FROM e JOIN pm USING (label, d)),
  cc AS (SELECT a.d AS i, b.d AS j, covar_samp(a.x, b.x) AS c FROM ec a JOIN ec b USING (vec_id) GROUP BY 1, 2)
  SELECT round(avg(sd), 6) AS mean_sd, round(avg(sd) / (sqrt(sum(mu * mu)) / sqrt(count(*)) + 1e-12), 4) AS rel_std, count(*) FILTER (sd < 1e-4) AS dead_dims,
   (SELECT round(sum(c) FILTER (i = j) ** 2 / (sum(c * c) + 1e-12), 4) FROM ce) AS pr_rank_pooled,
   (SELECT round(sum(c) FILTER (i = j) ** 2 / (sum(c * c) + 1e-12), 4) FROM cc) AS pr_rank_content FROM dm""")
def _(spark, d):
    c = rnd(stats.collapse_check(V.vectors(spark, d), "vec", "label"), "mean_sd")
    return rnd(c, "rel_std", "pr_rank_pooled", "pr_rank_content", digits=4)
