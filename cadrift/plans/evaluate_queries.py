"""Queries over injections, ranking figures, survival and matched comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadrift.operators import evaluate, inject, pools, prepare, scale, scoring
from cadrift.plans import views as V
from cadrift.plans.registry import query
from cadrift.plans.search_queries import WIN, rnd

# Injected and probe scores: shipped lines are probes, finished ones injections with an SNR.
INJ = """inj AS (SELECT l_suppkey % 10 AS cadence_idx, l_returnflag AS method, l_linenumber * 5.0::DOUBLE AS snr, l_extendedprice + l_linenumber * 9000.0::DOUBLE AS score FROM lineitem WHERE l_linestatus = 'F'),
  probe AS (SELECT l_suppkey % 10 AS cadence_idx, l_returnflag AS method, l_extendedprice * 0.5::DOUBLE AS score FROM lineitem WHERE l_linestatus = 'O')"""


def injected(spark, d):
    li = V.table(spark, d, "lineitem")
    key = [F.pmod("l_suppkey", F.lit(10)).alias("cadence_idx"), F.col("l_returnflag").alias("method")]
    inj = li.filter("l_linestatus = 'F'").select(*key, (F.col("l_linenumber") * 5.0).alias("snr"),
                                                 (F.col("l_extendedprice") + F.col("l_linenumber") * 9000.0).alias("score"))
    return inj, li.filter("l_linestatus = 'O'").select(*key, (F.col("l_extendedprice") * 0.5).alias("score"))


def auc_sql(src, keys, label="label", score="score", name="au"):
    by = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""{name}_c AS (SELECT {by}{score} AS sc, count(*) FILTER ({label} = 1) AS p, count(*) FILTER ({label} = 0) AS n FROM {src} WHERE {score} IS NOT NULL GROUP BY ALL),
  {name}_r AS (SELECT *, sum(n) OVER ({part} ORDER BY sc) - n AS b FROM {name}_c),
  {name} AS (SELECT {by}sum(p * (b + n / 2)) / nullif(sum(p) * sum(n), 0) AS auc, sum(p)::BIGINT AS n_pos, sum(n)::BIGINT AS n_neg FROM {name}_r {"GROUP BY " + keys if keys else ""})"""


@query("eval1_roc_auc", f"WITH {V.LABELLED}, {auc_sql('labelled', 'lang')} SELECT lang, round(auc, 6) AS auc, n_pos, n_neg FROM au")
def _(spark, d):
    return rnd(evaluate.roc_auc(V.labelled(spark, d), ["lang"], "label", "score"), "auc")


@query("eval1_roc_auc_free", f"WITH {V.LABELLED}, {auc_sql('labelled', '')} SELECT round(greatest(auc, 1 - auc), 6) AS auc, n_pos, n_neg FROM au")
def _(spark, d):
    return rnd(evaluate.roc_auc(V.labelled(spark, d), [], "label", "score", free=True), "auc")


@query("eval2_tpr_at_fpr", f"""WITH {V.LABELLED}, t AS (SELECT lang, quantile_cont(score, 0.9) AS threshold FROM labelled WHERE label = 0 GROUP BY 1)
  SELECT lang, round(any_value(threshold), 6) AS threshold, round(avg((score > threshold)::INT) * 100, 6) AS tpr_pct FROM labelled JOIN t USING (lang) WHERE label = 1 GROUP BY 1""")
def _(spark, d):
    return rnd(evaluate.tpr_at_fpr(V.labelled(spark, d), ["lang"], "label", "score"), "threshold", "tpr_pct")


@query("join4_scores_to_background", f"""WITH {INJ}, m AS (SELECT method, snr, avg(score) AS mean_score FROM inj GROUP BY 1, 2)
  SELECT m.method, snr, round(mean_score, 6) AS mean_score, count(*) FILTER (p.score < mean_score) AS n_below, count(*) FILTER (p.score = mean_score) AS n_equal, count(*) AS n_background
  FROM m JOIN probe p ON m.method = p.method GROUP BY 1, 2, mean_score""")
def _(spark, d):
    inj, probe = injected(spark, d)
    m = inj.groupBy("method", "snr").agg(F.avg("score").alias("mean_score"))
    return rnd(evaluate.scores_below(probe, m, ["method"], at="mean_score"), "mean_score")


_CAL = "cal AS (SELECT method, median(score) AS center, 1.4826 * mad(score) AS spread FROM probe GROUP BY 1)"
_DET = """dt AS (SELECT method, snr, avg(score) AS mean_score, stddev_pop(score) AS std_score, avg((score > center + 3 * spread)::INT) * 100 AS det_3s,
   avg((score > center + 5 * spread)::INT) * 100 AS det_5s, any_value(center) AS c, any_value(spread) AS s FROM inj JOIN cal USING (method) GROUP BY 1, 2)"""


def _robust_cal(probe):
    return scale.robust_stats(probe, ["method"], "score", names=("center", "spread"))


@query("eval3_detection_table", f"""WITH {INJ}, {_CAL}, {_DET} SELECT dt.method, snr, round(mean_score, 6) AS mean_score, round(std_score, 6) AS std_score, round(det_3s, 6) AS det_3s, round(det_5s, 6) AS det_5s,
  round((mean_score - c) / s, 6) AS sigma, round(count(*) FILTER (p.score < mean_score) / count(*) * 100, 6) AS rank_pct FROM dt JOIN probe p ON dt.method = p.method GROUP BY ALL""")
def _(spark, d):
    inj, probe = injected(spark, d)
    t = evaluate.detection_table(inj, _robust_cal(probe), probe)
    return rnd(t, "mean_score", "std_score", "det_3s", "det_5s", "sigma", "rank_pct")


@query("eval3_detection_table_quiet", f"""WITH {INJ}, {_CAL.replace('median(score)', 'avg(score)').replace('1.4826 * mad(score)', 'stddev_pop(score)')}, {_DET}
  SELECT method, snr, round(mean_score, 6) AS mean_score, round(std_score, 6) AS std_score, round(det_3s, 6) AS det_3s, round(det_5s, 6) AS det_5s, round((mean_score - c) / s, 6) AS sigma FROM dt""")
def _(spark, d):
    inj, probe = injected(spark, d)
    t = evaluate.detection_table(inj, evaluate.quiet_calibration(probe))
    return rnd(t, "mean_score", "std_score", "det_3s", "det_5s", "sigma")


@query("eval4_detection_floor", f"WITH {INJ}, {_CAL}, {_DET} SELECT method, min(snr) FILTER (det_3s >= 50) AS floor_snr FROM dt GROUP BY 1")
def _(spark, d):
    inj, probe = injected(spark, d)
    return evaluate.detection_floor(evaluate.detection_table(inj, _robust_cal(probe)))


_PG = """own AS (SELECT method, cadence_idx, median(score) + 3 * 1.4826 * mad(score) AS t3, median(score) + 5 * 1.4826 * mad(score) AS t5 FROM probe GROUP BY 1, 2),
  po AS (SELECT method, median(score) + 3 * 1.4826 * mad(score) AS pt FROM probe GROUP BY 1),
  sp AS (SELECT method, min(t3) AS lo, max(t3) AS hi, median(t3) AS mid FROM own GROUP BY 1),
  dd AS (SELECT method, snr, avg((score > pt)::INT) * 100 AS a, avg((score > t3)::INT) * 100 AS b, avg((score > t5)::INT) * 100 AS c, count(*) AS n, count(DISTINCT cadence_idx) AS nc, any_value(pt) AS pt
   FROM inj JOIN own USING (method, cadence_idx) JOIN po USING (method) GROUP BY 1, 2),
  gg AS (SELECT method, snr, cadence_idx, count(*) AS n, avg(score) AS m, var_pop(score) * count(*) AS ss FROM inj GROUP BY 1, 2, 3),
  gm AS (SELECT method, snr, sum(n * m) / sum(n) AS gm FROM gg GROUP BY 1, 2),
  et AS (SELECT method, snr, sum(n * (m - gm) ** 2) / (sum(n * (m - gm) ** 2) + sum(ss)) AS eta2 FROM gg JOIN gm USING (method, snr) GROUP BY 1, 2)"""


@query("eval5_per_group_detection", f"""WITH {INJ}, {_PG} SELECT method, snr, round(a, 6) AS det_3s_pool, round(b, 6) AS det_3s_cad, round(c, 6) AS det_5s_cad, n AS n_injections, nc AS n_cadences,
  round(pt, 6) AS pooled_thresh3, round(eta2, 6) AS eta2, round(lo, 6) AS thresh3_min, round(hi, 6) AS thresh3_max, round(mid, 6) AS thresh3_median FROM dd JOIN et USING (method, snr) JOIN sp USING (method)""")
def _(spark, d):
    t = evaluate.per_group_detection(*injected(spark, d))
    return rnd(t, *[c for c in t.columns if c not in ("method", "snr", "n_injections", "n_cadences")])


@query("eval5_variance_verdict", f"""WITH {INJ}, {_PG} SELECT method, round(avg(eta2), 6) AS mean_eta2, CASE WHEN avg(eta2) > 0.5 THEN 'between' ELSE 'within' END AS dominates FROM et WHERE snr >= 30 GROUP BY 1""")
def _(spark, d):
    return rnd(evaluate.variance_verdict(evaluate.per_group_detection(*injected(spark, d))), "mean_eta2")


STAGES = ["s0_sigma3", "s1_far1pct", "s2_on_rows", "s3_short_list", "survives", "survives_min"]


@query("eval6_survival_cascade", f"WITH {V.TRIALS} SELECT snr, morphology, " + ", ".join(f"round(avg({s}::INT) * 100, 6) AS {s}" for s in STAGES)
       + " FROM trials GROUP BY GROUPING SETS ((snr), (snr, morphology))")
def _(spark, d):
    return rnd(evaluate.survival_cascade(V.trials(spark, d), STAGES), *STAGES)


@query("eval7_cut_cost", f"WITH {V.TRIALS} SELECT morphology, snr, round((avg(survives_min::INT) - avg(survives::INT)) * 100, 6) AS cost_pp FROM trials GROUP BY 1, 2")
def _(spark, d):
    return rnd(evaluate.cut_cost(V.trials(spark, d), "survives_min", "survives"), "cost_pp")


@query("eval8_review_budget", f"WITH {V.TRIALS}, c AS (SELECT unnest([5, 10, 30, 100])::BIGINT AS cap) SELECT snr, cap, round(avg((survives AND rank < cap)::INT) * 100, 6) AS complete_pct FROM trials, c GROUP BY 1, 2")
def _(spark, d):
    return rnd(evaluate.review_budget(V.trials(spark, d), [5, 10, 30, 100]), "complete_pct")


_INC = "inc AS (SELECT l_suppkey % 10 AS cadence_idx, l_extendedprice / 250.0::DOUBLE AS contrast FROM lineitem WHERE l_linenumber = 1)"


@query("eval9_rank_among_incumbents", f"""WITH {V.TRIALS}, {_INC}, i AS (SELECT cadence_idx, list_sort(list(contrast)) AS l, count(*) AS n FROM inc GROUP BY 1)
  SELECT trial, n AS n_incumbent, CASE WHEN survives THEN len(list_filter(l, lambda x: x > contrast)) ELSE -1 END AS rank FROM trials JOIN i USING (cadence_idx)""")
def _(spark, d):
    t = V.trials(spark, d).select("trial", "cadence_idx", "contrast", "survives")
    inc = V.table(spark, d, "lineitem").filter("l_linenumber = 1").select(
        F.pmod("l_suppkey", F.lit(10)).alias("cadence_idx"), (F.col("l_extendedprice") / 250.0).alias("contrast"))
    return evaluate.rank_among_incumbents(t, inc, ["cadence_idx"]).select("trial", "n_incumbent", "rank")


@query("eval10_rank_quantiles", f"WITH {V.TRIALS} SELECT snr, round(quantile_cont(rank, 0.5), 6) AS p50, round(quantile_cont(rank, 0.9), 6) AS p90, round(quantile_cont(rank, 0.99), 6) AS p99 FROM trials WHERE survives GROUP BY 1")
def _(spark, d):
    return rnd(evaluate.rank_quantiles(V.trials(spark, d)), "p50", "p90", "p99")


@query("eval19_stage_flags", f"""WITH {V.TRIALS}, th AS (SELECT cadence_idx, median(score) + 3 * 0.3 * 1.4826 * mad(score) AS t3, quantile_cont(score, 0.9) AS far, quantile_cont(score, 0.7) AS loose, quantile_cont(score, 0.8) AS oc FROM trials GROUP BY 1),
  t AS (SELECT trial, cadence_idx, score, rank % 4 AS hits, survives_min AS short FROM trials)
  SELECT trial, score > t3 AS s0_sigma3, score > far AS s1_far1pct, score > loose AS s1b_loose, score > least(far, oc) AS s1_min, hits >= 2 AS s2_on_rows, short AS s3_short_list,
   short AND score > far AS survives, short AND score > least(far, oc) AS survives_min FROM t JOIN th USING (cadence_idx)""")
def _(spark, d):
    t = V.trials(spark, d).select("trial", "cadence_idx", "score", F.pmod("rank", F.lit(4)).alias("n_on_hits_full"),
                                  F.col("survives_min").alias("in_short_list"))
    q = scale.exact_quantiles(t, ["cadence_idx"], "score", {"far_thresh": .9, "loose_thresh": .7, "off_ceiling": .8})
    r = scale.robust_stats(t, ["cadence_idx"], "score").select(
        "cadence_idx", (F.col("median") + 3 * 0.3 * F.col("mad_sigma")).alias("thresh_3"))
    return evaluate.stage_flags(t, q.join(r, "cadence_idx")).drop("cadence_idx", "score", "n_on_hits_full", "in_short_list")


# ------------------------------------------------------------------ matched pairs

def match_sql(caliper, tag=""):
    """The passes of one caliper; ``tag`` tells several calipers' tables apart."""
    ab = "SELECT id, v FROM {s}{n} WHERE id NOT IN (SELECT {s}_id FROM p{n})".replace("{n}", tag + "{n}")
    rank = "SELECT id, v, floor(v / {w}::DOUBLE) AS c, row_number() OVER (PARTITION BY floor(v / {w}::DOUBLE) ORDER BY v, id) AS i FROM {s}" + tag + "{n}"
    out = []
    for n, level in enumerate(range(evaluate.LEVELS - 1, -1, -1)):
        w = repr(caliper / 4 ** level)
        out.append(f"""p{tag}{n} AS (SELECT a.id AS a_id, a.v AS a_v, b.id AS b_id, b.v AS b_v FROM ({rank.format(w=w, s="a", n=n)}) a JOIN ({rank.format(w=w, s="b", n=n)}) b USING (c, i)),
  a{tag}{n + 1} AS ({ab.format(s="a", n=n)}), b{tag}{n + 1} AS ({ab.format(s="b", n=n)})""")
    n = evaluate.LEVELS
    for parity in (0, 1):
        k = f"floor(v / {caliper!r}::DOUBLE)::BIGINT"
        low = f"((({k} - {parity}) % 2) + 2) % 2 = 0"
        r = f"""SELECT *, row_number() OVER (PARTITION BY e, low ORDER BY CASE WHEN low THEN -v ELSE v END, id) AS i FROM (
    SELECT id, v, {low} AS low, CASE WHEN {low} THEN {k} ELSE {k} - 1 END AS e FROM {{s}}{tag}{n})"""
        out.append(f"""p{tag}{n} AS (SELECT a.id AS a_id, a.v AS a_v, b.id AS b_id, b.v AS b_v FROM ({r.format(s="a")}) a JOIN ({r.format(s="b")}) b USING (e, i)
    WHERE a.low <> b.low AND abs(a.v - b.v) <= {caliper!r}::DOUBLE), a{tag}{n + 1} AS ({ab.format(s="a", n=n)}), b{tag}{n + 1} AS ({ab.format(s="b", n=n)})""")
        n += 1
    out.append(f"pairs{tag} AS (" + " UNION ALL ".join(f"SELECT * FROM p{tag}{i}" for i in range(n)) + ")")
    return ",\n".join(out)


_AB = """a0 AS (SELECT doc_id AS id, ln(n_chars) AS v FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
  b0 AS (SELECT doc_id AS id, ln(n_chars) AS v FROM documents JOIN labels USING (doc_id) WHERE toxic = 0)"""


def _adaptive_sql():
    """Pairs of every caliper, their energy AUC, and the caliper chosen."""
    out = []
    for k, c in enumerate(evaluate.CALIPERS):
        t = "xyzuvw"[k]
        out.append(f"a{t}0 AS (SELECT * FROM a0), b{t}0 AS (SELECT * FROM b0), {match_sql(c, t)}")
    every = " UNION ALL ".join(f"SELECT {k} AS nth, {c!r}::DOUBLE AS caliper, * FROM pairs{'xyzuvw'[k]}" for k, c in enumerate(evaluate.CALIPERS))
    return f"""{_AB}, {", ".join(out)}, every AS ({every}),
  sides AS (SELECT nth, 0 AS label, a_v AS v FROM every UNION ALL SELECT nth, 1, b_v FROM every), {auc_sql("sides", "nth", score="v")},
  best AS (SELECT nth, greatest(auc, 1 - auc) AS energy_auc FROM au WHERE n_pos >= 20
           ORDER BY greatest(auc, 1 - auc) <= 0.58 DESC, CASE WHEN greatest(auc, 1 - auc) <= 0.58 THEN nth END, greatest(auc, 1 - auc), nth LIMIT 1)"""


def _energy_rows(spark, d):
    return V.labelled(spark, d).select(F.col("doc_id").alias("id"), "label", F.log("score").alias("energy"),
                                       F.pmod("doc_id", F.lit(97)).cast("double").alias("noise"), F.col("quality").cast("double").alias("quality"))


@query("join6_caliper_match", f"WITH {_AB}, {match_sql(0.05)} SELECT a_id, b_id, round(abs(a_v - b_v), 6) AS gap FROM pairs")
def _(spark, d):
    r = _energy_rows(spark, d)
    a, b = (r.filter(F.col("label") == c).select("id", F.col("energy").alias("v")) for c in (1, 0))
    p = evaluate.caliper_match(a, b, 0.05)
    return p.select("a_id", "b_id", F.round(F.abs(F.col("a_v") - F.col("b_v")), 6).alias("gap"))


@query("join7_adaptive_caliper", f"WITH {_adaptive_sql()} SELECT caliper, energy_auc, count(*) AS n_pairs FROM every JOIN best USING (nth) GROUP BY 1, 2")
def _(spark, d):
    r = _energy_rows(spark, d)
    a, b = (r.filter(F.col("label") == c).select("id", F.col("energy").alias("v")) for c in (1, 0))
    caliper, pairs, auc = evaluate.adaptive_caliper(a, b)
    if pairs is None:
        return spark.createDataFrame([], "caliper double, energy_auc double, n_pairs long")
    return pairs.agg(F.count("*").alias("n_pairs")).select(F.lit(caliper).alias("caliper"), F.lit(auc).alias("energy_auc"), "n_pairs")


@query("eval11_matched_energy_auc", f"""WITH {_adaptive_sql()},
  keep AS (SELECT caliper, 0 AS label, a_id AS doc_id FROM every JOIN best USING (nth) UNION ALL SELECT caliper, 1, b_id FROM every JOIN best USING (nth)),
  feat AS (SELECT caliper, label, ln(n_chars) AS energy, (doc_id % 97)::DOUBLE AS noise, quality::DOUBLE AS quality FROM keep JOIN documents USING (doc_id) JOIN labels USING (doc_id)),
  named AS (SELECT 'energy' AS name, label, energy AS s FROM feat UNION ALL SELECT 'noise', label, noise FROM feat UNION ALL SELECT 'quality', label, quality FROM feat),
  {auc_sql("named", "name", score="s", name="m")}
  SELECT name AS score, round(auc, 6) AS auc, n_pos AS n_per_class, (SELECT min(caliper) FROM keep) AS caliper FROM m""")
def _(spark, d):
    r = _energy_rows(spark, d).withColumn("label", 1 - F.col("label"))
    return rnd(evaluate.matched_auc(r, ["noise", "quality"]), "auc")


@query("eval12_cv_logistic_auc")
def _(spark, d):
    return rnd(evaluate.cv_logistic_auc(_energy_rows(spark, d), ["energy", "noise", "quality"]), "auc", digits=4)


@query("eval13_one_class_report", f"""WITH {INJ}, rfi AS (SELECT l_returnflag AS method, l_extendedprice * 0.7::DOUBLE AS score FROM lineitem WHERE l_discount > 0.08),
  cal AS (SELECT method, avg(score) AS center, stddev_pop(score) AS spread FROM probe GROUP BY 1), {_DET},
  q AS (SELECT method, avg(score) AS m, var_samp(score) AS v, count(*) AS n FROM probe GROUP BY 1), r AS (SELECT method, avg(score) AS m, var_samp(score) AS v, count(*) AS n FROM rfi GROUP BY 1),
  fl AS (SELECT method, min(snr) FILTER (det_3s >= 50) AS floor_snr FROM dt GROUP BY 1)
  SELECT method, snr, round(det_3s, 6) AS det_3s, round(det_5s, 6) AS det_5s, round((r.m - q.m) / sqrt(((q.n - 1) * q.v + (r.n - 1) * r.v) / (q.n + r.n - 2) + 1e-12), 6) AS rfi_d, floor_snr
  FROM dt JOIN q USING (method) JOIN r USING (method) JOIN fl USING (method)""")
def _(spark, d):
    inj, probe = injected(spark, d)
    rfi = V.table(spark, d, "lineitem").filter("l_discount > 0.08").select(
        F.col("l_returnflag").alias("method"), (F.col("l_extendedprice") * 0.7).alias("score"))
    return rnd(evaluate.one_class_report(probe, inj, rfi), "det_3s", "det_5s", "rfi_d")


_OP = f"""{V.LABELLED}, op AS (SELECT quality AS snr, label, score, (doc_id % 97)::DOUBLE AS energy FROM labelled), {auc_sql("op", "snr", name="a1")}, {auc_sql("op", "snr", score="energy", name="a2")},
  tt AS (SELECT snr, quantile_cont(score, 0.9) AS t FROM op WHERE label = 0 GROUP BY 1), tp AS (SELECT snr, avg((score > t)::INT) * 100 AS tpr FROM op JOIN tt USING (snr) WHERE label = 1 GROUP BY 1)"""


@query("eval14_operational_auc", f"""WITH {_OP} SELECT snr, round(a1.auc, 6) AS auc, round(a2.auc, 6) AS auc_energy, round(tpr, 6) AS tpr_pct, round(a1.auc - a2.auc, 6) AS margin
  FROM a1 JOIN a2 USING (snr) JOIN tp USING (snr)""")
def _(spark, d):
    s = V.labelled(spark, d).select(F.col("quality").alias("snr"), "label", "score", F.pmod("doc_id", F.lit(97)).cast("double").alias("energy"))
    return rnd(evaluate.operational_auc(s), "auc", "auc_energy", "tpr_pct", "margin")


_TOK = """tok AS (SELECT vec_id // 20 AS frame, vec_id % 20 AS patch, CASE WHEN label >= 7 THEN true WHEN label <= 4 THEN false END AS affected,
   sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * (1 + label / 100.0::DOUBLE) AS disp FROM embeddings),
  tk2 AS (SELECT *, affected::INT AS c, round(disp, 9) AS dr FROM tok WHERE affected IS NOT NULL)"""


@query("eval15_displacement_report", f"""WITH {_TOK}, {auc_sql("tk2", "", "c", "dr")}, g AS (SELECT avg(dr) FILTER (c = 1) AS m1, avg(dr) FILTER (c = 0) AS m0, var_samp(dr) FILTER (c = 1) AS v1, var_samp(dr) FILTER (c = 0) AS v0,
   count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 0) AS n0 FROM tk2), b AS (SELECT * FROM tok QUALIFY row_number() OVER (PARTITION BY frame ORDER BY round(disp, 9) DESC, patch) <= 5),
  h AS (SELECT frame, max(coalesce(affected, false)::INT) AS h FROM b GROUP BY 1)
  SELECT round(auc, 6) AS auc, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) + 1e-12), 6) AS cohens_d, (SELECT round(avg(h) * 100, 6) FROM h) AS top_hit_pct FROM au, g""")
def _(spark, d):
    v = V.vectors(spark, d)
    lab = F.col("label")
    t = v.select(F.floor(F.col("id") / 20).alias("frame"), F.pmod("id", F.lit(20)).alias("patch"),
                 F.when(lab >= 7, True).when(lab <= 4, False).alias("affected"),
                 F.round(scoring.norm("vec") * (1 + lab / 100.0), 9).alias("disp"))
    return rnd(evaluate.displacement_report(t), "auc", "cohens_d", "top_hit_pct")


@query("eval16_row_leakage", f"""WITH {V.MAP_ROWS}, r AS (SELECT cadence_idx, f_start, obs_idx, list_max(cells) AS m FROM map_rows),
  w AS (SELECT cadence_idx, f_start, avg(m) FILTER (obs_idx % 2 = 0) AS o, avg(m) FILTER (obs_idx % 2 = 1) AS f FROM r GROUP BY 1, 2)
  SELECT round(avg(o), 6) AS on_resp, round(avg(f), 6) AS off_resp, round(avg(o) / (avg(f) + 1e-12), 6) AS ratio,
   CASE WHEN avg(o) / (avg(f) + 1e-12) >= 3 THEN 'localized' WHEN avg(o) / (avg(f) + 1e-12) >= 1.5 THEN 'partial' ELSE 'diffuse' END AS verdict FROM w""")
def _(spark, d):
    return rnd(evaluate.row_leakage(V.map_rows(spark, d)), "on_resp", "off_resp", "ratio")


_ATT = f"""{V.LABELLED}, att AS (SELECT lang AS setting, 'q' || quality AS "case", label, score AS energy, (doc_id % 97)::DOUBLE AS noise, -score AS inverse FROM labelled),
  """ + ", ".join(auc_sql("att", 'setting, "case"', score=s, name=f"a_{s}") for s in ("energy", "noise", "inverse"))


@query("eval17_attribution_table", f"""WITH {_ATT} SELECT setting, "case", round(a_energy.auc, 6) AS energy, round(a_noise.auc, 6) AS noise, round(a_inverse.auc, 6) AS inverse
  FROM a_energy JOIN a_noise USING (setting, "case") JOIN a_inverse USING (setting, "case")""")
def _(spark, d):
    s = V.labelled(spark, d).select(
        F.col("lang").alias("setting"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("case"), "label",
        F.col("score").alias("energy"), F.pmod("doc_id", F.lit(97)).cast("double").alias("noise"), (-F.col("score")).alias("inverse"))
    return rnd(evaluate.attribution_table(s, ["energy", "noise", "inverse"]), "energy", "noise", "inverse")


@query("eval18_acceptance_gates", f"""WITH {_OP}, {auc_sql("op", "", name="a3")}, m AS (SELECT 'matched_auc' AS metric, (SELECT auc FROM a3) AS value UNION ALL SELECT 'tpr_snr12', (SELECT max(tpr) FROM tp)
   UNION ALL SELECT 'margin_over_simple', (SELECT max(a1.auc - a2.auc) FROM a1 JOIN a2 USING (snr)) UNION ALL SELECT 'train_val_gap', (SELECT max(auc) - min(auc) FROM a1)),
  g AS (SELECT * FROM (VALUES ('B1', 'matched_auc', '>=', 0.80::DOUBLE), ('B1b', 'margin_over_probe', '>', 0.0::DOUBLE), ('B2a', 'tpr_snr12', '>=', 70.0::DOUBLE), ('B2b', 'tpr_snr10', '>=', 40.0::DOUBLE),
   ('B3a', 'tpr_snr5', '>', 0.0::DOUBLE), ('B3b', 'tpr_snr7', '>', 0.0::DOUBLE), ('B4', 'train_val_gap', 'abs<=', 0.03::DOUBLE), ('B5a', 'energy_residual', '<=', 0.58::DOUBLE), ('B5b', 'margin_over_simple', '>=', 0.15::DOUBLE)) t(gate, metric, comparison, bound))
  SELECT gate, metric, round(value, 6) AS value, comparison, bound, CASE comparison WHEN '>=' THEN value >= bound WHEN '>' THEN value > bound WHEN 'abs<=' THEN abs(value) <= bound ELSE value <= bound END AS passed FROM g LEFT JOIN m USING (metric)""")
def _(spark, d):
    s = V.labelled(spark, d).select(F.col("quality").alias("snr"), "label", "score", F.pmod("doc_id", F.lit(97)).cast("double").alias("energy"))
    o = evaluate.operational_auc(s)
    m = evaluate.roc_auc(s, [], "label", "score").select(F.lit("matched_auc").alias("metric"), F.col("auc").alias("value"))
    for name, c in (("tpr_snr12", F.max("tpr_pct")), ("margin_over_simple", F.max("margin")), ("train_val_gap", F.max("auc") - F.min("auc"))):
        m = m.unionByName(o.agg(c.alias("value")).withColumn("metric", F.lit(name)))
    return rnd(evaluate.acceptance_gates(m), "value")


# ------------------------------------------------------------------ injections

@query("inj1_quiet_sites", f"""WITH {V.SCORES}, m AS (SELECT cadence_idx, median(score) AS m FROM scores GROUP BY 1)
  SELECT cadence_idx, f_start, score FROM scores JOIN m USING (cadence_idx) WHERE score <= m
  QUALIFY row_number() OVER (PARTITION BY cadence_idx ORDER BY md5('3|' || cadence_idx || '|' || f_start), cadence_idx, f_start) <= 10""")
def _(spark, d):
    return inject.quiet_sites(V.scores(spark, d).select(*WIN, "score"), 10, 3)


PARAMS = inject.SiteParams(fchans=32, tchans=18, n_obs=6)


def cadence_pixels(spark, d):
    """The pixel view as six observations of three time bins; later bins lie beyond the grid."""
    return V.pixels(spark, d).select(
        F.col("frame").alias("cadence_idx"), F.lit(0).cast("long").alias("f_start"),
        F.floor(F.col("t") / 3).alias("obs_idx"), F.pmod("t", F.lit(3)).alias("t"), "ch", "x")


def _sites(spark, d, kind):
    s = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("cadence_idx")).distinct().select(
        "cadence_idx", F.lit(0).cast("long").alias("f_start"), (10.0 + F.pmod("cadence_idx", F.lit(5)) * 5).alias("snr"))
    return inject.sample_site_params(s, kind, PARAMS, 11)


def _u(i):
    return f"((('0x' || substr(md5('11|{i}|' || cadence_idx || '|0'), 1, 8))::UBIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


_DFHZ, _DT, _PI = "2.7939677238464355::DOUBLE", "18.253611008::DOUBLE", "pi()"
_SITES = f"""st0 AS (SELECT DISTINCT l_suppkey AS cadence_idx FROM lineitem),
  st1 AS (SELECT cadence_idx, 10.0::DOUBLE + (cadence_idx % 5) * 5 AS snr, {", ".join(f"{_u(i)} AS u{i}" for i in range(8))}, 18 * {_DT} AS whole, 32 * {_DFHZ} AS band FROM st0),
  st2 AS (SELECT *, CASE WHEN u2 < 0.05 THEN 0.0 ELSE (CASE WHEN u3 < 0.5 THEN -1 ELSE 1 END) * least(greatest(10.0::DOUBLE ** (log10(0.3::DOUBLE) + 0.5::DOUBLE * sqrt(-2 * ln(u0)) * cos(2 * {_PI} * u1)), 0.01::DOUBLE), band / whole) END AS drift FROM st1),
  st3 AS (SELECT *, abs(drift) * whole / {_DFHZ} AS reach FROM st2),
  st4 AS (SELECT *, CASE WHEN drift < 0 THEN least(reach + 1, 30.0) ELSE 1.0 END AS lo, CASE WHEN drift > 0 THEN greatest(31 - reach, 1.0) ELSE 30.0 END AS hi FROM st3),
  sites AS (SELECT cadence_idx, snr, drift, least(greatest(CASE WHEN hi > lo THEN floor(lo + u6 * (hi - lo)) WHEN drift < 0 THEN floor(lo) ELSE floor(hi) END, 0), 31)::BIGINT AS start_ch, abs(drift) * {_DT} + 1.0 + 9.0 * u7 AS width FROM st4)"""


@query("inj3_sample_site_params", f"WITH {_SITES} SELECT cadence_idx, snr, round(drift, 6) AS drift_hz_s, start_ch, round(width, 6) AS width_hz FROM sites")
def _(spark, d):
    s = _sites(spark, d, "linear").select("cadence_idx", "snr", "drift_hz_s", "start_ch", "width_hz")
    return rnd(s, "drift_hz_s", "width_hz")


_INJECTED = f"""{V.PIXELS}, {_SITES}, cp AS (SELECT frame AS cadence_idx, t // 3 AS obs_idx, t % 3 AS t, ch, x FROM pixels),
  no AS (SELECT cadence_idx, stddev_pop(x) AS noise FROM cp WHERE obs_idx = 0 GROUP BY 1),
  ij AS (SELECT cadence_idx, obs_idx, t, ch, x AS clean, CASE WHEN obs_idx IN (0, 2, 4) THEN x + snr * noise * exp(-0.5::DOUBLE * ((ch - (start_ch + drift * (obs_idx * 3 + t) * {_DT} / {_DFHZ})) / greatest(width / {_DFHZ} / 2.355::DOUBLE, 0.3::DOUBLE)) ** 2) ELSE x END AS x
   FROM cp JOIN sites USING (cadence_idx) JOIN no USING (cadence_idx))"""


def _inject(spark, d, kind):
    return inject.inject_track(cadence_pixels(spark, d), _sites(spark, d, kind), kind, PARAMS)


@query("inj2_inject_track", f"WITH {_INJECTED} SELECT cadence_idx, obs_idx, t, ch, round(x, 6) AS x, clean FROM ij")
def _(spark, d):
    return rnd(_inject(spark, d, "linear").drop("f_start"), "x")


for _kind in ("quadratic", "sine", "pulses"):
    def _run(spark, d, kind=_kind):
        x = _inject(spark, d, kind)
        return rnd(x.groupBy("cadence_idx", "obs_idx").agg(
            F.sum(F.col("x") - F.col("clean")).alias("added"), F.max(F.col("x") - F.col("clean")).alias("peak")), "added", "peak")
    query(f"inj2_inject_{_kind}")(_run)


@query("inj4_paired_occupancy", f"""WITH {_INJECTED}, a AS (SELECT cadence_idx, obs_idx, x - clean AS on_add, snr * noise * exp(-0.5::DOUBLE * ((ch - (start_ch + drift * (obs_idx * 3 + t) * {_DT} / {_DFHZ})) / greatest(width / {_DFHZ} / 2.355::DOUBLE, 0.3::DOUBLE)) ** 2) AS full_add
   FROM ij JOIN sites USING (cadence_idx) JOIN no USING (cadence_idx))
  SELECT 'on_only' AS occupancy, cadence_idx, round(sum(on_add), 4) AS added FROM a GROUP BY 2 UNION ALL SELECT 'persistent', cadence_idx, round(coalesce(sum(full_add) FILTER (obs_idx < 6), 0), 4) FROM a GROUP BY 2""")
def _(spark, d):
    p = inject.paired_occupancy(cadence_pixels(spark, d), _sites(spark, d, "linear"), "linear", PARAMS)
    return rnd(p.groupBy("occupancy", "cadence_idx").agg(F.sum(F.col("x") - F.col("clean")).alias("added")), "added", digits=4)


def _flat(spark, d):
    x = _inject(spark, d, "linear")
    return x.select(F.col("cadence_idx").alias("frame"), (F.col("obs_idx") * 3 + F.col("t")).alias("t"), "ch", "x", "clean")


@query("inj5_locate_footprint", f"""WITH {_INJECTED}, c AS (SELECT cadence_idx AS frame, obs_idx AS "row", ch // 4 AS col, avg(abs(x - clean)) AS v FROM ij WHERE obs_idx IN (0, 2, 4) GROUP BY 1, 2, 3),
  b AS (SELECT frame, "row", first(col ORDER BY v DESC, col) AS peak_col, max(v) AS peak FROM c GROUP BY 1, 2),
  r AS (SELECT c.frame, c."row", median(v) AS bg FROM c JOIN b ON c.frame = b.frame AND c."row" = b."row" WHERE col <> peak_col GROUP BY 1, 2)
  SELECT b.frame, b."row", peak_col, round(peak, 6) AS peak, round(coalesce(bg, 0), 6) AS bg FROM b LEFT JOIN r USING (frame, "row") WHERE coalesce(bg, 0) <= 0 OR peak >= 3 * bg""")
def _(spark, d):
    return rnd(inject.locate_footprint(_flat(spark, d), 3, 4, 8), "peak", "bg")


@query("inj6_affected_patches", f"""WITH {_INJECTED} SELECT cadence_idx AS frame, obs_idx * 8 + ch // 4 AS patch, round(max(abs(x - clean)), 6) AS max_change,
  CASE WHEN max(abs(x - clean)) > 5 THEN true WHEN max(abs(x - clean)) < 0.5 THEN false END AS affected FROM ij GROUP BY 1, 2""")
def _(spark, d):
    return rnd(inject.affected_patches(_flat(spark, d), 3, 4, 8, 5.0, 0.5), "max_change")
