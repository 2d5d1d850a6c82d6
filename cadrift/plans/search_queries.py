"""Queries over thresholds, clusters, ceilings, ON/OFF rules and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadrift.operators import scale, search, stats
from cadrift.plans import views as V
from cadrift.plans.registry import query

WIN = ["cadence_idx", "f_start"]


def rnd(df, *cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def thr_sql(src="scores", far=0.99, by="cadence_idx"):
    return f"""thr0 AS (SELECT {by}, median(score) AS median, 1.4826 * mad(score) AS mad_sigma,
      quantile_cont(score, {far}) AS far_thresh FROM {src} GROUP BY {by}),
    thr AS (SELECT *, median + 3 * mad_sigma AS thresh_3, median + 5 * mad_sigma AS thresh_5 FROM thr0)"""


def chains_sql(name, src, cond, by="cadence_idx", stride=512):
    """CTEs ``{name}_w`` (windows above the cut with a chain number) and ``{name}`` (clusters)."""
    return f"""{name}_f AS (SELECT *, CASE WHEN f_start - lag(f_start) OVER (PARTITION BY {by} ORDER BY f_start)
      <= {stride} THEN 0 ELSE 1 END AS brk FROM {src} WHERE {cond}),
    {name}_w AS (SELECT *, sum(brk) OVER (PARTITION BY {by} ORDER BY f_start) AS chain FROM {name}_f),
    {name} AS (SELECT {by}, first(f_start ORDER BY score DESC, f_start) AS f_start_peak,
      max(score) AS peak_score, avg(score) AS mean_score, count(*) AS n_snippets,
      min(f_start) AS f_start_first, max(f_start) AS f_start_last,
      max(f_start) - min(f_start) + 1024 AS cluster_width_channels
      FROM {name}_w GROUP BY {by}, chain)"""


CLUSTER_COLS = """f_start_peak, round(f_start_peak * 2.7939677238464355 / 1e6, 6) AS freq_mhz_peak,
  round(peak_score, 6) AS peak_score, round(mean_score, 6) AS mean_score, n_snippets, f_start_first,
  f_start_last, cluster_width_channels"""


def ceiling_sql(pool, key="cadence_idx", value="v", q=0.999, iters=5):
    """Unrolled rounds of the noise ceiling; ends in CTE ``ceil`` (key, n_pool, n_core, ceiling)."""
    out = [f"""r0 AS (SELECT {key}, 0.0::DOUBLE AS c, 'Infinity'::DOUBLE AS w, count(*) AS n,
      count(*) AS n_pool, false AS done FROM {pool} GROUP BY {key})"""]
    for i in range(1, iters + 1):
        p = f"r{i - 1}"
        out.append(f"""m{i} AS (SELECT p.{key}, median({value}) AS med FROM {pool} p JOIN {p} r USING ({key})
      WHERE abs({value} - r.c) <= r.w GROUP BY 1),
    s{i} AS (SELECT p.{key}, any_value(med) AS med, median(abs({value} - med)) * 1.4826 AS sg
      FROM {pool} p JOIN {p} r USING ({key}) JOIN m{i} USING ({key})
      WHERE abs({value} - r.c) <= r.w GROUP BY 1),
    n{i} AS (SELECT p.{key}, any_value(med) AS med, any_value(sg) AS sg,
      count(*) FILTER (abs({value} - med) <= 3.0 * sg) AS m FROM {pool} p JOIN s{i} USING ({key}) GROUP BY 1),
    r{i} AS (SELECT {key}, CASE WHEN stop THEN c ELSE med END AS c, CASE WHEN stop THEN w ELSE 3.0 * sg END AS w,
      CASE WHEN stop THEN n ELSE m END AS n, n_pool, stop AS done FROM (
      SELECT r.*, med, sg, m, (done OR sg = 0 OR m = n) AS stop FROM {p} r JOIN n{i} USING ({key})))""")
    out.append(f"""ceil AS (SELECT p.{key}, any_value(n_pool) AS n_pool, count(*) AS n_core,
      quantile_cont({value}, {q}) AS ceiling FROM {pool} p JOIN r{iters} r USING ({key})
      WHERE abs({value} - r.c) <= r.w GROUP BY 1)""")
    return ",\n".join(out)


OFF_POOL = "pool AS (SELECT cadence_idx, v FROM cells WHERE obs_idx IN (1, 3, 5))"
PEAKS = """rp AS (SELECT cadence_idx, f_start, """ + ", ".join(
    f"max(m) FILTER (obs_idx = {i}) AS r{i}" for i in range(6)) + """ FROM (
  SELECT *, list_max(cells) AS m FROM map_rows) GROUP BY 1, 2)"""


def hits_sql(thr, src="rp"):
    ref = "coalesce(least(r0, r2, r4), 0.0)"
    on = " + ".join(f"coalesce((r{i} > {thr})::INT, 0)" for i in (0, 2, 4))
    off = " + ".join(f"coalesce((r{i} > {thr} AND r{i} >= 0.3 * {ref})::INT, 0)" for i in (1, 3, 5))
    return f"""SELECT *, n_off_hits_full >= 2 AS off_leak, n_on_hits_full >= 2 AND n_off_hits_full < 2 AS in_short_list
      FROM (SELECT *, ({on})::BIGINT AS n_on_hits_full, ({off})::BIGINT AS n_off_hits_full FROM {src})"""


def contrast_sql(thr, name="oo", src="cells"):
    return f"""{name}_c AS (SELECT cadence_idx, f_start, col, max(v) AS mv FROM {src} GROUP BY ALL),
    {name}_p AS (SELECT cadence_idx, f_start, first(col ORDER BY mv DESC, col) AS pc FROM {name}_c GROUP BY ALL),
    {name}_r AS (SELECT cadence_idx, f_start, obs_idx, max(v) AS m FROM {src} JOIN {name}_p USING (cadence_idx, f_start)
      WHERE col BETWEEN pc - 3 AND pc + 3 GROUP BY ALL),
    {name}_a AS (SELECT cadence_idx, f_start, coalesce(avg(m) FILTER (obs_idx % 2 = 0), 0.0) AS on_mean,
      coalesce(avg(m) FILTER (obs_idx % 2 = 1), 0.0) AS off_mean,
      count(*) FILTER (obs_idx % 2 = 0 AND m > {thr}) AS n_on_hits,
      count(*) FILTER (obs_idx % 2 = 1 AND m > {thr}) AS n_off_hits
      FROM {name}_r {"" if isinstance(thr, float) else "JOIN ceilings USING (cadence_idx)"} GROUP BY ALL),
    {name} AS (SELECT *, on_mean / greatest(off_mean, 1e-8) AS on_off_contrast FROM {name}_a)"""


@query("agg1_robust_stats", f"""SELECT l_suppkey AS cadence_idx, round(median(l_extendedprice), 6) AS median,
  round(1.4826 * mad(l_extendedprice), 6) AS mad_sigma FROM lineitem GROUP BY 1""")
def _(spark, d):
    return rnd(scale.robust_stats(V.plain_scores(spark, d), ["cadence_idx"], "score"), "median", "mad_sigma")


@query("agg2_off_noise_ceiling", f"""WITH {V.CELLS}, {OFF_POOL}, {ceiling_sql("pool")}
  SELECT cadence_idx, n_pool, n_core, round(ceiling, 6) AS ceiling FROM ceil""")
def _(spark, d):
    pool = search.off_cells(V.map_rows(spark, d))
    return rnd(stats.off_noise_ceiling(pool, ["cadence_idx"], "v"), "ceiling")


@query("cnd1_thresholds", f"""WITH scores AS (SELECT l_suppkey AS cadence_idx, l_returnflag AS method,
    l_extendedprice AS score FROM lineitem), {thr_sql(by="cadence_idx, method")}
  SELECT cadence_idx, method, round(any_value(median), 6) AS median, round(any_value(mad_sigma), 6) AS mad_sigma,
   round(any_value(thresh_3), 6) AS thresh_3, round(any_value(thresh_5), 6) AS thresh_5,
   round(any_value(far_thresh), 6) AS far_thresh, count(*) AS n, count(*) FILTER (score > thresh_3) AS n_3s,
   count(*) FILTER (score > thresh_5) AS n_5s, count(*) FILTER (score > far_thresh) AS n_far
  FROM scores JOIN thr USING (cadence_idx, method) GROUP BY 1, 2""")
def _(spark, d):
    t = search.thresholds(V.plain_scores(spark, d), ["cadence_idx", "method"])
    return rnd(t, "median", "mad_sigma", "thresh_3", "thresh_5", "far_thresh")


def _clusters(spark, d, far):
    s = V.scores(spark, d)
    largest = V.largest_cadence(spark, d)
    cut = scale.exact_quantiles(V.plain_scores(spark, d), ["cadence_idx"], "score", {"far_thresh": far},
                                largest=largest)
    s = s.join(cut, "cadence_idx")
    return s, search.cluster_candidates(s, ["cadence_idx"], F.col("score") > F.col("far_thresh"),
                                        V.STRIDE, V.FCHANS, V.DF_HZ, largest)


_ABOVE = "(SELECT s.* FROM scores s JOIN thr USING (cadence_idx) WHERE score > far_thresh)"


@query("cnd2_cluster_candidates", f"""WITH {V.SCORES}, {thr_sql(far=0.9)}, {chains_sql("cl", _ABOVE, "true")}
  SELECT cadence_idx, {CLUSTER_COLS} FROM cl""")
def _(spark, d):
    return rnd(_clusters(spark, d, 0.9)[1], "freq_mhz_peak", "peak_score", "mean_score")


@query("cnd3_n_clusters", f"""WITH {V.SCORES}, {thr_sql(far=0.9)}, {chains_sql("cl", _ABOVE, "true")}
  SELECT cadence_idx, count(*) AS n_clusters FROM cl GROUP BY 1""")
def _(spark, d):
    s, _c = _clusters(spark, d, 0.9)
    return search.n_clusters(s, ["cadence_idx"], F.col("score") > F.col("far_thresh"), V.STRIDE,
                             largest=V.largest_cadence(spark, d))


PROBE = """probe_w AS (SELECT cadence_idx, f_start FROM (SELECT DISTINCT cadence_idx, f_start FROM map_rows)
  QUALIFY row_number() OVER (PARTITION BY cadence_idx ORDER BY md5('0|' || cadence_idx || '|' || f_start), f_start) <= {n}),
 probe AS (SELECT cadence_idx, v FROM cells SEMI JOIN probe_w USING (cadence_idx, f_start) WHERE obs_idx IN (1, 3, 5))"""


@query("cnd4_background_probe", f"""WITH {V.CELLS}, {PROBE.format(n=5)}
  SELECT cadence_idx, count(*) AS n_cells, round(sum(v), 6) AS total, round(max(v), 6) AS top FROM probe GROUP BY 1""")
def _(spark, d):
    m = V.map_rows(spark, d)
    p = search.background_probe(m.select(*WIN).distinct(), m, 5)
    return p.groupBy("cadence_idx").agg(F.count("*").alias("n_cells"), F.round(F.sum("v"), 6).alias("total"),
                                        F.round(F.max("v"), 6).alias("top"))


_CEILS = f"""{OFF_POOL}, {ceiling_sql("pool")}, {thr_sql("map_scores")},
  ceilings AS (SELECT cadence_idx, n_pool, CASE WHEN n_pool >= 30 THEN ceiling END AS raw_ceiling, thresh_5, far_thresh,
   CASE WHEN n_pool >= 30 THEN greatest(ceiling, thresh_5) ELSE thresh_5 END AS off_ceiling
   FROM thr LEFT JOIN ceil USING (cadence_idx))"""


def _ceilings(spark, d):
    m = V.map_rows(spark, d)
    thr = search.threshold_values(V.map_scores(spark, d), ["cadence_idx"])
    return m, thr, search.off_ceiling(search.off_cells(m), thr)


@query("cnd5_off_ceiling", f"""WITH {V.MAP_SCORES}, {_CEILS} SELECT cadence_idx, n_pool,
  round(raw_ceiling, 6) AS raw_ceiling, round(thresh_5, 6) AS thresh_5, round(off_ceiling, 6) AS off_ceiling FROM ceilings""")
def _(spark, d):
    return rnd(_ceilings(spark, d)[2], "raw_ceiling", "thresh_5", "off_ceiling")


@query("cnd6_on_off_contrast", f"""WITH {V.CELLS}, {contrast_sql(0.3)} SELECT cadence_idx, f_start,
  round(on_off_contrast, 6) AS on_off_contrast, round(on_mean, 6) AS on_mean, round(off_mean, 6) AS off_mean,
  n_on_hits, n_off_hits FROM oo""")
def _(spark, d):
    m = V.map_rows(spark, d).withColumn("thr", F.lit(0.3))
    return rnd(search.on_off_contrast(m, WIN, thr="thr"), "on_off_contrast", "on_mean", "off_mean")


@query("cnd7_full_row_hits", f"""WITH {V.MAP_ROWS}, {PEAKS} SELECT cadence_idx, f_start, n_on_hits_full, n_off_hits_full,
  off_leak, in_short_list FROM ({hits_sql(0.3)})""")
def _(spark, d):
    p = search.row_peaks(V.map_rows(spark, d), WIN)
    return search.full_row_hits(p, F.lit(0.3)).drop(*[f"r{i}" for i in range(6)])


_LEAK = ", ".join(f"CASE WHEN r{i} > 0.3 AND r{i} >= 0.3 * coalesce(least(r0, r2, r4), 0.0) THEN {i} END" for i in (1, 3, 5))


@query("cnd8_leaking_rows", f"""WITH {V.MAP_ROWS}, {PEAKS}, a AS (SELECT *,
   coalesce(list_avg([r0, r2, r4]), 0.0) AS om, coalesce(list_avg([r1, r3, r5]), 0.0) AS fm FROM rp)
  SELECT cadence_idx, f_start, list_filter([{_LEAK}], lambda x: x IS NOT NULL)::BIGINT[] AS leaking,
   round(CASE WHEN fm > 0 THEN om / fm ELSE 1e300 END, 6) AS on_off_ratio FROM a""")
def _(spark, d):
    p = search.leaking_rows(search.row_peaks(V.map_rows(spark, d), WIN), F.lit(0.3))
    return p.select(*WIN, "leaking", F.round(F.least("on_off_ratio", F.lit(1e300)), 6).alias("on_off_ratio"))


@query("cnd9_row_breakdown", f"""WITH {V.MAP_ROWS} SELECT cadence_idx, f_start, obs_idx,
  CASE WHEN obs_idx % 2 = 0 THEN 'ON' ELSE 'OFF' END AS kind, list_max(cells) AS peak,
  (list_position(cells, list_max(cells)) - 1)::BIGINT AS col, list_max(cells) > 0.3 AS hit FROM map_rows""")
def _(spark, d):
    return search.row_breakdown(V.map_rows(spark, d), F.lit(0.3))


@query("cnd9_nearest_windows", f"""WITH {V.MAP_ROWS}, s AS (SELECT DISTINCT cadence_idx, f_start FROM map_rows),
  w AS (SELECT cadence_idx, max(f_start) // 2 + 100 AS wanted FROM s GROUP BY 1)
  SELECT cadence_idx, wanted, f_start, row_number() OVER (PARTITION BY cadence_idx, wanted
    ORDER BY abs(f_start - wanted), f_start) AS rank FROM s JOIN w USING (cadence_idx) QUALIFY rank <= 5""")
def _(spark, d):
    s = V.map_rows(spark, d).select(*WIN)
    w = s.groupBy("cadence_idx").agg((F.floor(F.max("f_start") / 2) + 100).alias("f_start"))
    return search.nearest_windows(s, w, 5).withColumn("rank", F.col("rank").cast("long"))


@query("cnd10_shortlist_rank", f"""WITH {V.SCORES}, {thr_sql(far=0.99)}, {chains_sql("cl", _ABOVE, "true")}
  SELECT cadence_idx, {CLUSTER_COLS}, row_number() OVER (PARTITION BY cadence_idx
    ORDER BY peak_score DESC, f_start_peak) AS rank FROM cl QUALIFY rank <= 30""")
def _(spark, d):
    c = search.shortlist_rank(_clusters(spark, d, 0.99)[1], ["cadence_idx"], 30)
    return rnd(c.withColumn("rank", F.col("rank").cast("long")), "freq_mhz_peak", "peak_score", "mean_score")


@query("cnd11_nth_candidate", f"""WITH {V.SCORES}, {thr_sql(far=0.99)}, {chains_sql("cl", _ABOVE, "true")}
  SELECT cadence_idx, {CLUSTER_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY cadence_idx
    ORDER BY peak_score DESC, f_start_peak) AS rank FROM cl) WHERE rank = 3""")
def _(spark, d):
    c = search.nth_candidate(_clusters(spark, d, 0.99)[1], ["cadence_idx"], 3).drop("rank")
    return rnd(c, "freq_mhz_peak", "peak_score", "mean_score")


@query("cnd12_sigma_of", f"""WITH {V.SCORES}, {thr_sql()} SELECT cadence_idx, f_start,
  round(CASE WHEN mad_sigma = 0 THEN 0.0 ELSE (score - median) / mad_sigma END, 6) AS sigma
  FROM scores JOIN thr USING (cadence_idx)""")
def _(spark, d):
    st = scale.robust_stats(V.plain_scores(spark, d), ["cadence_idx"], "score")
    s = V.scores(spark, d).join(st, "cadence_idx")
    return s.select(*WIN, F.round(search.sigma_of(F.col("score"), F.col("median"), F.col("mad_sigma")), 6).alias("sigma"))


@query("cnd13_fp_breakdown", f"""WITH scores AS (SELECT l_suppkey AS cadence_idx, l_quantity * l_quantity AS score FROM lineitem),
  {thr_sql()}, g AS (SELECT median(score) AS gm, 1.4826 * mad(score) AS gs FROM scores)
  SELECT cadence_idx, round(median, 6) AS median, round(mad_sigma, 6) AS mad_sigma, count(*) AS n,
   count(*) FILTER (score > thresh_3) AS n_3s_local, count(*) FILTER (score > thresh_5) AS n_5s_local,
   count(*) FILTER (score > gm + 3 * gs) AS n_3s_global, count(*) FILTER (score > gm + 5 * gs) AS n_5s_global
  FROM scores JOIN thr USING (cadence_idx), g GROUP BY ALL""")
def _(spark, d):
    s = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("cadence_idx"),
                                             (F.col("l_quantity") * F.col("l_quantity")).alias("score"))
    return rnd(search.fp_breakdown(s), "median", "mad_sigma")


@query("cnd14_sigma_sweep", """WITH s AS (SELECT value AS score FROM events), t AS (SELECT median(score) AS m,
   1.4826 * mad(score) AS sg, count(*) AS n FROM s), k AS (SELECT unnest(range(1, 501)) AS k)
  SELECT k, count(score) AS n_above, round(count(score) / any_value(n) * 100, 6) AS pct
  FROM k JOIN t ON true LEFT JOIN s ON score > m + k * sg GROUP BY k""")
def _(spark, d):
    s = V.table(spark, d, "events").select(F.col("value").alias("score"))
    return rnd(search.sigma_sweep(s), "pct")


_RATIO = f"""e AS (SELECT cadence_idx, f_start, col, sum(abs(v)) AS e, sum(v * v) FILTER (obs_idx % 2 = 0) AS son,
   count(*) FILTER (obs_idx % 2 = 0) AS non, sum(v * v) FILTER (obs_idx % 2 = 1) AS soff,
   count(*) FILTER (obs_idx % 2 = 1) AS noff FROM cells GROUP BY ALL),
  b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY cadence_idx, f_start ORDER BY e DESC, col) <= 5),
  ratios AS (SELECT cadence_idx, f_start, list(col ORDER BY col)::BIGINT[] AS peak_cols,
   (sum(son) / sum(non)) / (sum(soff) / sum(noff) + 1e-10) AS ratio FROM b GROUP BY ALL)"""


@query("cnd15_peak_column_ratio", f"""WITH {V.CELLS}, {_RATIO} SELECT cadence_idx, f_start, peak_cols,
  round(ratio, 6) AS ratio FROM ratios""")
def _(spark, d):
    return rnd(search.peak_column_ratio(V.map_rows(spark, d), WIN), "ratio")


@query("cnd15_ratio_cuts", f"""WITH {V.CELLS}, {_RATIO}, c AS (SELECT unnest([1.5, 2.0, 3.0, 4.0, 5.0, 8.0, 10.0])::DOUBLE AS r_cut)
  SELECT r_cut, count(*) FILTER (ratio > r_cut) AS n_survive, count(*) FILTER (NOT ratio > r_cut) AS n_rejected,
   round(avg((NOT ratio > r_cut)::INT) * 100, 6) AS pct_rejected FROM ratios, c GROUP BY 1""")
def _(spark, d):
    r = search.peak_column_ratio(V.map_rows(spark, d), WIN)
    return rnd(search.ratio_cuts(r, [1.5, 2.0, 3.0, 4.0, 5.0, 8.0, 10.0]), "pct_rejected")


_REG = """regime_in AS (SELECT l_suppkey AS cadence_idx, quantile_cont(l_extendedprice, 0.99) AS far_thresh,
   quantile_cont(l_extendedprice, 0.97) FILTER (l_returnflag = 'A') AS probe_ceiling,
   quantile_cont(l_extendedprice, 0.98) AS pooled_ceiling,
   median(l_extendedprice) + 5 * 0.25 * mad(l_extendedprice) * 1.4826 AS thresh_5 FROM lineitem GROUP BY 1),
  regime AS (SELECT *, greatest(probe_ceiling, thresh_5) AS off_ceiling, greatest(pooled_ceiling, thresh_5) AS off_ceiling_pooled FROM regime_in)"""


def _regime_in(spark, d):
    s = V.plain_scores(spark, d)
    key = ["cadence_idx"]
    q = scale.exact_quantiles(s, key, "score", {"far_thresh": 0.99, "pooled_ceiling": 0.98})
    p = scale.exact_quantiles(s.filter("method = 'A'"), key, "score", {"probe_ceiling": 0.97})
    r = scale.robust_stats(s, key, "score")
    return q.join(p, key, "left").join(r, key).select(
        *key, "far_thresh", "probe_ceiling", "pooled_ceiling",
        (F.col("median") + 5 * 0.25 * F.col("mad_sigma")).alias("thresh_5"))


@query("cnd16_threshold_regime", f"""WITH {_REG} SELECT cadence_idx, round(far_thresh / off_ceiling, 6) AS far_over_ceiling,
  CASE WHEN far_thresh / off_ceiling > 1 THEN 'far' ELSE 'ceiling' END AS binding_cut,
  CASE WHEN thresh_5 > probe_ceiling THEN 'thresh_5' ELSE 'noise' END AS ceiling_term,
  round(pooled_ceiling / probe_ceiling, 6) AS pool_inflation,
  (far_thresh / off_ceiling > 1) <> (far_thresh > off_ceiling_pooled) AS flips FROM regime""")
def _(spark, d):
    t = search.threshold_regime(_regime_in(spark, d)).select(
        "cadence_idx", "far_over_ceiling", "binding_cut", "ceiling_term", "pool_inflation", "flips")
    return rnd(t, "far_over_ceiling", "pool_inflation")


@query("cnd16_regime_percentiles", f"""WITH {_REG}, r AS (SELECT far_thresh / off_ceiling AS x FROM regime)
  SELECT round(min(x), 6) AS lo, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS p50,
   round(quantile_cont(x, 0.75), 6) AS p75, round(quantile_cont(x, 0.9), 6) AS p90, round(max(x), 6) AS hi,
   count(*) FILTER (x > 2.0) AS n_severe FROM r""")
def _(spark, d):
    t = search.threshold_regime(_regime_in(spark, d)).select("far_over_ceiling")
    q = scale.exact_quantiles(t, [], "far_over_ceiling",
                              {"lo": 0.0, "p25": .25, "p50": .5, "p75": .75, "p90": .9, "hi": 1.0})
    n = t.agg(F.count_if(F.col("far_over_ceiling") > 2.0).alias("n_severe"))
    return rnd(scale.attach(q, n, []), "lo", "p25", "p50", "p75", "p90", "hi")


_MEASURED = "measured AS (SELECT l_suppkey AS cadence_idx, quantile_cont(l_extendedprice, 0.985) AS off_ceiling FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' GROUP BY 1)"


def _measured(spark, d):
    li = V.table(spark, d, "lineitem").filter("l_returnflag = 'A' AND l_linestatus = 'F'")
    return scale.exact_quantiles(li.select(F.col("l_suppkey").alias("cadence_idx"), F.col("l_extendedprice").alias("score")),
                                 ["cadence_idx"], "score", {"off_ceiling": 0.985})


@query("join1_attach_thresholds", f"""WITH {V.SCORES}, {thr_sql()} SELECT cadence_idx, f_start, score > thresh_3 AS over_3s,
  score > far_thresh AS over_far FROM scores JOIN thr USING (cadence_idx)""")
def _(spark, d):
    t = search.threshold_values(V.plain_scores(spark, d), ["cadence_idx"])
    return V.scores(spark, d).join(t, "cadence_idx").select(
        *WIN, (F.col("score") > F.col("thresh_3")).alias("over_3s"), (F.col("score") > F.col("far_thresh")).alias("over_far"))


_FALLBACK = f"""{_MEASURED}, half AS (SELECT * FROM measured WHERE cadence_idx % 2 = 0),
  cf AS (SELECT thr.*, coalesce(h.off_ceiling, thresh_5) AS off_ceiling,
   CASE WHEN h.off_ceiling IS NOT NULL THEN 'measured' ELSE 'thresh_5 (assumed)' END AS ceiling_source
   FROM thr LEFT JOIN half h USING (cadence_idx))"""


def _fallback(spark, d, far=0.99):
    t = search.threshold_values(V.plain_scores(spark, d), ["cadence_idx"], far)
    return search.ceiling_with_fallback(t, _measured(spark, d).filter("cadence_idx % 2 = 0"))


@query("join2_ceiling_with_fallback", f"""WITH {V.SCORES}, {thr_sql()}, {_FALLBACK}
  SELECT cadence_idx, round(off_ceiling, 6) AS off_ceiling, ceiling_source FROM cf""")
def _(spark, d):
    return rnd(_fallback(spark, d).select("cadence_idx", "off_ceiling", "ceiling_source"), "off_ceiling")


_NEWCUT = "(SELECT s.* FROM scores s JOIN cf USING (cadence_idx) WHERE score > least(far_thresh, off_ceiling))"
_OLDCUT = "(SELECT s.* FROM scores s JOIN cf USING (cadence_idx) WHERE score > far_thresh)"


@query("cnd17_candidate_volume", f"""WITH {V.SCORES}, {thr_sql()}, {_FALLBACK}, {chains_sql("co", _OLDCUT, "true")},
  {chains_sql("cn", _NEWCUT, "true")}, o AS (SELECT cadence_idx, count(*) AS n FROM co GROUP BY 1),
  w AS (SELECT cadence_idx, count(*) AS n FROM cn GROUP BY 1)
  SELECT cadence_idx, ceiling_source, round(far_thresh, 6) AS far_thresh, round(off_ceiling, 6) AS off_ceiling,
   round(far_thresh / off_ceiling, 6) AS far_over_ceiling, coalesce(o.n, 0) AS n_clusters_now,
   coalesce(w.n, 0) AS n_clusters_new, round(coalesce(w.n, 0) / greatest(coalesce(o.n, 0), 1), 6) AS cluster_multiplier
  FROM cf LEFT JOIN o USING (cadence_idx) LEFT JOIN w USING (cadence_idx)""")
def _(spark, d):
    v = search.candidate_volume(V.scores(spark, d), _fallback(spark, d), V.STRIDE, V.largest_cadence(spark, d))
    return rnd(v, "far_thresh", "off_ceiling", "far_over_ceiling", "cluster_multiplier")


_MAPCL = chains_sql("cl", "(SELECT s.* FROM map_scores s JOIN thr USING (cadence_idx) WHERE score > far_thresh)", "true")


def _map_clusters(spark, d, far):
    s = V.map_scores(spark, d)
    largest = scale.largest_group(s, ["cadence_idx"])
    t = search.threshold_values(s, ["cadence_idx"], far, largest)
    s = s.join(t, "cadence_idx")
    return s, search.cluster_candidates(s, ["cadence_idx"], F.col("score") > F.col("far_thresh"), V.STRIDE,
                                        V.FCHANS, largest=largest)


_RETAIN = """saved AS (SELECT cadence_idx, f_start FROM map_scores JOIN (SELECT cadence_idx, quantile_cont(score, 0.8) AS q
   FROM map_scores GROUP BY 1) USING (cadence_idx) WHERE score >= q)"""


def retained(spark, d, q):
    s = V.map_scores(spark, d)
    c = scale.exact_quantiles(s, ["cadence_idx"], "score", {"map_thresh": q})
    return s.join(c, "cadence_idx").filter("score >= map_thresh"), c


@query("join3_map_coverage", f"""WITH {V.MAP_SCORES}, {thr_sql("map_scores", 0.6)}, {_MAPCL}, {_RETAIN}
  SELECT cl.cadence_idx, count(*) AS n, count(s.f_start) AS n_covered, count(*) FILTER (s.f_start IS NULL) AS n_uncovered
  FROM cl LEFT JOIN saved s ON cl.cadence_idx = s.cadence_idx AND cl.f_start_peak = s.f_start GROUP BY 1""")
def _(spark, d):
    return search.map_coverage(_map_clusters(spark, d, 0.6)[1], retained(spark, d, 0.8)[0], ["cadence_idx"])


@query("cnd18_review_load", f"""WITH {V.MAP_SCORES}, {thr_sql("map_scores", 0.7)}, {_RETAIN}, {PEAKS},
  mt AS (SELECT cadence_idx, quantile_cont(score, 0.8) AS map_thresh, quantile_cont(score, 0.5) AS off_ceiling FROM map_scores GROUP BY 1),
  cf AS (SELECT cadence_idx, far_thresh, off_ceiling, map_thresh FROM thr JOIN mt USING (cadence_idx)),
  {chains_sql("co", _OLDCUT.replace("scores s", "map_scores s"), "true")},
  {chains_sql("cn", _NEWCUT.replace("scores s", "map_scores s"), "true")},
  j AS ({hits_sql("off_ceiling", "(SELECT * FROM rp SEMI JOIN saved USING (cadence_idx, f_start) JOIN cf USING (cadence_idx))")}),
  o AS (SELECT cadence_idx, count(*) AS n_old FROM co GROUP BY 1),
  l AS (SELECT cn.cadence_idx, count(*) AS n_new, count(in_short_list) AS n_covered,
   count(*) FILTER (in_short_list IS NULL) AS n_uncovered, count(*) FILTER (in_short_list) AS n_short_list_covered
   FROM cn LEFT JOIN j ON cn.cadence_idx = j.cadence_idx AND cn.f_start_peak = j.f_start GROUP BY 1)
  SELECT cadence_idx, coalesce(n_old, 0) AS n_old, coalesce(n_new, 0) AS n_new, coalesce(n_covered, 0) AS n_covered,
   coalesce(n_uncovered, 0) AS n_uncovered, round(n_covered / n_new, 6) AS coverage_frac,
   coalesce(n_short_list_covered, 0) AS n_short_list_covered,
   CASE WHEN n_new > 0 THEN least(far_thresh, off_ceiling) < map_thresh END AS below_map_thresh
  FROM cf LEFT JOIN o USING (cadence_idx) LEFT JOIN l USING (cadence_idx)""")
def _(spark, d):
    s = V.map_scores(spark, d)
    t = search.threshold_values(s, ["cadence_idx"], 0.7).select("cadence_idx", "far_thresh")
    kept, _c = retained(spark, d, 0.8)
    c = scale.exact_quantiles(s, ["cadence_idx"], "score", {"map_thresh": 0.8, "off_ceiling": 0.5})
    saved = V.map_rows(spark, d).join(kept.select(*WIN), WIN, "left_semi")
    out = search.review_load(s, t.join(c, "cadence_idx"), saved, V.STRIDE, V.FCHANS,
                             scale.largest_group(s, ["cadence_idx"]))
    return rnd(out, "coverage_frac")


@query("cnd19_percentile_candidates", f"""WITH {V.SCORES}, {thr_sql(far=0.995)}, {chains_sql("cl", _ABOVE, "true", stride=4096)}
  SELECT cadence_idx, {CLUSTER_COLS.replace("round(f_start_peak * 2.7939677238464355 / 1e6, 6)", "0.0::DOUBLE")} FROM cl""")
def _(spark, d):
    s = search.percentile_candidates(V.scores(spark, d), ["cadence_idx"], 99.5, 8 * V.STRIDE)
    return rnd(s, "peak_score", "mean_score")


@query("cnd20_run_search", f"""WITH {V.MAP_SCORES}, {thr_sql("map_scores", 0.6)}, {_MAPCL}, {PROBE.format(n=4)},
  pk AS (SELECT cadence_idx, f_start_peak AS f_start FROM cl),
  pool AS (SELECT cadence_idx, v FROM cells SEMI JOIN pk USING (cadence_idx, f_start) WHERE obs_idx IN (1, 3, 5)
   UNION ALL SELECT * FROM probe), {ceiling_sql("pool")},
  ceilings AS (SELECT cadence_idx, CASE WHEN n_pool >= 30 THEN greatest(ceiling, thresh_5) ELSE thresh_5 END AS off_ceiling
   FROM thr LEFT JOIN ceil USING (cadence_idx)),
  {contrast_sql("off_ceiling")}, {PEAKS},
  j AS ({hits_sql("off_ceiling", "(SELECT * FROM rp JOIN ceilings USING (cadence_idx))")}),
  res AS (SELECT cl.cadence_idx, f_start_peak, peak_score, n_snippets, cluster_width_channels, off_ceiling,
   on_off_contrast, n_on_hits, n_off_hits, n_on_hits_full, n_off_hits_full, off_leak, in_short_list
   FROM cl JOIN oo ON cl.cadence_idx = oo.cadence_idx AND f_start_peak = oo.f_start
   JOIN j ON cl.cadence_idx = j.cadence_idx AND f_start_peak = j.f_start)
  SELECT * REPLACE (round(peak_score, 6) AS peak_score, round(off_ceiling, 6) AS off_ceiling,
   round(on_off_contrast, 6) AS on_off_contrast), CASE WHEN in_short_list THEN row_number() OVER (
   PARTITION BY cadence_idx, in_short_list ORDER BY on_off_contrast DESC, f_start_peak) END AS short_rank FROM res""")
def _(spark, d):
    out = search.run_search(V.map_scores(spark, d), V.map_rows(spark, d), stride=V.STRIDE, fchans=V.FCHANS,
                            far=0.6, probe=4)
    return rnd(out.select("cadence_idx", "f_start_peak", "peak_score", "n_snippets", "cluster_width_channels",
                          "off_ceiling", "on_off_contrast", "n_on_hits", "n_off_hits", "n_on_hits_full",
                          "n_off_hits_full", "off_leak", "in_short_list", "short_rank"),
               "peak_score", "off_ceiling", "on_off_contrast")
