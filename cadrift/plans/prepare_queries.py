"""Queries over frames: baselines, standardisation, patches, windows and frame statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadrift.operators import kernels, prepare, scale, scoring, stats
from cadrift.plans import views as V
from cadrift.plans.registry import query
from cadrift.plans.search_queries import rnd


def _px(spark, d):
    return V.pixels(spark, d)


@query("prj10_downsample", f"""WITH {V.PIXELS} SELECT frame, t, ch // 5 AS ch, round(avg(x), 6) AS x FROM pixels WHERE ch < 30 GROUP BY 1, 2, 3""")
def _(spark, d):
    return rnd(prepare.downsample(_px(spark, d), 5, 32), "x")


@query("prj10_downsample_array", """WITH e AS (SELECT vec_id, unnest(range(12)) AS g FROM embeddings)
  SELECT vec_id, g, round((SELECT avg(v::DOUBLE) FROM (SELECT unnest(embedding[g * 5 + 1:g * 5 + 5]) AS v)), 6) AS x
  FROM e JOIN embeddings USING (vec_id)""")
def _(spark, d):
    v = V.vectors(spark, d).select(F.col("id").alias("vec_id"), prepare.downsample_array(F.col("vec"), 5).alias("a"))
    return v.select("vec_id", F.posexplode("a").alias("g", "x")).select(
        "vec_id", F.col("g").cast("long").alias("g"), F.round("x", 6).alias("x"))


_CORE = """lx AS (SELECT frame, t, ch, ln(1 + greatest(x - 10, 0)) AS y FROM pixels),
  lm AS (SELECT frame, median(y) AS med, mad(y) AS md FROM lx GROUP BY 1)"""


@query("prj14_core_transform", f"""WITH {V.PIXELS}, {_CORE} SELECT frame, t, ch, round((y - med) / (md + 1e-6::DOUBLE), 6) AS x FROM lx JOIN lm USING (frame)""")
def _(spark, d):
    px = _px(spark, d).withColumn("x", F.col("x") - 10)
    return rnd(prepare.core_transform(px, ["frame"]), "x")


_CM = "cm AS (SELECT frame, ch, median(x) AS m FROM pixels GROUP BY 1, 2)"


@query("prj15_bandpass_median", f"""WITH {V.PIXELS}, {_CM}, fl AS (SELECT frame, max(m) * 1e-4::DOUBLE + 1e-10::DOUBLE AS f FROM cm GROUP BY 1)
  SELECT frame, t, ch, round(x / greatest(m, f), 6) AS x FROM pixels JOIN cm USING (frame, ch) JOIN fl USING (frame)""")
def _(spark, d):
    return rnd(prepare.bandpass_median(_px(spark, d)), "x")


def poly1_sql():
    out = [f"""pc0 AS (SELECT frame, ch, m, -1.0::DOUBLE + 2.0::DOUBLE * ch / 31 AS u, true AS keep FROM cm),
  pf0 AS (SELECT frame, regr_slope(m, u) AS b, regr_intercept(m, u) AS a, true AS live FROM pc0 GROUP BY 1)"""]
    for i in (1, 2, 3):
        j = i - 1
        out.append(f"""ps{i} AS (SELECT frame, stddev_pop(m - (a + b * u)) FILTER (keep) AS sg FROM pc{j} JOIN pf{j} USING (frame) GROUP BY 1),
  pc{i} AS (SELECT frame, ch, m, u, CASE WHEN live AND sg > 0 THEN abs(m - (a + b * u)) <= 3.0 * sg ELSE keep END AS keep
    FROM pc{j} JOIN pf{j} USING (frame) JOIN ps{i} USING (frame)),
  pg{i} AS (SELECT frame, regr_slope(m, u) FILTER (keep) AS b2, regr_intercept(m, u) FILTER (keep) AS a2, count(*) FILTER (keep) AS n FROM pc{i} GROUP BY 1),
  pf{i} AS (SELECT frame, CASE WHEN live AND sg > 0 AND n >= 2 THEN b2 ELSE b END AS b, CASE WHEN live AND sg > 0 AND n >= 2 THEN a2 ELSE a END AS a,
    live AND sg > 0 AND n >= 2 AS live FROM pf{j} JOIN ps{i} USING (frame) JOIN pg{i} USING (frame))""")
    return ",\n".join(out)


@query("prj16_bandpass_linear", f"""WITH {V.PIXELS}, {_CM}, {poly1_sql()} SELECT frame, ch, m, round(a + b * u, 6) AS b FROM pc3 JOIN pf3 USING (frame)""")
def _(spark, d):
    b = prepare.polynomial_baseline(prepare.channel_medians(_px(spark, d)), 32, degree=1)
    return rnd(b, "b")


@query("prj16_bandpass_polynomial")
def _(spark, d):
    px = _px(spark, d)
    base = prepare.polynomial_baseline(prepare.channel_medians(px), 32, degree=3)
    return rnd(prepare.divide_by_baseline(px, base.select("frame", "ch", "b")), "x")


@query("prj19_patch_grid", f"""WITH {V.PIXELS} SELECT frame, t, ch, x, (t // 4) * 4 + ch // 8 AS patch, t % 4 AS pt, ch % 8 AS pc FROM pixels""")
def _(spark, d):
    return prepare.patch_index(_px(spark, d), 4, 8, 4)


@query("prj19_patch_round_trip", f"WITH {V.PIXELS} SELECT frame, t, ch, x FROM pixels")
def _(spark, d):
    return prepare.unpatch(prepare.patch_index(_px(spark, d), 4, 8, 4).drop("t", "ch"), 4, 8, 4)


@query("prj20_block_pool", f"""WITH {V.PIXELS} SELECT frame, (t // 4) * 4 + ch // 8 AS patch, round(avg(x), 6) AS v, max(x) AS top FROM pixels GROUP BY 1, 2""")
def _(spark, d):
    px = _px(spark, d)
    top = prepare.block_pool(px, 4, 8, 4, "max").withColumnRenamed("v", "top")
    return rnd(prepare.block_pool(px, 4, 8, 4).join(top, ["frame", "patch"]), "v")


_NU = "(1500.0::DOUBLE - ch * 10.0)"
_DED = f"""dm AS (SELECT unnest([0.0, 50.0, 200.0])::DOUBLE AS dm), nt AS (SELECT frame, max(t) + 1 AS nt FROM pixels GROUP BY 1),
  sh AS (SELECT frame, dm, x, (((t - round_even(4148.808::DOUBLE * dm * ({_NU} ** -2 - 1500.0::DOUBLE ** -2) / 0.004::DOUBLE, 0)::BIGINT) % nt) + nt) % nt AS t
   FROM pixels JOIN nt USING (frame), dm), ded AS (SELECT frame, dm, t, avg(x) AS y FROM sh GROUP BY 1, 2, 3)"""


@query("prj21_dedisperse", f"WITH {V.PIXELS}, {_DED} SELECT frame, dm, t, round(y, 6) AS y FROM ded")
def _(spark, d):
    return rnd(prepare.dedisperse(_px(spark, d), [0, 50, 200], 1500.0 - F.col("ch") * 10.0, 1500.0, 0.004), "y")


@query("scr23_transient_snr", f"""WITH {V.PIXELS}, {_DED}, f0 AS (SELECT frame, t, avg(x) AS y FROM pixels GROUP BY 1, 2),
  sd AS (SELECT frame, stddev_pop(y) AS sd FROM f0 GROUP BY 1) SELECT frame, dm, round(max(y) / any_value(sd), 6) AS snr FROM ded JOIN sd USING (frame) GROUP BY 1, 2""")
def _(spark, d):
    return rnd(scoring.transient_snr(_px(spark, d), [0, 50, 200], 1500.0 - F.col("ch") * 10.0, 1500.0, 0.004), "snr")


_FUSED = """comp AS (SELECT vec_id, embedding, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS st1,
   list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE) AS st2, list_transform(embedding, lambda x: abs(x::DOUBLE) / 2) AS ss FROM embeddings)"""


def components(spark, d):
    return V.vectors(spark, d).select(
        F.col("id").alias("vec_id"), F.transform("vec", lambda x: F.abs(x)).alias("st1"),
        F.transform("vec", lambda x: x * x).alias("st2"), F.transform("vec", lambda x: F.abs(x) / 2).alias("ss"))


@query("prj22_fuse_maps", f"""WITH {_FUSED}, u AS (SELECT vec_id, unnest(range(64)) AS col, unnest(st1) AS a, unnest(st2) AS b, unnest(ss) AS c FROM comp)
  SELECT vec_id, col, round(0.5::DOUBLE * a + 0.3::DOUBLE * b + 0.2::DOUBLE * c, 6) AS cob FROM u""")
def _(spark, d):
    f = components(spark, d).select("vec_id", F.posexplode(
        scoring.fuse_arrays("st1", "st2", "ss", (0.5, 0.3, 0.2))).alias("col", "cob"))
    return f.select("vec_id", F.col("col").cast("long").alias("col"), F.round("cob", 6).alias("cob"))


BLOCKS = """blocks AS (SELECT vec_id // 192 AS cadence_idx, (vec_id // 32) % 6 AS obs_idx, (vec_id // 8) % 4 AS time_bin, vec_id % 8 AS block,
  list_transform(embedding, lambda x: abs(x) + 1) AS power FROM embeddings)"""


def blocks(spark, d):
    i = F.col("vec_id")
    return V.table(spark, d, "embeddings").select(
        F.floor(i / 192).alias("cadence_idx"), F.pmod(F.floor(i / 32), F.lit(6)).alias("obs_idx"),
        F.pmod(F.floor(i / 8), F.lit(4)).alias("time_bin"), F.pmod(i, F.lit(8)).alias("block"),
        F.transform("embedding", lambda x: (F.abs(x) + F.lit(1).cast("float")).cast("float")).alias("power"))


_WIN = """win AS (SELECT a.cadence_idx, a.obs_idx, a.time_bin, a.block * 64 AS f_start, list_concat(a.power, b.power) AS power
  FROM blocks a JOIN blocks b ON a.cadence_idx = b.cadence_idx AND a.obs_idx = b.obs_idx AND a.time_bin = b.time_bin AND b.block = a.block + 1)"""


@query("prj12_assemble_window", f"WITH {BLOCKS}, {_WIN} SELECT cadence_idx, obs_idx, time_bin, f_start, power FROM win")
def _(spark, d):
    return kernels.assemble_windows(blocks(spark, d), 64)


@query("join11_adjacent_blocks", f"WITH {BLOCKS}, {_WIN} SELECT cadence_idx, obs_idx, time_bin, f_start // 64 AS block, power[1:64] AS power, power[65:128] AS next_power FROM win")
def _(spark, d):
    return kernels.adjacent_blocks(blocks(spark, d))


@query("prj18_stack_frame", f"""WITH {BLOCKS}, {_WIN}, fr AS (SELECT cadence_idx, f_start, obs_idx, flatten(list(power ORDER BY time_bin)) AS frame FROM win GROUP BY 1, 2, 3)
  SELECT cadence_idx, f_start, flatten(list(frame ORDER BY obs_idx))[1:20 * 128] AS frame FROM fr GROUP BY 1, 2""")
def _(spark, d):
    return kernels.stack_frames(kernels.obs_frames(kernels.assemble_windows(blocks(spark, d), 64)), 20, 128)


_OBSF = f"""{BLOCKS}, {_WIN}, ow AS (SELECT cadence_idx, f_start, obs_idx, time_bin, unnest(range(128)) AS ch, unnest(power)::DOUBLE AS x FROM win
   SEMI JOIN (SELECT cadence_idx, f_start FROM win GROUP BY ALL HAVING count(*) = 24) USING (cadence_idx, f_start)),
  om AS (SELECT cadence_idx, f_start, obs_idx, ch, median(x) AS m FROM ow GROUP BY ALL),
  ofl AS (SELECT cadence_idx, f_start, obs_idx, max(m) * 1e-4::DOUBLE + 1e-10::DOUBLE AS f FROM om GROUP BY ALL)"""


@query("prj17_normalize_per_obs", f"""WITH {_OBSF}, ob AS (SELECT cadence_idx, f_start, obs_idx, ln(1 + (x / greatest(m, f))::FLOAT::DOUBLE) AS y
   FROM ow JOIN om USING (cadence_idx, f_start, obs_idx, ch) JOIN ofl USING (cadence_idx, f_start, obs_idx)),
  os AS (SELECT cadence_idx, f_start, obs_idx, median(y) AS med, mad(y) AS md FROM ob GROUP BY ALL),
  z AS (SELECT cadence_idx, f_start, (y - med) / (md + 1e-6::DOUBLE) AS z FROM ob JOIN os USING (cadence_idx, f_start, obs_idx))
  SELECT cadence_idx, f_start, count(*) AS n, round(max(z), 3) AS top, round(min(z), 3) AS low, round(avg(z), 3) AS mean FROM z GROUP BY 1, 2""")
def _(spark, d):
    f = kernels.obs_frames(kernels.assemble_windows(blocks(spark, d), 64))
    n = kernels.normalised_frames(f, 4, 128, "per_obs", method="median")
    return _frame_summary(n)


def _frame_summary(n):
    x = n.select("cadence_idx", "f_start", F.explode("frame").alias("z")).withColumn("z", F.col("z").cast("double"))
    return x.groupBy("cadence_idx", "f_start").agg(
        F.count("*").alias("n"), F.round(F.max("z"), 3).alias("top"), F.round(F.min("z"), 3).alias("low"),
        F.round(F.avg("z"), 3).alias("mean"))


@query("prj17_normalize_legacy_concat")
def _(spark, d):
    f = kernels.obs_frames(kernels.assemble_windows(blocks(spark, d), 64))
    return _frame_summary(kernels.normalised_frames(f, 4, 128, "legacy_concat"))


@query("prj19_patchify_array", f"""WITH {BLOCKS}, {_WIN}, fr AS (SELECT cadence_idx, f_start, obs_idx, time_bin, unnest(range(128)) AS ch, unnest(power) AS x FROM win)
  SELECT cadence_idx, f_start, obs_idx, list(x ORDER BY (time_bin // 2) * 8 + ch // 16, time_bin % 2, ch % 16) AS patches FROM fr GROUP BY 1, 2, 3 HAVING count(*) = 512""")
def _(spark, d):
    f = kernels.obs_frames(kernels.assemble_windows(blocks(spark, d), 64)).filter(F.size("frame") == 512)
    return f.select("cadence_idx", "f_start", "obs_idx", kernels.patchify("frame", 4, 128, 2, 16).alias("patches"))


# ------------------------------------------------------------------ frame statistics

_MET = """met AS (SELECT frame, max(x) AS max_val, quantile_cont(x, 0.99) AS p99, avg((x > 40)::INT) AS hot_frac_lo, avg((x > 49)::INT) AS hot_frac_hi FROM pixels GROUP BY 1),
  cs AS (SELECT frame, stddev_pop(m) AS col_mean_std FROM (SELECT frame, ch, avg(x) AS m FROM pixels GROUP BY 1, 2) GROUP BY 1),
  rs AS (SELECT frame, stddev_pop(m) AS row_mean_std FROM (SELECT frame, t, avg(x) AS m FROM pixels GROUP BY 1, 2) GROUP BY 1),
  metrics AS (SELECT * FROM met JOIN cs USING (frame) JOIN rs USING (frame))"""
_MCOLS = ("max_val", "p99", "hot_frac_lo", "hot_frac_hi", "col_mean_std", "row_mean_std")


def _metrics(spark, d):
    return stats.rfi_metrics(_px(spark, d), 40, 49)


@query("agg3_rfi_metrics", f"WITH {V.PIXELS}, {_MET} SELECT frame, " + ", ".join(f"round({c}, 6) AS {c}" for c in _MCOLS) + " FROM metrics")
def _(spark, d):
    return rnd(_metrics(spark, d), *_MCOLS)


_CLS = """q AS (SELECT quantile_cont(col_mean_std, 0.9) AS pc, quantile_cont(row_mean_std, 0.9) AS pr FROM metrics),
  cl AS (SELECT frame, CASE WHEN hot_frac_hi > 0 THEN 'strong' WHEN hot_frac_lo > 0 THEN 'mild' ELSE 'clean' END AS rfi_class,
   col_mean_std > pc AS line_like, row_mean_std > pr AS burst_like FROM metrics, q)"""


@query("agg4_rfi_class", f"WITH {V.PIXELS}, {_MET.replace('x > 49', 'x > 49.5')}, {_CLS} SELECT * FROM cl")
def _(spark, d):
    m = stats.rfi_metrics(_px(spark, d), 40, 49.5)
    return stats.rfi_class(m).select("frame", "rfi_class", "line_like", "burst_like")


@query("agg4_rfi_composition", f"""WITH {V.PIXELS}, {_MET.replace('x > 49', 'x > 49.5')}, {_CLS} SELECT rfi_class, count(*) AS n, count(*) FILTER (line_like) AS n_line,
  count(*) FILTER (burst_like) AS n_burst, round(count(*) / (SELECT count(*) FROM cl) * 100, 6) AS pct FROM cl GROUP BY 1""")
def _(spark, d):
    m = stats.rfi_metrics(_px(spark, d), 40, 49.5)
    return rnd(stats.rfi_composition(stats.rfi_class(m)), "pct")


_HOT = "hot AS (SELECT frame, avg((x > 40)::INT) AS hot_frac FROM pixels GROUP BY 1)"


@query("agg5_quiet_rfi_split", f"""WITH {V.PIXELS}, {_HOT}, q AS (SELECT quantile_cont(hot_frac, 0.25) AS a, quantile_cont(hot_frac, 0.75) AS b FROM hot)
  SELECT frame, round(hot_frac, 6) AS hot_frac, CASE WHEN hot_frac <= a THEN 'quiet' WHEN hot_frac >= b THEN 'rfi' ELSE 'middle' END AS class FROM hot, q""")
def _(spark, d):
    return rnd(stats.quiet_rfi_split(stats.hot_fraction(_px(spark, d), 40)), "hot_frac")


@query("agg5_quiet_mild_strong", f"""WITH {V.PIXELS}, {_HOT}, q AS (SELECT quantile_cont(hot_frac, 0.1) AS a, quantile_cont(hot_frac, 0.5) AS b, quantile_cont(hot_frac, 0.95) AS c FROM hot)
  SELECT frame, CASE WHEN hot_frac <= a THEN 'quiet' WHEN hot_frac >= c THEN 'strong_rfi' WHEN abs(hot_frac - b) <= 0.01 THEN 'mild_rfi' END AS class FROM hot, q""")
def _(spark, d):
    return stats.quiet_mild_strong(stats.hot_fraction(_px(spark, d), 40)).select("frame", "class")


@query("agg5_extreme_frames", f"""WITH {V.PIXELS}, {_HOT} (SELECT frame, round(hot_frac, 6) AS hot_frac, 'lowest' AS side FROM hot ORDER BY hot.hot_frac, frame LIMIT 10)
  UNION ALL (SELECT frame, round(hot_frac, 6), 'highest' FROM hot ORDER BY hot.hot_frac DESC, frame LIMIT 10)""")
def _(spark, d):
    return rnd(stats.extreme_frames(stats.hot_fraction(_px(spark, d), 40), 10), "hot_frac")


@query("agg6_channel_rfi_flags", f"""WITH {V.PIXELS}, {_CM}, fb AS (SELECT frame, median(m) AS base, mad(m) AS md FROM cm GROUP BY 1),
  bd AS (SELECT frame, m, base, abs(m - base) > 2.0 * 1.4826::DOUBLE * (md + 1e-10::DOUBLE) AS bad FROM cm JOIN fb USING (frame))
  SELECT frame, round(avg(bad::INT), 6) AS rfi_frac, round(avg(m) FILTER (bad) / any_value(base), 6) AS rfi_intensity_ratio FROM bd GROUP BY 1""")
def _(spark, d):
    return rnd(stats.channel_rfi_flags(_px(spark, d), 2.0), "rfi_frac", "rfi_intensity_ratio")


_CF = """cf AS (SELECT frame, avg((m > 49)::INT) AS chan_frac, sum(h) / sum(n) AS hot_frac FROM (
  SELECT frame, ch, max(x) AS m, count(*) AS n, count(*) FILTER (x > 49) AS h FROM pixels GROUP BY 1, 2) GROUP BY 1)"""


@query("agg7_chan_frac", f"WITH {V.PIXELS}, {_CF} SELECT frame, round(chan_frac, 6) AS chan_frac, round(hot_frac, 6) AS hot_frac FROM cf")
def _(spark, d):
    return rnd(stats.chan_frac(_px(spark, d), 49), "chan_frac", "hot_frac")


@query("agg7_pick_examples", f"""WITH {V.PIXELS}, {_CF}, p AS ((SELECT frame, hot_frac, chan_frac, 'clean' || row_number() OVER (ORDER BY hot_frac, frame) AS role FROM cf ORDER BY hot_frac, frame LIMIT 2)
  UNION ALL (SELECT frame, hot_frac, chan_frac, 'rfi' FROM cf ORDER BY (chan_frac <= 0.25)::INT DESC, hot_frac DESC, CASE WHEN chan_frac <= 0.25 THEN frame ELSE -frame END LIMIT 1))
  SELECT frame, role, round(hot_frac, 6) AS hot_frac, round(chan_frac, 6) AS chan_frac FROM p""")
def _(spark, d):
    return rnd(stats.pick_examples(stats.chan_frac(_px(spark, d), 49), 0.25), "hot_frac", "chan_frac")


@query("agg8_level_steps", f"""WITH {V.PIXELS}, o AS (SELECT frame, t % 6 AS obs_idx, median(x) AS m, mad(x) AS md, avg(x) AS mean FROM pixels GROUP BY 1, 2)
  SELECT frame, round(max(m) - min(m), 6) AS level_spread, round(avg(md), 6) AS mean_mad, round((max(m) - min(m)) / greatest(avg(md), 1e-9), 6) AS spread_ratio,
   round(stddev_pop(mean), 6) AS block_mean_std FROM o GROUP BY 1""")
def _(spark, d):
    px = _px(spark, d).withColumn("obs_idx", F.pmod("t", F.lit(6)))
    return rnd(stats.level_steps(px), "level_spread", "mean_mad", "spread_ratio", "block_mean_std")


@query("agg10_describe_metrics", """WITH l AS (SELECT 'quantity' AS metric, l_quantity AS x FROM lineitem UNION ALL SELECT 'price', l_extendedprice FROM lineitem)
  SELECT metric, round(avg(x), 6) AS mean, max(x) AS max, min(x) AS min, round(stddev_pop(x), 6) AS std, round(quantile_cont(x, 0.5), 6) AS p50,
   round(quantile_cont(x, 0.95), 6) AS p95, round(quantile_cont(x, 0.99), 6) AS p99 FROM l GROUP BY 1""")
def _(spark, d):
    li = V.table(spark, d, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    return rnd(stats.describe_metrics(li, ["quantity", "price"]), "mean", "std", "p50", "p95", "p99")


@query("agg11_histogram", """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.995) AS q FROM lineitem), x AS (SELECT least(l_extendedprice, q) AS x FROM lineitem, q),
  s AS (SELECT min(x) AS lo, max(x) AS hi FROM x) SELECT least(floor((x - lo) / ((hi - lo) / 50)), 49)::BIGINT AS bin, count(*) AS n FROM x, s GROUP BY 1""")
def _(spark, d):
    return stats.histogram(V.table(spark, d, "lineitem"), "l_extendedprice", 50, 0.995)


@query("agg11_histogram_log", """WITH x AS (SELECT log10(value) AS x FROM events WHERE value > 0), s AS (SELECT min(x) AS lo, max(x) AS hi FROM x)
  SELECT least(floor((x - lo) / ((hi - lo) / 40)), 39)::BIGINT AS bin, count(*) AS n FROM x, s GROUP BY 1""")
def _(spark, d):
    return stats.histogram(V.table(spark, d, "events"), "value", 40, log=True)


# ------------------------------------------------------------------ frame scores

@query("scr1_max_pixel", f"WITH {V.PIXELS} SELECT frame, max(x) AS max_pixel FROM pixels GROUP BY 1")
def _(spark, d):
    return scoring.frame_scores(_px(spark, d)).select("frame", "max_pixel")


@query("scr2_peak_snr", f"WITH {V.PIXELS} SELECT frame, round(max(x) / (stddev_pop(x) + 1e-9), 6) AS peak_snr FROM pixels GROUP BY 1")
def _(spark, d):
    return rnd(scoring.frame_scores(_px(spark, d)).select("frame", "peak_snr"), "peak_snr")


_TOP = """tk AS (SELECT frame, x * x AS q, row_number() OVER (PARTITION BY frame ORDER BY x * x DESC) AS r, count(*) OVER (PARTITION BY frame) AS n FROM pixels)"""


@query("scr3_top1pct_energy", f"""WITH {V.PIXELS}, {_TOP} SELECT frame, round(sum(q) FILTER (r <= greatest(1, floor(0.01::DOUBLE * n))), 6) AS top_energy FROM tk GROUP BY 1""")
def _(spark, d):
    return rnd(scoring.top_energy(_px(spark, d)).select("frame", "top_energy"), "top_energy")


@query("scr4_frame_stats", f"""WITH {V.PIXELS}, {_TOP}, t AS (SELECT frame, sum(q) FILTER (r <= greatest(1, floor(0.001::DOUBLE * n))) / (sum(q) + 1e-9) AS top_share FROM tk GROUP BY 1),
  mu AS (SELECT frame, avg(x) AS mu, stddev_pop(x) + 1e-9 AS sd FROM pixels GROUP BY 1)
  SELECT frame, round(max(x) / any_value(sd), 6) AS peakiness, round(avg((x - mu) ** 4) / any_value(sd) ** 4 - 3, 6) AS kurtosis, round(any_value(top_share), 6) AS top_share
  FROM pixels JOIN mu USING (frame) JOIN t USING (frame) GROUP BY 1""")
def _(spark, d):
    return rnd(scoring.frame_stats(_px(spark, d)), "peakiness", "kurtosis", "top_share")


@query("scr5_frame_energy", f"WITH {V.PIXELS} SELECT frame, round(avg(x * x), 6) AS frame_energy FROM pixels GROUP BY 1")
def _(spark, d):
    return rnd(scoring.frame_scores(_px(spark, d)).select("frame", "frame_energy"), "frame_energy")


_ERR = f"""{V.PIXELS}, rec AS (SELECT frame, t, ch, x, (CASE WHEN ch % 3 = 0 THEN x ELSE x - 2 END) AS clean, avg(x) OVER (PARTITION BY frame) AS xhat FROM pixels)"""


@query("scr9_hot_pixel_error", f"""WITH {_ERR} SELECT frame, round(avg((x - xhat) ** 2), 6) AS err, round(avg((x - xhat) ** 2) FILTER (x > 45), 6) AS err_hot,
  round(avg((x - xhat) ** 2) FILTER (abs(x - clean) > 1), 6) AS err_signal FROM rec GROUP BY 1""")
def _(spark, d):
    px = _px(spark, d)
    mean = px.groupBy("frame").agg(F.avg("x").alias("xhat"))
    j = px.join(mean, "frame").withColumn("clean", F.when(F.col("ch") % 3 == 0, F.col("x")).otherwise(F.col("x") - 2))
    return rnd(scoring.hot_pixel_error(j, 45), "err", "err_hot", "err_signal")


@query("agg18_category_energy", f"""WITH {_ERR}, fr AS (SELECT frame, avg(x * x) AS e_in, avg(xhat * xhat) AS e_rec, max(abs(x)) AS peak_in, max(abs(xhat)) AS peak_rec, avg((x > 40)::INT) AS hot_frac FROM rec GROUP BY 1),
  q AS (SELECT quantile_cont(hot_frac, 0.25) AS a, quantile_cont(hot_frac, 0.75) AS b FROM fr),
  c AS (SELECT *, CASE WHEN hot_frac <= a THEN 'quiet' WHEN hot_frac >= b THEN 'rfi' ELSE 'middle' END AS class FROM fr, q)
  SELECT class, count(*) AS n, round(avg(e_in), 6) AS e_in, round(avg(e_rec), 6) AS e_rec, round(avg(e_rec / greatest(e_in, 1e-10)), 6) AS ratio, max(peak_in) AS peak_in, round(max(peak_rec), 6) AS peak_rec
  FROM c GROUP BY 1""")
def _(spark, d):
    px = _px(spark, d)
    mean = px.groupBy("frame").agg(F.avg("x").alias("xhat"))
    x, h = F.col("x"), F.col("xhat")
    fr = px.join(mean, "frame").groupBy("frame").agg(
        F.avg(x * x).alias("e_in"), F.avg(h * h).alias("e_rec"), F.max(F.abs(x)).alias("peak_in"),
        F.max(F.abs(h)).alias("peak_rec"), F.avg((x > 40).cast("int")).alias("hot_frac"))
    return rnd(stats.category_energy(stats.quiet_rfi_split(fr)), "e_in", "e_rec", "ratio", "peak_rec")
