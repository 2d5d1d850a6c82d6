"""Thresholds, adjacency clusters, noise ceilings, ON/OFF rules and ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadrift.operators import scale, stats
from cadrift.session import cut

ON_ROWS = (0, 2, 4)
OFF_ROWS = (1, 3, 5)
FAR_QUANTILE = 0.99
MIN_OFF_POOL = 30
LEAK_FRAC = 0.3
CHAIN_SPAN_WINDOWS = 1 << 16


def thresholds(scores: DataFrame, by: Sequence[str], far: float = FAR_QUANTILE) -> DataFrame:
    """Per group: median, robust sigma, 3 and 5 sigma cuts, the far quantile, counts above."""
    by = list(by)
    base = threshold_values(scores, by, far)
    above = scale.attach(scores.select(*by, "score"), base, by).groupBy(*by).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("score") > F.col(t)).alias(n) for t, n in (
            ("thresh_3", "n_3s"), ("thresh_5", "n_5s"), ("far_thresh", "n_far"))])
    return scale.attach(base, above, by)


def threshold_values(scores: DataFrame, by: Sequence[str], far: float = FAR_QUANTILE,
                     largest: int | None = None) -> DataFrame:
    by = list(by)
    largest = scale.largest_group(scores, by) if largest is None else largest
    if largest <= scale.CELL:
        v = F.col("_s")
        g = scale.sorted_values(scores, by, "score").withColumn("median", scale.quantile_of(v, 0.5))
        both = g.select(*by, "median", (scale.mad_of(v, F.col("median")) * 1.4826).alias("mad_sigma"),
                        scale.quantile_of(v, far).alias("far_thresh"))
    else:
        q = scale.exact_quantiles(scores, by, "score", {"far_thresh": far}, largest=largest)
        st = scale.robust_stats(scores, by, "score", largest=largest)
        both = scale.attach(q, st, by)
    return both.select(
        *by, "median", "mad_sigma", (F.col("median") + 3 * F.col("mad_sigma")).alias("thresh_3"),
        (F.col("median") + 5 * F.col("mad_sigma")).alias("thresh_5"), "far_thresh")


def freq_mhz(f_start: Column, df_hz: float | None) -> Column:
    return f_start * (df_hz / 1e6) if df_hz else F.lit(0.0)


def chain_windows(scores: DataFrame, keys: Sequence[str], above: Column, stride: int,
                  largest: int | None = None) -> DataFrame:
    """Windows above the threshold with the first window of their chain as ``chain_start``.

    ``largest`` is any known upper bound on the windows of one key.
    """
    return scale.gap_chains(scores.filter(above), keys, "f_start", stride,
                            stride * CHAIN_SPAN_WINDOWS, largest=largest)


def cluster_candidates(scores: DataFrame, keys: Sequence[str], above: Column, stride: int,
                       fchans: int, df_hz: float | None = None,
                       largest: int | None = None) -> DataFrame:
    """One row per chain of adjacent windows above the threshold.

    ``scores`` already carries its threshold column; ``f_start`` is unique per key.
    """
    peak = F.min(F.struct((-F.col("score")).alias("s"), F.col("f_start").alias("f")))
    g = chain_windows(scores, keys, above, stride, largest).groupBy(*keys, "chain_start").agg(
        peak.alias("_p"), F.max("score").alias("peak_score"), F.avg("score").alias("mean_score"),
        F.count("*").alias("n_snippets"), F.max("f_start").alias("f_start_last"))
    return g.select(
        *keys, F.col("_p.f").alias("f_start_peak"),
        freq_mhz(F.col("_p.f"), df_hz).alias("freq_mhz_peak"), "peak_score", "mean_score",
        "n_snippets", F.col("chain_start").alias("f_start_first"), "f_start_last",
        (F.col("f_start_last") - F.col("chain_start") + fchans).alias("cluster_width_channels"))


def n_clusters(scores: DataFrame, keys: Sequence[str], above: Column, stride: int,
               name: str = "n_clusters", largest: int | None = None) -> DataFrame:
    """Chains per key; keys without any window above are absent."""
    return chain_windows(scores, keys, above, stride, largest).groupBy(*keys).agg(
        F.count_if(F.col("f_start") == F.col("chain_start")).alias(name))


def background_probe(windows: DataFrame, maps: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """OFF-row cells of ``n`` seeded random windows per cadence, one row per cell."""
    win = ["cadence_idx", "f_start"]
    picked = scale.seeded_sample(windows.select(*win), ["cadence_idx"], win, n, seed)
    return off_cells(scale.meet(maps, picked, win, "left_semi"))


def off_cells(maps: DataFrame) -> DataFrame:
    return maps.filter(F.col("obs_idx").isin(*OFF_ROWS)).select(
        "cadence_idx", F.explode("cells").alias("v"))


def off_ceiling(pool: DataFrame, thr: DataFrame, min_pool: int = MIN_OFF_POOL) -> DataFrame:
    """Noise ceiling per cadence of ``thr``, floored at its 5 sigma cut.

    Cadences whose pool is too small for a robust estimate use the 5 sigma cut alone.
    """
    raw = stats.off_noise_ceiling(pool, ["cadence_idx"], "v").withColumnRenamed(
        "ceiling", "raw_ceiling")
    enough = F.coalesce(F.col("n_pool"), F.lit(0)) >= min_pool
    return scale.meet(thr, raw, ["cadence_idx"], "left").select(
        "cadence_idx", F.coalesce("n_pool", F.lit(0)).alias("n_pool"),
        F.when(enough, F.col("raw_ceiling")).alias("raw_ceiling"), "thresh_5",
        F.when(enough, F.greatest("raw_ceiling", "thresh_5"))
        .otherwise(F.col("thresh_5")).alias("off_ceiling"))


def row_peaks(maps: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Six columns r0..r5: each observation row's own maximum (NULL where it is missing)."""
    return maps.groupBy(*keys, *carry).agg(*[
        F.max(F.when(F.col("obs_idx") == i, F.array_max("cells"))).alias(f"r{i}")
        for i in (*ON_ROWS, *OFF_ROWS)])


def _hits(rows, cond) -> Column:
    return sum((F.when(cond(F.col(f"r{i}")), 1).otherwise(0) for i in rows),
               F.lit(0)).cast("long")


def _mean(rows) -> Column:
    cols = [F.col(f"r{i}") for i in rows]
    n = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    return F.when(n > 0, sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0)) / n
                  ).otherwise(F.lit(0.0))


def on_off_contrast(maps: DataFrame, keys: Sequence[str], col_window: int = 3,
                    thr: str | None = None, eps: float = 1e-8) -> DataFrame:
    """ON/OFF contrast near the map's peak column, row hits if ``thr`` names a column.

    A window's rows are unique by (keys, obs_idx), so its group holds one map.
    """
    top = F.array_max("cells")
    peak = F.min(F.struct((-top).alias("m"), F.array_position("cells", top).cast("int").alias("c")))
    carry = [thr] if thr else []
    lo = F.greatest(F.col("_c") - col_window, F.lit(1))
    near = maps.withColumn("_c", peak.over(Window.partitionBy(*keys)).c).withColumn(
        "cells", F.slice("cells", lo, F.col("_c") + col_window - lo + 1))
    rows = row_peaks(near, keys, carry)
    out = rows.withColumn("on_mean", _mean(ON_ROWS)).withColumn("off_mean", _mean(OFF_ROWS))
    cols = [*keys, (F.col("on_mean") / F.greatest("off_mean", F.lit(eps))).alias("on_off_contrast"),
            "on_mean", "off_mean"]
    if thr:
        cols += [_hits(ON_ROWS, lambda c: c > F.col(thr)).alias("n_on_hits"),
                 _hits(OFF_ROWS, lambda c: c > F.col(thr)).alias("n_off_hits")]
    return out.select(*cols)


def _leaks(thr: Column, leak_frac: float, row: int) -> Column:
    on_ref = F.coalesce(F.least(*[F.col(f"r{i}") for i in ON_ROWS]), F.lit(0.0))
    c = F.col(f"r{row}")
    return (c > thr) & (c >= leak_frac * on_ref)


def full_row_hits(peaks: DataFrame, thr: Column, leak_frac: float = LEAK_FRAC) -> DataFrame:
    """Row hits over the whole frequency axis, leak flag and short-list membership."""
    n_off = sum((F.when(_leaks(thr, leak_frac, i), 1).otherwise(0) for i in OFF_ROWS), F.lit(0))
    return (peaks.withColumn("n_on_hits_full", _hits(ON_ROWS, lambda c: c > thr))
            .withColumn("n_off_hits_full", n_off.cast("long"))
            .withColumn("off_leak", F.col("n_off_hits_full") >= 2)
            .withColumn("in_short_list", (F.col("n_on_hits_full") >= 2) & ~F.col("off_leak")))


def leaking_rows(peaks: DataFrame, thr: Column, leak_frac: float = LEAK_FRAC) -> DataFrame:
    """Indices of leaking OFF rows and the ON/OFF row-peak ratio."""
    leaking = F.array_compact(F.array(*[
        F.when(_leaks(thr, leak_frac, i), F.lit(i).cast("long")) for i in OFF_ROWS]))
    return peaks.withColumn("leaking", leaking).withColumn(
        "on_off_ratio", F.when(_mean(OFF_ROWS) > 0, _mean(ON_ROWS) / _mean(OFF_ROWS))
        .otherwise(F.lit(float("inf"))))


def row_breakdown(maps: DataFrame, thr: Column) -> DataFrame:
    """Per observation row: peak, its column, whether it is a hit."""
    top = F.array_max("cells")
    return maps.select("cadence_idx", "f_start", "obs_idx",
                       F.when(F.col("obs_idx") % 2 == 0, "ON").otherwise("OFF").alias("kind"),
                       top.alias("peak"),
                       (F.array_position("cells", top) - 1).cast("long").alias("col"),
                       (top > thr).alias("hit"))


def nearest_windows(saved: DataFrame, wanted: DataFrame, k: int = 5) -> DataFrame:
    """Per wanted window of a cadence, the ``k`` saved windows nearest in f_start."""
    key, span = ["cadence_idx"], F.floor(F.col("f_start") / CHAIN_SPAN_WINDOWS)
    have = saved.select("cadence_idx", "f_start").distinct()
    both = have.withColumn("_is", F.lit(1)).unionByName(wanted.select("cadence_idx", "f_start").distinct().withColumn("_is", F.lit(0)))
    largest = scale.largest_group(both, key)
    placed = scale.running_sum(both, key, ["f_start", F.col("_is").desc()], span, {"_at": "_is"}, largest)
    ranked = placed.filter("_is = 1").select("cadence_idx", "f_start", F.col("_at").alias("_rank"))
    # the k before and the k after hold the k nearest
    asked = placed.filter("_is = 0").select("cadence_idx", F.col("f_start").alias("wanted"), F.explode(
        F.sequence(F.col("_at") - (k - 1), F.col("_at") + k)).alias("_rank"))
    near = scale.meet(asked, ranked, ["cadence_idx", "_rank"]).select("cadence_idx", "f_start", "wanted")
    return scale.top_per_key(near, ["cadence_idx", "wanted"],
                             [F.abs(F.col("f_start") - F.col("wanted")), "f_start"], k)


def shortlist_rank(candidates: DataFrame, by: Sequence[str], top_k: int = 30,
                   ignore_short_list: bool = False) -> DataFrame:
    """First ``top_k`` per group by contrast among the short list; by peak where no map is known."""
    has_map = "on_off_contrast" in candidates.columns
    c = candidates
    if has_map and not ignore_short_list:
        c = c.filter("in_short_list")
    first = F.col("on_off_contrast" if has_map else "peak_score").desc()
    return scale.top_per_key(c, by, [first, "f_start_peak"], top_k)


def nth_candidate(candidates: DataFrame, by: Sequence[str], rank: int,
                  order: str = "peak_score") -> DataFrame:
    """The 1-based ``rank``-th candidate per group; fails when no group has that many."""
    if rank < 1:
        raise ValueError("rank starts at 1")
    out = scale.top_per_key(candidates, by, [F.col(order).desc(), "f_start_peak"], rank).filter(
        F.col("rank") == rank)
    if out.isEmpty():
        raise IndexError(f"no group has {rank} candidates")
    return out


def sigma_of(score: Column, median: Column, sigma: Column) -> Column:
    return F.when(sigma == 0, F.lit(0.0)).otherwise((score - median) / sigma)


def fp_breakdown(scores: DataFrame) -> DataFrame:
    """Per cadence: counts above its own 3 and 5 sigma cuts and above the pooled ones."""
    local = threshold_values(scores, ["cadence_idx"]).select(
        "cadence_idx", "median", "mad_sigma", F.col("thresh_3").alias("l3"),
        F.col("thresh_5").alias("l5"))
    pooled = threshold_values(scores, []).select(
        F.col("thresh_3").alias("g3"), F.col("thresh_5").alias("g5"))
    rows = scale.attach(scale.meet(scores.select("cadence_idx", "score"), local, ["cadence_idx"]), pooled, [])
    return rows.groupBy("cadence_idx", "median", "mad_sigma").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("score") > F.col(t)).alias(name) for t, name in (
            ("l3", "n_3s_local"), ("l5", "n_5s_local"), ("g3", "n_3s_global"), ("g5", "n_5s_global"))])


def sigma_sweep(scores: DataFrame, k_max: int = 500) -> DataFrame:
    """Windows above median + k sigma for k = 1..k_max in one pass.

    Each score is counted under the largest k it exceeds; counts then add up from the top
    over at most k_max + 1 rows.
    """
    thr = threshold_values(scores, []).select("median", "mad_sigma")
    rows = scale.attach(scores.select("score"), thr, [])
    k0 = F.ceil(F.try_divide(F.col("score") - F.col("median"), F.col("mad_sigma")))
    near = F.array(*[k0 + i for i in (1, 0, -1, -2)])
    passed = F.filter(near, lambda k: F.col("score") > F.col("median") + k * F.col("mad_sigma"))
    flat = F.when(F.col("score") > F.col("median"), k_max).otherwise(0)
    level = F.least(F.greatest(F.when(F.col("mad_sigma") == 0, flat).otherwise(
        F.coalesce(F.get(passed, F.lit(0)), F.lit(0))), F.lit(0)), F.lit(k_max))
    counted = rows.groupBy(level.cast("long").alias("k")).agg(F.count("*").alias("_c"))
    ks = scores.sparkSession.range(0, k_max + 1).withColumnRenamed("id", "k")
    down = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    filled = ks.join(counted, "k", "left")
    total = F.sum("_c").over(Window.partitionBy())
    return filled.select(
        "k", F.coalesce(F.sum("_c").over(down), F.lit(0)).cast("long").alias("n_above"),
        total.alias("_n")).filter("k > 0").select(
        "k", "n_above", (F.col("n_above") / F.col("_n") * 100).alias("pct"))


def peak_column_ratio(maps: DataFrame, keys: Sequence[str], top: int = 5,
                      eps: float = 1e-10) -> DataFrame:
    """Mean square on ON over OFF rows, inside the ``top`` columns of most residual energy."""
    cells = maps.select(*keys, "obs_idx", F.posexplode("cells").alias("col", "v"))
    energy = cells.groupBy(*keys, "col").agg(
        F.sum(F.abs("v")).alias("e"),
        *[F.sum(F.when(F.col("obs_idx").isin(*rows), F.col("v") * F.col("v"))).alias(f"s_{n}")
          for n, rows in (("on", ON_ROWS), ("off", OFF_ROWS))],
        *[F.count_if(F.col("obs_idx").isin(*rows)).alias(f"n_{n}")
          for n, rows in (("on", ON_ROWS), ("off", OFF_ROWS))])
    best = scale.top_per_key(energy, keys, [F.col("e").desc(), "col"], top)
    return best.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.col("col").cast("long"))).alias("peak_cols"),
        (F.sum("s_on") / F.sum("n_on") / (F.sum("s_off") / F.sum("n_off") + eps)).alias("ratio"))


def ratio_cuts(ratios: DataFrame, cuts: Sequence[float]) -> DataFrame:
    """Survivors and rejected share at each ratio cut."""
    cut = F.explode(F.array(*[F.lit(float(c)) for c in cuts]))
    return ratios.select("ratio", cut.alias("r_cut")).groupBy("r_cut").agg(
        F.count_if(F.col("ratio") > F.col("r_cut")).alias("n_survive"),
        F.count_if(~(F.col("ratio") > F.col("r_cut"))).alias("n_rejected"),
        (F.avg((~(F.col("ratio") > F.col("r_cut"))).cast("int")) * 100).alias("pct_rejected"))


def threshold_regime(t: DataFrame) -> DataFrame:
    """Which cut binds, which term of the ceiling wins, and whether pooling flips it.

    Columns in: far_thresh, probe_ceiling, pooled_ceiling, thresh_5.
    """
    t = (t.withColumn("off_ceiling", F.greatest("probe_ceiling", "thresh_5"))
         .withColumn("off_ceiling_pooled", F.greatest("pooled_ceiling", "thresh_5"))
         .withColumn("far_over_ceiling", F.try_divide("far_thresh", "off_ceiling")))
    by_far = F.col("far_over_ceiling") > 1.0
    return (t.withColumn("binding_cut", F.when(by_far, "far").otherwise("ceiling"))
            .withColumn("ceiling_term", F.when(F.col("thresh_5") > F.col("probe_ceiling"),
                                               "thresh_5").otherwise("noise"))
            .withColumn("pool_inflation", F.try_divide("pooled_ceiling", "probe_ceiling"))
            .withColumn("flips", by_far != (F.col("far_thresh") > F.col("off_ceiling_pooled"))))


def ceiling_with_fallback(thr: DataFrame, measured: DataFrame) -> DataFrame:
    """Measured ceiling where there is one, else the 5 sigma cut; the source is kept."""
    own = measured.select("cadence_idx", F.col("off_ceiling").alias("_m"))
    return scale.meet(thr, own, ["cadence_idx"], "left").select(
        *thr.columns, F.coalesce("_m", "thresh_5").alias("off_ceiling"),
        F.when(F.col("_m").isNotNull(), "measured").otherwise("thresh_5 (assumed)")
        .alias("ceiling_source"))


def _above_new(scores: DataFrame, t: DataFrame) -> DataFrame:
    """Windows above min(far, ceiling), written once: both cuts chain within these few."""
    s = scale.meet(scores.select("cadence_idx", "f_start", "score"), t.select("cadence_idx", "far_thresh", "new_thresh"), ["cadence_idx"])
    return cut(s.filter(F.col("score") > F.col("new_thresh")))


def candidate_volume(scores: DataFrame, ceilings: DataFrame, stride: int,
                     largest: int | None = None) -> DataFrame:
    """Clusters per cadence at the far cut and at min(far, ceiling)."""
    t = ceilings.withColumn("new_thresh", F.least("far_thresh", "off_ceiling"))
    s = _above_new(scores, t)
    now = n_clusters(s, ["cadence_idx"], F.col("score") > F.col("far_thresh"), stride, "n_clusters_now", largest)
    new = n_clusters(s, ["cadence_idx"], F.col("score") > F.col("new_thresh"), stride, "n_clusters_new", largest)
    key = ["cadence_idx"]
    out = scale.meet(scale.meet(t, now, key, "left"), new, key, "left").fillna(
        0, ["n_clusters_now", "n_clusters_new"])
    return out.select(
        "cadence_idx", "ceiling_source", "far_thresh", "off_ceiling",
        F.try_divide("far_thresh", "off_ceiling").alias("far_over_ceiling"),
        "n_clusters_now", "n_clusters_new",
        (F.col("n_clusters_new") / F.greatest("n_clusters_now", F.lit(1))).alias("cluster_multiplier"))


def map_coverage(candidates: DataFrame, saved: DataFrame, by: Sequence[str]) -> DataFrame:
    """Candidates whose peak window has a saved map, and those that have none."""
    have = saved.select(*by, F.col("f_start").alias("f_start_peak")).distinct().withColumn(
        "_has", F.lit(True))
    return scale.meet(candidates, have, [*by, "f_start_peak"], "left").groupBy(*by).agg(
        F.count("*").alias("n"), F.count("_has").alias("n_covered"),
        F.count_if(F.col("_has").isNull()).alias("n_uncovered"))


def review_load(scores: DataFrame, ceilings: DataFrame, saved: DataFrame, stride: int,
                fchans: int, largest: int | None = None) -> DataFrame:
    """Old and new clusters, map coverage and short-list members among covered new clusters.

    ``ceilings``: cadence_idx, far_thresh, off_ceiling, map_thresh.
    """
    t = ceilings.withColumn("new_thresh", F.least("far_thresh", "off_ceiling"))
    s = _above_new(scores, t)
    key = ["cadence_idx"]
    old = n_clusters(s, key, F.col("score") > F.col("far_thresh"), stride, "n_old", largest)
    new = cluster_candidates(s, key, F.col("score") > F.col("new_thresh"), stride, fchans,
                             largest=largest)
    peaks = row_peaks(saved, ["cadence_idx", "f_start"]).withColumnRenamed("f_start", "f_start_peak")
    judged = full_row_hits(scale.meet(peaks, t.select("cadence_idx", "off_ceiling"), key),
                           F.col("off_ceiling")).select("cadence_idx", "f_start_peak", "in_short_list")
    load = scale.meet(new, judged, ["cadence_idx", "f_start_peak"], "left").groupBy("cadence_idx").agg(
        F.count("*").alias("n_new"), F.count("in_short_list").alias("n_covered"),
        F.count_if(F.col("in_short_list").isNull()).alias("n_uncovered"),
        F.count_if("in_short_list").alias("n_short_list_covered"))
    counts = ["n_old", "n_new", "n_covered", "n_uncovered", "n_short_list_covered"]
    out = scale.meet(scale.meet(t, old, key, "left"), load, key, "left").fillna(0, counts)
    return out.select(
        "cadence_idx", "n_old", "n_new", "n_covered", "n_uncovered",
        F.when(F.col("n_new") > 0, F.col("n_covered") / F.col("n_new")).alias("coverage_frac"),
        "n_short_list_covered",
        F.when(F.col("n_new") > 0, F.col("new_thresh") < F.col("map_thresh")).alias("below_map_thresh"))


def percentile_candidates(scores: DataFrame, by: Sequence[str], pct: float = 99.5, sep_bins: int = 8,
                          fchans: int = 1024) -> DataFrame:
    """Clusters above a top percentile, merged when at most ``sep_bins`` apart."""
    largest = scale.largest_group(scores, by)
    cutv = scale.exact_quantiles(scores, by, "score", {"_cut": pct / 100.0}, largest=largest)
    return cluster_candidates(scale.attach(scores, cutv, by), by, F.col("score") > F.col("_cut"),
                              sep_bins, fchans, largest=largest)


def run_search(scores: DataFrame, maps: DataFrame, *, stride: int, fchans: int,
               df_hz: float | None = None, far: float = FAR_QUANTILE, probe: int = 200,
               min_pool: int = MIN_OFF_POOL, seed: int = 0) -> DataFrame:
    """Whole search for all cadences at once: thresholds to judged, ranked candidates.

    ``scores``: cadence_idx, f_start, score. ``maps``: cadence_idx, f_start, obs_idx, cells.
    Only maps of cluster peaks and of the seeded probe are used; ``short_rank`` is NULL for
    candidates outside the short list, none is dropped.
    """
    key = ["cadence_idx"]
    win = ["cadence_idx", "f_start"]
    largest = scale.largest_group(scores, key)
    thr = cut(threshold_values(scores, key, far, largest))
    cand = cut(cluster_candidates(
        scale.meet(scores, thr.select("cadence_idx", "far_thresh"), key), key,
        F.col("score") > F.col("far_thresh"), stride, fchans, df_hz, largest))
    peaks_at = cand.select("cadence_idx", F.col("f_start_peak").alias("f_start"))
    peak_maps = scale.meet(maps, peaks_at, win, "left_semi")
    pool = off_cells(peak_maps).unionByName(background_probe(scores, maps, probe, seed))
    ceil = off_ceiling(pool, thr, min_pool).select("cadence_idx", "off_ceiling")
    judged_maps = scale.meet(peak_maps, ceil, key)
    contrast = on_off_contrast(judged_maps, win, thr="off_ceiling")
    full = full_row_hits(row_peaks(judged_maps, win, ["off_ceiling"]), F.col("off_ceiling")).drop(
        *[f"r{i}" for i in range(6)])
    out = scale.meet(cand.withColumn("f_start", F.col("f_start_peak")), thr.select("cadence_idx", "thresh_3", "thresh_5"), key)
    out = cut(scale.meet(scale.meet(out, contrast, win, "left"), full, win, "left").drop("f_start"))
    order = F.struct((-F.col("on_off_contrast")).alias("c"), F.col("f_start_peak").alias("f"))
    short = (out.filter("in_short_list").select("cadence_idx", order.alias("_o")))
    if largest > scale.HOT_GROUP_ROWS:
        short = scale.range_bucketed(short, ["_o"])
    else:
        short = short.withColumn("_rb", F.lit(0))
    ranked = scale.ordered_rank(short, key, ["_o"], F.col("_rb"), "short_rank", largest)
    return scale.meet(out, ranked.select("cadence_idx", F.col("_o.f").alias("f_start_peak"), "short_rank"),
                      ["cadence_idx", "f_start_peak"], "left")
