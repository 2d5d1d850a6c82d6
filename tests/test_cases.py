"""Hand-worked cases and error paths."""

import math

import pytest
from pyspark.sql import functions as F

from cadrift.functions import geometry, names
from cadrift.operators import catalog, evaluate, inject, pools, prepare, registry, scale, scoring, search, stats


def test_rawspec_names(spark):
    rows = [("blc00_guppi_60055_03921_MESSIER67_0055.rawspec.0000.h5",), ("blc00_guppi_60055_03921_A_B_0055.rawspec.0000.h5",),
            ("a_b_c.rawspec.0000.h5",), ("notes.txt",), ("blc01_guppi_60055_03921_X_0001.0002.h5",), ("blc01_guppi_6x_1_X_0001.0002.h5",)]
    r = names.parse_rawspec_name(spark.createDataFrame(rows, "name string")).collect()
    assert (r[0]["node"], r[0]["mjd_day"], r[0]["abs_time_s"], r[0]["target"], r[0]["scan_num"], r[0]["product"]) == (
        "blc00", 60055, 5188755921, "MESSIER67", "0055", "0000")
    assert r[1]["target"] == "A_B"
    assert r[2]["parse_error"] == "fewer than six parts: a_b_c" and r[2]["node"] is None
    assert r[3]["parse_error"] == "no product in the name: notes.txt"
    assert r[4]["product"] == "0002" and r[4]["parse_error"] is None
    assert r[5]["parse_error"] == "day or second is no number: 6x, 1"


def test_labelled_names(spark):
    rows = [("/d/blc_60055_100_TIC12_ON_1.0001.0000.h5",), ("/d/blc_60055_100_hip7_off.0000.hdf5",), ("/d/STAR_ON_x.0000.h5",), ("/d/STAR_ON_x.h5",)]
    r = names.parse_labelled_name(spark.createDataFrame(rows, "path string")).collect()
    assert (r[0]["target"], r[0]["obs_type"], r[0]["mjd"], r[0]["secs"], r[0]["product"]) == ("TIC12", "ON", "60055", 100, "0000")
    assert (r[1]["target"], r[1]["obs_type"]) == ("hip7", "OFF")
    assert (r[2]["target"], r[2]["mjd"], r[2]["secs"]) == ("STAR", "00000", 0)
    assert r[3]["target"] is None and r[3]["product"] is None


def test_sliding_windows(spark):
    df = spark.createDataFrame([(1, 2560), (2, 1000)], "i int, nchans int")
    got = [(r["i"], r["f_start"]) for r in geometry.sliding_windows(df, 1024, 512).collect()]
    assert got == [(1, 0), (1, 512), (1, 1024), (1, 1536)]


def test_core_transform(spark):
    x = [0.0, math.e - 1, math.e ** 2 - 1, -3.0]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(x[:3])], "frame int, t int, x double")
    got = [r["x"] for r in prepare.core_transform(df, ["frame"]).orderBy("t").collect()]
    assert got == pytest.approx([-1 / 1.000001, 0.0, 1 / 1.000001])
    neg = spark.createDataFrame([(0, 0, -3.0), (0, 1, 0.0)], "frame int, t int, x double")
    assert [r["x"] for r in prepare.core_transform(neg, ["frame"]).collect()] == [0.0, 0.0]


def test_gap_sessions(spark):
    df = spark.createDataFrame([(t,) for t in (0, 325, 1025, 1726)], "abs_time_s long")
    got = {r["abs_time_s"]: r["session_start"] for r in catalog.gap_sessions(df).collect()}
    assert got == {0: 0, 325: 0, 1025: 0, 1726: 1726}


@pytest.mark.parametrize("seq,on,off,n_on,n_off,pattern", [
    ("MAMBMC", "M", ["A", "B", "C"], 3, 3, "3 ON, 3 OFF of 3 targets"),
    ("ABAB", "A", ["B"], 2, 2, "2 ON, 2 OFF of 1 target"),
    ("ABC", None, ["A", "B", "C"], 0, 3, "no target repeats"),
    ("AA", "A", [], 2, 0, "2 ON, no OFF"),
    ("BAAB", "B", ["A"], 2, 2, "2 ON, 2 OFF of 1 target"),
])
def test_infer_on_off(spark, seq, on, off, n_on, n_off, pattern):
    df = spark.createDataFrame([(1, c, i, f"f{i}") for i, c in enumerate(seq)], "g int, target string, abs_time_s long, file string")
    r = catalog.infer_on_off(df, ["g"]).first()
    assert (r["on_target"], r["off_targets"], r["n_on"], r["n_off"], r["pattern"]) == (on, off, n_on, n_off, pattern)


def test_chunk_cadences(spark):
    df = spark.createDataFrame([(0, i, f"f{i:02d}") for i in range(14)], "k int, abs_time_s long, file string")
    rows, left = catalog.chunk_cadences(df, ["k"])
    assert rows.select("chunk").distinct().count() == 2 and rows.count() == 12
    assert left.first()["n_leftover"] == 2


@pytest.mark.parametrize("n,want", [(1, (1, 0, 0)), (2, (1, 0, 1)), (3, (2, 0, 1)), (5, (3, 0, 2)), (7, (3, 1, 3)), (10, (5, 1, 4))])
def test_allocate(spark, n, want):
    c = pools.allocate(F.lit(n), (0.5, 0.1, 0.4), (1, 0, 1 if n >= 2 else 0))
    r = spark.range(1).select(*[x.alias(p) for x, p in zip(c, pools.POOLS)]).first()
    assert (r["train"], r["val"], r["heldout"]) == want


def test_plan_snippets(spark):
    df = spark.createDataFrame([(0, 5), (1, 2), (2, 4), (3, 9)], "c long, avail long")
    got = {r["c"]: r["take"] for r in pools.plan_snippets(df, "c", "avail", 3, 7).collect()}
    assert got == {0: 3, 1: 2, 2: 2}


def test_split_leaves_one_in_train(spark):
    one = spark.createDataFrame([(1,)], "c long")
    assert [r["split"] for r in pools.fraction_split(one, "c", 0.2).collect()] == ["train"]
    two = spark.createDataFrame([(1,), (2,)], "c long")
    assert sorted(r["split"] for r in pools.fraction_split(two, "c", 0.9).collect()) == ["train", "val"]


def test_stratified_split_counts_and_coverage(spark):
    df = spark.createDataFrame([(i, i % 4, f"t{i % 5}") for i in range(103)], "cadence long, band long, target string")
    s = pools.stratified_split(df, ["band"], "cadence")
    for r in s.groupBy("band").pivot("pool").count().collect():
        n = r["train"] + r["val"] + r["heldout"]
        assert (r["train"], r["val"], r["heldout"]) in ((13, 3, 10), (13, 2, 11), (13, 2, 10), (12, 3, 10)), (n, r)
    fixed, _ = pools.repair_coverage(s, "target", "cadence")
    have = {(r["target"], r["pool"]) for r in fixed.select("target", "pool").distinct().collect()}
    assert all((f"t{i}", p) in have for i in range(5) for p in ("train", "heldout"))
    with pytest.raises(ValueError):
        pools.stratified_split(df, ["band"], "cadence", (0.6, 0.4, 0.0))


def test_robust_stats_value(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 100)], "x double")
    r = scale.robust_stats(df, [], "x").first()
    assert (r["median"], r["mad_sigma"]) == (3.0, 1.4826)


def test_effect_sizes(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 7.0), (0, 1.0), (0, 3.0)], "c int, x double")
    assert stats.cohens_d(df, [], "c", "x").first()["cohens_d"] == pytest.approx(2.8284, abs=1e-4)
    assert stats.eta_squared(df, [], "c", "x").first()["eta2"] == pytest.approx(0.8)
    assert stats.eta_squared(df.filter("c = 1"), [], "c", "x").first()["eta2"] is None


def _scores(spark, vals, step=512):
    return spark.createDataFrame([(0, i * step, float(v)) for i, v in enumerate(vals)], "cadence_idx int, f_start long, score double")


def test_cluster_candidates(spark):
    s = _scores(spark, [.5, 2, 3, .9, 1.5, 1.0])
    r = search.cluster_candidates(s, ["cadence_idx"], F.col("score") > 1, 512, 1024).orderBy(F.col("peak_score").desc()).collect()
    got = [(x["f_start_peak"], x["peak_score"], x["mean_score"], x["n_snippets"], x["f_start_first"], x["f_start_last"],
            x["cluster_width_channels"]) for x in r]
    assert got == [(1024, 3.0, 2.5, 2, 512, 1024, 1536), (2048, 1.5, 1.5, 1, 2048, 2048, 1024)]
    tie = search.cluster_candidates(_scores(spark, [2, 2]), ["cadence_idx"], F.col("score") > 1, 512, 1024).first()
    assert tie["f_start_peak"] == 0
    empty = search.cluster_candidates(s, ["cadence_idx"], F.col("score") > 99, 512, 1024)
    assert empty.count() == 0 and "cluster_width_channels" in empty.columns


@pytest.mark.parametrize("peaks,on,off,leak,short", [
    ((10, .5, 8, 4, 9, .4), 3, 1, False, True), ((10, 5, 8, 4, 9, .4), 3, 2, True, False), ((10, .5, .5, .5, .5, .5), 1, 0, False, False)])
def test_full_row_hits(spark, peaks, on, off, leak, short):
    m = spark.createDataFrame([(0, 0, i, [float(p), 0.0]) for i, p in enumerate(peaks)], "cadence_idx int, f_start int, obs_idx int, cells array<double>")
    r = search.full_row_hits(search.row_peaks(m, ["cadence_idx", "f_start"]), F.lit(1.0)).first()
    assert (r["n_on_hits_full"], r["n_off_hits_full"], r["off_leak"], r["in_short_list"]) == (on, off, leak, short)


def test_sigma_and_sweep_without_spread(spark):
    r = spark.range(1).select(search.sigma_of(F.lit(4.0), F.lit(1.0), F.lit(0.0)).alias("s")).first()
    assert r["s"] == 0.0
    flat = spark.createDataFrame([(1.0,)] * 9 + [(2.0,)], "score double")
    assert search.sigma_sweep(flat, 5).filter("n_above <> 1").count() == 0


def test_off_ceiling_small_pool(spark):
    pool = spark.createDataFrame([(0, 9.0)] * 5, "cadence_idx int, v double")
    thr = spark.createDataFrame([(0, 2.0), (1, 3.0)], "cadence_idx int, thresh_5 double")
    got = {r["cadence_idx"]: (r["n_pool"], r["off_ceiling"]) for r in search.off_ceiling(pool, thr).collect()}
    assert got == {0: (5, 2.0), 1: (0, 3.0)}


def test_nth_candidate_out_of_range(spark):
    c = search.cluster_candidates(_scores(spark, [2]), ["cadence_idx"], F.col("score") > 1, 512, 1024)
    assert search.nth_candidate(c, ["cadence_idx"], 1).count() == 1
    with pytest.raises(IndexError):
        search.nth_candidate(c, ["cadence_idx"], 2)
    with pytest.raises(ValueError):
        search.nth_candidate(c, ["cadence_idx"], 0)


@pytest.mark.parametrize("frac,k", [(0.01, 4), (0.02, 8)])
def test_top_k_count(spark, frac, k):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(384)), lambda i: i.cast("double")).alias("c"))
    got = df.select(scoring.top_k_mean(F.col("c"), frac).alias("s")).first()["s"]
    assert got == sum(range(384 - k + 1, 385)) / k
    rows = df.select(F.lit(0).alias("w"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("o"), "c").select(
        "w", F.slice("c", F.col("o") * 64 + 1, F.lit(64)).alias("cells"))
    assert scoring.reduce_maps(rows, ["w"], "topk", frac).first()["score"] == got


def test_auc_value(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0), (0, 1.0), (0, 2.0)], "y int, s double")
    assert evaluate.roc_auc(df, [], "y", "s").first()["auc"] == 0.875


def test_rank_among_incumbents(spark):
    inc = spark.createDataFrame([(0, x) for x in (5.0, 3.0, 3.0, 1.0)], "c int, contrast double")
    t = spark.createDataFrame([(0, 3.0, True), (0, 3.0, False), (1, 3.0, True)], "c int, contrast double, survives boolean")
    got = {(r["c"], r["survives"]): r["rank"] for r in evaluate.rank_among_incumbents(t, inc, ["c"]).collect()}
    assert got == {(0, True): 1, (0, False): -1, (1, True): 0}


def test_ks_known(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 3.0), (1, 4.0)], "c int, x double")
    assert stats.ks_two_sample(df, "c", "x").first()["d"] == 1.0


def test_validate_headers(spark):
    h = spark.createDataFrame([(0, 16, 5)] * 6 + [(1, 16, 5)] * 5 + [(1, 15, 5)] + [(2, 16, None)] * 6, "cadence_idx int, ntime int, nchans int")
    ok = {r["cadence_idx"]: r["valid"] for r in catalog.validate_shapes(h, 96).collect()}
    assert ok == {0: True, 1: False, 2: True}
    n = {r["cadence_idx"]: r["nchans"] for r in catalog.validate_nchans(h).collect()}
    assert n == {0: 5, 1: 5, 2: None}


def test_unknown_names_raise(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "cells array<double>")
    with pytest.raises(ValueError, match="recon"):
        registry.anomaly_score(df, "cells", "median")
    with pytest.raises(ValueError, match="max_pixel"):
        registry.apply_scorers(df, "cells", ["nope"])
    with pytest.raises(ValueError, match="linear"):
        inject.track("spiral")
    with pytest.raises(ValueError):
        scoring.reduce_maps(df, [], "median")
    with pytest.raises(ValueError):
        scoring.off_context_score(df, [], n_rows=4)


def test_registered_scorer_is_used(spark):
    registry.register("low", lambda x: F.array_min(x))
    try:
        df = spark.createDataFrame([([1.0, 2.0],)], "cells array<double>")
        assert registry.apply_scorers(df, "cells", ["low", "max_pixel"]).first()["low"] == 1.0
    finally:
        del registry.SCORERS["low"]


def test_band_geometry_nan_is_null(spark):
    h = spark.createDataFrame([(float("nan"), -0.5, 4, 2.0, 3), (100.0, -0.5, 4, 2.0, 3)], "fch1 double, foff double, nchans int, tsamp double, ntime int")
    a, b = geometry.band_geometry(h).collect()
    assert a["f_start_mhz"] is None and a["bw_mhz"] == 2.0
    assert (b["f_start_mhz"], b["f_stop_mhz"], b["duration_s"]) == (98.0, 100.0, 6.0)


def test_on_rows_cover_half_the_grid(spark):
    r = spark.range(384).select(geometry.on_role(F.floor(F.col("id") / 64)).alias("r"))
    assert r.filter("r = 'ON'").count() == 192
