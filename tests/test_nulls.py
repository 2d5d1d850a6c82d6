"""NULL keys, NULL positions, groups without values and NaN: one answer below and above the size switch."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadrift.operators import catalog, evaluate, inject, pools, prepare, scale, scoring, search, stats
from cadrift.sources import io
from tests.harness import norm

NAN = float("nan")
ROWS = [("a", 1, 3.0), ("a", 2, 1.0), ("a", 10, 2.0), ("a", None, 5.0), ("a", 11, NAN), (None, 1, 4.0), (None, 5, 6.0), (None, None, None),
        ("b", 3, None), ("b", 4, None), ("c", 7, NAN), ("d", 8, 1.0), ("d", 9, 1.0), ("d", 9, 1.0)]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], "k string, p long, x double, id long").repartition(3)


def same(monkeypatch, make):
    def take(df):
        return sorted((tuple(norm(v) for v in r) for r in df.collect()), key=str)
    few = take(make())
    monkeypatch.setattr(scale, "HOT_GROUP_ROWS", 1)
    monkeypatch.setattr(scale, "CELL", 1)
    assert take(make()) == few
    return few


def test_ranks_keep_null_keys_and_positions(monkeypatch, rows):
    out = same(monkeypatch, lambda: scale.ordered_rank(rows, ["k"], ["p", "id"], F.floor(F.col("p") / 4), largest=scale.largest_group(rows, ["k"])))
    assert len(out) == len(ROWS)


def test_chains(monkeypatch, rows):
    one = rows.filter("id <> 13")  # positions are unique per key here
    out = same(monkeypatch, lambda: scale.gap_chains(one, ["k"], "p", 2, 4, largest=scale.largest_group(one, ["k"])))
    assert len(out) == len(ROWS) - 1
    sessions = same(monkeypatch, lambda: catalog.gap_sessions(rows, "p", 2, ["k"]))
    assert len(sessions) == len(ROWS)


@pytest.mark.parametrize("keys", [["k"], []])
def test_quantiles(monkeypatch, rows, keys):
    out = same(monkeypatch, lambda: scale.exact_quantiles(rows, keys, "x", {"lo": 0.25, "mid": 0.5, "hi": 0.9}))
    assert len(out) == (5 if keys else 1)
    by = dict((r[0], r[1:]) for r in out) if keys else {}
    assert not keys or (by["b"] == (None, None, None) and by[None] == pytest.approx((4.5, 5.0, 5.8)) and by["d"] == (1.0, 1.0, 1.0))


def test_narrowing_ends_when_a_pass_changes_nothing(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 1, 2, 2, 3, 3)], "x double")
    assert scale.exact_quantiles(df, [], "x", {"m": 0.5}, limit=1).first()[0] == 2.0


def test_robust_stats_and_thresholds(monkeypatch, rows):
    assert len(same(monkeypatch, lambda: scale.robust_stats(rows, ["k"], "x"))) == 5
    scores = rows.filter("x IS NOT NULL AND NOT isnan(x)").withColumnRenamed("x", "score")
    assert {r[0] for r in same(monkeypatch, lambda: search.thresholds(scores, ["k"]))} == {"a", None, "d"}


@pytest.mark.parametrize("limit", [None, 1])
def test_noise_ceiling(rows, limit):
    got = {r.k: (r.n_pool, r.n_core, r.ceiling) for r in stats.off_noise_ceiling(rows, ["k"], "x", 0.5, limit=limit).collect()}
    assert got == {"a": (4, 4, 2.5), None: (2, 2, 5.0), "b": (0, 0, None), "c": (0, 0, None), "d": (3, 3, 1.0)}


def test_auc_and_split_keep_null_keys(spark, rows):
    labelled = rows.filter("x IS NOT NULL AND NOT isnan(x)").withColumn("y", F.pmod("id", F.lit(2)).cast("int"))
    assert {r.k for r in evaluate.roc_auc(labelled, ["k"], "y", "x").collect()} == {"a", None, "d"}
    assert pools.stratified_split(rows, ["k"], "id").count() == len(ROWS)


def windows(spark):
    """Two cadences, one of NULL key, with scores and six-row maps."""
    r = np.random.default_rng(4)
    scores, maps = [], []
    for c in ("a", None):
        for w in range(80):
            scores.append((c, w * 512, float(r.exponential() + (30 if w % 40 == 7 else 0))))
            maps += [(c, w * 512, o, [float(v) for v in np.abs(r.normal(size=8)) + (20 * (o % 2 == 0) if w % 40 == 7 else 0)]) for o in range(6)]
    return (spark.createDataFrame(scores, "cadence_idx string, f_start long, score double"),
            spark.createDataFrame(maps, "cadence_idx string, f_start long, obs_idx int, cells array<double>"))


def test_search_keeps_the_cadence_of_a_null_key(spark):
    scores, maps = windows(spark)
    found = search.run_search(scores, maps, stride=512, fchans=1024, far=0.95, probe=20).collect()
    by = {k: [r for r in found if r.cadence_idx == k] for k in ("a", None)}
    assert len(by["a"]) == len(by[None]) >= 2
    assert all(r.on_off_contrast is not None and r.n_on_hits_full == 3 for r in found if r.f_start_peak % (40 * 512) == 7 * 512)
    thr = search.threshold_values(scores, ["cadence_idx"])
    pool = search.background_probe(scores, maps, 30)
    assert {r.cadence_idx: r["count"] for r in pool.groupBy("cadence_idx").count().collect()} == {"a": 720, None: 720}
    ceil = search.off_ceiling(pool, thr)
    assert {(r.cadence_idx, r.n_pool) for r in ceil.collect()} == {("a", 720), (None, 720)}
    t = search.ceiling_with_fallback(thr, ceil).withColumn("map_thresh", F.lit(None).cast("double"))
    assert {r.ceiling_source for r in t.collect()} == {"measured"}
    both = {"a", None}
    assert {r.cadence_idx for r in search.fp_breakdown(scores).collect()} == both
    assert {r.cadence_idx for r in search.candidate_volume(scores, t, 512).filter("n_clusters_now > 0").collect()} == both
    load = search.review_load(scores, t, maps, 512, 1024).collect()
    assert {r.cadence_idx for r in load if r.n_covered} == both and all(r.below_map_thresh is None for r in load)
    cand = search.cluster_candidates(scale.meet(scores, thr, ["cadence_idx"]), ["cadence_idx"], F.col("score") > F.col("far_thresh"), 512, 1024)
    assert {r.cadence_idx: r.n_uncovered for r in search.map_coverage(cand, maps, ["cadence_idx"]).collect()} == {"a": 0, None: 0}


def test_frame_statistics_keep_the_frame_of_a_null_key(spark):
    r = np.random.default_rng(2)
    px = spark.createDataFrame([(f, o, t, c, float(r.exponential())) for f in ("a", None) for o in (0, 1) for t in range(4) for c in range(6)],
                               "frame string, obs_idx int, t long, ch long, x double")
    one = px.filter("obs_idx = 0")
    metrics = stats.rfi_metrics(one)
    for out in (metrics, stats.rfi_class(metrics), stats.channel_rfi_flags(one), stats.level_steps(px), scoring.frame_stats(one), prepare.bandpass_median(one),
                prepare.divide_by_baseline(one, prepare.polynomial_baseline(prepare.channel_medians(one), 6)), scoring.transient_snr(one, [0.0, 50.0], 1400.0 + F.col("ch"), 1400.0, 1e-3)):
        assert {x.frame for x in out.select("frame").distinct().collect()} == {"a", None}


def test_evaluation_keeps_methods_of_a_null_name(spark):
    r = np.random.default_rng(3)
    probe = spark.createDataFrame([(c, m, float(r.normal())) for m in ("m", None) for c in (1, None) for _ in range(30)], "cadence_idx long, method string, score double")
    hits = spark.createDataFrame([(c, m, s, float(r.normal() + 9)) for m in ("m", None) for c in (1, None) for s in (5.0, 30.0) for _ in range(4)],
                                 "cadence_idx long, method string, snr double, score double")
    calibration = scale.robust_stats(probe, ["method"], "score", names=("center", "spread"))
    assert {(x.method, x.snr) for x in evaluate.detection_table(hits, calibration, probe).collect()} == {(m, s) for m in ("m", None) for s in (5.0, 30.0)}
    per = evaluate.per_group_detection(hits, probe).collect()
    assert {x.method for x in per} == {"m", None} and all(x.n_injections == 8 for x in per)
    assert {x.method for x in evaluate.one_class_report(probe, hits, probe).collect()} == {"m", None}
    trials = hits.select("cadence_idx", "score", F.lit(3).alias("n_on_hits_full"), F.lit(True).alias("in_short_list"))
    cuts = search.threshold_values(probe, ["cadence_idx"]).withColumn("loose_thresh", F.lit(1.0)).withColumn("off_ceiling", F.lit(2.0))
    assert evaluate.stage_flags(trials, cuts).count() == trials.count()
    sites = inject.quiet_sites(probe.withColumn("f_start", F.monotonically_increasing_id()), 5)
    assert {x.cadence_idx: x["count"] for x in sites.groupBy("cadence_idx").count().collect()} == {1: 5, None: 5}


def test_repair_moves_rows_of_a_null_target(spark):
    df = spark.createDataFrame([("x", i, "val") for i in range(4)] + [(None, 10 + i, "val") for i in range(4)], "target string, cadence long, pool string")
    fixed, moves = pools.repair_coverage(df)
    have = {(r.target, r.pool) for r in fixed.collect()}
    assert {(t, p) for t in ("x", None) for p in ("train", "heldout")} <= have and moves.count() == 4


def test_chunks_of_a_missing_band(spark):
    files = spark.createDataFrame([(b, i * 60, f"f{i}", "t") for b in (None, 1.0) for i in range(8)], "band double, abs_time_s long, file string, target string")
    full, left = catalog.chunk_cadences(files, ["band"])
    assert full.count() == 12 and sorted(map(tuple, left.collect()), key=str) == [(1.0, 2), (None, 2)]


def test_survival_of_null_groups(spark):
    t = spark.createDataFrame([(5.0, "m", True), (5.0, None, False), (None, "m", True)], "snr double, morphology string, s boolean")
    got = sorted(map(tuple, evaluate.survival_cascade(t, ["s"], pooled="pooled").collect()), key=str)
    assert got == sorted([(5.0, "m", 100.0, False), (5.0, None, 0.0, False), (5.0, None, 50.0, True), (None, "m", 100.0, False), (None, None, 100.0, True)], key=str)


def test_unmeasured_gates_are_reported(spark):
    m = spark.createDataFrame([("matched_auc", 0.9), ("train_val_gap", -0.5)], "metric string, value double")
    got = {r.gate: r.passed for r in evaluate.acceptance_gates(m).collect()}
    assert got["B1"] is True and got["B4"] is False and len(got) == len(evaluate.GATES)
    assert all(v is None for g, v in got.items() if g not in ("B1", "B4"))


def test_scan_of_a_product_takes_both_endings(spark, tmp_path):
    for name in ("a.0000.h5", "b.0000.hdf5", "c.0001.h5"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "x.0000.h5d").mkdir()
    (tmp_path / "x.0000.h5d" / "d.0002.h5").write_bytes(b"x")
    got = [r.path.rsplit("/", 1)[-1] for r in io.scan_observations(spark, str(tmp_path), "0000").collect()]
    assert sorted(got) == ["a.0000.h5", "b.0000.hdf5"]


def test_one_forest_rule_gives_psi_rows_a_tree(spark):
    from cadrift.operators import learned
    df = spark.createDataFrame([(i, [float(x) for x in np.random.default_rng(i).normal(size=3)]) for i in range(3000)], "id long, vec array<double>")
    forest = learned.IsolationForest(trees=5, psi=32)
    assert [r["count"] for r in forest._subsamples(df, "vec", ["id"]).groupBy("tree").count().collect()] == [32] * 5
    assert not math.isnan(forest.fit(df).score(df).agg(F.avg("score")).first()[0])
