"""Array kernels and fitted scorers against independent NumPy."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from numpy.polynomial import Polynomial
from pyspark.sql import functions as F

from cadrift.operators import inject, kernels, learned, prepare, stats


def poly_reference(m, deg=3):
    x = np.linspace(-1, 1, len(m))
    keep = np.ones(len(m), bool)
    p = Polynomial.fit(x, m, deg)
    for _ in range(3):
        r = m - p(x)
        s = np.std(r[keep])
        if s == 0:
            break
        keep = np.abs(r) <= 3 * s
        if keep.sum() < deg + 1:
            break
        p = Polynomial.fit(x[keep], m[keep], deg)
    return p(x)


def frame_reference(x, method="polynomial"):
    m = np.median(x, axis=0)
    b = poly_reference(m) if method == "polynomial" else m
    y = np.log1p(np.clip(x / np.maximum(b, b.max() * 1e-4 + 1e-10), 0, None))
    med = np.median(y)
    return (y - med) / (np.median(np.abs(y - med)) + 1e-6)


@pytest.fixture(scope="module")
def stepped():
    rng = np.random.default_rng(0)
    gain = np.array([1, 1.6, 1, 1.6, 1, 1.6])[:, None, None]
    return rng.normal(10, 1, (6, 16, 256)) * gain * (1 + 0.3 * np.linspace(-1, 1, 256) ** 2)


def test_baseline_with_outliers():
    rng = np.random.default_rng(1)
    m = rng.normal(10, 0.1, (5, 300)) + np.linspace(-1, 1, 300) ** 3
    m[1, 40:60] += 30
    m[2] = 4.0
    m[3, ::7] += 5
    got = kernels.fit_baseline(m, 3)
    for i in range(5):
        np.testing.assert_allclose(got[i], poly_reference(m[i]), rtol=1e-6)


def _frames(spark, x):
    pdf = pd.DataFrame({"cadence_idx": 0, "f_start": 0, "obs_idx": range(len(x)), "frame": [f.ravel().astype(np.float32) for f in x]})
    return spark.createDataFrame(pdf, "cadence_idx long, f_start long, obs_idx long, frame array<float>").repartition(3)


def test_normalisation_modes(spark, stepped):
    x = stepped.astype(np.float32).astype(float)
    per = np.array(kernels.normalised_frames(_frames(spark, x), 16, 256).first()["frame"]).reshape(96, 256)
    np.testing.assert_allclose(per, np.concatenate([frame_reference(f) for f in x]), atol=2e-4, rtol=1e-4)
    legacy = np.array(kernels.normalised_frames(_frames(spark, x), 16, 256, "legacy_concat").first()["frame"]).reshape(96, 256)
    np.testing.assert_allclose(legacy, frame_reference(np.concatenate(x)), atol=2e-4, rtol=1e-4)
    assert not np.allclose(per, legacy, atol=0.05)
    med = np.median(per.reshape(6, -1), axis=1)
    assert np.ptp(med) < 0.1 < np.ptp(np.median(legacy.reshape(6, -1), axis=1))
    with pytest.raises(ValueError):
        kernels.normalised_frames(_frames(spark, x), 16, 256, "other")


def test_malformed_observation_drops_its_window(spark, stepped):
    short = _frames(spark, stepped).withColumn("frame", F.when(F.col("obs_idx") == 2, F.slice("frame", 1, 100)).otherwise(F.col("frame")))
    assert kernels.normalised_frames(short, 16, 256).count() == 0


def test_long_and_array_baselines_agree(spark, stepped):
    x = stepped[:2]
    rows = [(i, t, c, float(x[i, t, c])) for i in range(2) for t in range(16) for c in range(256)]
    px = spark.createDataFrame(pd.DataFrame(rows, columns=["frame", "t", "ch", "x"]))
    b = prepare.polynomial_baseline(prepare.channel_medians(px), 256).toPandas().sort_values(["frame", "ch"])
    want = np.concatenate([poly_reference(np.median(f, axis=0)) for f in x])
    np.testing.assert_allclose(b["b"], want, rtol=1e-6)


def test_patch_round_trip(spark, stepped):
    f = _frames(spark, stepped)
    p = f.withColumn("p", kernels.patchify("frame", 16, 256, 4, 16)).withColumn("back", kernels.unpatchify("p", 16, 256, 4, 16))
    r = p.filter("obs_idx = 1").first()
    assert r["back"] == r["frame"]
    np.testing.assert_array_equal(np.array(r["p"][64:128]).reshape(4, 16), stepped[1].astype(np.float32)[:4, 16:32])


def test_assemble_windows_matches_join(spark):
    rows = [(c, 0, t, b, [float(c * 1000 + t * 500 + b)] * 2) for c in range(2) for t in range(2) for b in range(200) if b != 77]
    s = spark.createDataFrame(rows, "cadence_idx long, obs_idx long, time_bin long, block long, power array<float>")
    a = kernels.assemble_windows(s, 2).toPandas().sort_values(["cadence_idx", "time_bin", "f_start"])
    j = kernels.adjacent_blocks(s).select("cadence_idx", "time_bin", (F.col("block") * 2).alias("f_start"),
                                          F.concat("power", "next_power").alias("power")).toPandas().sort_values(["cadence_idx", "time_bin", "f_start"])
    assert len(a) == 2 * 2 * (198 - 1) and a["f_start"].tolist() == j["f_start"].tolist()
    np.testing.assert_array_equal(np.stack(a["power"]), np.stack(j["power"]))


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8)) @ rng.normal(size=(8, 8))
    x[:3] += 40
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(4)


def test_covariance_and_shrinkage(cloud):
    x, df = cloud
    n, mean, cov = stats.covariance(df)
    np.testing.assert_allclose(cov, np.cov(x.T), rtol=1e-9)
    m, inv, s = learned.fit_mahalanobis(df)
    c = x - x.mean(0)
    emp = c.T @ c / len(x)
    mu = np.trace(emp) / 8
    beta = ((np.einsum("bi,bj->bij", c, c) - emp) ** 2).sum() / len(x) ** 2
    want = min(beta / ((emp - mu * np.eye(8)) ** 2).sum(), 1)
    assert s == pytest.approx(want, rel=1e-9)
    d = learned.mahalanobis(df, (m, inv, s)).toPandas().sort_values("id")["distance"].to_numpy()
    p = np.linalg.inv((1 - want) * emp + want * mu * np.eye(8))
    np.testing.assert_allclose(d, np.sqrt(np.einsum("bi,ij,bj->b", c, p, c)), rtol=1e-9)


def test_isolation_forest(spark, cloud, tmp_path):
    x, df = cloud
    f = learned.IsolationForest(trees=60, psi=64)
    with pytest.raises(RuntimeError):
        f.score(df)
    s = f.fit(df).score(df).toPandas().sort_values("id")["score"].to_numpy()
    assert set(np.argsort(-s)[:3]) == {0, 1, 2} and s.max() > 0 > np.median(s)
    f.save(spark, str(tmp_path / "forest"))
    again = learned.IsolationForest.load(spark, str(tmp_path / "forest")).score(df.repartition(1)).toPandas().sort_values("id")["score"]
    np.testing.assert_array_equal(again, s)


def test_forest_subsamples_a_big_table(spark):
    df = spark.range(20_000).select("id", F.array(F.rand(1), F.rand(2)).alias("vec"))
    f = learned.IsolationForest(trees=5, psi=32)
    n = f._subsamples(df, "vec", ["id"]).groupBy("tree").count().collect()
    assert sorted((r["tree"], r["count"]) for r in n) == [(i, 32) for i in range(5)]


def test_mixture_ranks_outliers(cloud):
    x, df = cloud
    m = learned.MixtureDensity(2)
    with pytest.raises(RuntimeError):
        m.score(df)
    s = m.fit(df.filter("id >= 3")).score(df).toPandas().sort_values("id")["score"].to_numpy()
    assert set(np.argsort(-s)[:3]) == {0, 1, 2}


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(3, 2, (300, 5))
    y = x @ rng.normal(size=(5, 3)) + rng.normal(size=(300, 3))
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "id long, x array<double>, y array<double>").repartition(3)
    r = learned.ridge_residual(df, learned.fit_ridge(df, "x", "y", 2.0), "x", "y").toPandas().sort_values("id")["residual"]
    u = np.c_[(x - x.mean(0)) / (x.std(0) + 1e-6), np.ones(300)]
    t = (y - y.mean(0)) / (y.std(0) + 1e-6)
    w = np.linalg.solve(u.T @ u + 2 * np.eye(6), u.T @ t)
    np.testing.assert_allclose(r, ((t - u @ w) ** 2).mean(1), rtol=1e-8)


def test_pca_residual(cloud):
    x, df = cloud
    r = learned.pca_residual(df, learned.fit_pca(df, 3)).toPandas().sort_values("id")["residual"].to_numpy()
    c = x - x.mean(0)
    v = np.linalg.svd(c, full_matrices=False)[2][:3]
    np.testing.assert_allclose(r, ((c - c @ v.T @ v) ** 2).mean(1), rtol=1e-6, atol=1e-9)


def test_memory_is_sparse_and_recalls_prototypes(spark):
    slots = np.eye(8) * 6
    df = spark.createDataFrame([(i, (slots[i % 8]).tolist()) for i in range(16)], "id long, vec array<double>")
    r = learned.prototype_memory(df, slots).toPandas()
    w = np.stack(r["weights"].to_numpy())
    assert (w > 0).sum(axis=1).max() == 1 and r["residual"].max() < 1e-9


# ------------------------------------------------------------------ injection

SMALL = inject.SiteParams(fchans=256, tchans=96, n_obs=6)


def _background(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(10, 0.1, (6, 16, 256))
    i = np.indices(x.shape).reshape(3, -1)
    pdf = pd.DataFrame({"cadence_idx": 0, "f_start": 0, "obs_idx": i[0], "t": i[1], "ch": i[2], "x": x.ravel()})
    return spark.createDataFrame(pdf).repartition(4)


def _site(spark, kind, snr=20.0, seed=0):
    s = spark.createDataFrame([(0, 0, float(snr))], "cadence_idx long, f_start long, snr double")
    return inject.sample_site_params(s, kind, SMALL, seed)


@pytest.mark.parametrize("kind", list(inject.TRACKS))
def test_injection_invariants(spark, kind):
    px = _background(spark)
    quiet = inject.inject_track(px, _site(spark, kind, 5), kind, SMALL).toPandas()
    loud = inject.inject_track(px, _site(spark, kind, 50), kind, SMALL).toPandas()
    for r in (quiet, loud):
        off = r[r["obs_idx"] % 2 == 1]
        assert (off["x"] == off["clean"]).all()
        assert (r["x"] >= r["clean"]).all() and np.isfinite(r["x"]).all()
    k = ["obs_idx", "t", "ch"]
    m = quiet.merge(loud, on=k)
    dq, dl = m["x_x"] - m["clean_x"], m["x_y"] - m["clean_y"]
    np.testing.assert_allclose(dl, 10 * dq, rtol=1e-6, atol=1e-9)
    assert dl.sum() > dq.sum() > 0


@pytest.mark.parametrize("kind", ["linear", "quadratic", "sine"])
def test_tracks_stay_in_band(spark, kind):
    s = spark.range(64).select(F.col("id").alias("cadence_idx"), F.lit(0).alias("f_start"), F.lit(10.0).alias("snr"))
    p = inject.sample_site_params(s, kind, SMALL, 3)
    tau = F.explode(F.sequence(F.lit(0), F.lit(95))).alias("b")
    c = p.select("*", tau).select(inject.track_channel(kind, F.col("b") * SMALL.dt_s, SMALL).alias("c"))
    r = c.agg(F.min("c").alias("lo"), F.max("c").alias("hi")).first()
    assert r["lo"] >= -1 and r["hi"] <= SMALL.fchans
    same = inject.sample_site_params(s.repartition(7), kind, SMALL, 3).orderBy("cadence_idx").collect()
    assert same == p.orderBy("cadence_idx").collect()


def test_drift_direction(spark):
    s = _site(spark, "linear").withColumn("drift_hz_s", F.lit(0.2)).withColumn("start_ch", F.lit(20))
    c = s.select(inject.track_channel("linear", F.lit(0.0), SMALL).alias("a"), inject.track_channel("linear", F.lit(500.0), SMALL).alias("b")).first()
    assert c["b"] > c["a"]


def test_shared_sums_are_those_of_every_trial_alone():
    r = np.random.default_rng(9)
    for channels, bins in ((1, 5), (2, 7), (13, 32), (64, 50)):
        x = r.normal(size=(channels, bins))
        shifts = np.rint(np.outer(np.linspace(0, 40, 31), np.linspace(1, 0, channels) ** 2)).astype(int)
        want = np.array([sum(np.roll(x[c], -s[c]) for c in range(channels)) for s in shifts])
        assert np.allclose(prepare.shared_sums(x, shifts), want)


def test_dedispersion_of_frames_with_holes(spark):
    r = np.random.default_rng(11)
    dms = [0.0, 3.0, 10.0, 10.5, 40.0]
    rows = [(f, t, c, None if r.random() < 0.1 else float(r.normal())) for f in (1, None) for t in range(12) for c in range(9) if r.random() < 0.8]
    px = spark.createDataFrame(rows, "frame long, t long, ch long, x double").repartition(3)
    got = {(x.frame, x.dm, x.t): x.y for x in prepare.dedisperse(px, dms, 1200.0 + 20 * F.col("ch"), 1400.0, 1e-2).collect()}
    want = {}
    for f in (1, None):
        nt = 1 + max(t for g, t, _, _ in rows if g == f)
        for d in dms:
            for g, t, c, x in rows:
                if g == f:
                    shift = int(np.rint(prepare.DISPERSION * d * ((1200.0 + 20 * c) ** -2.0 - 1400.0 ** -2) / 1e-2))
                    want.setdefault((f, d, (t - shift) % nt), []).append(x)
    mean = lambda v: float(np.mean(v)) if v else None
    want = {k: mean([x for x in v if x is not None]) for k, v in want.items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) if want[k] is not None else got[k] is None for k in want)


def test_frame_scorer_of_a_large_mean(spark):
    from cadrift.operators import registry
    x = np.random.default_rng(1).normal(size=500) + 1e6
    got = registry.apply_scorers(spark.createDataFrame([(x.tolist(),)], "x array<double>"), "x", ["peak_snr"]).first().peak_snr
    assert got == pytest.approx(x.max() / (x.std() + 1e-9), rel=1e-9)


def test_fold_models_are_those_of_each_training_set(spark):
    from cadrift.operators import evaluate
    r = np.random.default_rng(6)
    x = r.normal(size=(400, 3)) * [1, 50, 0.01] + [0, 1000, 5]
    y = (r.random(400) < 1 / (1 + np.exp(-(x[:, 0] + (x[:, 1] - 1000) / 50)))).astype(int)
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(400)] + [(1000, None, 0.0, 0.0, 0.0), (1001, 1, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, label int, a double, b double, c double").repartition(3)
    written, models = evaluate.fold_models(df, ["a", "b", "c"], "label", ["id"], 4)
    t = written.toPandas()
    assert len(t) == 400 and sorted(models) == [0, 1, 2, 3]
    aucs = []
    for f in range(4):
        tr, te = t[t.fold != f], t[t.fold == f]
        mu, sd = tr[["x0", "x1", "x2"]].mean().to_numpy(), tr[["x0", "x1", "x2"]].std().to_numpy()
        z = np.column_stack([np.ones(len(tr)), (tr[["x0", "x1", "x2"]].to_numpy() - mu) / sd])
        w = np.zeros(4)
        for _ in range(30):
            p = 1 / (1 + np.exp(-z @ w))
            w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z, z.T @ (tr.label.to_numpy() - p))
        assert np.allclose(models[f]["w"], w[1:], atol=1e-6) and np.allclose(models[f]["mean"], mu) and np.allclose(models[f]["sd"], sd)
        s = ((te[["x0", "x1", "x2"]].to_numpy() - mu) / sd) @ w[1:]
        pos, neg = s[te.label == 1], s[te.label == 0]
        aucs.append(((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2))
    got = evaluate.cv_logistic_auc(df, ["a", "b", "c"], k=4).first()
    assert got.auc == pytest.approx(np.mean(aucs), abs=1e-9) and got.n_folds == 4


def test_frames_leave_in_small_batches():
    """A large batch is neither converted nor answered whole."""
    frames = pa.array([[float(k), 1.0, 2.0, 3.0] for k in range(1000)], pa.list_(pa.float32()))
    out = list(kernels.steps((2, 2), lambda x: x + 1)(iter([frames.slice(0, 0), frames.slice(3)])))
    assert max(map(len, out)) <= kernels.FRAMES_PER_STEP
    assert sum((b.to_pylist() for b in out), []) == [[k + 1.0, 2.0, 3.0, 4.0] for k in range(3, 1000)]
    for odd in ([[1.0, 2.0], [1.0] * 6], [None, [1.0] * 4]):
        with pytest.raises(ValueError, match="shape"):
            list(kernels.steps((2, 2), lambda x: x)(iter([pa.array(odd, pa.list_(pa.float32()))])))
