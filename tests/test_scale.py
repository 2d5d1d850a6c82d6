"""The paths for groups too large for one task give the plain answers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cadrift.operators import evaluate, scale, stats
from tests.harness import compare

HOT = ["cnd1_thresholds", "cnd2_cluster_candidates", "cat1_gap_sessions", "cat6_chunk_cadences", "spl2_stratified_split",
       "samp1_plan_snippets", "scr3_top1pct_energy", "agg8_level_steps", "eval9_rank_among_incumbents", "join6_caliper_match",
       "cat12_coverage_report", "agg11_histogram"]


@pytest.mark.parametrize("name", HOT)
def test_hot_paths_match_oracle(spark, duck, sf_dir, name, monkeypatch):
    monkeypatch.setattr(scale, "HOT_GROUP_ROWS", 150)
    monkeypatch.setattr(scale, "CELL", 150)
    monkeypatch.setattr(evaluate, "CHAIN_ROWS", 20)
    problem, _, _ = compare(entry.queries()[name](spark, sf_dir), duck, entry.oracle_sql()[name])
    assert problem is None


def _skewed(spark, n=3000, ties=False, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n) ** 3
    if ties:
        x = np.round(x)
    key = np.where(rng.random(n) < 0.6, 0, rng.integers(1, 9, n))
    pdf = pd.DataFrame({"k": key, "x": x})
    return pdf, spark.createDataFrame(pdf).repartition(5)


@pytest.mark.parametrize("ties", [False, True])
def test_exact_quantiles_by_narrowing(spark, ties):
    pdf, df = _skewed(spark, ties=ties)
    probs = {"a": 0.0, "b": 0.1, "m": 0.5, "p": 0.99, "z": 1.0}
    got = scale.exact_quantiles(df, ["k"], "x", probs, limit=100).toPandas().set_index("k").sort_index()
    for name, p in probs.items():
        want = pdf.groupby("k")["x"].quantile(p)
        np.testing.assert_allclose(got[name].to_numpy(), want.to_numpy(), rtol=1e-12, atol=1e-12)


def test_global_quantile_by_narrowing(spark):
    pdf, df = _skewed(spark, seed=4)
    got = scale.exact_quantiles(df, [], "x", {"m": 0.5, "q": 0.975}, limit=100).first()
    np.testing.assert_allclose([got["m"], got["q"]], np.quantile(pdf["x"], [0.5, 0.975]), rtol=1e-12)


def test_robust_stats_both_ways(spark):
    pdf, df = _skewed(spark, seed=1)
    for limit in (100, 10_000):
        got = scale.robust_stats(df, ["k"], "x", limit=limit).toPandas().set_index("k").sort_index()
        med = pdf.groupby("k")["x"].median()
        mad = pdf.groupby("k")["x"].apply(lambda v: np.median(np.abs(v - np.median(v))) * 1.4826)
        np.testing.assert_allclose(got["median"], med, rtol=1e-12)
        np.testing.assert_allclose(got["mad_sigma"], mad, rtol=1e-12)


def clip_reference(x, q=0.999, iters=5, clip=3.0):
    inside = np.ones(len(x), bool)
    for _ in range(iters):
        mid = np.median(x[inside])
        s = 1.4826 * np.median(np.abs(x[inside] - mid))
        new = np.abs(x - mid) <= clip * s
        if s == 0 or new.sum() == inside.sum():
            break
        inside = new
    return np.quantile(x[inside], q), inside.sum()


def test_noise_ceiling_both_ways(spark):
    rng = np.random.default_rng(3)
    parts = {0: rng.normal(size=900) ** 3, 1: np.full(40, 5.0), 2: np.concatenate([rng.normal(size=300), rng.normal(60, 1, 50)]),
             3: np.array([7.0])}
    pdf = pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in parts.items()])
    df = spark.createDataFrame(pdf).repartition(4)
    for limit in (200, 10_000):
        got = stats.off_noise_ceiling(df, ["k"], "v", limit=limit).toPandas().set_index("k")
        for k, v in parts.items():
            want, n = clip_reference(v)
            assert got.loc[k, "ceiling"] == pytest.approx(want, rel=1e-12)
            assert got.loc[k, "n_core"] == n and got.loc[k, "n_pool"] == len(v)


@pytest.mark.parametrize("span", [50, 1000, 10**9])
def test_gap_chains_across_buckets(spark, span):
    rng = np.random.default_rng(5)
    pos = np.unique(rng.integers(0, 20_000, 1500))
    pdf = pd.DataFrame({"k": rng.integers(0, 2, len(pos)), "p": pos})
    got = scale.gap_chains(spark.createDataFrame(pdf).repartition(3), ["k"], "p", 10, span).toPandas().sort_values(["k", "p"])
    want = []
    for _, g in pdf.sort_values(["k", "p"]).groupby("k"):
        start = g["p"].where(g["p"].diff().fillna(11) > 10).ffill()
        want.extend(start.astype(int))
    assert got["chain_start"].tolist() == want


def test_running_sum_and_rank_over_buckets(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 500), "o": rng.permutation(500), "v": rng.integers(0, 9, 500)})
    df = spark.createDataFrame(pdf)
    got = scale.running_sum(df, ["k"], ["o"], F.floor(F.col("o") / 37), {"s": "v"}).toPandas().sort_values(["k", "o"])
    s = pdf.sort_values(["k", "o"])
    assert got["s"].tolist() == s.groupby("k")["v"].cumsum().tolist()
    r = scale.hash_rank(df, ["k"], 1, ["o"], digits=1).toPandas()
    for _, g in r.groupby("k"):
        assert sorted(g["rank"]) == list(range(1, len(g) + 1))


def test_order_statistic_with_ties(spark):
    df = spark.createDataFrame([(0, float(v)) for v in [5, 5, 5, 4, 4, 1, 0, 0, 0, 0]], "k int, x double")
    r = scale.order_statistic(df, ["k"], "x", 0.2).first()
    assert (r["n_taken"], r["n_values"], r["top_sum"], r["total"]) == (2, 10, 10.0, 24.0)


def _match(spark, a, b, caliper):
    mk = lambda v: spark.createDataFrame(pd.DataFrame({"id": np.arange(len(v)), "v": v}))
    return evaluate.caliper_match(mk(a), mk(b), caliper).toPandas()


@pytest.mark.parametrize("seed,kind", [(0, "uniform"), (1, "ties"), (2, "shifted")])
def test_caliper_match_properties(spark, seed, kind):
    rng = np.random.default_rng(seed)
    a, b = rng.uniform(0, 3, 120), rng.uniform(0, 3, 200)
    if kind == "ties":
        a, b = np.round(a, 1), np.round(b, 1)
    if kind == "shifted":
        a, b = np.round(rng.uniform(0, 20, 150), 2), np.round(rng.uniform(0, 20, 150), 2)
    caliper = 0.05
    p = _match(spark, a, b, caliper)
    assert p["a_id"].is_unique and p["b_id"].is_unique
    assert ((p["a_v"] - p["b_v"]).abs() <= caliper + 1e-12).all()
    left_a = np.delete(a, p["a_id"].to_numpy(int))
    left_b = np.delete(b, p["b_id"].to_numpy(int))
    if len(left_a) and len(left_b):  # maximal: nothing within the caliper is left on both sides
        assert np.abs(left_a[:, None] - left_b[None, :]).min() > caliper


@pytest.mark.parametrize("name,most", [("prj16_bandpass_polynomial", 8), ("join7_adaptive_caliper", 40)])
def test_few_jobs_before_a_query_runs(spark, sf_dir, name, most):
    group = f"jobs-{name}"
    spark.sparkContext.setJobGroup(group, name)
    try:
        entry.queries()[name](spark, sf_dir)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= most
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("spread", [0.02, 3.0])
def test_chains_match_as_the_passes_do(spark, spread):
    r = np.random.default_rng(5)
    side = lambda n: [(f"k{r.integers(10**6)}-{i}", None if i % 40 == 3 else float("nan") if i % 40 == 5 else float(np.round(r.normal() * spread, 3))) for i in range(n)]
    a, b = (spark.createDataFrame(side(n), "id string, v double") for n in (150, 230))
    found = [sorted(map(tuple, evaluate.caliper_pairs(a, b, [0.05, 0.01], chain_rows=n).collect())) for n in (1 << 20, 40, 0)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 20
    for c in (0.05, 0.01):
        pairs = [p for p in found[0] if p[0] == c]
        assert all(abs(p[2] - p[4]) <= c for p in pairs)
        assert len({p[1] for p in pairs}) == len({p[3] for p in pairs}) == len(pairs)


@pytest.mark.parametrize("cell", [1, 7, 1 << 16])
def test_radix_selection_of_all_kinds_of_doubles(spark, cell):
    r = np.random.default_rng(8)
    v = [0.0, -0.0, 1.0, np.inf, -np.inf, np.nan, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, np.nextafter(2, 0), np.nextafter(8, 9)]
    v += list(np.ldexp(r.normal(size=300), r.integers(-1070, 1000, 300))) + [3.5] * 50
    df = spark.createDataFrame([(k, float(x)) for k in ("a", None) for x in v] + [("a", None)], "k string, x double")
    rows = scale.ordered_bits(df.select(scale.group_key(["k"]).alias("_k"), "x"), "x", "_o").select("_k", "_o").filter("_o IS NOT NULL")
    ranks = rows.select("_k").distinct().withColumn("_n", F.lit(len(v)).cast("long")).withColumn("_r", F.explode(F.array(*[F.lit(i).cast("long") for i in range(0, len(v), 7)])))
    got = {(x._k.k, x._r): x._v for x in scale.values_at_ranks(rows, ranks, cell).collect()}
    want = np.sort(np.array(v))
    assert len(got) == 2 * len(range(0, len(v), 7))
    assert all(g == want[i] or (np.isnan(g) and np.isnan(want[i])) for (_, i), g in got.items())
