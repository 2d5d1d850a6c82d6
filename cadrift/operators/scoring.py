"""Scores of frames, maps and vectors with built-in functions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadrift.operators import scale


def frame_scores(px: DataFrame, frame: str = "frame") -> DataFrame:
    """max_pixel, peak_snr and mean energy per frame in one aggregate."""
    x = F.col("x")
    return px.groupBy(frame).agg(
        F.max(x).alias("max_pixel"), (F.max(x) / (F.stddev_pop(x) + 1e-9)).alias("peak_snr"),
        F.avg(x * x).alias("frame_energy"))


def top_energy(px: DataFrame, fraction: float = 0.01, frame: str = "frame") -> DataFrame:
    """Sum of the largest squares and its share of the total; k = max(1, int(fraction n))."""
    sq = px.select(frame, (F.col("x") * F.col("x")).alias("q"))
    s = scale.order_statistic(sq, [frame], "q", fraction)
    return s.select(frame, F.col("top_sum").alias("top_energy"),
                    (F.col("top_sum") / (F.col("total") + 1e-9)).alias("top_share"))


def frame_stats(px: DataFrame, frame: str = "frame") -> DataFrame:
    """Peakiness, excess kurtosis and energy share of the brightest 0.1 % of pixels.

    Moments are taken about the frame mean with population scaling, the std is floored by
    adding 1e-9 as in the peakiness.
    """
    mu = px.groupBy(frame).agg(F.avg("x").alias("_mu"), F.stddev_pop("x").alias("_sd"))
    m4 = F.avg(F.pow(F.col("x") - F.col("_mu"), F.lit(4)))
    base = scale.meet(px, mu, [frame]).groupBy(frame).agg(
        (F.max("x") / (F.max("_sd") + 1e-9)).alias("peakiness"),
        (m4 / F.pow(F.max("_sd") + 1e-9, F.lit(4)) - 3.0).alias("kurtosis"))
    return scale.meet(base, top_energy(px, 0.001, frame).select(frame, "top_share"), [frame])


def top_k_mean(cells: Column, frac: float) -> Column:
    """Mean of the k largest entries of an array, k = max(1, round half even(frac n))."""
    k = F.greatest(F.lit(1), F.bround(F.size(cells) * F.lit(frac), 0).cast("int"))
    top = F.slice(F.sort_array(cells, asc=False), F.lit(1), k)
    return F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / k


def array_mean(cells: Column) -> Column:
    return F.aggregate(cells, F.lit(0.0), lambda a, x: a + x) / F.size(cells)


METHODS = ("recon", "topk", "max")


def reduce_maps(maps: DataFrame, keys: Sequence[str], method: str = "topk",
                topk_frac: float = 0.02) -> DataFrame:
    """One score per map from its observation rows.

    A row keeps at most its own k best cells before the rows of a map meet, so only
    candidates for the top k are shuffled.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; choose from {', '.join(METHODS)}")
    if method == "recon":
        s = F.aggregate("cells", F.lit(0.0), lambda a, x: a + x)
        return maps.groupBy(*keys).agg((F.sum(s) / F.sum(F.size("cells"))).alias("score"))
    if method == "max":
        return maps.groupBy(*keys).agg(F.max(F.array_max("cells")).alias("score"))
    n_max = 6 * F.size("cells")
    k_row = F.greatest(F.lit(1), F.ceil(n_max * F.lit(topk_frac)).cast("int"))
    best = maps.select(*keys, F.size("cells").alias("n"),
                       F.slice(F.sort_array("cells", asc=False), F.lit(1), k_row).alias("best"))
    g = best.groupBy(*keys).agg(F.sum("n").alias("n"),  # six rows of one map
                                F.flatten(F.collect_list("best")).alias("best"))
    k = F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(topk_frac), 0).cast("int"))
    top = F.slice(F.sort_array("best", asc=False), F.lit(1), k)
    return g.select(*keys, (F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / k).alias("score"))


def mean_sq_diff(a, b) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(d, F.lit(0.0), lambda s, v: s + v) / F.size(d)


def disagreement(df: DataFrame, teacher: str, s1: str, s2: str,
                 weights: Sequence[float] = (0.5, 0.5, 0.5)) -> DataFrame:
    """st1, st2, ss and the fused disagreement of one cell's three feature vectors."""
    d = (df.withColumn("st1", mean_sq_diff(teacher, s1)).withColumn("st2", mean_sq_diff(teacher, s2))
         .withColumn("ss", mean_sq_diff(s1, s2)))
    return d.withColumn("cob", fuse("st1", "st2", "ss", weights))


def fuse(st1: str, st2: str, ss: str, weights: Sequence[float]) -> Column:
    return weights[0] * F.col(st1) + weights[1] * F.col(st2) + weights[2] * F.col(ss)


def fuse_arrays(st1, st2, ss, weights: Sequence[float]) -> Column:
    """Cell-wise fusion of three stored component maps, so weights can change without rescoring."""
    return F.transform(F.arrays_zip(F.col(st1).alias("a"), F.col(st2).alias("b"), F.col(ss).alias("c")),
                       lambda r: weights[0] * r["a"] + weights[1] * r["b"] + weights[2] * r["c"])


def recon_error(x, xhat, method: str = "recon", topk_frac: float = 0.02, mask=None) -> Column:
    """Squared error between two arrays: mean, top-k mean, or mean over a 0/1 mask."""
    sq = F.zip_with(x, xhat, lambda a, b: (a - b) * (a - b))
    if method == "recon":
        return array_mean(sq)
    if method == "topk":
        return top_k_mean(sq, topk_frac)
    if method == "masked":
        on = F.zip_with(sq, mask, lambda v, m: v * m)
        return (F.aggregate(on, F.lit(0.0), lambda a, v: a + v)
                / (F.aggregate(mask, F.lit(0.0), lambda a, v: a + v) + 1e-8))
    raise ValueError(f"unknown method {method!r}; choose from recon, topk, masked")


def hot_pixel_error(px: DataFrame, hot: float = 5.0, delta: float = 1.0,
                    frame: str = "frame") -> DataFrame:
    """Mean error over all pixels, hot pixels and changed pixels (columns x, xhat, clean)."""
    e = F.pow(F.col("x") - F.col("xhat"), F.lit(2))
    return px.groupBy(frame).agg(
        F.avg(e).alias("err"), F.avg(F.when(F.col("x") > hot, e)).alias("err_hot"),
        F.avg(F.when(F.abs(F.col("x") - F.col("clean")) > delta, e)).alias("err_signal"))


def batch_mean_mse(df: DataFrame, vec: str = "vec") -> DataFrame:
    """Squared distance of every vector from the mean vector of all rows."""
    mean = (df.select(F.posexplode(vec).alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m"))
            .agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("_m")))  # one per dimension
    j = scale.attach(df, mean.select(F.transform("_m", lambda r: r["m"]).alias("_mean")), [])
    return j.withColumn("mse", mean_sq_diff(vec, "_mean")).drop("_mean")


def whitened_distance(df: DataFrame, quiet: DataFrame, vec: str = "vec") -> DataFrame:
    """Distance from the quiet centroid in per-dimension sigmas (near-zero sigma counts as 1)."""
    from cadrift.operators.stats import packed_moments
    j = scale.attach(df, packed_moments(quiet, vec), [])
    z = F.transform(F.arrays_zip(F.col(vec).alias("x"), F.col("mu").alias("m"), F.col("sd").alias("s")),
                    lambda r: F.pow((r["x"] - r["m"]) / F.when(r["s"] < 1e-6, 1.0).otherwise(r["s"]), F.lit(2)))
    return j.withColumn("distance", F.sqrt(F.aggregate(z, F.lit(0.0), lambda a, v: a + v))).drop("mu", "sd")


def off_context_score(maps: DataFrame, keys: Sequence[str], n_rows: int = 6) -> DataFrame:
    """Mean squared error of ON cells predicted by the mean of the OFF cells in their column."""
    if n_rows < 6:
        raise ValueError(f"a map of {n_rows} rows has no ON/OFF grid of six observations")
    cells = maps.select(*keys, "obs_idx", F.posexplode("cells").alias("col", "v"))
    on = F.col("obs_idx") % 2 == 0
    # mean of (v - p)^2 over ON rows from sums, with p the OFF mean of the same column
    c = cells.groupBy(*keys, "col").agg(
        F.avg(F.when(~on, F.col("v"))).alias("p"), F.sum(F.when(on, F.col("v"))).alias("s"),
        F.sum(F.when(on, F.col("v") * F.col("v"))).alias("q"), F.count_if(on).alias("n"))
    err = F.col("q") - 2 * F.col("p") * F.col("s") + F.col("n") * F.col("p") * F.col("p")
    return c.filter("p IS NOT NULL AND n > 0").groupBy(*keys).agg((F.sum(err) / F.sum("n")).alias("score"))


def transient_snr(px: DataFrame, dms: Sequence[float], nu_mhz: Column, nu_ref: float, dt: float,
                  frame: str = "frame") -> DataFrame:
    """Peak of the dedispersed channel mean over the std of the undispersed one, per DM."""
    from cadrift.operators.prepare import dedisperse
    flat = px.groupBy(frame, "t").agg(F.avg("x").alias("y")).groupBy(frame).agg(
        F.stddev_pop("y").alias("_sd"))
    series = dedisperse(px, dms, nu_mhz, nu_ref, dt, frame)
    return scale.meet(series.groupBy(frame, "dm").agg(F.max("y").alias("peak")), flat, [frame]).select(
        frame, "dm", F.try_divide("peak", "_sd").alias("snr"))


def softmax_recall(pairs: DataFrame, key: str, slots: int, lam: float | None = None,
                   eps: float = 1e-12) -> DataFrame:
    """Sparse addressing weights per query from (key, slot, sim) rows: softmax, shrink, renorm.

    ``slots`` is the fixed memory size, so a query's group has that many rows.
    """
    lam = 1.0 / slots if lam is None else lam
    w = Window.partitionBy(key)
    top = pairs.withColumn("_e", F.exp(F.col("sim") - F.max("sim").over(w)))
    att = top.withColumn("_w", F.col("_e") / F.sum("_e").over(w))
    shrunk = att.withColumn("_s", F.greatest(F.col("_w") - lam, F.lit(0.0)) * F.col("_w")
                            / (F.abs(F.col("_w") - lam) + eps))
    return shrunk.withColumn("weight", F.col("_s") / (F.sum("_s").over(w) + eps)).drop("_e", "_w", "_s")


def norm(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x * x), F.lit(0.0), lambda s, v: s + v))


def slot_usage(weights: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """How often each slot wins a query (ties to the lower slot), per ``by``."""
    win = weights.groupBy(key, *by).agg(
        F.min(F.struct((-F.col("weight")).alias("w"), F.col("slot").alias("slot"))).alias("b"))
    return win.groupBy(*by, F.col("b.slot").alias("slot")).agg(F.count("*").alias("n_wins"))


def self_match_score(patches: DataFrame, snippet: str, n_groups: int, tau: float = 0.07,
                     temperature_pred: str = "pred", target: str = "target") -> DataFrame:
    """Per snippet: -log softmax of each masked patch's cosine to its own target.

    ``patches``: snippet, patch, pred, target. Group g keeps patches with
    patch % n_groups = g visible; the others are matched among themselves. The patches of a
    snippet (a fixed grid) travel together, and batches of snippets go through matrix products.
    Sums of exponentials are taken about the largest, so no similarity overflows.
    """
    def run(batches):
        for b in batches:
            rows = b.column("rows")
            flat, ends = rows.flatten(), np.append(0, np.cumsum(pc.list_value_length(rows).to_numpy()))
            patch = flat.field("patch").to_numpy()
            p, q = (flat.field(c).flatten().to_numpy().astype(np.float64).reshape(len(patch), -1) for c in ("p", "q"))
            p, q = (x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-12)[:, None] for x in (p, q))
            scores = []
            for i, j in zip(ends[:-1], ends[1:]):
                sims, means = p[i:j] @ q[i:j].T / tau, []
                for g in range(n_groups):
                    m = patch[i:j] % n_groups != g
                    if m.any():
                        z = sims[np.ix_(m, m)]
                        top = z.max(axis=1)
                        means.append((np.log(np.exp(z - top[:, None]).sum(axis=1)) + top - np.diag(z)).mean())
                scores.append(float(np.mean(means)) if means else None)
            yield pa.RecordBatch.from_arrays([b.column("_s"), pa.array(scores, pa.float64())], names=[snippet, "score"])

    packed = patches.groupBy(F.col(snippet).alias("_s")).agg(F.collect_list(F.struct(
        F.col("patch").cast("long").alias("patch"), F.col(temperature_pred).alias("p"), F.col(target).alias("q"))).alias("rows"))
    kind = patches.schema[snippet].dataType.simpleString()
    return packed.mapInArrow(run, f"`{snippet}` {kind}, score double").filter("score IS NOT NULL")
