"""Distribution statistics over long tables. All accept groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadrift.operators import scale
from cadrift.session import cut


def off_noise_ceiling(pool: DataFrame, keys: Sequence[str], value: str, quantile: float = 0.999,
                      iters: int = 5, clip: float = 3.0, limit: int | None = None) -> DataFrame:
    """Quantile of what iterated median/MAD clipping leaves, per key.

    The survivors of a round are those within ``width`` of ``center``, so the state carried
    between rounds is one small row per key, never a mask. A round that finds no spread, or
    keeps as many values as before, ends a key without taking effect. NULL and NaN are not
    counted; a key without other values has a NULL ceiling.
    """
    keys = list(keys)
    x = F.col(value).cast("double")
    pool = cut(pool.select(scale.group_key(keys).alias("_k"), F.when(~F.isnan(x), x).alias("_x")))
    largest = scale.largest_group(pool, ["_k"])
    named = [F.col("_k").getField(k).alias(k) for k in keys]
    if largest <= (scale.HOT_GROUP_ROWS if limit is None else limit):  # 16 MB of doubles at most
        key = pool.schema["_k"].dataType.simpleString()
        out = pool.groupBy("_k").applyInArrow(_ceiling_kernel(quantile, iters, clip), f"_k {key}, n_pool long, n_core long, ceiling double")
        return out.select(*named, "n_pool", "n_core", "ceiling")
    own = ["_k"]
    state = cut(pool.groupBy(*own).agg(
        F.count("_x").alias("n_pool"), F.count("_x").alias("kept"), F.lit(0.0).alias("center"),
        F.lit(float("inf")).alias("width"), (F.count("_x") == 0).alias("done")))

    def inside(s: DataFrame) -> DataFrame:
        return pool.join(s, own).filter(F.abs(F.col("_x") - F.col("center")) <= F.col("width"))

    for _ in range(iters):
        live = state.filter(~F.col("done")).select(*own, "center", "width")
        core = cut(scale.robust_stats(inside(live), own, "_x", limit=limit, largest=largest))
        fits = F.abs(F.col("_x") - F.col("median")) <= clip * F.col("mad_sigma")
        again = pool.join(core, own).groupBy(*own).agg(F.count_if(fits).alias("_m"))
        stop = F.col("done") | (F.col("mad_sigma") == 0) | (F.col("_m") == F.col("kept"))

        def upd(new: Column, old: str) -> Column:
            return F.when(stop, F.col(old)).otherwise(new).alias(old)

        state = cut(state.join(core, own, "left").join(again, own, "left").select(
            *own, "n_pool", upd(F.col("_m"), "kept"), upd(F.col("median"), "center"),
            upd(clip * F.col("mad_sigma"), "width"), stop.alias("done")))
        if state.filter(~F.col("done")).isEmpty():
            break
    top = scale.exact_quantiles(inside(state.select(*own, "center", "width")), own, "_x",
                                {"ceiling": quantile}, limit, largest)
    return state.select(*own, "n_pool", F.col("kept").alias("n_core")).join(top, own, "left").select(*named, "n_pool", "n_core", "ceiling")


def _ceiling_kernel(quantile: float, iters: int, clip: float):
    """The same rule on the values of one group, sorted once: survivors are a slice of them."""
    def middle(v: np.ndarray) -> float:
        return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2

    def run(group: pa.Table) -> pa.Table:
        x = group.column("_x").combine_chunks().drop_null().to_numpy()
        x = np.sort(x)
        core = x
        for _ in range(iters):
            if not len(core):
                break
            mid = middle(core)
            width = middle(np.sort(np.abs(core - mid))) * 1.4826
            kept = x[np.abs(x - mid) <= clip * width]
            if width == 0 or len(kept) == len(core):
                break
            core = kept
        top = None
        if len(core):
            h = (len(core) - 1) * quantile
            lo = int(h)
            top = float(core[lo] + (core[min(lo + 1, len(core) - 1)] - core[lo]) * (h - lo))
        return pa.table({"_k": group.column("_k").slice(0, 1), "n_pool": [len(x)], "n_core": [len(core)], "ceiling": pa.array([top], pa.float64())})
    return run


def _long_moments(px: DataFrame, by: str, frame: str, value: str) -> DataFrame:
    """Population std, per frame, of the means over ``by``."""
    return (px.groupBy(frame, by).agg(F.avg(value).alias("_m"))
            .groupBy(frame).agg(F.stddev_pop("_m").alias("sd")))


def rfi_metrics(px: DataFrame, lo: float = 5.0, hi: float = 10.0, frame: str = "frame") -> DataFrame:
    """Per frame: maximum, 99th percentile, hot shares, spread of column and row means."""
    base = px.groupBy(frame).agg(
        F.max("x").alias("max_val"), F.avg((F.col("x") > lo).cast("int")).alias("hot_frac_lo"),
        F.avg((F.col("x") > hi).cast("int")).alias("hot_frac_hi"))
    p99 = scale.exact_quantiles(px, [frame], "x", {"p99": 0.99})
    col = _long_moments(px, "ch", frame, "x").withColumnRenamed("sd", "col_mean_std")
    row = _long_moments(px, "t", frame, "x").withColumnRenamed("sd", "row_mean_std")
    return scale.meet(scale.meet(scale.meet(base, p99, [frame]), col, [frame]), row, [frame])


def rfi_class(metrics: DataFrame) -> DataFrame:
    """Adds class (strong, mild, clean) and the line-like and burst-like flags."""
    q = scale.exact_quantiles(metrics, [], "col_mean_std", {"_pc": 0.9})
    q2 = scale.exact_quantiles(metrics, [], "row_mean_std", {"_pr": 0.9})
    m = scale.attach(scale.attach(metrics, q, []), q2, [])
    return (m.withColumn("rfi_class", F.when(F.col("hot_frac_hi") > 0, "strong")
                         .when(F.col("hot_frac_lo") > 0, "mild").otherwise("clean"))
            .withColumn("line_like", F.col("col_mean_std") > F.col("_pc"))
            .withColumn("burst_like", F.col("row_mean_std") > F.col("_pr")).drop("_pc", "_pr"))


def rfi_composition(classed: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy())
    return classed.groupBy("rfi_class").agg(
        F.count("*").alias("n"), F.count_if("line_like").alias("n_line"),
        F.count_if("burst_like").alias("n_burst")).select(
        "*", (F.col("n") / total * 100).alias("pct"))


def hot_fraction(px: DataFrame, sigma: float = 5.0, frame: str = "frame") -> DataFrame:
    return px.groupBy(frame).agg(F.avg((F.col("x") > sigma).cast("int")).alias("hot_frac"))


def quiet_rfi_split(hot: DataFrame, lo: float = 0.25, hi: float = 0.75) -> DataFrame:
    """quiet at or below the low quantile, rfi at or above the high one; quiet wins a tie."""
    q = scale.exact_quantiles(hot, [], "hot_frac", {"_lo": lo, "_hi": hi})
    return scale.attach(hot, q, []).select(
        *hot.columns, F.when(F.col("hot_frac") <= F.col("_lo"), "quiet")
        .when(F.col("hot_frac") >= F.col("_hi"), "rfi").otherwise("middle").alias("class"))


def quiet_mild_strong(hot: DataFrame, half_width: float = 0.01) -> DataFrame:
    """quiet <= p10, strong >= p95, mild within ``half_width`` of the median."""
    q = scale.exact_quantiles(hot, [], "hot_frac", {"_a": 0.10, "_b": 0.50, "_c": 0.95})
    return scale.attach(hot, q, []).select(
        *hot.columns, F.when(F.col("hot_frac") <= F.col("_a"), "quiet")
        .when(F.col("hot_frac") >= F.col("_c"), "strong_rfi")
        .when(F.abs(F.col("hot_frac") - F.col("_b")) <= half_width, "mild_rfi").alias("class"))


def extreme_frames(hot: DataFrame, n: int, frame: str = "frame") -> DataFrame:
    """The ``n`` quietest and ``n`` hottest frames."""
    low = hot.orderBy("hot_frac", frame).limit(n).withColumn("side", F.lit("lowest"))
    high = hot.orderBy(F.col("hot_frac").desc(), frame).limit(n).withColumn("side", F.lit("highest"))
    return low.unionByName(high)


def channel_rfi_flags(px: DataFrame, k: float = 5.0, frame: str = "frame") -> DataFrame:
    """Share of channels whose temporal median is far from the frame's, and their intensity."""
    ch = scale.exact_quantiles(px, [frame, "ch"], "x", {"_cm": 0.5})
    st = scale.robust_stats(ch, [frame], "_cm", scale=1.0, names=("base", "_mad"))
    bad = F.abs(F.col("_cm") - F.col("base")) > k * 1.4826 * (F.col("_mad") + 1e-10)
    return scale.meet(ch, st, [frame]).groupBy(frame, "base").agg(
        F.avg(bad.cast("int")).alias("rfi_frac"), F.avg(F.when(bad, F.col("_cm"))).alias("_hot")
    ).select(frame, "rfi_frac", F.try_divide("_hot", "base").alias("rfi_intensity_ratio"))


def chan_frac(px: DataFrame, sigma: float = 5.0, frame: str = "frame") -> DataFrame:
    """Share of channels with any pixel above ``sigma``, and the hot pixel share."""
    ch = px.groupBy(frame, "ch").agg(
        F.max("x").alias("_m"), F.count("*").alias("_n"), F.count_if(F.col("x") > sigma).alias("_h"))
    return ch.groupBy(frame).agg(
        F.avg((F.col("_m") > sigma).cast("int")).alias("chan_frac"),
        (F.sum("_h") / F.sum("_n")).alias("hot_frac"))


def pick_examples(cf: DataFrame, max_chan_frac: float = 0.10, frame: str = "frame") -> DataFrame:
    """Two cleanest frames and the hottest narrow one (any frame if none is narrow)."""
    clean = cf.orderBy("hot_frac", frame).limit(2).select(
        frame, "hot_frac", "chan_frac",
        F.row_number().over(Window.orderBy("hot_frac", frame)).cast("string").alias("_r"))
    narrow = (F.col("chan_frac") <= max_chan_frac).cast("int")
    hot = cf.orderBy(narrow.desc(), F.col("hot_frac").desc(),
                     F.when(narrow == 1, F.col(frame)).otherwise(-F.col(frame))).limit(1)
    return clean.select(frame, "hot_frac", "chan_frac", F.concat(F.lit("clean"), "_r").alias("role")
                        ).unionByName(hot.select(frame, "hot_frac", "chan_frac", F.lit("rfi").alias("role")))


def level_steps(px: DataFrame, frame: str = "frame", obs: str = "obs_idx") -> DataFrame:
    """Spread of per-observation medians over their mean MAD, and std of block means."""
    st = scale.robust_stats(px, [frame, obs], "x", scale=1.0, names=("m", "mad"))
    means = px.groupBy(frame, obs).agg(F.avg("x").alias("mean"))
    return scale.meet(st, means, [frame, obs]).groupBy(frame).agg(
        (F.max("m") - F.min("m")).alias("level_spread"), F.avg("mad").alias("mean_mad"),
        ((F.max("m") - F.min("m")) / F.greatest(F.avg("mad"), F.lit(1e-9))).alias("spread_ratio"),
        F.stddev_pop("mean").alias("block_mean_std"))


def ks_two_sample(df: DataFrame, cls: str, value: str, n: int | None = None, seed: int = 0,
                  ids: Sequence[str] = ("id",)) -> DataFrame:
    """KS distance of classes 0 and 1, optionally on equal seeded subsamples of ``n``."""
    rows = df.filter(F.col(value).isNotNull())
    if n is not None:
        h = rows.withColumn("_h", scale.seeded_hash(seed, *ids))
        rows = scale.top_per_key(h, [cls], ["_h", *ids], n)
    vc = rows.groupBy(value).agg(F.count_if(F.col(cls) == 0).alias("a"),
                                 F.count_if(F.col(cls) == 1).alias("b"))
    vc = scale.range_bucketed(vc, [value])
    run = scale.running_sum(vc, [], [value], F.col("_rb"), {"ca": "a", "cb": "b"})
    tot = vc.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    d = scale.attach(run, tot, []).agg(
        F.max(F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))).alias("d"),
        F.max("na").alias("n_a"), F.max("nb").alias("n_b"))
    en = F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    lam = (en + 0.12 + 0.11 / en) * F.col("d")
    terms = sum((F.lit(2.0 * (-1) ** (j - 1)) * F.exp(-2.0 * j * j * lam * lam) for j in range(1, 101)),
                F.lit(0.0))
    return d.withColumn("p_asymptotic", F.when(lam < 0.2, F.lit(1.0)).otherwise(
        F.least(F.greatest(terms, F.lit(0.0)), F.lit(1.0))))


def describe_metrics(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """mean, p50, p95, p99, max, min, std per metric column."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics
    ])).alias("s")).select("s.*")
    q = scale.exact_quantiles(long, ["metric"], "x", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    a = long.groupBy("metric").agg(F.avg("x").alias("mean"), F.max("x").alias("max"),
                                   F.min("x").alias("min"), F.stddev_pop("x").alias("std"))
    return a.join(q, "metric")


def histogram(df: DataFrame, value: str, bins: int, clip_q: float | None = None,
              log: bool = False) -> DataFrame:
    """Counts in equal (or log-equal) bins; the last bin includes its upper edge.

    Values are clipped at quantile ``clip_q`` first; the log form keeps positive values only.
    """
    rows = df.select(F.col(value).cast("double").alias("x")).filter("x IS NOT NULL")
    if log:
        rows = rows.filter("x > 0").select(F.log10("x").alias("x"))
    if clip_q is not None:
        q = scale.exact_quantiles(rows, [], "x", {"_q": clip_q})
        rows = scale.attach(rows, q, []).select(F.least("x", "_q").alias("x"))
    span = rows.agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    rows = scale.attach(rows, span, [])
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor(F.try_divide(F.col("x") - F.col("_lo"), width)), F.lit(bins - 1)))
    return rows.groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def cohens_d(df: DataFrame, keys: Sequence[str], cls: str, value: str) -> DataFrame:
    """Effect size of class 1 over class 0 with the pooled sample variance."""
    def agg(fn, c):
        return fn(F.when(F.col(cls) == c, F.col(value)))
    g = df.groupBy(*keys).agg(
        *[agg(F.avg, c).alias(f"m{c}") for c in (0, 1)],
        *[agg(F.var_samp, c).alias(f"v{c}") for c in (0, 1)],
        *[agg(F.count, c).alias(f"n{c}") for c in (0, 1)])
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0"))
                    / (F.col("n1") + F.col("n0") - 2) + 1e-12)
    ok = (F.col("n0") > 1) & (F.col("n1") > 1)
    return g.select(*keys, F.when(ok, (F.col("m1") - F.col("m0")) / pooled).alias("cohens_d"))


def eta_squared(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """Between-group share of the variance; NULL with one group or no variance."""
    keys = list(keys)
    g = df.groupBy(*keys, group).agg(F.count(value).alias("n"), F.avg(value).alias("m"),
                                     (F.var_pop(value) * F.count(value)).alias("ss"))
    grand = g.groupBy(*keys).agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_gm"))
    between = F.sum(F.col("n") * F.pow(F.col("m") - F.col("_gm"), F.lit(2)))
    total = between + F.sum("ss")
    return scale.attach(g, grand, keys).groupBy(*keys).agg(
        F.when((F.count("*") > 1) & (total > 0), F.try_divide(between, total)).alias("eta2"),
        F.sum("n").alias("n"), F.count("*").alias("n_groups"))


def vector_moments(df: DataFrame, vec: str = "vec") -> DataFrame:
    """Mean and population std per dimension, variance clamped at zero: one row per dim."""
    return (df.select(F.posexplode(vec).alias("dim", "x")).groupBy("dim")
            .agg(F.avg("x").alias("mu"), F.sqrt(F.greatest(F.var_pop("x"), F.lit(0.0))).alias("sd")))


def packed_moments(df: DataFrame, vec: str = "vec") -> DataFrame:
    """One row with arrays ``mu`` and ``sd`` in dimension order."""
    m = vector_moments(df, vec)
    s = F.array_sort(F.collect_list(F.struct("dim", "mu", "sd")))  # one entry per dimension
    return m.agg(s.alias("_m")).select(F.transform("_m", lambda r: r["mu"]).alias("mu"),
                                       F.transform("_m", lambda r: r["sd"]).alias("sd"))


def per_channel_norm(df: DataFrame, vec: str = "vec", eps: float = 1e-6) -> DataFrame:
    d = scale.attach(df, packed_moments(df, vec), [])
    z = F.transform(F.arrays_zip(F.col(vec).alias("x"), F.col("mu").alias("m"), F.col("sd").alias("s")),
                    lambda r: (r["x"] - r["m"]) / (r["s"] + eps))
    return d.withColumn(vec, z).drop("mu", "sd")


def onoff_heterogeneity(row_means: DataFrame, keys: Sequence[str], score: str | None = None,
                        thr: float | None = None) -> DataFrame:
    """Effect size of OFF over ON row means, and the share of windows where OFF is higher."""
    w = row_means.groupBy(*keys).agg(
        F.avg(F.when(F.col("obs_idx") % 2 == 0, F.col("m"))).alias("on_mean"),
        F.avg(F.when(F.col("obs_idx") % 2 == 1, F.col("m"))).alias("off_mean"))
    both = w.filter("on_mean IS NOT NULL AND off_mean IS NOT NULL")
    long = both.select(F.explode(F.array(
        F.struct(F.lit(1).alias("c"), F.col("off_mean").alias("v")),
        F.struct(F.lit(0).alias("c"), F.col("on_mean").alias("v")))).alias("s")).select("s.*")
    d = cohens_d(long, [], "c", "v")
    return scale.attach(both.agg(
        F.count("*").alias("n"), F.avg("on_mean").alias("on_mean"), F.avg("off_mean").alias("off_mean"),
        (F.avg((F.col("off_mean") > F.col("on_mean")).cast("int")) * 100).alias("pct_off_gt_on")), d, [])


def component_budget(cells: DataFrame, w: Sequence[float]) -> DataFrame:
    """Weighted share of each component in the fused mean and the two redundancy figures."""
    m = cells.agg(F.avg("st1").alias("a"), F.avg("st2").alias("b"), F.avg("ss").alias("c"),
                  F.corr("st1", "st2").alias("corr_st1_st2"))
    fused = w[0] * F.col("a") + w[1] * F.col("b") + w[2] * F.col("c")
    den = F.greatest(fused, F.lit(1e-12))
    return m.select((w[0] * F.col("a") / den).alias("share_st1"), (w[1] * F.col("b") / den).alias("share_st2"),
                    (w[2] * F.col("c") / den).alias("share_ss"), "corr_st1_st2",
                    (F.col("c") / F.greatest("a", F.lit(1e-12))).alias("ss_over_st1"))


def category_energy(frames: DataFrame, first: int | None = None) -> DataFrame:
    """Energy in, energy of the reconstruction, ratio and peaks per class; of its ``first`` frames if given.

    Columns in: frame, class, e_in, e_rec, peak_in, peak_rec.
    """
    f = scale.top_per_key(frames, ["class"], ["frame"], first) if first else frames
    return f.groupBy("class").agg(
        F.count("*").alias("n"), F.avg("e_in").alias("e_in"), F.avg("e_rec").alias("e_rec"),
        F.avg(F.col("e_rec") / F.greatest("e_in", F.lit(1e-10))).alias("ratio"),
        F.max("peak_in").alias("peak_in"), F.max("peak_rec").alias("peak_rec"))


def summed_matrix(df: DataFrame, columns: Sequence[str], shape: tuple[int, int], add):
    """Sum over all rows of the matrices ``add(batch)``; only this small matrix reaches the driver.

    Partitions are read one after the other by as many tasks as there are cores, each sends one
    part, and rows of parts are summed as arrays.
    """
    import numpy as np
    import pandas as pd

    def partial(batches):
        acc = np.zeros(shape)
        for b in batches:
            if len(b):
                acc += add(b)
        yield pd.DataFrame({"row": range(shape[0]), "vals": acc.tolist()})

    def total(key, rows):
        return pd.DataFrame({"row": [key[0]], "vals": [np.stack(rows["vals"].to_numpy()).sum(axis=0)]})

    schema = "row int, vals array<double>"
    parts = df.select(*columns).coalesce(df.sparkSession.sparkContext.defaultParallelism).mapInPandas(partial, schema)
    out = np.zeros(shape)
    for r in parts.groupBy("row").applyInPandas(total, schema).collect():
        out[r["row"]] = r["vals"]
    return out


def covariance(df: DataFrame, vec: str = "vec"):
    """(n, mean, covariance with n - 1) of the vectors; the D x D matrix lives on the driver.

    Sums are of differences from the mean, which a first pass gives, so large means cost no digits.
    """
    import numpy as np
    first = packed_moments(df, vec).first()
    mean = np.array(first["mu"] or [], float)
    dim = len(mean)
    if dim > 4096:
        raise ValueError(f"{dim} dimensions: the covariance matrix is too large for one machine")

    def add(b):
        x = np.stack(b[vec].to_numpy()) - mean
        x = np.hstack([x, np.ones((len(x), 1))])
        return x.T @ x

    m = summed_matrix(df, [vec], (dim + 1, dim + 1), add)
    n = int(round(m[dim, dim]))
    off = m[dim, :dim] / max(n, 1)
    return n, mean + off, (m[:dim, :dim] - n * np.outer(off, off)) / max(n - 1, 1)


def participation_rank(cov) -> float:
    import numpy as np
    ev = np.clip(np.linalg.eigvalsh(cov), 0, None)
    return float(ev.sum() ** 2 / ((ev ** 2).sum() + 1e-12))


def collapse_check(df: DataFrame, vec: str = "vec", position: str | None = None) -> DataFrame:
    """Mean std, relative variation, dead dimensions and participation ranks of the vectors."""
    dims = vector_moments(df, vec)
    base = dims.agg(F.avg("sd").alias("mean_sd"), F.sqrt(F.sum(F.col("mu") * F.col("mu"))).alias("_norm"),
                    F.count("*").alias("n_dims"), F.count_if(F.col("sd") < 1e-4).alias("dead_dims"))
    out = base.select("mean_sd", (F.col("mean_sd") / (F.col("_norm") / F.sqrt("n_dims") + 1e-12)).alias("rel_std"),
                      "dead_dims", F.lit(participation_rank(covariance(df, vec)[2])).alias("pr_rank_pooled"))
    if position is None:
        return out
    mean = (df.select(position, F.posexplode(vec).alias("d", "x")).groupBy(position, "d")
            .agg(F.avg("x").alias("m")).groupBy(position)
            .agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("_p")))  # one per dimension
    centred = df.join(mean, position).select(F.zip_with(
        vec, "_p", lambda x, p: x - p["m"]).alias(vec))
    return out.withColumn("pr_rank_content", F.lit(participation_rank(covariance(centred, vec)[2])))
