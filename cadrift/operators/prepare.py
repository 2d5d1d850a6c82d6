"""Preparation of long pixel tables (frame, t, ch, x) with built-in functions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadrift.operators import kernels, scale

# Fixed value: dispersion constant in MHz^2 pc^-1 cm^3 s.
DISPERSION = 4.148808e3


def downsample(px: DataFrame, factor: int, nchans: int, frame: str = "frame") -> DataFrame:
    """Mean over groups of ``factor`` channels; channels beyond the last whole group drop out."""
    whole = nchans // factor * factor
    return px.filter(F.col("ch") < whole).groupBy(
        frame, "t", F.floor(F.col("ch") / factor).alias("ch")).agg(F.avg("x").alias("x"))


def downsample_array(power, factor: int) -> Column:
    """The same on one array column."""
    n = F.floor(F.size(power) / factor).cast("int")
    group = lambda i: F.slice(power, i * factor + 1, F.lit(factor))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: total(group(i)) / factor)
                  ).otherwise(F.array().cast("array<double>"))


def core_transform(px: DataFrame, keys: Sequence[str], eps: float = 1e-6) -> DataFrame:
    """log1p of the non-negative part, minus its median, over MAD + eps, per ``keys``."""
    y = px.withColumn("x", F.log1p(F.greatest(F.col("x"), F.lit(0.0))))
    st = scale.robust_stats(y, keys, "x", scale=1.0, names=("_med", "_mad"))
    return scale.attach(y, st, list(keys)).withColumn(
        "x", (F.col("x") - F.col("_med")) / (F.col("_mad") + eps)).drop("_med", "_mad")


def channel_medians(px: DataFrame, frame: str = "frame") -> DataFrame:
    return scale.exact_quantiles(px, [frame, "ch"], "x", {"m": 0.5})


def divide_by_baseline(px: DataFrame, base: DataFrame, frame: str = "frame") -> DataFrame:
    """x over its channel's baseline ``b``, floored at a small share of the frame's peak."""
    floor = base.groupBy(frame).agg((F.max("b") * 1e-4 + 1e-10).alias("_floor"))
    b = scale.meet(base, floor, [frame]).select(frame, "ch", F.greatest("b", "_floor").alias("_b"))
    return scale.meet(px, b, [frame, "ch"]).withColumn("x", F.col("x") / F.col("_b")).drop("_b")


def bandpass_median(px: DataFrame, frame: str = "frame") -> DataFrame:
    return divide_by_baseline(px, channel_medians(px, frame).withColumnRenamed("m", "b"), frame)


def polynomial_baseline(curves: DataFrame, nchans: int | Column, degree: int = 3, rounds: int = 3,
                        clip: float = 3.0, frame: str = "frame") -> DataFrame:
    """Clipped polynomial baseline of long channel medians (frame, ch, m) as column ``b``.

    A frame's medians meet in one row and all rounds run there, many frames at once. NULL medians
    take no part; frames with fewer than ``degree + 1`` others have no baseline and no rows.
    """
    n = nchans if isinstance(nchans, Column) else F.lit(nchans)
    u = F.lit(-1.0) + 2.0 * F.col("ch") / (n - 1)
    g = curves.groupBy(frame).agg(F.array_sort(F.collect_list(F.struct("ch", F.col("m").cast("double").alias("m"), u.alias("u")))).alias("_c"))

    @F.pandas_udf("array<double>")
    def fit(us: pd.Series, ms: pd.Series) -> pd.Series:
        out, alike = [None] * len(us), {}
        for i, x in enumerate(us):
            alike.setdefault(np.asarray(x, float).tobytes(), []).append(i)
        for x, rows in alike.items():
            m = np.array([[np.nan if v is None else v for v in ms.iloc[i]] for i in rows], float)
            for i, b in zip(rows, kernels.fit_baseline(m, degree, rounds, clip, np.frombuffer(x))):
                out[i] = None if np.isnan(b).any() else b
        return pd.Series(out)

    fitted = g.withColumn("_b", fit(F.transform("_c", lambda c: c["u"]), F.transform("_c", lambda c: c["m"]))).filter("_b IS NOT NULL")
    return fitted.select(frame, F.explode(F.arrays_zip("_c", "_b")).alias("_z")).select(
        frame, "_z._c.ch", "_z._c.m", F.col("_z._b").alias("b"))


def patch_index(px: DataFrame, ph: int, pw: int, nw: int) -> DataFrame:
    """Adds patch k = floor(t / ph) * nw + floor(ch / pw) and the place (pt, pc) inside it."""
    return px.select("*", (F.floor(F.col("t") / ph) * nw + F.floor(F.col("ch") / pw)).alias("patch"),
                     F.pmod("t", F.lit(ph)).alias("pt"), F.pmod("ch", F.lit(pw)).alias("pc"))


def unpatch(patched: DataFrame, ph: int, pw: int, nw: int) -> DataFrame:
    k = F.col("patch")
    return patched.withColumn("t", F.floor(k / nw) * ph + F.col("pt")).withColumn(
        "ch", F.pmod(k, F.lit(nw)) * pw + F.col("pc")).drop("patch", "pt", "pc")


def block_pool(px: DataFrame, ph: int, pw: int, nw: int, how: str = "mean", value: str = "x",
               frame: str = "frame") -> DataFrame:
    fn = {"mean": F.avg, "max": F.max}[how]
    return patch_index(px, ph, pw, nw).groupBy(frame, "patch").agg(fn(value).alias("v"))


def shared_sums(x: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Sums over channels of ``x`` (channels, bins), rolled back by ``shifts`` (trials, channels).

    Halves of the band are summed first, again and again. Trials whose delays inside a band differ
    only by a constant share its sum, and narrow bands have few such patterns, so most additions
    are done once for many trials. Delays are the given integers at every level.
    """
    bins = np.arange(x.shape[1])

    def band(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if b - a == 1:
            return x[a:b], np.zeros(len(shifts), np.int64)
        m = (a + b) // 2
        (left, of_left), (right, of_right) = band(a, m), band(m, b)
        apart = (shifts[:, m] - shifts[:, a]) % x.shape[1]
        both, kind = np.unique(np.column_stack([of_left, of_right, apart]), axis=0, return_inverse=True)
        return left[both[:, 0]] + right[both[:, 1][:, None], (bins + both[:, 2][:, None]) % x.shape[1]], kind.ravel()

    series, kind = band(0, len(x))
    return series[kind[:, None], (bins + shifts[:, :1]) % x.shape[1]]


def dedisperse(px: DataFrame, dms: Sequence[float], nu_mhz: Column, nu_ref: float, dt: float,
               frame: str = "frame") -> DataFrame:
    """Channel mean per time bin after undoing the dispersion delay, for every DM.

    Bins roll around the frame's length, as many channels as arrive in a bin are averaged. A
    frame is a fixed grid and one task's group: pixels move once, whatever the number of DMs.
    ``nu_mhz`` depends on the channel alone. A NULL pixel is not averaged, a bin that no pixel
    reaches has no row.
    """
    trials = np.array([float(d) for d in dms])

    def run(group: pa.Table) -> pa.Table:
        t, ch = (group.column(c).to_numpy().astype(np.int64) for c in ("_t", "_c"))
        nu, x = group.column("_nu").to_numpy(), group.column("_x")
        known = x.is_valid().to_numpy()
        value = np.where(known, pc.fill_null(x, 0.0).to_numpy(), 0.0)
        channels, first, at = np.unique(ch, return_index=True, return_inverse=True)
        nt = int(t.max()) + 1
        shifts = np.rint(DISPERSION * trials[:, None] * (np.power(nu[first], -2.0) - nu_ref ** -2) / dt).astype(np.int64)
        grids = np.zeros((3, len(channels), nt))
        for grid, v in zip(grids, (value, known, np.ones(len(t)))):
            np.add.at(grid, (at, t), v)
        total, n, rows = (shared_sums(g, shifts) for g in grids)
        dm, b = np.nonzero(rows > 0)
        n = n[dm, b]
        y = pa.array(total[dm, b] / np.maximum(n, 1), mask=n == 0)
        key = group.column("_f").combine_chunks().slice(0, 1).take(pa.array(np.zeros(len(b), np.int64)))
        return pa.table({frame: key, "dm": trials[dm], "t": b, "y": y})

    kind = px.schema[frame].dataType.simpleString()
    pixels = px.select(F.col(frame).alias("_f"), F.col("t").cast("long").alias("_t"), F.col("ch").cast("long").alias("_c"),
                       F.col("x").cast("double").alias("_x"), nu_mhz.cast("double").alias("_nu"))
    return pixels.groupBy("_f").applyInArrow(run, f"`{frame}` {kind}, dm double, t long, y double")
