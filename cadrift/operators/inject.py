"""Planting known tracks in pixel tables and finding where they land."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadrift.operators import prepare, scale

WIN = ["cadence_idx", "f_start"]
ON = (0, 2, 4)


@dataclass(frozen=True)
class SiteParams:
    """Ranges the site parameters are drawn from."""

    df_hz: float = 2.7939677238464355
    dt_s: float = 18.253611008
    fchans: int = 1024
    tchans: int = 96
    n_obs: int = 6
    drift_median: float = 0.3
    drift_log_sigma: float = 0.5
    min_drift: float = 0.01
    zero_drift_prob: float = 0.05
    width_lo_hz: float = 1.0
    width_hi_hz: float = 10.0
    pulse_frac: tuple[float, float] = (0.1, 0.5)
    pulse_period_bins: float = 8.0
    pulse_duty: float = 0.33
    pulse_jitter: float = 0.05


def quiet_sites(scores: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` seeded windows per cadence among those at or below the cadence's median score."""
    from cadrift.operators.pools import sample_per_group
    med = scale.exact_quantiles(scores, ["cadence_idx"], "score", {"_m": 0.5})
    quiet = scale.meet(scores, med, ["cadence_idx"]).filter(F.col("score") <= F.col("_m")).drop("_m")
    return sample_per_group(quiet, ["cadence_idx"], WIN, n, seed)


def uniform(seed, i: int, *ids: str) -> Column:
    """Repeatable uniform in (0, 1) from the md5 of seed, draw number and the site's key."""
    h = F.md5(F.concat_ws("|", F.lit(f"{seed}|{i}"), *[F.col(c).cast("string") for c in ids]))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def _linear(s, tau):
    return F.col("drift_hz_s") * tau


def _quadratic(s, tau):
    """Half acceleration times time squared, the acceleration chosen by the total excursion."""
    whole = s.tchans * s.dt_s
    return F.col("excursion_hz") * tau * tau / (whole * whole)


def _sine(s, tau):
    return F.col("drift_hz_s") * tau + F.col("amplitude_hz") * F.sin(2 * math.pi * tau / F.col("period_s"))


def _steady(tau):
    return F.lit(1.0)


def _pulses(tau):
    """Gaussian pulses, one centred in each period."""
    phase = F.pmod(tau, F.col("period_s")) - F.col("period_s") / 2
    return F.exp(-0.5 * F.pow(phase / (F.col("pulse_s") / 2.355), F.lit(2)))


# name -> (frequency offset in Hz at time tau, brightness at tau)
TRACKS = {
    "linear": (_linear, _steady),
    "quadratic": (_quadratic, _steady),
    "sine": (_sine, _steady),
    "pulses": (_linear, _pulses),
}


def track(name: str):
    if name not in TRACKS:
        raise ValueError(f"unknown track {name!r}; choose from {', '.join(TRACKS)}")
    return TRACKS[name]


def sample_site_params(sites: DataFrame, kind: str, params: SiteParams = SiteParams(), seed: int = 0,
                       ids: Sequence[str] = WIN) -> DataFrame:
    """Adds the track's parameters, drawn so that the whole track stays inside the window."""
    track(kind)
    s = params
    whole = s.tchans * s.dt_s
    band = s.fchans * s.df_hz
    u = [uniform(seed, i, *ids) for i in range(8)]
    d = sites.select("*", F.lit(kind).alias("kind"), *[x.alias(f"_u{i}") for i, x in enumerate(u)])
    u = [F.col(f"_u{i}") for i in range(8)]
    sign = F.when(u[3] < 0.5, -1.0).otherwise(1.0)
    zero = F.lit(0.0)
    if kind in ("linear", "pulses"):
        normal = F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1])
        mag = F.pow(F.lit(10.0), math.log10(s.drift_median) + s.drift_log_sigma * normal)
        limit = band / whole
        drift = F.when(u[2] < s.zero_drift_prob, zero).otherwise(
            sign * F.least(F.greatest(mag, F.lit(s.min_drift)), F.lit(limit)))
        if kind == "pulses":
            drift = (2 * u[2] - 1) * s.pulse_jitter
        d = d.withColumn("drift_hz_s", drift).withColumn("excursion_hz", zero).withColumn("amplitude_hz", zero)
        reach = F.abs("drift_hz_s") * whole / s.df_hz
        lo = F.when(F.col("drift_hz_s") < 0, F.least(reach + 1, F.lit(s.fchans - 2.0))).otherwise(F.lit(1.0))
        hi = F.when(F.col("drift_hz_s") > 0, F.greatest(s.fchans - 1 - reach, F.lit(1.0))).otherwise(F.lit(s.fchans - 2.0))
        rate = F.abs("drift_hz_s")
    elif kind == "quadratic":
        d = d.withColumn("excursion_hz", sign * (0.05 + 0.35 * u[0]) * band).withColumn(
            "drift_hz_s", zero).withColumn("amplitude_hz", zero)
        reach = F.abs("excursion_hz") / s.df_hz
        margin = 0.05 * s.fchans
        lo = F.when(F.col("excursion_hz") < 0, margin + reach).otherwise(F.lit(margin))
        hi = F.when(F.col("excursion_hz") > 0, s.fchans - margin - reach).otherwise(F.lit(s.fchans - margin))
        rate = F.abs("excursion_hz") / whole
    else:
        limit = 0.10 * band / whole
        d = d.withColumn("amplitude_hz", (0.05 + 0.15 * u[0]) * band).withColumn(
            "drift_hz_s", (2 * u[1] - 1) * limit).withColumn("excursion_hz", zero)
        reach = (F.col("amplitude_hz") + F.abs("drift_hz_s") * whole) / s.df_hz
        lo, hi = reach, s.fchans - reach
        rate = None
    cycles = 2.0 + 3.0 * u[4]
    per_obs = whole / s.n_obs
    period = whole / cycles if kind == "sine" else F.least(F.lit(per_obs), s.pulse_period_bins * s.dt_s
                                                                  + u[4] * max(per_obs - s.pulse_period_bins * s.dt_s, 0.0))
    longest = F.greatest(F.lit(s.dt_s), s.pulse_duty * F.col("period_s"))
    d = d.withColumn("period_s", period).withColumn("pulse_s", s.dt_s + u[5] * (longest - s.dt_s))
    if rate is None:
        rate = 2 * math.pi * F.col("amplitude_hz") / F.col("period_s") + F.abs("drift_hz_s")
    full = F.floor(F.when(F.col("drift_hz_s") < 0, lo).otherwise(hi)) if kind in ("linear", "pulses") else F.lit(s.fchans // 2)
    start = F.when(hi > lo, F.floor(lo + u[6] * (hi - lo))).otherwise(full)
    width = rate * s.dt_s + s.width_lo_hz + (s.width_hi_hz - s.width_lo_hz) * u[7]
    if kind == "pulses":
        width = (s.pulse_frac[0] + (s.pulse_frac[1] - s.pulse_frac[0]) * u[7]) * band
    return d.withColumn("start_ch", F.least(F.greatest(start, F.lit(0)), F.lit(s.fchans - 1)).cast("long")).withColumn(
        "width_hz", width).drop(*[f"_u{i}" for i in range(8)])


def track_channel(kind: str, tau: Column, params: SiteParams = SiteParams()) -> Column:
    """Channel of the track's centre at absolute time ``tau``."""
    shift, _ = track(kind)
    return F.col("start_ch") + shift(params, tau) / params.df_hz


def inject_track(px: DataFrame, sites: DataFrame, kind: str, params: SiteParams = SiteParams(),
                 on_indices: Sequence[int] = ON) -> DataFrame:
    """Adds snr x noise x Gaussian line along the track in the given observations only.

    px: cadence_idx, f_start, obs_idx, t, ch, x; sites: sampled parameters and ``snr``. Noise
    is the population std of the window's first listed observation (this package's own
    convention), so the amplitude is one constant per window; time runs on the absolute axis
    of the cadence. Rows of other observations, and windows without a site, keep their value.
    """
    _, glow = track(kind)
    noise = px.join(sites.select(*WIN).distinct(), WIN, "left_semi").filter(
        F.col("obs_idx") == on_indices[0]).groupBy(*WIN).agg(F.stddev_pop("x").alias("noise"))
    plan = sites.join(noise, WIN)
    tau = (F.col("obs_idx") * (params.tchans // params.n_obs) + F.col("t")) * params.dt_s
    sigma = F.greatest(F.col("width_hz") / params.df_hz / 2.355, F.lit(0.3))
    line = F.exp(-0.5 * F.pow((F.col("ch") - track_channel(kind, tau, params)) / sigma, F.lit(2)))
    added = F.col("snr") * F.col("noise") * line * glow(tau)
    lit_up = F.col("snr").isNotNull() & F.col("obs_idx").isin(*on_indices)
    cols = [c for c in px.columns if c != "x"]
    return px.join(plan, WIN, "left").select(
        *cols, F.when(lit_up, F.col("x") + added).otherwise(F.col("x")).alias("x"), F.col("x").alias("clean"))


def paired_occupancy(px: DataFrame, sites: DataFrame, kind: str, params: SiteParams = SiteParams()) -> DataFrame:
    """The same sites rendered in ON observations only and in all of them."""
    on = inject_track(px, sites, kind, params, ON).withColumn("occupancy", F.lit("on_only"))
    every = inject_track(px, sites, kind, params, tuple(range(params.n_obs))).withColumn(
        "occupancy", F.lit("persistent"))
    return on.unionByName(every)


def locate_footprint(px: DataFrame, ph: int, pw: int, nw: int, ratio: float = 3.0, frame: str = "frame",
                     on_rows: Sequence[int] = ON) -> DataFrame:
    """Per ON grid row the column of largest pooled |injected - clean|, if it stands out.

    px: frame, t, ch, x, clean. Kept where it reaches ``ratio`` times the median of the row's
    other columns, or where those are all zero. A grid row has ``nw`` cells.
    """
    d = px.withColumn("x", F.abs(F.col("x") - F.col("clean")))
    cells = prepare.block_pool(d, ph, pw, nw, "mean", "x", frame).select(
        frame, F.floor(F.col("patch") / nw).alias("row"), F.pmod("patch", F.lit(nw)).alias("col"), "v")
    cells = cells.filter(F.col("row").isin(*on_rows))
    key = [frame, "row"]
    best = cells.groupBy(*key).agg(F.min(F.struct((-F.col("v")).alias("m"), "col")).alias("b")).select(
        *key, F.col("b.col").alias("peak_col"), (-F.col("b.m")).alias("peak"))
    rest = scale.meet(cells, best, key).filter(F.col("col") != F.col("peak_col"))
    bg = scale.exact_quantiles(rest, key, "v", {"bg": 0.5})
    j = scale.meet(best, bg, key, "left").withColumn("bg", F.coalesce("bg", F.lit(0.0)))
    return j.filter((F.col("bg") <= 0) | (F.col("peak") >= ratio * F.col("bg")))


def affected_patches(px: DataFrame, ph: int, pw: int, nw: int, hi: float, lo: float, frame: str = "frame") -> DataFrame:
    """True where a patch's largest |injected - clean| is above ``hi``, false below ``lo``, NULL between."""
    d = px.withColumn("x", F.abs(F.col("x") - F.col("clean")))
    m = prepare.block_pool(d, ph, pw, nw, "max", "x", frame)
    return m.select(frame, "patch", F.col("v").alias("max_change"),
                    F.when(F.col("v") > hi, True).when(F.col("v") < lo, False).alias("affected"))
