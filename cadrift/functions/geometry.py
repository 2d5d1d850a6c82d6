"""Bands, windows and frequencies as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band_geometry(df: DataFrame) -> DataFrame:
    """Derived header columns from fch1 (MHz), foff (MHz, may be negative), nchans, tsamp, ntime.

    A missing number arrives as NaN in some headers and is kept as NULL.
    """
    for c in ("fch1", "foff", "tsamp"):
        df = df.withColumn(c, F.nullif(F.col(c), F.lit(float("nan"))))
    end = F.col("fch1") + F.col("foff") * F.col("nchans")
    both = F.col("fch1").isNotNull() & end.isNotNull()
    return df.select(
        *[c for c in df.columns if c not in ("fch1", "foff", "tsamp")],
        F.round("fch1", 6).alias("fch1_mhz"), F.round(F.col("foff") * 1e6, 4).alias("foff_hz"),
        F.when(both, F.round(F.least("fch1", end), 4)).alias("f_start_mhz"),
        F.when(both, F.round(F.greatest("fch1", end), 4)).alias("f_stop_mhz"),
        F.round(F.abs(F.col("foff") * F.col("nchans")), 4).alias("bw_mhz"),
        F.round("tsamp", 9).alias("tsamp_s"), F.round(F.col("tsamp") * F.col("ntime"), 2).alias("duration_s"))


def band_edge(f) -> Column:
    """Whole MHz, halves to even."""
    return F.bround(f, 0)


# Upper edges (MHz) and names of the coarse regions.
REGIONS = (
    (1200, "L-low (750-1200)"),
    (1900, "L-high (1200-1900)"),
    (3200, "S (1900-3200)"),
    (5000, "C-low (3200-5000)"),
    (8000, "C-high/X-low (5000-8000)"),
    (10000, "X-mid (8000-10000)"),
)
TOP_REGION = "X-high (10000-12400)"


def freq_region(f_lo) -> Column:
    out = None
    for edge, name in REGIONS:
        out = F.when(f_lo < edge, name) if out is None else out.when(f_lo < edge, name)
    return out.otherwise(TOP_REGION)


def on_role(obs_idx, n_rows: int = 6) -> Column:
    """ON for even observation rows, OFF for odd ones, NULL beyond the grid."""
    return F.when((obs_idx >= 0) & (obs_idx < n_rows), F.when(obs_idx % 2 == 0, "ON").otherwise("OFF"))


def sliding_windows(df: DataFrame, fchans: int, stride: int, nchans: str = "nchans") -> DataFrame:
    """One row per window start with the whole window inside the band."""
    last = F.col(nchans) - fchans
    starts = F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(stride).cast("long")))
    return df.select("*", F.explode(starts).alias("f_start"))


def subband_windows(df: DataFrame, n: int = 3, lo: float = 0.1, hi: float = 0.9, channels: int = 1024) -> DataFrame:
    """Windows of ``channels`` centred at ``n`` fixed fractions of each band."""
    fracs = [lo + (hi - lo) * i / max(n - 1, 1) for i in range(n)]
    half = F.col("df_mhz") * (channels / 2)
    centre = F.col("f_lo") + F.col("frac") * (F.col("f_hi") - F.col("f_lo"))
    return (df.withColumn("frac", F.explode(F.array(*[F.lit(f) for f in fracs])))
            .withColumn("w_start", centre - half).withColumn("w_stop", centre + half))
