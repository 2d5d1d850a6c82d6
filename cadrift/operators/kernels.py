"""Vectorised NumPy kernels on Arrow batches: one row holds one frame of fixed geometry."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAMES_PER_STEP = 64


def fit_baseline(m: np.ndarray, degree: int, rounds: int = 3, clip: float = 3.0, u: np.ndarray | None = None) -> np.ndarray:
    """Clipped polynomial baselines of many channel-median curves at once: (B, F) -> (B, F).

    All curves share the abscissa, so each round is one batched weighted least squares in a
    Chebyshev basis. A curve stops when its residual has no spread or too few channels stay;
    the curve fitted before that is kept. Kept channels are chosen anew among all channels.
    ``u`` gives the abscissa if it is not even. NaN takes no part; a curve with too few other
    values comes back as NaN.
    """
    basis = np.polynomial.chebyshev.chebvander(np.linspace(-1.0, 1.0, m.shape[1]) if u is None else u, degree)
    known = ~np.isnan(m)
    if (known.sum(axis=1) < degree + 1).any():
        out, enough = np.full(m.shape, np.nan), known.sum(axis=1) >= degree + 1
        if enough.any():
            out[enough] = fit_baseline(m[enough], degree, rounds, clip, u)
        return out
    m, keep = np.where(known, m, 0.0), known.astype(float)
    curve = _weighted_fit(basis, m, keep)
    live = np.ones(len(m), bool)
    for _ in range(rounds):
        res = m - curve
        n = keep.sum(axis=1)
        mean = (res * keep).sum(axis=1) / n
        sigma = np.sqrt((((res - mean[:, None]) ** 2) * keep).sum(axis=1) / n)
        inside = known & (np.abs(res) <= clip * sigma[:, None])
        live &= (sigma > 0) & (inside.sum(axis=1) >= degree + 1)
        if not live.any():
            break
        keep[live] = inside[live]
        curve[live] = _weighted_fit(basis, m[live], keep[live])
    return curve


def _weighted_fit(basis: np.ndarray, m: np.ndarray, w: np.ndarray) -> np.ndarray:
    a = np.einsum("fi,bf,fj->bij", basis, w, basis, optimize=True)
    b = np.einsum("fi,bf->bi", basis, w * m, optimize=True)
    return np.linalg.solve(a, b[..., None])[..., 0] @ basis.T


def divide_baseline(x: np.ndarray, method: str, degree: int = 3) -> np.ndarray:
    """Frames (B, T, F) over their baseline, floored at a small share of its peak."""
    m = np.median(x, axis=1)
    if method == "polynomial":
        base = fit_baseline(m, degree)
    elif method == "median":
        base = m
    else:
        raise ValueError(f"unknown baseline {method!r}; choose from polynomial, median")
    floor = base.max(axis=1, keepdims=True) * 1e-4 + 1e-10
    return x / np.maximum(base, floor)[:, None, :]


def standardise(x: np.ndarray, eps: float) -> np.ndarray:
    """log1p of the non-negative part, centred on the median, over MAD + eps, per frame."""
    y = np.log1p(np.maximum(x, 0.0)).reshape(len(x), -1)
    y -= np.median(y, axis=1, keepdims=True)
    y /= np.median(np.abs(y), axis=1, keepdims=True) + eps
    return y.reshape(x.shape)


def steps(shape: Sequence[int], fn: Callable[[np.ndarray], np.ndarray]):
    """``fn`` on frames of one shape, a few at a time; results leave the task as they are made."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for i in range(0, len(batch), FRAMES_PER_STEP):
                part = batch.slice(i, FRAMES_PER_STEP)
                if part.null_count or (part.value_lengths().to_numpy() != np.prod(shape)).any():
                    raise ValueError(f"frames must be of shape {tuple(shape)}")
                x = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                y = fn(x.reshape(-1, *shape)).astype(np.float32).reshape(-1)
                at = np.arange(len(part) + 1, dtype=np.int32) * (len(y) // len(part))
                yield pa.ListArray.from_arrays(pa.array(at), pa.array(y, from_pandas=True))
    return run


def _in_steps(frame: str, shape, fn) -> Column:
    return F.arrow_udf(steps(shape, fn), "array<float>")(frame)


def preprocess(frame: str, ntime: int, nchans: int, method: str = "polynomial", degree: int = 3,
               eps: float = 1e-6) -> Column:
    """Baseline removal and standardisation of a row-major frame column."""
    return _in_steps(frame, (ntime, nchans), lambda x: standardise(
        divide_baseline(x, method, degree).astype(np.float32).astype(np.float64), eps))


def bandpass(frame: str, ntime: int, nchans: int, method: str = "polynomial", degree: int = 3) -> Column:
    return _in_steps(frame, (ntime, nchans), lambda x: divide_baseline(x, method, degree))


def patchify(frame: str, ntime: int, nchans: int, ph: int, pw: int) -> Column:
    """Frame -> concatenated patches, patch k = i * (nchans / pw) + j, each ph x pw row-major."""
    return _in_steps(frame, (ntime // ph, ph, nchans // pw, pw), lambda x: x.transpose(0, 1, 3, 2, 4))


def unpatchify(patches: str, ntime: int, nchans: int, ph: int, pw: int) -> Column:
    return _in_steps(patches, (ntime // ph, nchans // pw, ph, pw), lambda x: x.transpose(0, 1, 3, 2, 4))


BLOCK_BUCKET = 64


def assemble_windows(spectra: DataFrame, block: int = 512) -> DataFrame:
    """Windows of two adjacent blocks at a stride of one block, per time bin.

    Blocks travel in runs of BLOCK_BUCKET; only the first block of a run is sent twice (it
    also ends the last window of the run before), so overlap costs under 2 % of the shuffle
    and no task holds a whole band.
    """
    own = F.floor(F.col("block") / BLOCK_BUCKET)
    at_edge = (F.col("block") % BLOCK_BUCKET == 0) & (F.col("block") > 0)
    runs = spectra.withColumn("_own", own).withColumn(
        "_run", F.explode(F.when(at_edge, F.array("_own", F.col("_own") - 1)).otherwise(F.array("_own"))))
    w = Window.partitionBy("cadence_idx", "obs_idx", "time_bin", "_run").orderBy("block")
    pair = runs.withColumn("_nb", F.lead("block").over(w)).withColumn("_np", F.lead("power").over(w))
    ok = (F.col("_own") == F.col("_run")) & (F.col("_nb") == F.col("block") + 1)
    return pair.filter(ok).select(
        "cadence_idx", "obs_idx", "time_bin", (F.col("block") * block).alias("f_start"),
        F.concat("power", "_np").alias("power"))


def adjacent_blocks(spectra: DataFrame) -> DataFrame:
    """The same pairs by an equi join on the next block; no key is ever hot."""
    k = ["cadence_idx", "obs_idx", "time_bin"]
    nxt = spectra.select(*k, (F.col("block") - 1).alias("block"), F.col("power").alias("next_power"))
    return spectra.join(nxt, [*k, "block"])


def obs_frames(windows: DataFrame) -> DataFrame:
    """Row-major frame per (cadence, window, observation) from its fixed number of time bins."""
    rows = F.sort_array(F.collect_list(F.struct("time_bin", "power")))
    return windows.groupBy("cadence_idx", "f_start", "obs_idx").agg(
        F.flatten(F.transform(rows, lambda r: r["power"])).alias("frame"))


def stack_frames(frames: DataFrame, tchans: int, nchans: int) -> DataFrame:
    """Observations of a window stacked in time, cut at ``tchans`` rows (six rows per window)."""
    rows = F.sort_array(F.collect_list(F.struct("obs_idx", "frame")))
    return frames.groupBy("cadence_idx", "f_start").agg(
        F.slice(F.flatten(F.transform(rows, lambda r: r["frame"])), 1, tchans * nchans).alias("frame"))


MODES = ("per_obs", "legacy_concat")


def normalised_frames(frames: DataFrame, ntime: int, nchans: int, mode: str = "per_obs", n_obs: int = 6,
                      **opts) -> DataFrame:
    """Standardised model frames: each observation alone then stacked, or stacked first."""
    frames = frames.filter(F.size("frame") == ntime * nchans)  # a malformed observation drops its window
    if mode == "per_obs":
        each = frames.withColumn("frame", preprocess("frame", ntime, nchans, **opts))
        whole = stack_frames(each, ntime * n_obs, nchans)
        return whole.filter(F.size("frame") == ntime * n_obs * nchans)
    if mode == "legacy_concat":
        whole = stack_frames(frames, ntime * n_obs, nchans)
        whole = whole.filter(F.size("frame") == ntime * n_obs * nchans)
        return whole.withColumn("frame", preprocess("frame", ntime * n_obs, nchans, **opts))
    raise ValueError(f"unknown mode {mode!r}; choose from {', '.join(MODES)}")


def score_with_model(df: DataFrame, make_predict_fn, inputs: Sequence[str], return_type, batch: int = 512,
                     out: str = "prediction", **opts) -> DataFrame:
    """Batch scores, maps or embeddings of a supplied model, loaded once per Python worker."""
    from pyspark.ml.functions import predict_batch_udf
    udf = predict_batch_udf(make_predict_fn, return_type=return_type, batch_size=batch, **opts)
    return df.withColumn(out, udf(*inputs))
