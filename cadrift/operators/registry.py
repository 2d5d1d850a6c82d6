"""Named scorers and score methods."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadrift.operators import scoring


def _max(x: Column) -> Column:
    return F.array_max(x)


def _peak(x: Column) -> Column:
    """Peak over the population std, whose squares are taken about the mean."""
    mean = scoring.array_mean(x)
    var = scoring.array_mean(F.transform(x, lambda v: (v - mean) * (v - mean)))
    return F.array_max(x) / (F.sqrt(var) + 1e-9)


def _top1pct(x: Column) -> Column:
    sq = F.sort_array(F.transform(x, lambda v: v * v), asc=False)
    k = F.greatest(F.lit(1), F.floor(F.size(x) * F.lit(0.01)).cast("int"))
    return F.aggregate(F.slice(sq, F.lit(1), k), F.lit(0.0), lambda a, v: a + v)


SCORERS: dict[str, Callable[[Column], Column]] = {
    "max_pixel": _max, "peak_snr": _peak, "top1pct_energy": _top1pct}


def register(name: str, fn: Callable[[Column], Column]) -> None:
    """Adds a frame-array scorer: any Column function, a ``pandas_udf`` included."""
    SCORERS[name] = fn


def apply_scorers(df: DataFrame, frame: str, names=None) -> DataFrame:
    """One score column per named scorer."""
    names = list(SCORERS) if names is None else list(names)
    unknown = [n for n in names if n not in SCORERS]
    if unknown:
        raise ValueError(f"unknown scorer {unknown[0]!r}; choose from {', '.join(SCORERS)}")
    return df.select("*", *[SCORERS[n](F.col(frame)).alias(n) for n in names])


MAP_METHODS = ("recon", "topk", "max")


def anomaly_score(df: DataFrame, cells: str, method: str = "topk", topk_frac: float = 0.02,
                  out: str = "score") -> DataFrame:
    """Score of a whole map held in one array: mean, mean of the top share, or maximum."""
    x = F.col(cells)
    if method == "recon":
        s = scoring.array_mean(x)
    elif method == "topk":
        s = scoring.top_k_mean(x, topk_frac)
    elif method == "max":
        s = F.array_max(x)
    else:
        raise ValueError(f"unknown method {method!r}; choose from {', '.join(MAP_METHODS)}")
    return df.withColumn(out, s)
