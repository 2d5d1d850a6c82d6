"""Fitted scorers. What is fitted is small (fixed dimensions or slots); data stays distributed."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadrift.operators import scale, stats


def _vector_udf(fn, returns: str = "double"):
    """Arrow UDF applying ``fn`` to a (batch, dim) matrix."""
    @F.pandas_udf(returns)
    def run(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object if "array" in returns else float)
        out = fn(np.stack(v.to_numpy()).astype(float))
        return pd.Series(list(out) if "array" in returns else out)
    return run


# ------------------------------------------------------------------ Mahalanobis

def fit_mahalanobis(df: DataFrame, vec: str = "vec") -> tuple[np.ndarray, np.ndarray, float]:
    """(mean, inverse of the shrunk covariance, shrinkage) with the analytic optimal shrinkage.

    Ledoit and Wolf (2004): shrink towards a scaled identity by the ratio of the squared
    error of the covariance entries to their spread; needs one extra pass for fourth powers.
    """
    n, mean, cov = stats.covariance(df, vec)
    emp = cov * (n - 1) / n
    p = len(mean)
    mu = np.trace(emp) / p
    lit = F.array(*[F.lit(float(m)) for m in mean])
    sq = F.aggregate(F.zip_with(vec, lit, lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda a, v: a + v)
    fourth = df.agg(F.avg(sq * sq)).first()[0]
    spread = ((emp - mu * np.eye(p)) ** 2).sum()
    error = (fourth - (emp ** 2).sum()) / n
    s = 0.0 if spread == 0 else float(min(error, spread) / spread)
    return mean, np.linalg.inv((1 - s) * emp + s * mu * np.eye(p)), s


def mahalanobis(df: DataFrame, fitted, vec: str = "vec", out: str = "distance") -> DataFrame:
    mean, inv, _ = fitted
    return df.withColumn(out, _vector_udf(lambda x: np.sqrt(np.clip(
        np.einsum("bi,ij,bj->b", x - mean, inv, x - mean, optimize=True), 0, None)))(vec))


# ------------------------------------------------------------------ isolation forest

_EULER = 0.5772156649015329


def _avg_path(n):
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    big = 2.0 * (np.log(np.maximum(n - 1, 1)) + _EULER) - 2.0 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng, limit: int) -> list:
    """Random splits until single points or the depth limit: rows (node, left, right, dim, cut, path)."""
    nodes, todo = [], [(x, 0, 0)]
    count = 1
    while todo:
        part, depth, me = todo.pop()
        lo, hi = part.min(axis=0), part.max(axis=0)
        open_dims = np.flatnonzero(hi > lo)
        if depth >= limit or len(part) <= 1 or not len(open_dims):
            nodes.append((me, -1, -1, -1, 0.0, depth + float(_avg_path(len(part)))))
            continue
        dim = int(rng.choice(open_dims))
        at = float(rng.uniform(lo[dim], hi[dim]))
        left = part[:, dim] <= at
        nodes.append((me, count, count + 1, dim, at, 0.0))
        todo += [(part[left], depth + 1, count), (part[~left], depth + 1, count + 1)]
        count += 2
    return sorted(nodes)


class IsolationForest:
    """Higher score = stranger; published algorithm with subsamples of ``psi`` rows per tree."""

    NODE_SCHEMA = "tree int, node int, left int, right int, dim int, cut double, path double, psi int"

    def __init__(self, trees: int = 100, psi: int = 256, seed: int = 42):
        self.trees, self.psi, self.seed = trees, psi, seed
        self.nodes: pd.DataFrame | None = None

    def _subsamples(self, df: DataFrame, vec: str, ids: Sequence[str]) -> DataFrame:
        """Seeded subsample per tree: every (row, tree) is thinned by hash to about four times
        ``psi`` rows a tree, before anything moves, and the first ``psi`` of these stay."""
        kept = max(1, int(np.ceil((1 << 40) * min(1.0, 4 * self.psi / max(df.count(), 1)))))
        place = lambda t: F.pmod(F.xxhash64(F.lit(self.seed), t, *ids), F.lit(1 << 40))
        trees = F.filter(F.sequence(F.lit(0), F.lit(self.trees - 1)), lambda t: place(t) < F.lit(kept))
        rows = df.select(*ids, F.col(vec).alias("_v"), F.explode(trees).alias("tree"))
        rows = rows.withColumn("_h", scale.seeded_hash(self.seed, "tree", *ids))
        return scale.top_per_key(rows, ["tree"], ["_h", *ids], self.psi).select("tree", "_h", "_v")

    def fit(self, df: DataFrame, vec: str = "vec", ids: Sequence[str] = ("id",)) -> IsolationForest:
        seed, psi = self.seed, self.psi
        limit = int(np.ceil(np.log2(max(psi, 2))))

        def one(key, pdf):
            x = np.stack(pdf.sort_values("_h")["_v"].to_numpy()).astype(float)
            grown = _grow(x, np.random.default_rng([seed, int(key[0])]), limit)
            return pd.DataFrame([(int(key[0]), *r, len(x)) for r in grown])

        # at most trees * (2 psi - 1) small rows
        self.nodes = (self._subsamples(df, vec, ids).groupBy("tree")
                      .applyInPandas(one, self.NODE_SCHEMA).toPandas())
        return self

    def score(self, df: DataFrame, vec: str = "vec", out: str = "score") -> DataFrame:
        if self.nodes is None:
            raise RuntimeError("fit or load the forest before scoring")
        trees = [g.sort_values("node")[["left", "right", "dim", "cut", "path"]].to_numpy()
                 for _, g in self.nodes.groupby("tree")]
        norm = float(_avg_path(int(self.nodes["psi"].max())))

        def run(x):
            total = np.zeros(len(x))
            rows = np.arange(len(x))
            for t in trees:
                at = np.zeros(len(x), int)
                while True:
                    inner = t[at, 0] >= 0
                    if not inner.any():
                        break
                    go_left = x[rows, np.maximum(t[at, 2], 0).astype(int)] <= t[at, 3]
                    at = np.where(inner, np.where(go_left, t[at, 0], t[at, 1]), at).astype(int)
                total += t[at, 4]
            return 2.0 ** (-(total / len(trees)) / max(norm, 1e-12)) - 0.5
        return df.withColumn(out, _vector_udf(run)(vec))

    def save(self, spark: SparkSession, path: str) -> None:
        if self.nodes is None:
            raise RuntimeError("fit the forest before saving")
        spark.createDataFrame(self.nodes, self.NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IsolationForest:
        f = cls()
        f.nodes = spark.read.schema(cls.NODE_SCHEMA).parquet(path).toPandas()
        return f


# ------------------------------------------------------------------ mixture density

class MixtureDensity:
    """Negative log density under a Gaussian mixture of the whole vector, or of its ``dims`` first
    principal components; same interface as the forest."""

    def __init__(self, k: int = 3, seed: int = 42, dims: int | None = None):
        self.k, self.seed, self.dims = k, seed, dims
        self.parts = None

    def fit(self, df: DataFrame, vec: str = "vec") -> MixtureDensity:
        from pyspark.ml.clustering import GaussianMixture
        from pyspark.ml.functions import array_to_vector
        size = df.select(F.size(vec)).first()[0]
        self.proj = (np.zeros(size), np.eye(size)) if self.dims is None else fit_pca(df, min(self.dims, size), vec)
        z = project(df, self.proj, vec)
        if self.k == 1:  # no iteration to run
            n, mean, cov = stats.covariance(z, "z")
            self.parts = [(1.0, mean, cov * (n - 1) / n)]
            return self
        z = z.select(array_to_vector("z").alias("features"))
        m = GaussianMixture(k=self.k, seed=self.seed, maxIter=30).fit(z)
        rows = m.gaussiansDF.collect()  # k rows
        self.parts = [(w, r["mean"].toArray(), r["cov"].toArray()) for w, r in zip(m.weights, rows)]
        return self

    def score(self, df: DataFrame, vec: str = "vec", out: str = "score") -> DataFrame:
        if self.parts is None:
            raise RuntimeError("fit the mixture before scoring")
        prep = []
        for w, mean, cov in self.parts:
            c = cov + 1e-9 * np.eye(len(mean))
            prep.append((np.log(max(w, 1e-300)) - 0.5 * (np.linalg.slogdet(2 * np.pi * c)[1]), mean, np.linalg.inv(c)))
        mean0, p = self.proj

        def run(x):
            z = (x - mean0) @ p
            ll = np.stack([c - 0.5 * np.einsum("bi,ij,bj->b", z - m, i, z - m) for c, m, i in prep])
            top = ll.max(axis=0)
            return -(top + np.log(np.exp(ll - top).sum(axis=0)))
        return df.withColumn(out, _vector_udf(run)(vec))


# ------------------------------------------------------------------ prototypes

def fit_prototypes(df: DataFrame, slots: int, seed: int = 42, vec: str = "vec") -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    m = KMeans(k=slots, seed=seed).fit(df.select(array_to_vector(vec).alias("features")))
    return np.array(m.clusterCenters())


def address(x: np.ndarray, slots: np.ndarray, lam: float, eps: float = 1e-12) -> np.ndarray:
    """Softmax of dot products, shrunk below ``lam``, renormalised: (batch, slots)."""
    sim = x @ slots.T
    w = np.exp(sim - sim.max(axis=1, keepdims=True))
    w /= w.sum(axis=1, keepdims=True)
    w = np.maximum(w - lam, 0) * w / (np.abs(w - lam) + eps)
    return w / (w.sum(axis=1, keepdims=True) + eps)


def prototype_memory(df: DataFrame, slots: np.ndarray, lam: float | None = None, vec: str = "vec",
                     eps: float = 1e-12) -> DataFrame:
    """Adds weights, recall, residual (mean square) and entropy of each vector's addressing."""
    if slots.size > 1 << 22:
        raise ValueError("the memory is too large to ship to every task")
    lam = 1.0 / len(slots) if lam is None else lam
    w = df.withColumn("weights", _vector_udf(lambda x: address(x, slots, lam, eps), "array<double>")(vec))
    w = w.withColumn("recall", _vector_udf(lambda a: a @ slots, "array<double>")("weights"))
    from cadrift.operators.scoring import mean_sq_diff
    ent = F.aggregate("weights", F.lit(0.0), lambda s, a: s - a * F.log(a + eps))
    return w.withColumn("residual", mean_sq_diff(vec, "recall")).withColumn("entropy", ent)


# ------------------------------------------------------------------ linear students

def fit_ridge(df: DataFrame, x: str, y: str, alpha: float = 1.0):
    """Closed-form multi-output ridge on standardised inputs and outputs.

    Every Arrow batch adds its part of X'X and X'Y; only the summed small matrices meet.
    """
    mx, my = (stats.packed_moments(df, c).first() for c in (x, y))
    xm, xs, ym, ys = (np.array(a, float) for a in (mx["mu"], mx["sd"], my["mu"], my["sd"]))
    xs, ys = xs + 1e-6, ys + 1e-6
    p, q = len(xm) + 1, len(ym)
    if p > 4096:
        raise ValueError(f"{p} inputs: the normal equations are too large for one machine")

    def add(b):
        a = (np.stack(b[x].to_numpy()) - xm) / xs
        a = np.hstack([a, np.ones((len(a), 1))])
        t = (np.stack(b[y].to_numpy()) - ym) / ys
        return a.T @ np.hstack([a, t])

    m = stats.summed_matrix(df, [x, y], (p, p + q), add)
    w = np.linalg.solve(m[:, :p] + alpha * np.eye(p), m[:, p:])
    return xm, xs, ym, ys, w


def ridge_residual(df: DataFrame, fitted, x: str, y: str, out: str = "residual") -> DataFrame:
    """Mean squared prediction residual in standardised output space."""
    xm, xs, ym, ys, w = fitted

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        u = (np.stack(a.to_numpy()) - xm) / xs
        t = (np.stack(b.to_numpy()) - ym) / ys
        return pd.Series(((t - u @ w[:-1] - w[-1]) ** 2).mean(axis=1))
    return df.withColumn(out, run(x, y))


def fit_pca(df: DataFrame, k: int, vec: str = "vec") -> tuple[np.ndarray, np.ndarray]:
    """(mean, dim x k components) from the distributed PCA of MLlib."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    m = PCA(k=k, inputCol="features", outputCol="z").fit(df.select(array_to_vector(vec).alias("features")))
    return np.array(stats.packed_moments(df, vec).first()["mu"]), np.array(m.pc.toArray())


def project(df: DataFrame, fitted, vec: str = "vec", out: str = "z") -> DataFrame:
    mean, p = fitted
    return df.withColumn(out, _vector_udf(lambda x: (x - mean) @ p, "array<double>")(vec))


def pca_residual(df: DataFrame, fitted, vec: str = "vec", out: str = "residual") -> DataFrame:
    """Mean squared error of the low-rank reconstruction."""
    mean, p = fitted

    def run(x):
        c = x - mean
        return ((c - c @ p @ p.T) ** 2).mean(axis=1)
    return df.withColumn(out, _vector_udf(run)(vec))
