"""Embedding near-dedup with a pivot-permutation index.

Each distinct vector is described by its ``near`` nearest of some reference points, in order. The
inverted lists are kept by pairs of points, so members of a list share two at least; their vectors
are verified where the list is. The number of points grows with the square root of the table, so
lists keep their length.

Dense groups are cut short by angles: points taken from the data are so far apart, and the core of
a point so narrow, that all vectors of a core are linked with each other and none with another
core. So lists compare a vector with others only if one of the two is in no core, and a core
counts for its links as a whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadrift.llm.components import components
from cadrift.session import cut

LEFT, RIGHT = 1, 2


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of binary vectors as doubles, shorter ones filled with zeros."""
    parts = [np.frombuffer(x, np.float64) for x in column.to_pylist()]
    out = np.zeros((len(parts), max(map(len, parts), default=0)))
    for row, p in zip(out, parts):
        row[:len(p)] = p
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pack(batches):
    """Vectors as bytes of doubles; null for those that link with nothing."""
    for b in batches:
        out = []
        for v in b.column("embedding").to_pylist():
            x = None if not v or any(e is None for e in v) else np.array(v, np.float64) + 0.0
            ok = x is not None and np.isfinite(x).all() and x.any()
            out.append(np.trim_zeros(x, "b").tobytes() if ok else None)
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(out, pa.binary())], names=["vec_id", "vec"])


def choose_points(sample: np.ndarray, count: int, apart: float, dims: int) -> tuple[np.ndarray, int]:
    """``count`` reference points, and how many of them, the first, are vectors of the sample: of
    these no two have a cosine over ``apart``. The rest are seeded random directions."""
    chosen = np.zeros((0, dims))
    for x in sample:
        if len(chosen) == count:
            break
        if not len(chosen) or (chosen @ x).max() < apart:
            chosen = np.vstack([chosen, x])
    more = unit(np.random.default_rng(11).normal(size=(max(0, count - len(chosen)), dims))) if count > len(chosen) else np.zeros((0, dims))
    return np.vstack([chosen, more]), len(chosen)


def describe(points: np.ndarray, taken: int, core: float, near: int):
    """Core of each vector (-1: none) and its nearest points, nearest first."""
    def run(batches):
        for b in batches:
            x = unit(matrix(b.column("vec")))
            wide = np.zeros((len(x), points.shape[1]))
            wide[:, :x.shape[1]] = x
            sims = wide @ points.T
            best = sims[:, :taken].argmax(axis=1) if taken else np.zeros(len(x), np.int64)
            inside = sims[np.arange(len(x)), best] >= core if taken else np.zeros(len(x), bool)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :near].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.where(inside, best, -1), pa.int32()), pa.array(order.tolist(), pa.list_(pa.int32()))],
                                             names=[*b.schema.names, "core", "points"])
    return run


def verify(least: float):
    """Links in lists that arrive sorted by list and tile; the last list of a batch waits for more."""
    def links(rows: pa.Table):
        role, core = rows.column("role").to_numpy(), rows.column("core").to_numpy()
        ids = np.array(rows.column("cid").to_pylist(), object)
        x = unit(matrix(rows.column("vec").combine_chunks()))
        left, right = np.flatnonzero(role & LEFT), np.flatnonzero(role & RIGHT)
        i, j = np.nonzero(x[left] @ x[right].T >= least)
        i, j = left[i], right[j]
        keep = (core[j] >= 0) | (ids[i] < ids[j]) if len(i) else np.zeros(0, bool)  # two outside cores: once
        return ids[i[keep.astype(bool)]], ids[j[keep.astype(bool)]]

    def run(batches):
        names, waiting = ["list", "tile"], None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if waiting is None else pa.concat_tables([waiting, t])
            lists, tiles = (t.column(c).to_numpy() for c in names)
            ends = np.flatnonzero((lists[1:] != lists[:-1]) | (tiles[1:] != tiles[:-1])) + 1
            cuts = [0, *ends.tolist()]
            yield from emit(links(t.slice(a, z - a)) for a, z in zip(cuts[:-1], cuts[1:]) if z - a > 1)
            waiting = t.slice(cuts[-1])
        if waiting is not None and waiting.num_rows > 1:
            yield from emit([links(waiting)])

    def emit(found):
        one, two = [], []
        for a, b in found:
            one.extend(a), two.extend(b)
        yield pa.RecordBatch.from_arrays([pa.array(one, pa.binary()), pa.array(two, pa.binary())], names=["a", "b"])
    return run


def listed(described: DataFrame, tile_rows: int) -> DataFrame:
    """``cid, list, tile, role``: which tiles of which lists a vector goes to.

    A list compares its vectors outside cores (left) with all of its vectors (right). Both sides are
    cut into parts of about ``tile_rows``; most lists are one tile.
    """
    pairs = described.select("cid", (F.col("core") < 0).alias("free"), F.explode(F.expr(
        "flatten(transform(points, (p, i) -> transform(slice(points, i + 2, size(points)), q -> shiftleft(cast(least(p, q) AS BIGINT), 32) + greatest(p, q))))")).alias("list"))
    sizes = (pairs.groupBy("list").agg(F.sum(F.col("free").cast("long")).alias("n_left"), F.count("*").alias("n_right"))
             .filter("n_left > 0 AND n_right > 1")
             .select("list", F.ceil(F.col("n_left") / tile_rows).cast("int").alias("lefts"), F.ceil(F.col("n_right") / tile_rows).cast("int").alias("rights")))
    tiles = """filter(flatten(array(
        if(free, transform(sequence(0, rights - 1), j -> struct(l * rights + j AS tile, if(j = r, 3, 1) AS role)), array()),
        transform(sequence(0, lefts - 1), i -> struct(i * rights + r AS tile, if(free AND i = l, 0, 2) AS role)))), x -> x.role > 0)"""
    return (pairs.join(sizes, "list").withColumn("l", F.expr("pmod(xxhash64(cid, 1), lefts)").cast("int"))
            .withColumn("r", F.expr("pmod(xxhash64(cid, 2), rights)").cast("int"))
            .select("cid", "list", F.explode(F.expr(tiles)).alias("t")).select("cid", "list", "t.tile", "t.role"))


def near_vectors(vectors: DataFrame, least: float = 0.9, near: int = 8, most_points: int = 4096, tile_rows: int = 2048) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors(vec_id, embedding)``.

    Rows are linked at a cosine of ``least`` or more, computed in doubles. Equal vectors are linked;
    null, empty and zero vectors and those with null or non-finite entries are not, and are their own
    component. Shorter vectors count as if filled with zeros. Repeated rows count as other vectors.
    A null vec_id gives no component to others and is not kept. Other columns are ignored.

    Links are looked for among vectors that share two of their ``near`` nearest points; the points
    are twice the root of the table, 64 at least and ``most_points`` at most, chosen from a hashed
    sample of four times as many vectors.
    """
    rows = cut(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
               .mapInArrow(pack, "vec_id long, vec binary").withColumn("cid", F.unhex(F.md5("vec"))))
    classes = cut(rows.filter("cid IS NOT NULL").groupBy("cid").agg(F.count("*").alias("m"), F.min("vec_id").alias("least_id"), F.max("vec").alias("vec")))
    size = classes.agg(F.count("*").alias("n"), F.max(F.octet_length("vec")).alias("bytes")).first()
    count = int(min(most_points, max(64, 2 * math.isqrt(size.n))))
    share = min(1.0, 4 * count / max(size.n, 1))
    sample = [r.vec for r in classes.filter(F.pmod(F.xxhash64("cid"), F.lit(1 << 30)) < int(share * (1 << 30)))  # about 4 * count vectors
              .select("vec").orderBy(F.xxhash64("cid", F.lit(3))).collect()]
    dims = (size.bytes or 8) // 8
    known = np.zeros((len(sample), dims))
    for row, v in zip(known, sample):
        row[:len(v) // 8] = np.frombuffer(bytes(v), np.float64)
    half = math.acos(least) / 2
    points, taken = choose_points(unit(known) if len(known) else known, count, math.cos(min(math.pi, 4 * half + 1e-6)), dims)
    described = cut(classes.mapInArrow(describe(points, taken, math.cos(half) + 1e-12, near),
                                       "cid binary, m long, least_id long, vec binary, core int, points array<int>"))

    calls = listed(described.select("cid", "core", "points"), tile_rows).groupBy("cid").agg(F.collect_list(F.struct("list", "tile", "role")).alias("calls"))
    lists = (described.select("cid", "core", "vec").join(calls, "cid").select("cid", "core", "vec", F.explode("calls").alias("c"))
             .select("c.list", "c.tile", "c.role", "cid", "core", "vec"))
    links = cut(lists.repartition("list", "tile").sortWithinPartitions("list", "tile").mapInArrow(verify(least), "a binary, b binary").distinct())

    mass = described.select("cid", "m")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    outside = both.join(mass.withColumnRenamed("cid", "b"), "b").groupBy("a").agg(F.sum("m").alias("far")).withColumnRenamed("a", "cid")
    cores = described.filter("core >= 0").groupBy("core").agg(F.sum("m").alias("in_core"), F.min("cid").alias("hub"))
    stars = described.filter("core >= 0").select("cid", "core").join(F.broadcast(cores), "core")  # a row per point
    joined = components(links.unionByName(stars.select(F.col("cid").alias("a"), F.col("hub").alias("b"))))
    rooted = described.select("cid", "least_id").join(joined.select(F.col("a").alias("cid"), F.col("b").alias("root")), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_class = (described.select("cid", "m", "core").join(F.broadcast(cores.select("core", "in_core")), "core", "left").join(outside, "cid", "left")
                .select("cid", (F.coalesce("in_core", "m") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
                .join(rooted.select("cid", "root").join(ids, "root").select("cid", "component_id"), "cid"))
    out = rows.select("vec_id", "cid").join(of_class, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
