"""Building blocks that stay exact when one key holds a large share of all rows.

Ranks, running totals and gap chains are computed per (key, bucket) and stitched with a
table of bucket totals, so no task ever sees a whole key. Exact quantiles are one sorted array
of a bounded length, or radix selection, which counts digits of the values and moves no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadrift.session import cut

# Largest group that one window may order.
HOT_GROUP_ROWS = 2_000_000
# Values in an array, and counters of one cell in a round of radix selection.
CELL = 1 << 16


def meet(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which NULL meets NULL; columns of ``left``, then the rest of ``right``."""
    keys = list(keys)
    other = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(other, same, how).drop(*[f"_r_{k}" for k in keys])


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Add the columns of a per-key table, NULL keys included; without keys, of a one-row table."""
    if keys:
        return meet(df, stats, keys, how)
    packed = stats.select(F.struct(*[F.col(c) for c in stats.columns])).scalar()
    return df.withColumn("_s", packed).select(*df.columns, "_s.*")


def group_key(keys: Sequence[str], *more: str) -> Column:
    """The keys as one value that is never NULL itself, so windows, sums and joins on it keep NULL keys."""
    return F.struct(*[F.col(k) for k in (*keys, *more)]) if keys or more else F.struct(F.lit(0).alias("_none"))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence, bucket: Column,
                values: dict[str, Column | str], largest: int | None = None) -> DataFrame:
    """Inclusive running sums of ``values`` per key in the order of ``order``.

    A plain window while the ``largest`` group is known to fit one task. Otherwise sums run
    per bucket and are stitched: ``bucket`` must not decrease along ``order`` (NULL first) and
    bounds what one task sorts. NULL keys and NULL positions are kept in both.
    """
    keys = list(keys)
    if largest is not None and largest <= HOT_GROUP_ROWS:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        return df.select("*", *[F.sum(v).over(w).alias(n) for n, v in values.items()])
    b = df.withColumn("_b", bucket)
    for name, v in values.items():
        b = b.withColumn(f"_v_{name}", F.col(v) if isinstance(v, str) else v)
    b = b.withColumn("_g", group_key(keys, "_b"))
    local = Window.partitionBy("_g").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("_k").orderBy("_g._b").rowsBetween(Window.unboundedPreceding, -1)
    totals = b.groupBy("_g").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values]).withColumn(
        "_k", F.struct(*[F.col("_g").getField(k).alias(k) for k in keys] or [F.lit(0).alias("_none")]))
    offsets = totals.select("_g", *[
        F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values])
    rows = b.select("*", *[F.sum(f"_v_{n}").over(local).alias(f"_l_{n}") for n in values])
    joined = rows.join(offsets, "_g")
    return joined.select(*df.columns, *[
        (F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in values])


def ordered_rank(df: DataFrame, keys: Sequence[str], order: Sequence, bucket: Column,
                 name: str = "rank", largest: int | None = None) -> DataFrame:
    """1-based row number per key in the order of ``order``."""
    if largest is not None and largest <= HOT_GROUP_ROWS:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.row_number().over(w).cast("long"))
    return running_sum(df, keys, order, bucket, {name: F.lit(1).cast("long")})


def seeded_hash(seed: int | str, *cols: str) -> Column:
    """Random-looking but repeatable order key: md5 of the seed and the row's own key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def hash_rank(df: DataFrame, keys: Sequence[str], seed: int | str, ids: Sequence[str],
              name: str = "rank", digits: int = 3, largest: int | None = None) -> DataFrame:
    """1-based rank per key in seeded md5 order; the leading hash digits are even buckets."""
    h = df.withColumn("_h", seeded_hash(seed, *ids))
    return ordered_rank(h, keys, ["_h", *ids], F.substring("_h", 1, digits), name, largest).drop("_h")


def range_bucketed(df: DataFrame, order: Sequence) -> DataFrame:
    """Write ``df`` range partitioned by ``order`` with the partition number as ``_rb``."""
    return cut(df.repartitionByRange(*order).withColumn("_rb", F.spark_partition_id()))


def gap_chains(df: DataFrame, keys: Sequence[str], pos: str, gap, span: int,
               name: str = "chain_start", largest: int | None = None) -> DataFrame:
    """Give each row the position where its chain starts.

    Rows chain while consecutive positions differ by at most ``gap``. One window while the
    ``largest`` group is known to fit one task; otherwise buckets of ``span`` positions are
    chained and stitched, for which positions must be unique per key.
    """
    keys = list(keys)
    if largest is not None and largest <= HOT_GROUP_ROWS:
        w = Window.partitionBy(*keys).orderBy(pos)
        prev = F.lag(pos).over(w)
        start = F.when(prev.isNull() | (F.col(pos) - prev > gap), F.col(pos))
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return (df.withColumn("_start", start)
                .withColumn(name, F.max("_start").over(upto)).drop("_start"))
    b = df.withColumn("_b", F.floor(F.col(pos) / F.lit(span))).withColumn("_g", group_key(keys, "_b"))
    key = F.struct(*[F.col("_g").getField(k).alias(k) for k in keys] or [F.lit(0).alias("_none")])
    local = Window.partitionBy("_g").orderBy(pos)
    over_buckets = Window.partitionBy("_k").orderBy("_g._b")
    edges = (b.groupBy("_g").agg(F.max(pos).alias("_last")).withColumn("_k", key)
             .select("_g", F.lag("_last").over(over_buckets).alias("_prev_last")))
    flagged = (
        b.withColumn("_lag", F.lag(pos).over(local)).join(edges, "_g")
        .withColumn("_prev", F.coalesce("_lag", "_prev_last"))
        .withColumn("_start", F.when(F.col("_prev").isNull()
                                     | (F.col(pos) - F.col("_prev") > gap), F.col(pos)))
    )
    carried = (
        flagged.groupBy("_g").agg(F.max("_start").alias("_ls")).withColumn("_k", key)
        .select("_g", F.max("_ls").over(
            over_buckets.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    )
    seen = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (flagged.withColumn("_in", F.max("_start").over(seen))
            .join(carried, "_g")
            .select(*df.columns, F.coalesce("_in", "_carry").alias(name)))


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows in the largest group: a map-side combined count, one number to the driver."""
    if not keys:
        return df.count()
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                    limit: int | None = None, largest: int | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per key, one column per entry of ``probs``.

    NULL is not counted, NaN is the largest value; a group without values has NULL. ``largest``
    passes on a group size already known to the caller.
    """
    keys = list(keys)
    limit = CELL if limit is None else limit
    largest = largest_group(df, keys) if largest is None else largest
    if largest <= limit:
        g = sorted_values(df, keys, value)
        return g.select(*keys, *[quantile_of(F.col("_s"), p).alias(n) for n, p in probs.items()])
    return _quantiles_by_digits(df, keys, value, probs, limit)


def sorted_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sorted array ``_s`` per key. Only for groups whose size was checked to fit one task."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("_s"))


def quantile_of(values: Column, p: float) -> Column:
    """Linearly interpolated quantile of a sorted array; NULL when it is empty."""
    h = (F.size(values) - 1) * F.lit(float(p))
    lo = F.get(values, F.floor(h).cast("int"))
    return lo + (F.get(values, F.ceil(h).cast("int")) - lo) * (h - F.floor(h))


def mad_of(values: Column, median: Column) -> Column:
    """Median absolute deviation of a sorted array."""
    return quantile_of(F.sort_array(F.transform(values, lambda x: F.abs(x - median))), 0.5)


def ordered_bits(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Add the 64-bit integer that orders as the double ``value`` does: its bits, negated below zero.

    The exponent comes from a logarithm that is put right by comparison with powers of two; scaling
    by powers of two is exact. Both zeros are 0, NaN is the largest integer, NULL stays NULL.
    """
    t = "(52 - _e)"
    return (rows.withColumn("_x", F.col(value).cast("double"))
            .withColumn("_a", F.expr("IF(abs(_x) < double('Infinity'), abs(_x), NULL)"))
            .withColumn("_e", F.expr("CAST(floor(log2(_a)) AS INT)"))
            .withColumn("_e", F.expr("_e + IF(pow(2D, _e + 1) <= _a, 1, 0) - IF(pow(2D, _e) > _a, 1, 0)"))
            .withColumn("_e", F.expr("greatest(coalesce(_e, -1022), -1022)"))
            .withColumn(name, F.expr(f"""CASE WHEN isnan(_x) THEN {2**63 - 1}L WHEN _a IS NULL THEN {2047 << 52}L * CAST(signum(_x) AS BIGINT)
                ELSE CAST(signum(_x) AS BIGINT) * ((_e + 1022) * {1 << 52}L + CAST(_a * pow(2D, {t} div 2) * pow(2D, {t} - {t} div 2) AS BIGINT)) END"""))
            .withColumn(name, F.when(F.col("_x").isNotNull(), F.col(name))).drop("_x", "_a", "_e"))


def double_of(bits: str) -> Column:
    """The double of an integer of ``ordered_bits``."""
    m, t = f"abs({bits})", f"(CAST(shiftright(abs({bits}), 52) AS INT) - 1075)"
    f = f"({m} & {(1 << 52) - 1}L)"
    return F.expr(f"""CASE WHEN {bits} = {2**63 - 1}L THEN double('NaN') WHEN {m} = {2047 << 52}L THEN double('Infinity') * signum({bits})
        WHEN shiftright({m}, 52) = 0 THEN signum({bits}) * {f} * pow(2D, -1074)
        ELSE signum({bits}) * ({f} + {1 << 52}L) * pow(2D, {t} div 2) * pow(2D, {t} - {t} div 2) END""")


def values_at_ranks(rows: DataFrame, ranks: DataFrame, cell: int = CELL) -> DataFrame:
    """``_k, _r, _v``: the value at 0-based rank ``_r`` among a key's integers ``_o``, by radix selection.

    A round counts the next 16 bits of the values in each wanted cell, with map-side combination,
    and narrows every (key, rank) to one digit. A cell of at most ``cell`` values is told apart by all
    its remaining bits at once, so a cell never has more counters than that or than there are
    digits. State is one row per key and rank; rows are scanned, never moved. Four rounds at most.
    """
    state = ranks.select("_k", "_r", F.lit(0).cast("long").alias("_cell"), F.lit(64).alias("_s"), F.col("_r").alias("_rest"), "_n")
    for least in (48, 32, 16, 0):
        to = F.when(F.col("_n") <= cell, 0).otherwise(least).alias("_to")
        wanted = state.filter("_s > 0")
        cells = wanted.select("_k", "_cell", "_s", to).distinct()
        here = rows if least == 48 else rows.withColumn("_cell", F.shiftright("_o", least + 16))
        joined = here.join(cells.drop("_cell") if least == 48 else cells, "_k" if least == 48 else ["_k", "_cell"])
        if least == 48:
            joined = joined.withColumn("_cell", F.lit(0).cast("long"))
        counted = joined.groupBy("_k", "_cell", "_to", F.expr("shiftright(_o, _to)").alias("_d")).agg(F.count("*").alias("_c"))
        upto = Window.partitionBy("_k", "_cell").orderBy("_d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = counted.withColumn("_cum", F.sum("_c").over(upto))
        found = (wanted.drop("_n").join(summed, ["_k", "_cell"]).filter((F.col("_rest") < F.col("_cum")) & (F.col("_rest") >= F.col("_cum") - F.col("_c")))
                 .select("_k", "_r", F.col("_d").alias("_cell"), F.col("_to").alias("_s"), (F.col("_rest") - F.col("_cum") + F.col("_c")).alias("_rest"), F.col("_c").alias("_n")))
        state = cut(found if least == 48 else found.unionByName(state.filter("_s = 0")))
        if state.filter("_s > 0").isEmpty():
            break
    return state.select("_k", "_r", double_of("_cell").alias("_v"))


def _quantiles_by_digits(df, keys, value, probs, cell):
    """Quantiles of groups of any size; groups without a value keep their row, with NULL."""
    keyed = cut(ordered_bits(df.select(group_key(keys).alias("_k"), F.col(value).alias("_y")), "_y", "_o").select("_k", "_o"))
    rows = keyed.filter("_o IS NOT NULL")
    wanted = F.array(*[F.struct(F.lit(name).alias("_p"), F.lit(float(p)).alias("_q")) for name, p in probs.items()])
    target = (rows.groupBy("_k").agg(F.count("*").alias("_n")).select("_k", "_n", F.explode(wanted).alias("_w"))
              .select("_k", "_n", "_w._p", ((F.col("_n") - 1) * F.col("_w._q")).alias("_h")))
    target = cut(target.withColumn("_r0", F.floor("_h")).withColumn("_r1", F.ceil("_h")))
    ranks = target.select("_k", "_n", F.explode(F.array("_r0", "_r1")).alias("_r")).distinct()
    at = values_at_ranks(rows, ranks, cell).groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_at"))  # two a probability
    lo, hi = F.col("_at")[F.col("_r0")], F.col("_at")[F.col("_r1")]
    solved = target.join(at, "_k").withColumn("_v", lo + (hi - lo) * (F.col("_h") - F.col("_r0")))
    known = solved.groupBy("_k").agg(*[F.max(F.when(F.col("_p") == name, F.col("_v"))).alias(name) for name in probs])
    every = keyed.select("_k").distinct() if keys else df.sparkSession.range(1).select(group_key([]).alias("_k"))
    return every.join(known, "_k", "left").select(*[F.col("_k").getField(k).alias(k) for k in keys], *probs)


def robust_stats(df: DataFrame, keys: Sequence[str], value: str, *, scale: float = 1.4826,
                 limit: int | None = None, names: tuple[str, str] = ("median", "mad_sigma"),
                 largest: int | None = None) -> DataFrame:
    """Median and scaled median absolute deviation per key."""
    keys = list(keys)
    largest = largest_group(df, keys) if largest is None else largest
    if largest <= (CELL if limit is None else limit):
        g = sorted_values(df, keys, value).withColumn(names[0], quantile_of(F.col("_s"), 0.5))
        return g.select(*keys, names[0], (mad_of(F.col("_s"), F.col(names[0])) * F.lit(scale)).alias(names[1]))
    med = exact_quantiles(df, keys, value, {names[0]: 0.5}, limit, largest)
    dev = attach(df.select(*keys, value), med, keys).select(
        *keys, F.abs(F.col(value) - F.col(names[0])).alias("_d"))
    mad = exact_quantiles(dev, keys, "_d", {names[1]: 0.5}, limit, largest)
    mad = mad.withColumn(names[1], F.col(names[1]) * F.lit(scale))
    return attach(med, mad, keys)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence, k: int,
                name: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Catalyst limits each map task to k rows per key first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


# Catalyst limits rows per key before the shuffle up to this k.
GROUP_LIMIT_K = 1000


def seeded_sample(df: DataFrame, keys: Sequence[str], ids: Sequence[str], n: int, seed: int | str = 0) -> DataFrame:
    """``n`` rows per key without replacement: the first in seeded md5 order."""
    if n <= GROUP_LIMIT_K:
        h = df.withColumn("_h", seeded_hash(seed, *ids))
        return top_per_key(h, keys, ["_h", *ids], n, "_r").drop("_h", "_r")
    return hash_rank(df, keys, seed, ids, "_r").filter(F.col("_r") <= n).drop("_r")


def order_statistic(df: DataFrame, keys: Sequence[str], value: str, fraction: float,
                    least: int = 1, limit: int | None = None) -> DataFrame:
    """Per key: sum of the k largest values with k = max(least, int(fraction * n)), and of all.

    Uses the exact k-th largest value as a cut, so nothing is sorted or ranked: rows above
    it are summed and the ties at the cut fill the remaining places.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(value).alias("_n"))
    k = F.greatest(F.lit(least), F.floor(F.lit(fraction) * F.col("_n"))).cast("long")
    cutv = kth_largest(df, keys, value, sizes.withColumn("_k", k), limit)
    joined = attach(df.select(*keys, value), cutv, keys)
    above = F.col(value) > F.col("_kth")
    return joined.groupBy(*keys).agg(
        F.max("_k").alias("n_taken"), F.max("_n").alias("n_values"), F.sum(value).alias("total"),
        (F.coalesce(F.sum(F.when(above, F.col(value))), F.lit(0.0))
         + (F.max("_k") - F.count_if(above)) * F.max("_kth")).alias("top_sum"))


def kth_largest(df, keys, value, sizes, limit=None):
    """Per key the ``_k``-th largest value (``sizes`` holds keys, _n, _k)."""
    limit = CELL if limit is None else limit
    top = [F.max("_n").alias("_n"), F.max("_k").alias("_k")]
    if largest_group(df, keys) <= limit:
        counted = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
        w = Window.partitionBy(*keys).orderBy(F.col(value).desc()).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        ranked = counted.withColumn("_cum", F.sum("_c").over(w))
        return (attach(ranked, sizes, keys).groupBy(*keys)
                .agg(*top, F.max(F.when(F.col("_cum") >= F.col("_k"), F.col(value))).alias("_kth")))
    rows = cut(ordered_bits(df.select(group_key(keys).alias("_g"), F.col(value).alias("_y")), "_y", "_o")
               .filter("_o IS NOT NULL").select(F.col("_g").alias("_k"), "_o"))
    every = cut(sizes.select(group_key(keys).alias("_g"), "_n", F.col("_k").alias("_want")))
    ranks = every.filter("_n > 0").select(F.col("_g").alias("_k"), "_n", F.greatest(F.col("_n") - F.col("_want"), F.lit(0)).cast("long").alias("_r"))
    at = values_at_ranks(rows, ranks, limit).select(F.col("_k").alias("_g"), F.col("_v").alias("_kth"))
    return every.join(at, "_g", "left").select(*[F.col("_g").getField(k).alias(k) for k in keys], "_n", F.col("_want").alias("_k"), "_kth")
