"""Train, val and held-out pools; sampling plans. Random order is seeded md5 everywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadrift.operators import scale

POOLS = ("train", "val", "heldout")


def allocate(n: Column, fracs: Sequence[float], mins: Sequence) -> list[Column]:
    """Largest-remainder shares of ``n`` for (train, val, heldout) with minimums.

    If the minimums do not fit, val gives first, then whichever other pool is further above
    its own minimum, train on a tie. ``mins`` holds integers or columns of at most 1.
    """
    raw = [n * F.lit(float(f)) for f in fracs]
    m = [x if isinstance(x, Column) else F.lit(int(x)) for x in mins]
    base = [F.greatest(F.floor(r), k.cast("long")) for r, k in zip(raw, m)]
    over = F.greatest(base[0] + base[1] + base[2] - n, F.lit(0))
    from_val = F.least(base[1], over)
    train, val, held = base[0], base[1] - from_val, base[2]
    left = over - from_val
    for _ in range(sum(x if isinstance(x, int) else 1 for x in mins)):
        st, sh = train - m[0], held - m[2]
        take_t = (left > 0) & (st > 0) & (st >= sh)
        take_h = (left > 0) & ~take_t & (sh > 0)
        train = train - F.when(take_t, 1).otherwise(0)
        held = held - F.when(take_h, 1).otherwise(0)
        left = left - F.when(take_t | take_h, 1).otherwise(0)
    rest = F.greatest(n - (base[0] + base[1] + base[2]), F.lit(0))
    gap = [r - b for r, b in zip(raw, base)]
    out = []
    for i, cur in enumerate((train, val, held)):
        ahead = sum((F.when((gap[j] > gap[i]) | ((gap[j] == gap[i]) & F.lit(j < i)), 1).otherwise(0)
                     for j in range(3) if j != i), F.lit(0))
        out.append((cur + F.greatest(F.floor((rest - ahead + 2) / 3), F.lit(0))).cast("long"))
    return out


def stratified_split(df: DataFrame, strata: Sequence[str], id_col: str, fracs: Sequence[float] = (0.5, 0.1, 0.4),
                     seed: int = 42) -> DataFrame:
    """Adds ``pool``: per stratum in seeded order first train, then heldout, then val."""
    if fracs[2] <= 0:
        raise ValueError("train and val fractions must leave a held-out share")
    strata = list(strata)
    sizes = df.groupBy(*strata).agg(F.count("*").alias("_n"))
    n = F.col("_n")
    t, v, h = allocate(n, fracs, (F.when(n >= 1, 1).otherwise(0), 0, F.when(n >= 2, 1).otherwise(0)))
    plan = sizes.select(*strata, t.alias("_t"), h.alias("_h"))
    ranked = scale.hash_rank(df, strata, seed, [id_col], "_r", largest=scale.largest_group(df, strata))
    pool = (F.when(F.col("_r") <= F.col("_t"), "train")
            .when(F.col("_r") <= F.col("_t") + F.col("_h"), "heldout").otherwise("val"))
    return scale.meet(ranked, plan, strata).select(*df.columns, pool.alias("pool"))


def _repair_pass(df: DataFrame, required: str, target: str, id_col: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """Each target without ``required`` gives one cadence to it: from val first, seeded choice."""
    order = F.struct(F.when(F.col("pool") == "val", 0).otherwise(1).alias("p"),
                     scale.seeded_hash(f"{seed}-{required}", id_col).alias("h"),
                     F.col(id_col).alias("id"), F.col("pool").alias("from"))
    missing = df.groupBy(target).agg(
        F.count_if(F.col("pool") == required).alias("_have"), F.count("*").alias("_n"),
        F.min(F.when(F.col("pool") != required, order)).alias("_d")).filter("_have = 0")
    moves = missing.select(target, F.col("_d.id").alias("_id"), F.col("_d.from").alias("from_pool"),
                           F.lit(required).alias("to_pool"), F.col("_d").isNull().alias("failed"))
    hit = scale.meet(df, moves.select(target, "_id"), [target], "left")
    fixed = hit.withColumn("pool", F.when(F.col(id_col) == F.col("_id"), required).otherwise(F.col("pool"))).drop("_id")
    return fixed.select(*df.columns), moves


def repair_coverage(df: DataFrame, target: str = "target", id_col: str = "cadence",
                    required: Sequence[str] = ("train", "heldout"), seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(repaired rows, moves): every target ends in every required pool where it can.

    Pools are repaired in turn because a later pool sees the earlier moves; targets share
    no rows, so one pass repairs all of them at once.
    """
    log = None
    for pool in required:
        df, moves = _repair_pass(df, pool, target, id_col, seed)
        log = moves if log is None else log.unionByName(moves)
    return df, log.withColumnRenamed("_id", id_col)


def day_diversity(df: DataFrame, band: Sequence[str] = ("band",), day: str = "day") -> DataFrame:
    """(band, pool) groups whose cadences all come from one day."""
    g = df.groupBy(*band, "pool").agg(F.countDistinct(day).alias("_d"), F.count("*").alias("n_cadences"),
                                      F.min(day).alias("only_day"))
    return g.filter("_d = 1").drop("_d")


def pool_coverage(df: DataFrame, by: str) -> DataFrame:
    """Cadences per pool for each value of ``by``; missing pools count 0."""
    return df.groupBy(by).pivot("pool", list(POOLS)).count().fillna(0, list(POOLS))


def fraction_split(df: DataFrame, id_col: str, val_fraction: float, seed: int = 42) -> DataFrame:
    """Adds ``split``: seeded order, at least one and at most n - 1 rows in val.

    A single row is left in train: split its snippets instead (``fraction_split`` on them).
    """
    n = df.count()
    n_val = min(max(1, int(n * val_fraction)), n - 1)
    ranked = scale.hash_rank(df, [], seed, [id_col], "_r", largest=n)
    return ranked.withColumn("split", F.when(F.col("_r") <= n_val, "val").otherwise("train")).drop("_r")


def exclude_targets(df: DataFrame, id_col: str, target: str, excluded: Sequence[str], train_fraction: float,
                    val_fraction: float, seed: int = 42) -> DataFrame:
    """Adds ``split``: listed targets always held out; the rest split in seeded order.

    The first int(n * train_fraction) of the rest are train and val, val taking the first
    max(1, int(m * val_fraction)) of them.
    """
    names = df.sparkSession.createDataFrame([(x,) for x in excluded], f"`{target}` string")
    out = df.join(names, target, "left_semi").withColumn("split", F.lit("inject_recovery"))
    rest = df.join(names, target, "left_anti")
    n = rest.count()
    m = int(n * train_fraction)
    n_val = max(1, int(m * val_fraction))
    ranked = scale.hash_rank(rest, [], seed, [id_col], "_r", largest=n)
    r = F.col("_r")
    kept = ranked.withColumn("split", F.when(r > m, "inject_recovery").when(r <= n_val, "val").otherwise("train"))
    return kept.select(*df.columns, "split").unionByName(out.select(*df.columns, "split"))


def plan_snippets(df: DataFrame, order: str, avail: str, cap_per: int, cap_total: int) -> DataFrame:
    """Snippets to take per cadence in manifest order until ``cap_total`` is reached."""
    d = df.withColumn("_x", F.greatest(F.least(F.lit(cap_per), F.col(avail)), F.lit(0)).cast("long"))
    run = scale.running_sum(d, [], [order], F.floor(F.col(order) / (1 << 20)), {"_cum": "_x"}, largest=df.count())
    take = F.greatest(F.lit(0), F.least(F.col("_x"), cap_total - (F.col("_cum") - F.col("_x"))))
    return run.withColumn("take", take).filter("take > 0").select(*df.columns, "take")


def sample_per_group(df: DataFrame, keys: Sequence[str], ids: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` rows per group without replacement in seeded order."""
    return scale.seeded_sample(df, keys, ids, n, seed)


def trial_grid(sites: DataFrame, morphologies: Sequence[str], snrs: Sequence[float], seed: int = 0) -> DataFrame:
    """Sites x morphologies x SNRs with one seed per (cadence, site, morphology)."""
    m = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("m_idx"), F.lit(n).alias("morphology"))
                            for i, n in enumerate(morphologies)]))
    return (sites.select("*", m.alias("_m")).select(*sites.columns, "_m.*")
            .withColumn("snr", F.explode(F.array(*[F.lit(float(s)) for s in snrs])))
            .withColumn("site_seed", seed + 1000 * F.col("cadence_idx") + F.col("site") + 100000 * F.col("m_idx")))
