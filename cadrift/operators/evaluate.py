"""Recovery, ranking and separation figures; energy-matched pairs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadrift.operators import scale, stats
from cadrift.session import cut


# ------------------------------------------------------------------ ranking maths

def roc_auc(df: DataFrame, keys: Sequence[str], label: str, score: str, free: bool = False) -> DataFrame:
    """Exact AUC per key, ties counted half; with ``free`` the better orientation.

    Rows are first counted per distinct score. Negatives below each score come from a
    running total over range partitions, so even one key holding all rows is spread out.
    """
    keys = list(keys)
    counts = df.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(
        F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
    ranged = scale.range_bucketed(counts, [score])
    run = scale.running_sum(ranged, keys, [score], F.col("_rb"), {"_cum": "_n"})
    half = F.col("_p") * (F.col("_cum") - F.col("_n") + F.col("_n") / 2)
    a = run.groupBy(*keys).agg(F.sum(half).alias("_u"), F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"))
    auc = F.try_divide(F.col("_u"), F.col("n_pos") * F.col("n_neg"))
    return a.select(*keys, (F.greatest(auc, 1 - auc) if free else auc).alias("auc"), "n_pos", "n_neg")


def tpr_at_fpr(df: DataFrame, keys: Sequence[str], label: str, score: str, fpr: float = 0.10) -> DataFrame:
    """Share (%) of positives strictly above the (1 - fpr) quantile of the negatives."""
    keys = list(keys)
    thr = scale.exact_quantiles(df.filter(F.col(label) == 0), keys, score, {"threshold": 1 - fpr})
    pos = df.filter(F.col(label) == 1).select(*keys, score)
    hit = F.avg((F.col(score) > F.col("threshold")).cast("int")) * 100
    return scale.attach(pos, thr, keys).groupBy(*keys, "threshold").agg(hit.alias("tpr_pct"))


def scores_below(background: DataFrame, points: DataFrame, keys: Sequence[str], score: str = "score",
                 at: str = "at") -> DataFrame:
    """For each point: background rows strictly below it, equal to it, and in total, per key.

    Points and background are counted together per distinct value and totalled in one
    ordered pass, so the theta join never happens. Points are written first: a mean that is
    computed again can differ in its last bit and would not meet itself.
    """
    keys, points = list(keys), cut(points)
    bg = background.select(*keys, F.col(score).cast("double").alias("_v"), F.lit(1).alias("_bg"))
    pt = points.select(*keys, F.col(at).cast("double").alias("_v"), F.lit(0).alias("_bg"))
    counts = bg.unionByName(pt).groupBy(*keys, "_v").agg(F.sum("_bg").alias("_c"))
    run = scale.running_sum(scale.range_bucketed(counts, ["_v"]), keys, ["_v"], F.col("_rb"), {"_cum": "_c"})
    total = background.groupBy(*keys).agg(F.count(score).alias("n_background"))
    at_v = run.select(*keys, F.col("_v").alias("_at"), (F.col("_cum") - F.col("_c")).alias("n_below"),
                      F.col("_c").alias("n_equal"))
    j = scale.meet(points.withColumn("_at", F.col(at).cast("double")), at_v, [*keys, "_at"]).drop("_at")
    out = scale.attach(j, total, keys, "left") if keys else scale.attach(j, total, [])
    return out.withColumn("n_background", F.coalesce("n_background", F.lit(0)))


def detection_table(injected: DataFrame, calibration: DataFrame, background: DataFrame | None = None) -> DataFrame:
    """Per method and SNR: mean, std, distance above background, detection rates, rank.

    ``calibration``: method, center, spread (median and robust sigma of the search, or mean
    and std of quiet frames). ``background`` (method, score) adds the rank of the mean score.
    """
    j = scale.meet(injected, calibration, ["method"])
    c, s = F.col("center"), F.col("spread")
    t = j.groupBy("method", "snr", "center", "spread").agg(
        F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"),
        (F.avg((F.col("score") > c + 3 * s).cast("int")) * 100).alias("det_3s"),
        (F.avg((F.col("score") > c + 5 * s).cast("int")) * 100).alias("det_5s"))
    t = t.withColumn("sigma", F.when(s > 0, F.try_divide(F.col("mean_score") - c, s)).otherwise(F.lit(0.0))).drop(
        "center", "spread")
    if background is None:
        return t
    r = scores_below(background, t, ["method"], at="mean_score")
    return r.withColumn("rank_pct", F.try_divide("n_below", "n_background") * 100).drop(
        "n_below", "n_equal", "n_background")


def quiet_calibration(quiet: DataFrame) -> DataFrame:
    return quiet.groupBy("method").agg(F.avg("score").alias("center"), F.stddev_pop("score").alias("spread"))


def detection_floor(table: DataFrame, by: Sequence[str] = ("method",), rate: str = "det_3s",
                    at_least: float = 50.0) -> DataFrame:
    return table.groupBy(*by).agg(F.min(F.when(F.col(rate) >= at_least, F.col("snr"))).alias("floor_snr"))


def per_group_detection(injected: DataFrame, probe: DataFrame) -> DataFrame:
    """Detection against the pooled and each cadence's own threshold, with eta squared.

    injected: cadence_idx, method, snr, score; probe: cadence_idx, method, score.
    """
    own = scale.robust_stats(probe, ["method", "cadence_idx"], "score").select(
        "method", "cadence_idx", (F.col("median") + 3 * F.col("mad_sigma")).alias("t3"),
        (F.col("median") + 5 * F.col("mad_sigma")).alias("t5"))
    pool = scale.robust_stats(probe, ["method"], "score").select(
        "method", (F.col("median") + 3 * F.col("mad_sigma")).alias("pooled_thresh3"))
    spread = own.groupBy("method").agg(F.min("t3").alias("thresh3_min"), F.max("t3").alias("thresh3_max"))
    mid = scale.exact_quantiles(own, ["method"], "t3", {"thresh3_median": 0.5})
    j = scale.meet(scale.meet(injected, own, ["method", "cadence_idx"]), pool, ["method"])

    def share(t):
        return F.avg((F.col("score") > F.col(t)).cast("int")) * 100
    d = j.groupBy("method", "snr").agg(
        share("pooled_thresh3").alias("det_3s_pool"), share("t3").alias("det_3s_cad"),
        share("t5").alias("det_5s_cad"), F.count("*").alias("n_injections"),
        F.countDistinct("cadence_idx").alias("n_cadences"), F.max("pooled_thresh3").alias("pooled_thresh3"))
    eta = stats.eta_squared(injected, ["method", "snr"], "cadence_idx", "score").select("method", "snr", "eta2")
    return scale.meet(scale.meet(scale.meet(d, eta, ["method", "snr"]), spread, ["method"]), mid, ["method"])


def variance_verdict(detection: DataFrame, high_snr: float = 30.0) -> DataFrame:
    """between where cadence identity explains over half of the high-SNR variance."""
    m = detection.filter(F.col("snr") >= high_snr).groupBy("method").agg(F.avg("eta2").alias("mean_eta2"))
    return m.withColumn("dominates", F.when(F.col("mean_eta2") > 0.5, "between").otherwise("within"))


# ------------------------------------------------------------------ survival of trials

def survival_cascade(trials: DataFrame, stages: Sequence[str], by: str = "morphology",
                     pooled: str | None = None) -> DataFrame:
    """Share (%) of trials passing each stage, per SNR, per ``by`` and pooled (NULL).

    ``pooled`` names a column that tells the pooled rows from those of a NULL ``by``. Trials of a
    NULL SNR are a group like others.
    """
    rows = trials.rollup("snr", by).agg(F.grouping_id().alias("_g"), *[
        (F.avg(F.col(s).cast("double")) * 100).alias(s) for s in stages]).filter("_g <> 3")
    return (rows.withColumn(pooled, F.col("_g") == 1) if pooled else rows).drop("_g")


def cut_cost(trials: DataFrame, a: str, b: str, by: Sequence[str] = ("morphology", "snr")) -> DataFrame:
    return trials.groupBy(*by).agg(
        ((F.avg(F.col(a).cast("double")) - F.avg(F.col(b).cast("double"))) * 100).alias("cost_pp"))


def review_budget(trials: DataFrame, caps: Sequence[int], survives: str = "survives", rank: str = "rank") -> DataFrame:
    """Share (%) of all trials that survive with a rank below each cap.

    Trials are counted per (snr, rank bucket) first, so caps never multiply the rows.
    """
    edge = sum((F.when(F.col(rank) >= c, 1).otherwise(0) for c in sorted(caps)), F.lit(0))
    level = F.when(F.col(survives), edge).otherwise(F.lit(len(caps)))
    c = trials.groupBy("snr", level.alias("_l")).agg(F.count("*").alias("_n"))
    caps_at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(cap).cast("long").alias("cap"))
                                  for i, cap in enumerate(sorted(caps))]))
    j = c.select("snr", "_l", "_n", caps_at.alias("c"))
    return j.groupBy("snr", F.col("c.cap").alias("cap")).agg(
        (F.sum(F.when(F.col("_l") <= F.col("c.i"), F.col("_n")).otherwise(0)) * 100 / F.sum("_n")).alias("complete_pct"))


def rank_among_incumbents(trials: DataFrame, incumbents: DataFrame, keys: Sequence[str],
                          contrast: str = "contrast", survives: str = "survives") -> DataFrame:
    """Incumbents strictly above the trial's contrast; -1 where the trial does not survive."""
    below = scores_below(incumbents, trials, keys, contrast, contrast)
    above = F.col("n_background") - F.col("n_below") - F.col("n_equal")
    return below.withColumn("rank", F.when(F.col(survives), above).otherwise(F.lit(-1)).cast("long")).withColumnRenamed(
        "n_background", "n_incumbent").drop("n_below", "n_equal")


def rank_quantiles(trials: DataFrame, probs: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    s = trials.filter("survives")
    return scale.exact_quantiles(s, ["snr"], "rank", {f"p{round(p * 100)}": p for p in probs})


def stage_flags(trials: DataFrame, thr: DataFrame) -> DataFrame:
    """Stage outcomes of each trial against its cadence's thresholds.

    trials: cadence_idx, score, n_on_hits_full, in_short_list; thr: cadence_idx, thresh_3,
    far_thresh, loose_thresh, off_ceiling.
    """
    j = scale.meet(trials, thr, ["cadence_idx"]).withColumn("min_thresh", F.least("far_thresh", "off_ceiling"))
    s = F.col("score")
    return j.select(
        *trials.columns, (s > F.col("thresh_3")).alias("s0_sigma3"), (s > F.col("far_thresh")).alias("s1_far1pct"),
        (s > F.col("loose_thresh")).alias("s1b_loose"), (s > F.col("min_thresh")).alias("s1_min"),
        (F.col("n_on_hits_full") >= 2).alias("s2_on_rows"), F.col("in_short_list").alias("s3_short_list"),
        (F.col("in_short_list") & (s > F.col("far_thresh"))).alias("survives"),
        (F.col("in_short_list") & (s > F.col("min_thresh"))).alias("survives_min"))


# ------------------------------------------------------------------ matched pairs

LEVELS = 4  # grids of caliper / 64, / 16, / 4 and the caliper itself


def caliper_match(a: DataFrame, b: DataFrame, caliper: float) -> DataFrame:
    """1:1 pairs (a_id, a_v, b_id, b_v) within ``caliper``; see ``caliper_pairs``."""
    return caliper_pairs(a, b, [caliper]).drop("caliper")


# Rows of a chain that one task may match.
CHAIN_ROWS = 1 << 20


def caliper_pairs(a: DataFrame, b: DataFrame, calipers: Sequence[float], chain_rows: int | None = None) -> DataFrame:
    """For every caliper, 1:1 pairs of near-equal values; no unmatched pair that close remains.

    Pairs the i-th a with the i-th b in cells of a fine grid first, then of ever coarser ones
    up to the caliper, which approximates nearest-first matching. What is left in a coarsest
    cell is of one side, so two more passes match neighbouring cells across their edges,
    nearest to the edge first, and stop where the distance exceeds the caliper: after that
    nothing within the caliper is left. Order differs from a sequential greedy match.

    Only neighbouring cells meet, so a chain of occupied cells is matched by itself: both sides are
    cut where a cell is empty, and every chain of up to ``chain_rows`` rows goes through all passes
    in one Arrow call. Rows of longer chains go through the same passes as joins on (caliper,
    cell, rank), a key that is never hot. NULL and NaN match nothing.

    a, b: (id, v). Returns caliper, a_id, a_v, b_id, b_v.
    """
    chain_rows = CHAIN_ROWS if chain_rows is None else chain_rows
    sides = [d.select("id", F.col("v").cast("double").alias("v"), F.lit(n).alias("side")) for d, n in ((a, "a"), (b, "b"))]
    both = sides[0].unionByName(sides[1]).filter("v IS NOT NULL AND NOT isnan(v)")
    cell = F.floor(F.col("v") / F.col("caliper"))
    left = cut(both.withColumn("caliper", F.explode(F.array(*[F.lit(float(c)) for c in calipers]))).withColumn("_k", cell))
    cells = cut(left.groupBy("caliper", "_k").agg(F.count("*").alias("_n"), F.count_if(F.col("side") == "a").alias("_a")))
    chained = scale.gap_chains(cells, ["caliper"], "_k", 1, 1 << 16, "_chain", scale.largest_group(cells, ["caliper"]))
    sizes = chained.groupBy("caliper", "_chain").agg(F.sum("_n").alias("_rows"), F.sum("_a").alias("_of_a"))
    sizes = sizes.filter((F.col("_of_a") > 0) & (F.col("_of_a") < F.col("_rows")))  # a chain of one side has no pairs
    chained = cut(chained.select("caliper", "_k", "_chain").join(sizes.select("caliper", "_chain", "_rows"), ["caliper", "_chain"]))
    placed = left.join(chained, ["caliper", "_k"])
    kind = left.schema["id"].dataType.simpleString()
    found = (placed.filter(F.col("_rows") <= chain_rows).select("caliper", "_chain", "id", "v", "side").groupBy("caliper", "_chain")
             .applyInArrow(_match_chain, f"caliper double, a_id {kind}, a_v double, b_id {kind}, b_v double"))
    long = chained.filter(F.col("_rows") > chain_rows)
    if long.isEmpty():
        return found
    return found.unionByName(_pairs_by_passes(left.join(long.select("caliper", "_k"), ["caliper", "_k"], "left_semi").drop("_k")))


def _levels(v, caliper, floor, step: int):
    """Cell of a pass inside cells; in passes over edges the lower and upper cell share the lower one's number."""
    if step < LEVELS:
        return floor(v / (caliper / 4 ** (LEVELS - 1 - step)))
    return floor(v / caliper)


def _match_chain(rows: pa.Table) -> pa.Table:
    """All passes over the rows of one chain."""
    caliper = rows.column("caliper")[0].as_py()
    ids, v = rows.column("id").combine_chunks(), rows.column("v").to_numpy()
    of_a = pc.equal(rows.column("side"), "a").to_numpy()
    order_id = pc.rank(ids, sort_keys="ascending", tiebreaker="first").to_numpy().astype(np.int64)
    open_, pairs = np.arange(len(v)), []
    for step in range(LEVELS + 2):
        x, side = v[open_], of_a[open_]
        cell = _levels(x, caliper, np.floor, step).astype(np.int64)
        slot, along = side, x
        if step >= LEVELS:
            low = (cell - (step - LEVELS)) % 2 == 0
            cell, slot, along = np.where(low, cell, cell - 1), low, np.where(low, -x, x)
        order = np.lexsort((order_id[open_], along, slot, side, cell))
        key = np.column_stack([cell, side, slot])[order]
        first = np.append(True, (key[1:] != key[:-1]).any(axis=1))
        rank = np.arange(len(order)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        numbers = np.unique(cell[order], return_inverse=True)[1] * (len(order) + 1) + rank
        up = slot[order]
        _, i, j = np.intersect1d(numbers[up], numbers[~up], return_indices=True)
        i, j = open_[order[up][i]], open_[order[~up][j]]
        ok = of_a[i] != of_a[j]
        if step >= LEVELS:
            ok &= np.abs(v[i] - v[j]) <= caliper
        i, j = i[ok], j[ok]
        pairs.append(np.column_stack([np.where(of_a[i], i, j), np.where(of_a[i], j, i)]))
        open_ = np.setdiff1d(open_, pairs[-1].ravel())
    one, two = np.concatenate(pairs).T
    return pa.table({"caliper": np.full(len(one), caliper), "a_id": ids.take(pa.array(one)), "a_v": v[one], "b_id": ids.take(pa.array(two)), "b_v": v[two]})


def _pairs_by_passes(left: DataFrame) -> DataFrame:
    """The same passes as ranked joins, each written before the next."""
    cell = F.floor(F.col("v") / F.col("caliper"))
    # cells only get finer and rows only leave, so this bounds every pass
    largest = 2 * scale.largest_group(left.select("caliper", "side", cell.alias("c")), ["caliper", "side", "c"])
    found = None
    for step in range(LEVELS + 2):
        d = left.withColumn("_k", _levels(F.col("v"), F.col("caliper"), F.floor, step))
        if step < LEVELS:
            d = d.select("caliper", "id", "v", "side", F.col("_k").alias("_c"), (F.col("side") == "a").alias("_slot"), F.col("v").alias("_d"))
        else:
            low = F.pmod(F.col("_k") - (step - LEVELS), F.lit(2)) == 0
            d = d.select(
                "caliper", "id", "v", "side", F.when(low, F.col("_k")).otherwise(F.col("_k") - 1).alias("_c"),
                low.alias("_slot"), F.when(low, -F.col("v")).otherwise(F.col("v")).alias("_d"))
        met = cut(_meet(d, largest, edges=step >= LEVELS))
        is_a = F.col("x.side") == "a"
        pairs = met.filter("paired").select(
            "caliper", F.when(is_a, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(is_a, F.col("y")).otherwise(F.col("x")).alias("b"))
        pairs = pairs.select("caliper", "a.id", "a.v", "b.id", "b.v").toDF("caliper", "a_id", "a_v", "b_id", "b_v")
        found = pairs if found is None else found.unionByName(pairs)
        left = met.filter("NOT paired").select("caliper", F.explode(F.array_compact(F.array("x", "y"))).alias("s")).select("caliper", "s.*")
    return found


def _meet(d: DataFrame, largest: int, edges: bool) -> DataFrame:
    """One row per (caliper, cell, rank) with the two rows that can meet there and whether they pair.

    The slots are the sides inside a cell, and the lower and upper cell at an edge, where a
    coarsest cell holds one side only.
    """
    key, order = ["caliper", "_c", "side", "_slot"], ["_d", "id"]
    bucket = F.lit(0)
    if largest > scale.HOT_GROUP_ROWS:
        d, bucket = scale.range_bucketed(d, order), F.col("_rb")
    ranked = scale.ordered_rank(d, key, order, bucket, "_i", largest)
    row = F.struct("id", "v", "side")
    g = ranked.groupBy("caliper", "_c", "_i").agg(F.max(F.when(F.col("_slot"), row)).alias("x"),
                                                  F.max(F.when(~F.col("_slot"), row)).alias("y"))
    ok = F.col("x.side") != F.col("y.side")
    if edges:
        ok = ok & (F.abs(F.col("x.v") - F.col("y.v")) <= F.col("caliper"))
    return g.select("caliper", "x", "y", F.coalesce(ok, F.lit(False)).alias("paired"))


CALIPERS = (0.10, 0.05, 0.03, 0.02, 0.01, 0.005)


def adaptive_caliper(a: DataFrame, b: DataFrame, calipers: Sequence[float] = CALIPERS, min_pairs: int = 20,
                     neutral: float = 0.58) -> tuple[float | None, DataFrame | None, float | None]:
    """(caliper, pairs, energy AUC): the loosest caliper whose pairs the value cannot tell apart.

    If none gets the orientation-free AUC down to ``neutral``, the one with the smallest AUC.
    """
    pairs = cut(caliper_pairs(a, b, calipers))
    long = pairs.select("caliper", F.explode(F.array(
        F.struct(F.lit(0).alias("label"), F.col("a_v").alias("v")),
        F.struct(F.lit(1).alias("label"), F.col("b_v").alias("v")))).alias("s")).select("caliper", "s.*")
    auc = {r.caliper: r for r in roc_auc(long, ["caliper"], "label", "v", free=True).collect()}  # a row per caliper
    best = (None, None)
    for c in map(float, calipers):
        r = auc.get(c)
        if r is None or r.n_pos < min_pairs:
            continue
        if best[1] is None or r.auc < best[1]:
            best = (c, r.auc)
        if r.auc <= neutral:
            best = (c, r.auc)
            break
    chosen = None if best[0] is None else pairs.filter(F.col("caliper") == best[0]).drop("caliper")
    return best[0], chosen, best[1]


def matched_auc(rows: DataFrame, features: Sequence[str], energy: str = "energy", **opts) -> DataFrame:
    """AUC of energy and other scores on energy-matched pairs (rows: id, label, energy, features).

    Label 0 rows are matched to label 1 rows; no row comes back where too few pairs exist.
    """
    side = [rows.filter(F.col("label") == c).select("id", F.col(energy).alias("v")) for c in (0, 1)]
    caliper, pairs, _ = adaptive_caliper(*side, **opts)
    if pairs is None:
        return rows.sparkSession.createDataFrame([], "score string, auc double, n_per_class long, caliper double")
    keep = pairs.select(F.explode(F.array(
        F.struct(F.lit(0).alias("label"), F.col("a_id").alias("id")),
        F.struct(F.lit(1).alias("label"), F.col("b_id").alias("id")))).alias("s")).select("s.*")
    long = unpivot(rows.join(keep, ["id", "label"]), [energy, *features])
    return roc_auc(long, ["name"], "label", "score").select(
        F.col("name").alias("score"), "auc", F.col("n_pos").alias("n_per_class"), F.lit(caliper).alias("caliper"))


def unpivot(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ("label",)) -> DataFrame:
    return df.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("score")) for c in cols])).alias("s")).select(
        *keep, "s.*")


def cv_logistic_auc(df: DataFrame, features: Sequence[str], label: str = "label", ids: Sequence[str] = ("id",),
                    k: int = 5, seed: int = 0) -> DataFrame:
    """Mean exact AUC of a standardised logistic regression over ``k`` seeded folds.

    Rows with a NULL label or feature take no part. The model of a fold learns from all others.
    """
    rows, models = fold_models(df, features, label, ids, k, seed)
    score = sum((F.get(F.col("_m.w"), F.lit(i)) * (F.col(f"x{i}") - F.get(F.col("_m.mean"), F.lit(i))) / F.get(F.col("_m.sd"), F.lit(i))
                 for i in range(len(features))), F.lit(0.0))
    of_fold = F.create_map(*[c for f, m in models.items() for c in (F.lit(f), F.struct(*[F.array(*map(F.lit, v)).alias(n) for n, v in m.items()]))])
    out = rows.withColumn("_m", of_fold[F.col("fold")]).select("fold", "label", score.alias("score"))  # log odds but for a constant
    return roc_auc(out, ["fold"], "label", "score").agg(F.avg("auc").alias("auc"), F.count("*").alias("n_folds"))


def fold_models(df: DataFrame, features: Sequence[str], label: str, ids: Sequence[str], k: int, seed: int = 0,
                rounds: int = 25) -> tuple[DataFrame, dict[int, dict[str, list[float]]]]:
    """Written rows (label, fold, x0, x1, ...) and, per fold, mean, sample deviation and weights of the
    logistic regression on the other folds, by iteratively reweighted normal equations.

    The fold is a key: one narrow pass gives the sums X'WX and X'(y - p) of all models at once, a few
    numbers a partition, and the driver solves ``k`` systems of as many unknowns as there are
    features. Ends when no weight moves, at most after ``rounds`` passes.
    """
    fold = F.pmod(F.conv(F.substring(scale.seeded_hash(seed, *ids), 1, 8), 16, 10).cast("long"), F.lit(k))
    d, xs = len(features), [f"x{i}" for i in range(len(features))]
    rows = cut(df.select(F.col(label).cast("double").alias("label"), fold.cast("int").alias("fold"),
                         *[F.col(c).cast("double").alias(x) for c, x in zip(features, xs)]).dropna())
    stats_ = rows.groupBy("fold").agg(F.count("*").alias("n"), *[f(x).alias(f"{g}{i}") for i, x in enumerate(xs) for f, g in ((F.avg, "m"), (F.var_pop, "v"))])
    at = {r.fold: (r.n, np.array([r[f"m{i}"] for i in range(d)]), np.array([r[f"v{i}"] for i in range(d)])) for r in stats_.collect()}  # a row per fold
    models = {}
    for f in at:
        n, mean, var = (np.array(x) for x in zip(*[v for g, v in at.items() if g != f])) if len(at) > 1 else (np.zeros(1), np.zeros((1, d)), np.ones((1, d)))
        total = max(n.sum(), 1)
        mu = (n[:, None] * mean).sum(0) / total
        spread = (n[:, None] * (var + (mean - mu) ** 2)).sum(0) / max(total - 1, 1)
        models[f] = (mu, np.where(spread > 0, np.sqrt(spread), 1.0), np.zeros(d + 1))

    def sums(batches):
        acc = {f: np.zeros((d + 1, d + 2)) for f in models}
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy() for c in xs])
            y, of = b.column("label").to_numpy(), b.column("fold").to_numpy()
            for f, (mu, sd, w) in models.items():
                z = np.column_stack([np.ones((of != f).sum()), (x[of != f] - mu) / sd])
                p = 1 / (1 + np.exp(-np.clip(z @ w, -700, 700)))
                acc[f] += z.T @ np.column_stack([z * (p * (1 - p))[:, None], y[of != f] - p])
        for f, m in acc.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, f, np.int32)), pa.array(np.arange(m.size, dtype=np.int32)), pa.array(m.ravel())], names=["model", "place", "value"])

    for _ in range(rounds if models else 0):
        got = rows.mapInArrow(sums, "model int, place int, value double").groupBy("model", "place").agg(F.sum("value").alias("value")).toArrow()
        moved = 0.0
        for f, (mu, sd, w) in models.items():
            mine = got.filter(pc.equal(got.column("model"), f)).sort_by("place").column("value").to_numpy().reshape(d + 1, d + 2)
            step = np.linalg.pinv(mine[:, :-1] + 1e-9 * np.eye(d + 1)) @ mine[:, -1]
            if np.isfinite(step).all():
                step *= min(1.0, 10 / max(np.abs(step).max(), 1e-300))  # where classes are apart, weights grow without end
                models[f] = (mu, sd, w + step)
                moved = max(moved, np.abs(step).max())
        if moved < 1e-9:
            break
    return rows, {f: {"mean": mu.tolist(), "sd": sd.tolist(), "w": w[1:].tolist()} for f, (mu, sd, w) in models.items()}


def operational_auc(scored: DataFrame, keys: Sequence[str] = ("snr",), fpr: float = 0.10) -> DataFrame:
    """Signal vs interference AUC and TPR of the score, the energy-only AUC and the margin.

    scored: keys, label, score, energy on the same rows.
    """
    keys = list(keys)
    long = unpivot(scored, ["score", "energy"], [*keys, "label"])
    a = roc_auc(long, [*keys, "name"], "label", "score").groupBy(*keys).agg(
        F.max(F.when(F.col("name") == "score", F.col("auc"))).alias("auc"),
        F.max(F.when(F.col("name") == "energy", F.col("auc"))).alias("auc_energy"))
    t = tpr_at_fpr(scored, keys, "label", "score", fpr).select(*keys, "tpr_pct")
    return scale.attach(a, t, keys).withColumn("margin", F.col("auc") - F.col("auc_energy"))


def displacement_report(tokens: DataFrame, frame: str = "frame", top: int = 5) -> DataFrame:
    """How far features move where a patch was touched: AUC, effect size and top-k hit rate.

    tokens: frame, patch, affected (true, false, NULL = between), disp.
    """
    rows = tokens.filter("affected IS NOT NULL").withColumn("_c", F.col("affected").cast("int"))
    auc = roc_auc(rows, [], "_c", "disp").select("auc")
    d = stats.cohens_d(rows, [], "_c", "disp")
    best = scale.top_per_key(tokens, [frame], [F.col("disp").desc(), "patch"], top)
    hit = best.groupBy(frame).agg(F.max(F.coalesce(F.col("affected"), F.lit(False)).cast("int")).alias("_h")).agg(
        (F.avg("_h") * 100).alias("top_hit_pct"))
    return scale.attach(scale.attach(auc, d, []), hit, [])


def row_leakage(disp_rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of per-row peak displacement on ON over OFF rows; localized, partial or diffuse."""
    keys = list(keys)
    m = F.array_max("cells")
    w = disp_rows.groupBy(*keys, "cadence_idx", "f_start").agg(
        F.avg(F.when(F.col("obs_idx") % 2 == 0, m)).alias("on"), F.avg(F.when(F.col("obs_idx") % 2 == 1, m)).alias("off"))
    g = w.groupBy(*keys).agg(F.avg("on").alias("on_resp"), F.avg("off").alias("off_resp"))
    r = F.col("on_resp") / (F.col("off_resp") + 1e-12)
    return g.withColumn("ratio", r).withColumn("verdict", F.when(r >= 3.0, "localized").when(
        r >= 1.5, "partial").otherwise("diffuse"))


def attribution_table(scored: DataFrame, scores: Sequence[str]) -> DataFrame:
    """AUC of every score in every setting, one row per (setting, case) (scored: setting, case, label, scores)."""
    long = unpivot(scored, scores, ["setting", "case", "label"])
    a = roc_auc(long, ["setting", "case", "name"], "label", "score")
    return a.groupBy("setting", "case").pivot("name", list(scores)).agg(F.max("auc"))


# Acceptance bars (name, metric, comparison, bound); "abs<=" bounds the size.
GATES = (
    ("B1", "matched_auc", ">=", 0.80),
    ("B1b", "margin_over_probe", ">", 0.0),
    ("B2a", "tpr_snr12", ">=", 70.0),
    ("B2b", "tpr_snr10", ">=", 40.0),
    ("B3a", "tpr_snr5", ">", 0.0),
    ("B3b", "tpr_snr7", ">", 0.0),
    ("B4", "train_val_gap", "abs<=", 0.03),
    ("B5a", "energy_residual", "<=", 0.58),
    ("B5b", "margin_over_simple", ">=", 0.15),
)


def acceptance_gates(metrics: DataFrame, gates=GATES) -> DataFrame:
    """Every gate with its value and whether it passes; both NULL where the metric was not measured.

    ``metrics``: metric, value.
    """
    g = metrics.sparkSession.createDataFrame([(n, m, c, float(b)) for n, m, c, b in gates],
                                             "gate string, metric string, comparison string, bound double")
    v, b, c = F.col("value"), F.col("bound"), F.col("comparison")
    ok = (F.when(c == ">=", v >= b).when(c == ">", v > b).when(c == "<=", v <= b).when(c == "<", v < b)
          .when(c == "abs<=", F.abs(v) <= b))
    return g.join(metrics, "metric", "left").select("gate", "metric", "value", "comparison", "bound", ok.alias("passed"))


def one_class_report(calibration: DataFrame, injected: DataFrame, rfi: DataFrame) -> DataFrame:
    """Per scorer and SNR: detection at 3 and 5 sigma of the quiet scores and the effect size of RFI.

    calibration, rfi: method, score; injected: method, snr, score.
    """
    t = detection_table(injected, quiet_calibration(calibration)).select("method", "snr", "det_3s", "det_5s")
    both = calibration.select("method", "score", F.lit(0).alias("c")).unionByName(
        rfi.select("method", "score", F.lit(1).alias("c")))
    d = stats.cohens_d(both, ["method"], "c", "score").withColumnRenamed("cohens_d", "rfi_d")
    return scale.meet(scale.meet(t, d, ["method"]), detection_floor(t), ["method"])
