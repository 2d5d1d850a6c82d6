"""Observations to sessions, ON/OFF roles, cadences and catalogue reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadrift.functions.geometry import band_edge, freq_region
from cadrift.functions.names import basename
from cadrift.operators import scale
from cadrift.session import cut

GAP_S = 700
DAY_S = 86_400
TIME_SPAN_S = 30 * DAY_S
CADENCE_FILES = 6
PATTERN = ["ON", "OFF", "ON", "OFF", "ON", "OFF"]


def gap_sessions(df: DataFrame, ts: str = "abs_time_s", gap: int = GAP_S, by: Sequence[str] = (),
                 largest: int | None = None) -> DataFrame:
    """Adds ``session_start``: a new session begins where the gap exceeds ``gap``."""
    by = list(by)
    largest = scale.largest_group(df, by) if largest is None else largest
    if largest <= scale.HOT_GROUP_ROWS:
        return scale.gap_chains(df, by, ts, gap, TIME_SPAN_S, "session_start", largest)
    times = df.select(*by, ts).distinct()
    return scale.meet(df, scale.gap_chains(times, by, ts, gap, TIME_SPAN_S, "session_start"), [*by, ts])


def number_sessions(sessions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Session starts with their 1-based number per ``by``, in time order."""
    starts = sessions.select(*by, "session_start").distinct()
    return scale.ordered_rank(starts, by, ["session_start"],
                              F.floor(F.col("session_start") / (TIME_SPAN_S * 12)), "session")


def infer_on_off(df: DataFrame, keys: Sequence[str], target: str = "target", ts: str = "abs_time_s",
                 tie: str = "file") -> DataFrame:
    """ON target (most frequent, earliest on a tie), OFF targets in first-seen order, counts, pattern.

    Rows are counted per target before a group's targets meet, so a group costs as much as
    it has distinct targets.
    """
    keys = list(keys)
    per = df.groupBy(*keys, target).agg(F.count("*").alias("n"), F.min(F.struct(ts, tie)).alias("first"))
    g = per.groupBy(*keys).agg(
        F.max("n").alias("_max"), F.sum("n").alias("_all"),
        F.min(F.struct((-F.col("n")).alias("n"), "first", F.col(target).alias("t"))).alias("_on"),
        F.sort_array(F.collect_list(F.struct("first", F.col(target).alias("t")))).alias("_seen"))
    clear = F.col("_max") > 1
    on = F.when(clear, F.col("_on.t"))
    seen = F.transform("_seen", lambda s: s["t"])
    off = F.when(clear, F.filter(seen, lambda t: t != F.col("_on.t"))).otherwise(seen)
    n_on = F.when(clear, F.col("_max")).otherwise(F.lit(0)).cast("long")
    g = g.select(*keys, on.alias("on_target"), off.alias("off_targets"), n_on.alias("n_on"),
                 (F.col("_all") - n_on).alias("n_off"))
    k = F.size("off_targets")
    text = F.concat(F.col("n_on").cast("string"), F.lit(" ON, "), F.col("n_off").cast("string"), F.lit(" OFF of "), k.cast("string"),
                    F.when(k == 1, " target").otherwise(" targets"))
    return g.withColumn("pattern", F.when(F.col("on_target").isNull(), "no target repeats")
                        .when(k == 0, F.concat(F.col("n_on").cast("string"), F.lit(" ON, no OFF"))).otherwise(text))


_CAD = ["target", "mjd", "product"]


def labelled_groups(parsed: DataFrame) -> DataFrame:
    """(target, mjd, product) groups with their size and, for six files, order and pattern.

    Sizes are counted first; only groups of exactly six files are ever collected.
    """
    rows = parsed.filter("target IS NOT NULL")
    sizes = rows.groupBy(*_CAD).agg(F.count("*").alias("n_files"))
    six = scale.meet(rows, sizes.filter(F.col("n_files") == CADENCE_FILES), _CAD).drop("n_files")
    s = F.sort_array(F.collect_list(F.struct("secs", "path", "obs_type")))
    files = six.groupBy(*_CAD).agg(s.alias("_s")).select(
        *_CAD, F.transform("_s", lambda x: x["path"]).alias("files"),
        (F.transform("_s", lambda x: x["obs_type"]) == F.array(*[F.lit(p) for p in PATTERN])).alias("pattern_ok"))
    return scale.meet(sizes, files, _CAD, "left")


def dedupe_filesets(cads: DataFrame) -> DataFrame:
    """One cadence per set of file base names: the first by target, day and product."""
    key = F.sort_array(F.transform("files", lambda p: basename(p)))
    first = F.min(F.struct(*_CAD, "files"))
    return cads.withColumn("_k", key).groupBy("_k").agg(first.alias("c")).select("c.*")


def labelled_cadences(parsed: DataFrame, products: Sequence[str] = ()) -> DataFrame:
    """Complete ON,OFF,ON,OFF,ON,OFF cadences with distinct file sets."""
    if products:
        parsed = parsed.filter(F.col("product").isin(*products))
    ok = labelled_groups(parsed).filter("pattern_ok").select(*_CAD, "files")
    return dedupe_filesets(ok)


def rejection_counts(parsed: DataFrame) -> DataFrame:
    """Names that do not parse, groups not of six files, wrong patterns, duplicate file sets."""
    groups = labelled_groups(parsed)
    good = groups.filter("pattern_ok")
    counts = groups.agg(F.count_if(F.col("n_files") != CADENCE_FILES).alias("incomplete"),
                        F.count_if(~F.col("pattern_ok")).alias("wrong_pattern"),
                        F.count_if(F.col("pattern_ok")).alias("_ok"))
    kept = dedupe_filesets(good.select(*_CAD, "files")).agg(F.count("*").alias("_kept"))
    names = parsed.agg(F.count_if(F.col("target").isNull()).alias("unparsed"))
    one = scale.attach(scale.attach(counts, kept, []), names, [])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(r).alias("reason"), c.cast("long").alias("n")) for r, c in (
            ("unparsed", F.col("unparsed")), ("incomplete", F.col("incomplete")),
            ("wrong_pattern", F.col("wrong_pattern")), ("duplicate", F.col("_ok") - F.col("_kept")))
    ])).alias("s")).select("s.*")


def with_band(df: DataFrame) -> DataFrame:
    return df.withColumn("band_lo", band_edge(F.col("f_start_mhz"))).withColumn(
        "band_hi", band_edge(F.col("f_stop_mhz")))


def chunk_cadences(df: DataFrame, keys: Sequence[str], n: int = CADENCE_FILES, ts: str = "abs_time_s",
                   tie: str = "file", largest: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(cadence rows, leftovers): consecutive chunks of ``n`` files per key in time order."""
    keys = list(keys)
    largest = scale.largest_group(df, keys) if largest is None else largest
    ranked = scale.ordered_rank(df, keys, [ts, tie], F.floor(F.col(ts) / DAY_S), "_pos", largest)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    pos = scale.meet(ranked, sizes, keys).withColumn("chunk", F.floor((F.col("_pos") - 1) / n))
    full = pos.filter(F.col("chunk") < F.floor(F.col("_n") / n))
    rows = full.withColumn("obs_idx", F.pmod(F.col("_pos") - 1, F.lit(n))).drop("_pos", "_n")
    left = sizes.select(*keys, F.pmod("_n", F.lit(n)).alias("n_leftover")).filter("n_leftover > 0")
    return rows, left


def cadence_table(rows: DataFrame, keys: Sequence[str], ts: str = "abs_time_s", tie: str = "file") -> DataFrame:
    """One row per chunk: roles, days and the files in time order (a chunk has six rows)."""
    k = [*keys, "chunk"]
    rows = cut(rows.select(*k, ts, tie, "mjd_day", "target"))
    files = rows.groupBy(*k).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(ts, tie))), lambda s: s[tie]).alias("files"),
        F.sort_array(F.collect_set("mjd_day")).alias("mjd_days"))
    return scale.meet(infer_on_off(rows, k, ts=ts, tie=tie), files, k)


def validate_shapes(headers: DataFrame, tchans: int, cadence: str = "cadence_idx") -> DataFrame:
    """Cadences whose height divides evenly and whose every observation has that height."""
    g = headers.groupBy(cadence).agg(F.count("*").alias("n_obs"), F.min("ntime").alias("_lo"),
                                     F.max("ntime").alias("_hi"), F.count("ntime").alias("_k"))
    want = F.floor(F.lit(tchans) / F.col("n_obs"))
    return g.select(cadence, "n_obs", (
        (F.lit(tchans) % F.col("n_obs") == 0) & (F.col("_k") == F.col("n_obs"))
        & F.coalesce((F.col("_lo") == want) & (F.col("_hi") == want), F.lit(False))).alias("valid"))


def validate_nchans(headers: DataFrame, cadence: str = "cadence_idx") -> DataFrame:
    """Channel count per cadence; NULL where a header is missing or counts differ."""
    g = headers.groupBy(cadence).agg(F.min("nchans").alias("_lo"), F.max("nchans").alias("_hi"),
                                     F.count_if(F.col("nchans").isNull()).alias("_bad"))
    return g.select(cadence, F.when((F.col("_bad") == 0) & (F.col("_lo") == F.col("_hi")), F.col("_lo")).alias("nchans"))


def consistent_band(df: DataFrame, keys: Sequence[str], tol: float = 1.0, ts: str = "abs_time_s",
                    tie: str = "file") -> DataFrame:
    """Band label of each group's first file, MIXED where any file is off by more than ``tol``."""
    g = df.groupBy(*keys).agg(
        F.count("*").alias("n_files"),
        F.min(F.struct(ts, tie, F.col("f_start_mhz").alias("lo"), F.col("f_stop_mhz").alias("hi"))).alias("f"),
        *[fn(c).alias(f"{n}_{c}") for c in ("f_start_mhz", "f_stop_mhz") for n, fn in (("min", F.min), ("max", F.max))])
    lo, hi = band_edge(F.col("f.lo")), band_edge(F.col("f.hi"))
    ok = ((F.col("max_f_start_mhz") - lo <= tol) & (lo - F.col("min_f_start_mhz") <= tol)
          & (F.col("max_f_stop_mhz") - hi <= tol) & (hi - F.col("min_f_stop_mhz") <= tol))
    label = F.concat(lo.cast("long").cast("string"), F.lit("-"), hi.cast("long").cast("string"), F.lit(" MHz"))
    return g.select(*keys, "n_files", F.when(ok, label).otherwise("MIXED/inconsistent").alias("band"))


def summarize_targets(cads: DataFrame) -> DataFrame:
    """Per ON target: cadences, distinct bands, distinct days."""
    base = cads.groupBy("on_target").agg(
        F.count("*").alias("n_complete_cadences"), F.countDistinct("band_lo", "band_hi").alias("n_distinct_bands"))
    days = cads.select("on_target", F.explode("mjd_days").alias("day")).groupBy("on_target").agg(
        F.countDistinct("day").alias("n_distinct_mjd_days"))
    return base.join(days, base.on_target.eqNullSafe(days.on_target), "left").select(
        base.on_target, "n_complete_cadences", "n_distinct_bands", "n_distinct_mjd_days")


def repetition_shares(targets: DataFrame) -> DataFrame:
    return targets.agg(F.count("*").alias("n_targets"), *[
        F.count_if(F.col(c) > 1).alias(n) for c, n in (
            ("n_complete_cadences", "multi_cadence"), ("n_distinct_bands", "multi_band"),
            ("n_distinct_mjd_days", "multi_day"))])


def summarize_bands(cads: DataFrame) -> DataFrame:
    return cads.groupBy("band_lo", "band_hi").agg(F.count("*").alias("n_complete_cadences")).withColumn(
        "region", freq_region(F.col("band_lo")))


def region_totals(bands: DataFrame) -> DataFrame:
    return bands.groupBy("region").agg(F.sum("n_complete_cadences").alias("total_cadences"),
                                       F.count("*").alias("n_bands"))


def coverage_report(df: DataFrame, by: str = "product") -> DataFrame:
    """Range of frequencies, and min, max and upper-middle value of bandwidth and duration."""
    base = df.groupBy(by).agg(
        F.count("*").alias("n_files"), F.min("f_lo").alias("f_min"), F.max("f_hi").alias("f_max"),
        *[fn(c).alias(f"{c}_{n}") for c in ("bw", "duration") for n, fn in (("min", F.min), ("max", F.max))])
    for c in ("bw", "duration"):
        sizes = df.groupBy(by).agg(F.count(c).alias("_n")).withColumn(
            "_k", F.col("_n") - F.floor(F.col("_n") / 2))
        mid = scale.kth_largest(df.filter(F.col(c).isNotNull()), [by], c, sizes).select(
            by, F.col("_kth").alias(f"{c}_median"))
        base = scale.meet(base, mid, [by], "left")
    return base


def target_day_counts(session_days: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per ON target and day: number of sessions (``session_days``: by, session_start, on_target, mjd_day)."""
    return session_days.filter("on_target IS NOT NULL").groupBy(*by, "on_target", "mjd_day").agg(
        F.countDistinct("session_start").alias("n_cadences"))


def node_completeness(node_cadences: DataFrame) -> DataFrame:
    """Six-file cadences per node and band that are fewer than the best node's."""
    c = node_cadences.filter(F.col("n_files") == CADENCE_FILES).groupBy("node", "band").agg(
        F.count("*").alias("n_complete_cadences"))
    top = c.agg(F.max("n_complete_cadences").alias("max_complete"))
    return scale.attach(c, top, []).filter("n_complete_cadences < max_complete")


def complete_session_bands(df: DataFrame, session: Sequence[str]) -> DataFrame:
    """(session, band) groups of exactly six files."""
    g = with_band(df).groupBy(*session, "band_lo", "band_hi").agg(F.count("*").alias("n_files"))
    return g.filter(F.col("n_files") == CADENCE_FILES)


def sample_per_band(groups: DataFrame, session: Sequence[str], n_bands: int) -> DataFrame:
    """First complete session of each band, for the first ``n_bands`` bands by session order."""
    first = groups.groupBy("band_lo", "band_hi").agg(F.min(F.struct(*session)).alias("_s"))
    return first.select("band_lo", "band_hi", "_s.*").orderBy(*session, "band_lo", "band_hi").limit(n_bands)


def session_summary(sessions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Days, first and last second, span, file count, roles and pattern per session."""
    keys = [*by, "session_start"]
    sessions = cut(sessions.select(*keys, "abs_time_s", "mjd_day", "target", "file"))
    t = sessions.groupBy(*keys).agg(
        F.array_join(F.sort_array(F.collect_set("mjd_day")), "/").alias("days"),
        F.pmod(F.min("abs_time_s"), F.lit(DAY_S)).alias("t_start"), F.pmod(F.max("abs_time_s"), F.lit(DAY_S)).alias("t_end"),
        (F.max("abs_time_s") - F.min("abs_time_s")).alias("span_s"), F.count("*").alias("n_files"))
    return scale.meet(t, infer_on_off(sessions, keys), keys)


def session_members(sessions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every file with its session and role."""
    keys = [*by, "session_start"]
    on = infer_on_off(sessions, keys).select(*keys, "on_target")
    return scale.meet(sessions, on, keys).select(
        *keys, "file", "target", F.when(F.col("target").eqNullSafe(F.col("on_target")), "ON").otherwise("OFF").alias("role"))


def product_summary(cads: DataFrame) -> DataFrame:
    """Cadences, distinct targets with the first ten listed, and the day range per product."""
    per = cads.groupBy("product", "target").agg(F.count("*").alias("c"), F.min("mjd").alias("lo"), F.max("mjd").alias("hi"))
    listed = scale.top_per_key(per.select("product", "target"), ["product"], ["target"], 10).groupBy("product").agg(
        F.array_join(F.sort_array(F.collect_list("target")), ", ").alias("first_targets"))
    base = per.groupBy("product").agg(F.sum("c").alias("n_cadences"), F.count("*").alias("n_targets"),
                                      F.min("lo").alias("mjd_min"), F.max("hi").alias("mjd_max"))
    return scale.meet(base, listed, ["product"])


def band_members(df: DataFrame, tol: float = 1.0) -> DataFrame:
    """Files within ``tol`` MHz of each distinct whole-MHz band on both edges.

    A file can only belong to whole-MHz bands near its own edges, so it names those bands
    itself and an equi join keeps the ones that exist: no range join.
    """
    files = df.groupBy("f_lo", "f_hi").agg(F.count("*").alias("_c"))
    known = files.select(band_edge(F.col("f_lo")).alias("band_lo"), band_edge(F.col("f_hi")).alias("band_hi")).distinct()

    def near(c: str) -> Column:
        return F.explode(F.sequence(F.ceil(F.col(c) - tol), F.floor(F.col(c) + tol)))

    cand = (files.withColumn("_lo", near("f_lo")).withColumn("_hi", near("f_hi"))
            .filter((F.abs(F.col("f_lo") - F.col("_lo")) < tol) & (F.abs(F.col("f_hi") - F.col("_hi")) < tol))
            .groupBy(F.col("_lo").cast("double").alias("band_lo"), F.col("_hi").cast("double").alias("band_hi"))
            .agg(F.sum("_c").alias("n_files")))
    return known.join(cand, ["band_lo", "band_hi"])


def nodes_without_cadence(observations: DataFrame, cads: DataFrame) -> DataFrame:
    return observations.select("node").distinct().join(cads.select("node").distinct(), "node", "left_anti")


def cadence_scan(manifest: DataFrame, headers: DataFrame, key: str = "cadence_idx") -> DataFrame:
    """Files of each cadence in time order: mjd_sec first, name second (six files per cadence)."""
    w = Window.partitionBy(key).orderBy("mjd_sec", "file")
    return manifest.join(headers, "file").withColumn("obs_idx", F.row_number().over(w) - 1)
