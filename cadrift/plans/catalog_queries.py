"""Queries over names, headers, sessions, cadences and pools."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadrift.functions import geometry, names
from cadrift.operators import catalog, pools, scale
from cadrift.plans import views as V
from cadrift.plans.registry import query
from cadrift.plans.search_queries import rnd
from cadrift.session import cut

PARSED = r"""pr AS (SELECT *, contains(name, '.rawspec.') AND ends_with(name, '.h5') AS raw,
   regexp_matches(name, '^(.*)\.([0-9]+)\.h5$') AS old FROM names),
  pc AS (SELECT *, CASE WHEN raw THEN split_part(name, '.rawspec.', 1) ELSE regexp_extract(name, '^(.*)\.([0-9]+)\.h5$', 1) END AS core,
   CASE WHEN raw THEN regexp_extract(name, '^.*?\.rawspec\.(.*)\.h5$', 1) ELSE regexp_extract(name, '^(.*)\.([0-9]+)\.h5$', 2) END AS prod FROM pr),
  pf AS (SELECT *, string_split(core, '_') AS f FROM pc),
  pe AS (SELECT *, CASE WHEN NOT (raw OR old) THEN 'no product in the name: ' || name
    WHEN len(f) < 6 THEN 'fewer than six parts: ' || core
    WHEN TRY_CAST(f[3] AS BIGINT) IS NULL OR TRY_CAST(f[4] AS BIGINT) IS NULL
     THEN 'day or second is no number: ' || f[3] || ', ' || f[4] END AS parse_error FROM pf),
  parsed AS (SELECT event_id, name, CASE WHEN parse_error IS NULL THEN f[1] END AS node,
   CASE WHEN parse_error IS NULL THEN f[2] END AS backend,
   CASE WHEN parse_error IS NULL THEN TRY_CAST(f[3] AS BIGINT) END AS mjd_day,
   CASE WHEN parse_error IS NULL THEN TRY_CAST(f[4] AS BIGINT) END AS mjd_sec,
   CASE WHEN parse_error IS NULL THEN TRY_CAST(f[3] AS BIGINT) * 86400 + TRY_CAST(f[4] AS BIGINT) END AS abs_time_s,
   CASE WHEN parse_error IS NULL THEN array_to_string(f[5:len(f) - 1], '_') END AS target,
   CASE WHEN parse_error IS NULL THEN f[len(f)] END AS scan_num,
   CASE WHEN parse_error IS NULL THEN prod END AS product, parse_error FROM pe)"""


@query("prj1_parse_rawspec_name", f"WITH {V.NAMES}, {PARSED} SELECT * FROM parsed")
def _(spark, d):
    return names.parse_rawspec_name(V.names(spark, d))


LABELS = r"""lb AS (SELECT o_orderkey, path, split_part(path, '/', -1) AS n FROM labelled_names),
  lp AS (SELECT *, nullif(regexp_extract(n, '\.(\d{4})\.(?:h5|hdf5)$', 1, 'i'), '') AS prod,
   coalesce(nullif(regexp_extract(n, '(TIC\d+)_(ON|OFF)', 1, 'i'), ''), nullif(regexp_extract(n, '(HIP\d+|GJ\d+[A-Za-z]?)_(ON|OFF)', 1, 'i'), ''),
    nullif(regexp_extract(n, '([A-Za-z0-9]+)_(ON|OFF)(?:_|\.)', 1), '')) AS tg,
   coalesce(nullif(regexp_extract(n, '(TIC\d+)_(ON|OFF)', 2, 'i'), ''), nullif(regexp_extract(n, '(HIP\d+|GJ\d+[A-Za-z]?)_(ON|OFF)', 2, 'i'), ''),
    nullif(regexp_extract(n, '([A-Za-z0-9]+)_(ON|OFF)(?:_|\.)', 2), '')) AS ro FROM lb),
  labels_parsed AS (SELECT o_orderkey, path, CASE WHEN ok THEN tg END AS target, CASE WHEN ok THEN upper(ro) END AS obs_type,
   CASE WHEN ok THEN CASE WHEN st THEN regexp_extract(n, '_(\d{5})_(\d+)_', 1) ELSE '00000' END END AS mjd,
   CASE WHEN ok THEN CASE WHEN st THEN regexp_extract(n, '_(\d{5})_(\d+)_', 2)::BIGINT ELSE 0 END END AS secs,
   CASE WHEN ok THEN prod END AS product FROM (SELECT *, prod IS NOT NULL AND tg IS NOT NULL AS ok,
    regexp_matches(n, '_(\d{5})_(\d+)_') AS st FROM lp))"""


def _labels(spark, d):
    return cut(names.parse_labelled_name(V.labelled_names(spark, d)))


@query("prj2_parse_labelled_name", f"WITH {V.LABELLED_NAMES}, {LABELS} SELECT * FROM labels_parsed")
def _(spark, d):
    return names.parse_labelled_name(V.labelled_names(spark, d))


@query("src3_quarantine", f"""WITH {V.NAMES}, {PARSED} SELECT parse_error IS NULL AS good,
  split_part(parse_error, ':', 1) AS reason, count(*) AS n FROM parsed GROUP BY ALL""")
def _(spark, d):
    from cadrift.sources.io import quarantine
    good, bad = quarantine(names.parse_rawspec_name(V.names(spark, d)))
    g = good.groupBy().agg(F.lit(True).alias("good"), F.lit(None).cast("string").alias("reason"), F.count("*").alias("n"))
    b = bad.groupBy(F.split("parse_error", ":")[0].alias("reason")).agg(F.count("*").alias("n"))
    return g.unionByName(b.select(F.lit(False).alias("good"), "reason", "n"))


_DIR = r"""dirs AS (SELECT c_custkey, 'cad' || CASE WHEN c_custkey < 10 THEN '0' ELSE '' END || c_custkey || '_' || c_mktsegment || '_'
   || printf('%.1f', 1000.0 + c_nationkey * 187.25) || 'MHz_' || CASE WHEN c_nationkey = 0 THEN 'nodate'
   ELSE strftime(DATE '1858-11-17' + (60000 + c_nationkey)::INTEGER, '%Y%m%d') END AS dirname FROM customer)"""


def _dirs(spark, d):
    c = V.table(spark, d, "customer")
    nk = F.col("c_nationkey")
    mjd = F.when(nk == 0, F.lit(0.0)).otherwise(60000.5 + nk)
    return c.select("c_custkey", names.cadence_dirname(
        F.col("c_custkey"), F.col("c_mktsegment"), 1000.0 + nk * 187.25, mjd).alias("dirname"))


@query("prj3_cadence_dirname", f"WITH {_DIR} SELECT * FROM dirs")
def _(spark, d):
    return _dirs(spark, d)


@query("prj3_parse_cadence_dirname", rf"""WITH {_DIR}, m AS (SELECT *, regexp_matches(dirname, '^cad(\d+)_(.+?)_[\d.]+MHz_\d+$') AS fits FROM dirs)
  SELECT c_custkey, CASE WHEN fits THEN regexp_extract(dirname, '^cad(\d+)_(.+?)_[\d.]+MHz_\d+$', 1)::BIGINT END AS cad_idx,
  CASE WHEN fits THEN regexp_extract(dirname, '^cad(\d+)_(.+?)_[\d.]+MHz_\d+$', 2) END AS target FROM m""")
def _(spark, d):
    i, t = names.parse_cadence_dirname(F.col("dirname"))
    return _dirs(spark, d).select("c_custkey", i.alias("cad_idx"), t.alias("target"))


@query("prj4_abs_time", f"""WITH {V.OBSERVATIONS} SELECT obs_id, mjd_day * 86400 + mjd_sec AS t,
  strftime(DATE '1858-11-17' + mjd_day::INTEGER, '%Y%m%d') AS day FROM observations""")
def _(spark, d):
    o = V.observations(spark, d)
    return o.select("obs_id", names.abs_time(F.col("mjd_day"), F.col("mjd_sec")).alias("t"),
                    names.mjd_to_date(F.col("mjd_day")).alias("day"))


@query("prj5_band_geometry", """WITH h AS (SELECT p_partkey, p_retailprice AS fch1, CASE WHEN p_size % 2 = 0 THEN -0.25 ELSE 0.5 END::DOUBLE AS foff,
   p_size * 8 AS nchans, p_size / 7.0::DOUBLE AS tsamp, 16 AS ntime FROM part)
  SELECT p_partkey, nchans, ntime, round(fch1, 6) AS fch1_mhz, round(foff * 1e6, 4) AS foff_hz,
   round(least(fch1, fch1 + foff * nchans), 4) AS f_start_mhz, round(greatest(fch1, fch1 + foff * nchans), 4) AS f_stop_mhz,
   round(abs(foff * nchans), 4) AS bw_mhz, round(tsamp, 9) AS tsamp_s, round(tsamp * ntime, 2) AS duration_s FROM h""")
def _(spark, d):
    s = F.col("p_size")
    h = V.table(spark, d, "part").select(
        "p_partkey", F.col("p_retailprice").alias("fch1"), F.when(s % 2 == 0, -0.25).otherwise(0.5).alias("foff"),
        (s * 8).alias("nchans"), (s / 7.0).alias("tsamp"), F.lit(16).alias("ntime"))
    return geometry.band_geometry(h)


@query("prj6_band_node_key", f"""WITH {V.OBSERVATIONS} SELECT round_even(f_start_mhz, 0) AS band_lo, round_even(f_stop_mhz, 0) AS band_hi,
  node, count(*) AS n FROM observations GROUP BY ALL""")
def _(spark, d):
    o = catalog.with_band(V.observations(spark, d))
    return o.groupBy("band_lo", "band_hi", "node").agg(F.count("*").alias("n"))


_REGION = "CASE WHEN {x} < 1200 THEN 'L-low (750-1200)' WHEN {x} < 1900 THEN 'L-high (1200-1900)' WHEN {x} < 3200 THEN 'S (1900-3200)' WHEN {x} < 5000 THEN 'C-low (3200-5000)' WHEN {x} < 8000 THEN 'C-high/X-low (5000-8000)' WHEN {x} < 10000 THEN 'X-mid (8000-10000)' ELSE 'X-high (10000-12400)' END"


@query("prj7_freq_region", f"""SELECT l_orderkey, l_linenumber, l_extendedprice, {_REGION.format(x="l_extendedprice / 8")} AS region FROM lineitem""")
def _(spark, d):
    li = V.table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_extendedprice",
                     geometry.freq_region(F.col("l_extendedprice") / 8).alias("region"))


@query("prj8_freq_mhz", f"""WITH {V.SCORES} SELECT cadence_idx, f_start, round(f_start * 2.7939677238464355 / 1e6, 6) AS freq_mhz,
  0.0::DOUBLE AS freq_none FROM scores""")
def _(spark, d):
    from cadrift.operators.search import freq_mhz
    s = V.scores(spark, d)
    return s.select("cadence_idx", "f_start", F.round(freq_mhz(F.col("f_start"), V.DF_HZ), 6).alias("freq_mhz"),
                    freq_mhz(F.col("f_start"), None).alias("freq_none"))


@query("prj9_on_role", """SELECT l_linenumber - 1 AS obs_idx, CASE WHEN l_linenumber > 6 THEN NULL WHEN l_linenumber % 2 = 1 THEN 'ON' ELSE 'OFF' END AS role,
  count(*) AS n FROM lineitem GROUP BY ALL""")
def _(spark, d):
    i = F.col("l_linenumber") - 1
    li = V.table(spark, d, "lineitem").select(i.alias("obs_idx"), geometry.on_role(i).alias("role"))
    return li.groupBy("obs_idx", "role").agg(F.count("*").alias("n"))


@query("prj11_sliding_windows", """SELECT p_partkey, unnest(CASE WHEN p_size * 100 >= 1024 THEN range(0, p_size * 100 - 1024 + 1, 512) ELSE [] END)::BIGINT AS f_start FROM part""")
def _(spark, d):
    p = V.table(spark, d, "part").select("p_partkey", (F.col("p_size") * 100).alias("nchans"))
    return geometry.sliding_windows(p, 1024, 512).select("p_partkey", "f_start")


@query("prj13_subband_windows", f"""WITH {V.BANDS}, f AS (SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS frac)
  SELECT id, round(frac, 6) AS frac, round(f_lo + frac * (f_hi - f_lo) - 0.001::DOUBLE * 512, 6) AS w_start,
   round(f_lo + frac * (f_hi - f_lo) + 0.001::DOUBLE * 512, 6) AS w_stop FROM bands, f""")
def _(spark, d):
    b = geometry.subband_windows(V.bands(spark, d).withColumn("df_mhz", F.lit(0.001)))
    return rnd(b.select("id", "frac", "w_start", "w_stop"), "frac", "w_start", "w_stop")


def sess_sql(by="product", gap=700, src="observations"):
    return f"""s1 AS (SELECT *, CASE WHEN abs_time_s - lag(abs_time_s) OVER w <= {gap} THEN NULL ELSE abs_time_s END AS st
    FROM {src} WINDOW w AS (PARTITION BY {by} ORDER BY abs_time_s, obs_id)),
  sess AS (SELECT *, max(st) OVER (PARTITION BY {by} ORDER BY abs_time_s, obs_id ROWS UNBOUNDED PRECEDING) AS session_start FROM s1)"""


def onoff_sql(keys, src, name="oo"):
    return f"""{name}_p AS (SELECT {keys}, target, count(*) AS n, min((abs_time_s, file)) AS first FROM {src} GROUP BY ALL),
  {name}_o AS (SELECT {keys}, max(n) AS mx, sum(n)::BIGINT AS al, first(target ORDER BY n DESC, first) AS on0,
   list(target ORDER BY first) AS seen FROM {name}_p GROUP BY ALL),
  {name}_q AS (SELECT *, CASE WHEN mx > 1 THEN on0 END AS on_target,
   CASE WHEN mx > 1 THEN list_filter(seen, lambda t: t <> on0) ELSE seen END AS off_targets,
   CASE WHEN mx > 1 THEN mx ELSE 0 END AS n_on FROM {name}_o),
  {name} AS (SELECT {keys}, on_target, off_targets, n_on, al - n_on AS n_off,
   CASE WHEN on_target IS NULL THEN 'no target repeats'
    WHEN len(off_targets) = 0 THEN n_on || ' ON, no OFF'
    ELSE n_on || ' ON, ' || (al - n_on) || ' OFF of ' || len(off_targets) || CASE WHEN len(off_targets) = 1 THEN ' target' ELSE ' targets' END END AS pattern FROM {name}_q)"""


def _sessions(spark, d, by=("product",), gap=700):
    return catalog.gap_sessions(V.observations(spark, d), gap=gap, by=list(by))


@query("cat1_gap_sessions", f"WITH {V.OBSERVATIONS}, {sess_sql()} SELECT obs_id, product, session_start FROM sess")
def _(spark, d):
    return _sessions(spark, d).select("obs_id", "product", "session_start")


@query("cat1_session_numbers", f"""WITH {V.OBSERVATIONS}, {sess_sql("node", 1800)} SELECT node, session_start,
  row_number() OVER (PARTITION BY node ORDER BY session_start) AS session FROM (SELECT DISTINCT node, session_start FROM sess)""")
def _(spark, d):
    return catalog.number_sessions(_sessions(spark, d, ["node"], 1800), ["node"])


@query("cat1_sessions_unpartitioned", f"""WITH {V.OBSERVATIONS}, {sess_sql("1")} SELECT session_start, count(*) AS n_files,
  max(abs_time_s) - min(abs_time_s) AS span_s FROM sess GROUP BY 1""")
def _(spark, d):
    return _sessions(spark, d, []).groupBy("session_start").agg(
        F.count("*").alias("n_files"), (F.max("abs_time_s") - F.min("abs_time_s")).alias("span_s"))


@query("cat2_infer_on_off", f"""WITH {V.OBSERVATIONS}, {sess_sql()}, {onoff_sql("product, session_start", "sess")} SELECT * FROM oo""")
def _(spark, d):
    return catalog.infer_on_off(_sessions(spark, d), ["product", "session_start"])


_GROUPS = """lg AS (SELECT target, mjd, product, count(*) AS n, list(path ORDER BY secs, path) AS files,
   list(obs_type ORDER BY secs, path) AS pat FROM labels_parsed WHERE target IS NOT NULL GROUP BY ALL),
  lok AS (SELECT * FROM lg WHERE n = 6 AND pat = ['ON', 'OFF', 'ON', 'OFF', 'ON', 'OFF']),
  lk AS (SELECT *, list_sort(list_transform(files, lambda p: split_part(p, '/', -1))) AS k FROM lok),
  lded AS (SELECT * FROM lk QUALIFY row_number() OVER (PARTITION BY k ORDER BY target, mjd, product) = 1)"""

# Orders alternate ON/OFF by key parity, so true six-file cadences are rare in the plain view:
# the relaxed view labels each group's files by their position in time instead.
RELABEL = """labels_parsed AS (SELECT o_orderkey, regexp_replace(path, '_(ON|OFF)_', '_' || ty || '_') AS path, target, ty AS obs_type,
   mjd, secs, product FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY target, mjd, product ORDER BY secs, path) % 2 = 1
   THEN 'ON' ELSE 'OFF' END AS ty FROM labels_raw WHERE target IS NOT NULL)
   UNION ALL SELECT o_orderkey, path, target, obs_type, mjd, secs, product FROM labels_raw WHERE target IS NULL)"""
_LAB = f"{V.LABELLED_NAMES}, {LABELS.replace('labels_parsed AS', 'labels_raw AS')}, {RELABEL}, {_GROUPS}"


def _relabelled(spark, d):
    p = _labels(spark, d)
    key = ["target", "mjd", "product"]
    ok = p.filter("target IS NOT NULL")
    r = scale.ordered_rank(ok, key, ["secs", "path"], F.floor(F.col("secs") / V.ORDER_SPAN), "_r",
                           scale.largest_group(ok, key))
    ty = F.when(F.col("_r") % 2 == 1, "ON").otherwise("OFF")
    r = r.withColumn("obs_type", ty).withColumn(
        "path", F.regexp_replace("path", F.lit("_(ON|OFF)_"), F.concat(F.lit("_"), ty, F.lit("_"))))
    return cut(r.drop("_r").unionByName(p.filter("target IS NULL")))


@query("cat3_labelled_cadences", f"WITH {_LAB} SELECT target, mjd, product, files FROM lded")
def _(spark, d):
    return catalog.labelled_cadences(_relabelled(spark, d))


_COPIES = """lcop AS (SELECT target, mjd, product, files FROM lok UNION ALL SELECT target || 'B', mjd, product,
   list_transform(files, lambda p: replace(p, '/data/', '/copy/')) FROM lok),
  lk2 AS (SELECT *, list_sort(list_transform(files, lambda p: split_part(p, '/', -1))) AS k FROM lcop)"""


@query("cat4_dedupe_filesets", f"""WITH {_LAB}, {_COPIES} SELECT target, mjd, product, files FROM lk2
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY target, mjd, product) = 1""")
def _(spark, d):
    ok = catalog.labelled_groups(_relabelled(spark, d)).filter("pattern_ok").select("target", "mjd", "product", "files")
    copy = ok.withColumn("target", F.concat("target", F.lit("B"))).withColumn(
        "files", F.transform("files", lambda p: F.replace(p, F.lit("/data/"), F.lit("/copy/"))))
    return catalog.dedupe_filesets(ok.unionByName(copy))


@query("cat5_rejection_counts", f"""WITH {_LAB} SELECT 'unparsed' AS reason, count(*) AS n FROM labels_parsed WHERE target IS NULL
  UNION ALL SELECT 'incomplete', count(*) FROM lg WHERE n <> 6
  UNION ALL SELECT 'wrong_pattern', count(*) FROM lg WHERE n = 6 AND pat <> ['ON', 'OFF', 'ON', 'OFF', 'ON', 'OFF']
  UNION ALL SELECT 'duplicate', (SELECT count(*) FROM lok) - (SELECT count(*) FROM lded)""")
def _(spark, d):
    return catalog.rejection_counts(_relabelled(spark, d))


_CHUNK = f"""{V.OBSERVATIONS}, {sess_sql("node", 3600)}, cb AS (SELECT *, round_even(f_start_mhz, 0) AS band_lo,
   round_even(f_stop_mhz, 0) AS band_hi FROM sess),
  cr AS (SELECT *, row_number() OVER (PARTITION BY session_start, band_lo, band_hi, node ORDER BY abs_time_s, file) - 1 AS pos,
   count(*) OVER (PARTITION BY session_start, band_lo, band_hi, node) AS n FROM cb),
  ch AS (SELECT *, pos // 6 AS chunk FROM cr WHERE pos // 6 < n // 6)"""
_CK = ["session_start", "band_lo", "band_hi", "node"]


def _chunks(spark, d):
    s = catalog.with_band(_sessions(spark, d, ["node"], 3600))
    return catalog.chunk_cadences(s, _CK)


_CADS = f"""{_CHUNK}, {onoff_sql("session_start, band_lo, band_hi, node, chunk", "ch")},
  cfi AS (SELECT session_start, band_lo, band_hi, node, chunk, list(file ORDER BY abs_time_s, file) AS files,
   list_sort(list_distinct(list(mjd_day))) AS mjd_days FROM ch GROUP BY ALL),
  cads AS (SELECT oo.*, files, mjd_days FROM oo JOIN cfi USING (session_start, band_lo, band_hi, node, chunk))"""


def _cads(spark, d):
    return catalog.cadence_table(_chunks(spark, d)[0], _CK)


@query("cat6_chunk_cadences", f"WITH {_CADS} SELECT * FROM cads")
def _(spark, d):
    return _cads(spark, d)


@query("cat6_leftovers", f"""WITH {_CHUNK} SELECT session_start, band_lo, band_hi, node, any_value(n) % 6 AS n_leftover FROM cr
  GROUP BY ALL HAVING any_value(n) % 6 > 0""")
def _(spark, d):
    return _chunks(spark, d)[1]


@query("cat7_validate_shapes", """SELECT l_orderkey AS cadence_idx, count(*) AS n_obs,
  96 % count(*) = 0 AND min(n) = 96 // count(*) AND max(n) = 96 // count(*) AS valid FROM (
   SELECT l_orderkey, CASE WHEN l_quantity < 45 THEN 96 // count(*) OVER (PARTITION BY l_orderkey) ELSE 7 END AS n FROM lineitem) GROUP BY 1""")
def _(spark, d):
    li = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cadence_idx"), "l_quantity")
    n = li.groupBy("cadence_idx").agg(F.count("*").alias("_n"))
    h = li.join(n, "cadence_idx").withColumn("ntime", F.when(F.col("l_quantity") < 45, F.floor(96 / F.col("_n"))).otherwise(7))
    return catalog.validate_shapes(h, 96)


@query("cat8_validate_nchans", """SELECT l_orderkey AS cadence_idx, CASE WHEN count(*) FILTER (n IS NULL) = 0 AND min(n) = max(n) THEN min(n) END AS nchans
  FROM (SELECT l_orderkey, CASE WHEN l_quantity > 48 THEN NULL WHEN l_quantity > 40 THEN 512 ELSE 1024 END AS n FROM lineitem) GROUP BY 1""")
def _(spark, d):
    q = F.col("l_quantity")
    h = V.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("cadence_idx"), F.when(q > 48, F.lit(None)).when(q > 40, 512).otherwise(1024).alias("nchans"))
    return catalog.validate_nchans(h)


_CB_SRC = "cb0 AS (SELECT * REPLACE (f_stop_mhz + CASE WHEN obs_id % 17 = 0 THEN 2 ELSE 0 END AS f_stop_mhz) FROM sess)"


def consistent_sql(keys, src):
    return f"""bf AS (SELECT {keys}, count(*) AS n_files, round_even(first(f_start_mhz ORDER BY abs_time_s, file), 0) AS lo,
   round_even(first(f_stop_mhz ORDER BY abs_time_s, file), 0) AS hi, min(f_start_mhz) AS a, max(f_start_mhz) AS b,
   min(f_stop_mhz) AS c, max(f_stop_mhz) AS e FROM {src} GROUP BY ALL),
  nb AS (SELECT {keys}, n_files, CASE WHEN b - lo <= 1 AND lo - a <= 1 AND e - hi <= 1 AND hi - c <= 1
   THEN lo::BIGINT || '-' || hi::BIGINT || ' MHz' ELSE 'MIXED/inconsistent' END AS band FROM bf)"""


def _user_sessions(spark, d):
    s = _sessions(spark, d, ["user_id"], 21600)
    return s.withColumn("f_stop_mhz", F.col("f_stop_mhz") + F.when(F.col("obs_id") % 17 == 0, 2).otherwise(0))


_US = f"{V.OBSERVATIONS}, {sess_sql('user_id', 21600)}, {_CB_SRC}, {consistent_sql('user_id, node, session_start', 'cb0')}"


@query("cat9_consistent_band", f"WITH {_US} SELECT * FROM nb")
def _(spark, d):
    return catalog.consistent_band(_user_sessions(spark, d), ["user_id", "node", "session_start"])


_TSUM = """ts AS (SELECT on_target, count(*) AS n_complete_cadences, count(DISTINCT (band_lo, band_hi)) AS n_distinct_bands,
   (SELECT count(DISTINCT dd) FROM (SELECT on_target AS t2, unnest(mjd_days) AS dd FROM cads) x WHERE x.t2 IS NOT DISTINCT FROM cads.on_target) AS n_distinct_mjd_days
   FROM cads GROUP BY on_target)"""


@query("cat10_summarize_targets", f"""WITH {_CADS}, dd AS (SELECT on_target, unnest(mjd_days) AS day FROM cads),
  dc AS (SELECT on_target, count(DISTINCT day) AS k FROM dd GROUP BY 1)
  SELECT c.on_target, count(*) AS n_complete_cadences, count(DISTINCT (band_lo, band_hi)) AS n_distinct_bands, any_value(k) AS n_distinct_mjd_days
  FROM cads c LEFT JOIN dc ON c.on_target IS NOT DISTINCT FROM dc.on_target GROUP BY 1""")
def _(spark, d):
    return catalog.summarize_targets(_cads(spark, d))


@query("cat10_repetition_shares", f"""WITH {_CADS}, dd AS (SELECT on_target, unnest(mjd_days) AS day FROM cads),
  dc AS (SELECT on_target, count(DISTINCT day) AS k FROM dd GROUP BY 1),
  t AS (SELECT c.on_target, count(*) AS a, count(DISTINCT (band_lo, band_hi)) AS b, any_value(k) AS k
   FROM cads c LEFT JOIN dc ON c.on_target IS NOT DISTINCT FROM dc.on_target GROUP BY 1)
  SELECT count(*) AS n_targets, count(*) FILTER (a > 1) AS multi_cadence, count(*) FILTER (b > 1) AS multi_band,
   count(*) FILTER (k > 1) AS multi_day FROM t""")
def _(spark, d):
    return catalog.repetition_shares(catalog.summarize_targets(_cads(spark, d)))


_BANDSUM = f"bs AS (SELECT band_lo, band_hi, count(*) AS n_complete_cadences, {_REGION.format(x='band_lo')} AS region FROM cads GROUP BY 1, 2)"


@query("cat11_summarize_bands", f"WITH {_CADS}, {_BANDSUM} SELECT * FROM bs")
def _(spark, d):
    return catalog.summarize_bands(_cads(spark, d))


@query("cat11_region_totals", f"""WITH {_CADS}, {_BANDSUM} SELECT region, sum(n_complete_cadences)::BIGINT AS total_cadences,
  count(*) AS n_bands FROM bs GROUP BY 1""")
def _(spark, d):
    return catalog.region_totals(catalog.summarize_bands(_cads(spark, d)))


@query("cat12_coverage_report", f"""WITH {V.BANDS}, b AS (SELECT *, bw * 3 AS duration FROM bands)
  SELECT product, count(*) AS n_files, min(f_lo) AS f_min, max(f_hi) AS f_max, min(bw) AS bw_min, max(bw) AS bw_max,
   min(duration) AS duration_min, max(duration) AS duration_max, list_sort(list(bw))[len(list(bw)) // 2 + 1] AS bw_median,
   list_sort(list(duration))[len(list(duration)) // 2 + 1] AS duration_median FROM b GROUP BY 1""")
def _(spark, d):
    return catalog.coverage_report(V.bands(spark, d).withColumn("duration", F.col("bw") * 3))


@query("cat13_target_day_counts", f"""WITH {V.OBSERVATIONS}, {sess_sql()}, {onoff_sql("product, session_start", "sess")}
  SELECT product, on_target, mjd_day, count(DISTINCT session_start) AS n_cadences FROM sess JOIN oo USING (product, session_start)
  WHERE on_target IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    s = _sessions(spark, d)
    on = catalog.infer_on_off(s, ["product", "session_start"]).select("product", "session_start", "on_target")
    return catalog.target_day_counts(s.join(on, ["product", "session_start"]), ["product"])


@query("cat14_node_completeness", f"""WITH {_US}, c AS (SELECT node, band, count(*) AS n_complete_cadences FROM nb WHERE n_files = 6 GROUP BY ALL)
  SELECT *, (SELECT max(n_complete_cadences) FROM c) AS max_complete FROM c WHERE n_complete_cadences < (SELECT max(n_complete_cadences) FROM c)""")
def _(spark, d):
    return catalog.node_completeness(catalog.consistent_band(_user_sessions(spark, d), ["user_id", "node", "session_start"]))


_SB = f"""{V.OBSERVATIONS}, {sess_sql("user_id", 21600)}, g AS (SELECT user_id, session_start, round_even(f_start_mhz, 0) AS band_lo,
   round_even(f_stop_mhz, 0) AS band_hi, count(*) AS n_files FROM sess GROUP BY ALL HAVING count(*) = 6)"""


def _complete(spark, d):
    return catalog.complete_session_bands(_sessions(spark, d, ["user_id"], 21600), ["user_id", "session_start"])


@query("cat15_complete_session_bands", f"WITH {_SB} SELECT * FROM g")
def _(spark, d):
    return _complete(spark, d)


@query("cat15_sample_per_band", f"""WITH {_SB} SELECT band_lo, band_hi, session_start, user_id FROM g
  QUALIFY row_number() OVER (PARTITION BY band_lo, band_hi ORDER BY session_start, user_id) = 1 ORDER BY session_start, user_id, band_lo, band_hi LIMIT 8""")
def _(spark, d):
    return catalog.sample_per_band(_complete(spark, d), ["session_start", "user_id"], 8)


@query("cat16_session_summary", f"""WITH {V.OBSERVATIONS}, {sess_sql()}, {onoff_sql("product, session_start", "sess")},
  t AS (SELECT product, session_start, array_to_string(list_sort(list_distinct(list(mjd_day))), '/') AS days, min(abs_time_s) % 86400 AS t_start,
   max(abs_time_s) % 86400 AS t_end, max(abs_time_s) - min(abs_time_s) AS span_s, count(*) AS n_files FROM sess GROUP BY ALL)
  SELECT t.*, on_target, off_targets, n_on, n_off, pattern FROM t JOIN oo USING (product, session_start)""")
def _(spark, d):
    return catalog.session_summary(_sessions(spark, d), ["product"])


@query("cat16_session_members", f"""WITH {V.OBSERVATIONS}, {sess_sql()}, {onoff_sql("product, session_start", "sess")}
  SELECT product, session_start, file, target, CASE WHEN target IS NOT DISTINCT FROM on_target THEN 'ON' ELSE 'OFF' END AS role
  FROM sess JOIN oo USING (product, session_start)""")
def _(spark, d):
    return catalog.session_members(_sessions(spark, d), ["product"])


@query("cat17_product_summary", f"""WITH {_LAB} SELECT product, count(*) AS n_cadences, count(DISTINCT target) AS n_targets, min(mjd) AS mjd_min, max(mjd) AS mjd_max,
  array_to_string(list_sort(list_distinct(list(target)))[1:10], ', ') AS first_targets FROM lded GROUP BY 1""")
def _(spark, d):
    return catalog.product_summary(catalog.labelled_cadences(_relabelled(spark, d)))


_ALLOC = """raw AS (SELECT *, n * 0.5::DOUBLE AS ft, n * 0.1::DOUBLE AS fv, n * 0.4::DOUBLE AS fh FROM sizes),
  bs0 AS (SELECT *, greatest(floor(ft), 1)::BIGINT AS t0, floor(fv)::BIGINT AS v0, greatest(floor(fh), CASE WHEN n >= 2 THEN 1 ELSE 0 END)::BIGINT AS h0 FROM raw),
  bs1 AS (SELECT *, greatest(t0 + v0 + h0 - n, 0) AS ov, greatest(n - t0 - v0 - h0, 0) AS rest, ft - t0 AS gt, fv - v0 AS gv, fh - h0 AS gh FROM bs0),
  bs2 AS (SELECT *, v0 - least(v0, ov) AS v1, ov - least(v0, ov) AS lf FROM bs1),
  bs3 AS (SELECT *, t0 - CASE WHEN lf > 0 AND t0 - 1 > 0 THEN least(lf, t0 - 1) ELSE 0 END AS t1 FROM bs2),
  alloc AS (SELECT band, n, t1 + CASE WHEN (gv > gt)::INT + (gh > gt)::INT < rest THEN 1 ELSE 0 END AS n_train,
   v1 + CASE WHEN (gt >= gv)::INT + (gh > gv)::INT < rest THEN 1 ELSE 0 END AS n_val,
   h0 + CASE WHEN (gt >= gh)::INT + (gv >= gh)::INT < rest THEN 1 ELSE 0 END AS n_heldout FROM bs3)"""


@query("spl1_allocate", f"""WITH sizes AS (SELECT o_custkey AS band, count(*) AS n FROM orders GROUP BY 1), {_ALLOC}
  SELECT band, n, n_train, n_val, n_heldout FROM alloc""")
def _(spark, d):
    s = V.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("band")).agg(F.count("*").alias("n"))
    n = F.col("n")
    t, v, h = pools.allocate(n, (0.5, 0.1, 0.4), (1, 0, F.when(n >= 2, 1).otherwise(0)))
    return s.select("band", "n", t.alias("n_train"), v.alias("n_val"), h.alias("n_heldout"))


_SPLIT = f"""{V.CADENCES}, sizes AS (SELECT band, count(*) AS n FROM cadences GROUP BY 1), {_ALLOC},
  rk AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY md5('42|' || cadence), cadence) AS r FROM cadences),
  split AS (SELECT cadence, band, target, day, avail, CASE WHEN r <= n_train THEN 'train' WHEN r <= n_train + n_heldout THEN 'heldout' ELSE 'val' END AS pool
   FROM rk JOIN alloc USING (band))"""


def _split(spark, d):
    return pools.stratified_split(V.cadences(spark, d), ["band"], "cadence")


@query("spl2_stratified_split", f"WITH {_SPLIT} SELECT cadence, band, target, pool FROM split")
def _(spark, d):
    return _split(spark, d).select("cadence", "band", "target", "pool")


def _repair_sql(n, src, req):
    return f"""mv{n} AS (SELECT tgt, count(*) FILTER (pool = '{req}') AS have,
    first(cadence ORDER BY (pool <> 'val')::INT, md5('42-{req}|' || cadence), cadence) FILTER (pool <> '{req}') AS id,
    first(pool ORDER BY (pool <> 'val')::INT, md5('42-{req}|' || cadence), cadence) FILTER (pool <> '{req}') AS from_pool
    FROM {src} GROUP BY 1 HAVING count(*) FILTER (pool = '{req}') = 0),
   rp{n} AS (SELECT s.* REPLACE (CASE WHEN s.cadence = m.id THEN '{req}' ELSE pool END AS pool) FROM {src} s LEFT JOIN mv{n} m USING (tgt))"""


_REPAIR = f"""{_SPLIT}, rp0 AS (SELECT cadence, target || (cadence % 211) AS tgt, pool FROM split),
  {_repair_sql(1, "rp0", "train")}, {_repair_sql(2, "rp1", "heldout")}"""


def _repaired(spark, d):
    s = _split(spark, d).withColumn("tgt", F.concat("target", F.pmod("cadence", F.lit(211)).cast("string")))
    return pools.repair_coverage(s.select("cadence", "tgt", "pool"), "tgt", "cadence")


@query("spl3_repair_coverage", f"WITH {_REPAIR} SELECT cadence, tgt, pool FROM rp2")
def _(spark, d):
    return _repaired(spark, d)[0]


@query("spl3_repair_log", f"""WITH {_REPAIR} SELECT tgt, id AS cadence, from_pool, 'train' AS to_pool, id IS NULL AS failed FROM mv1
  UNION ALL SELECT tgt, id, from_pool, 'heldout', id IS NULL FROM mv2""")
def _(spark, d):
    return _repaired(spark, d)[1]


@query("spl4_day_diversity", f"""WITH {_SPLIT}, x AS (SELECT *, band * 7 + (cadence % 31) AS b FROM split)
  SELECT b, pool, count(*) AS n_cadences, min(day) AS only_day FROM x GROUP BY 1, 2 HAVING count(DISTINCT day) = 1""")
def _(spark, d):
    s = _split(spark, d).withColumn("b", F.col("band") * 7 + F.pmod("cadence", F.lit(31)))
    return pools.day_diversity(s, ["b"])


@query("spl5_pool_coverage", f"""WITH {_SPLIT} SELECT band, count(*) FILTER (pool = 'train') AS train, count(*) FILTER (pool = 'val') AS val,
  count(*) FILTER (pool = 'heldout') AS heldout FROM split GROUP BY 1""")
def _(spark, d):
    return pools.pool_coverage(_split(spark, d), "band")


@query("spl6_fraction_split", f"""WITH {V.CADENCES}, n AS (SELECT count(*) AS n FROM cadences), r AS (SELECT cadence,
   row_number() OVER (ORDER BY md5('42|' || cadence), cadence) AS r FROM cadences)
  SELECT cadence, CASE WHEN r <= least(greatest(1, floor(n * 0.15::DOUBLE)), n - 1) THEN 'val' ELSE 'train' END AS split FROM r, n""")
def _(spark, d):
    return pools.fraction_split(V.cadences(spark, d), "cadence", 0.15).select("cadence", "split")


@query("samp1_plan_snippets", f"""WITH {V.CADENCES}, x AS (SELECT cadence, greatest(least(30, (avail / 100)::BIGINT), 0) AS x FROM cadences),
  c AS (SELECT *, coalesce(sum(x) OVER (ORDER BY cadence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM x)
  SELECT cadence, least(x, 20000 - prior)::BIGINT AS take FROM c WHERE least(x, 20000 - prior) > 0""")
def _(spark, d):
    c = V.cadences(spark, d).select("cadence", F.round(F.col("avail") / 100, 0).cast("long").alias("avail"))
    return pools.plan_snippets(c, "cadence", "avail", 30, 20000).select("cadence", "take")


@query("samp2_sample_per_group", f"""WITH {V.SCORES} SELECT cadence_idx, f_start FROM scores
  QUALIFY row_number() OVER (PARTITION BY cadence_idx ORDER BY md5('7|' || cadence_idx || '|' || f_start), f_start) <= 25""")
def _(spark, d):
    return pools.sample_per_group(V.scores(spark, d).select("cadence_idx", "f_start"), ["cadence_idx"],
                                  ["cadence_idx", "f_start"], 25, 7)


@query("join5_band_members", f"""WITH {V.BANDS}, b AS (SELECT DISTINCT round_even(f_lo, 0) AS band_lo, round_even(f_hi, 0) AS band_hi FROM bands)
  SELECT band_lo, band_hi, count(*) AS n_files FROM b JOIN bands ON abs(f_lo - band_lo) < 1 AND abs(f_hi - band_hi) < 1 GROUP BY ALL""")
def _(spark, d):
    return catalog.band_members(V.bands(spark, d))


@query("join8_trial_grid", """WITH s AS (SELECT l_suppkey AS cadence_idx, l_linenumber AS site FROM lineitem GROUP BY ALL),
  m AS (SELECT unnest([0, 1, 2, 3]) AS m_idx, unnest(['linear', 'quadratic', 'sine', 'pulses']) AS morphology), r AS (SELECT unnest([5.0, 10.0, 20.0])::DOUBLE AS snr)
  SELECT cadence_idx, site, m_idx::BIGINT AS m_idx, morphology, snr, (7 + 1000 * cadence_idx + site + 100000 * m_idx)::BIGINT AS site_seed FROM s, m, r""")
def _(spark, d):
    s = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("cadence_idx"), F.col("l_linenumber").alias("site")).distinct()
    return pools.trial_grid(s, ["linear", "quadratic", "sine", "pulses"], [5, 10, 20], 7)


@query("join9_nodes_without_cadence", f"""WITH {V.OBSERVATIONS}, n AS (SELECT DISTINCT node || user_id AS node FROM observations)
  SELECT node FROM n WHERE node NOT IN (SELECT node || user_id FROM observations GROUP BY node || user_id HAVING count(*) >= 65)""")
def _(spark, d):
    o = V.observations(spark, d).withColumn("node", F.concat("node", F.col("user_id").cast("string")))
    return catalog.nodes_without_cadence(o, o.groupBy("node").count().filter("count >= 65"))


@query("join10_exclude_targets", f"""WITH {V.CADENCES}, k AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || cadence), cadence) AS r,
   count(*) OVER () AS n FROM cadences WHERE target NOT IN ('MACHINERY', 'BUILDING'))
  SELECT cadence, target, CASE WHEN r > floor(n * 0.8::DOUBLE) THEN 'inject_recovery'
   WHEN r <= greatest(1, floor(floor(n * 0.8::DOUBLE) * 0.1::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM k
  UNION ALL SELECT cadence, target, 'inject_recovery' FROM cadences WHERE target IN ('MACHINERY', 'BUILDING')""")
def _(spark, d):
    return pools.exclude_targets(V.cadences(spark, d).select("cadence", "target"), "cadence", "target",
                                 ["MACHINERY", "BUILDING"], 0.8, 0.1)


@query("src7_cadence_scan", f"""WITH {V.OBSERVATIONS} SELECT obs_id // 6 AS cadence_idx, file,
  row_number() OVER (PARTITION BY obs_id // 6 ORDER BY mjd_sec, file) - 1 AS obs_idx FROM observations""")
def _(spark, d):
    o = V.observations(spark, d)
    m = o.select("file", F.floor(F.col("obs_id") / 6).alias("cadence_idx"))
    out = catalog.cadence_scan(m, o.select("file", "mjd_sec"))
    return out.select("cadence_idx", "file", F.col("obs_idx").cast("long").alias("obs_idx"))


@query("sort1_multi_key", f"""WITH {V.OBSERVATIONS} SELECT product, abs_time_s, file, row_number() OVER (ORDER BY product, abs_time_s, file) AS pos
  FROM observations""")
def _(spark, d):
    o = V.observations(spark, d).select("product", "abs_time_s", "file")
    order = ["product", "abs_time_s", "file"]
    return scale.ordered_rank(scale.range_bucketed(o, order), [], order, F.col("_rb"), "pos").drop("_rb")


@query("set1_union_of_pools", f"""WITH {V.SCORES} SELECT 'low' AS pool, cadence_idx, f_start FROM scores WHERE score < 5000
  UNION ALL SELECT 'high', cadence_idx, f_start FROM scores WHERE score > 90000""")
def _(spark, d):
    s = V.scores(spark, d)
    return (s.filter("score < 5000").select(F.lit("low").alias("pool"), "cadence_idx", "f_start")
            .unionByName(s.filter("score > 90000").select(F.lit("high").alias("pool"), "cadence_idx", "f_start")))


@query("set2_difference", """SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity > 49 EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.09""")
def _(spark, d):
    li = V.table(spark, d, "lineitem")
    return li.filter("l_quantity > 49").select(F.col("l_partkey").alias("id")).subtract(
        li.filter("l_discount > 0.09").select("l_partkey"))


@query("set3_distinct", f"WITH {V.OBSERVATIONS} SELECT DISTINCT target, mjd_day, f_start_mhz FROM observations")
def _(spark, d):
    return V.observations(spark, d).select("target", "mjd_day", "f_start_mhz").distinct()
