"""Views that give the driver tables the shapes of this package, in Spark and in SQL.

Every view keeps all rows of its table. The SQL form is a CTE body used by the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadrift.operators import scale

STRIDE = 512
FCHANS = 1024
DF_HZ = 2.7939677238464355
ORDER_SPAN = 1 << 20

_LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity",
               "l_shipdate"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _numbered_lines(spark, d):
    li = table(spark, d, "lineitem").select(*_LINE_ORDER, "l_suppkey", "l_returnflag",
                                            "l_discount")
    bucket = F.floor(F.col("l_orderkey") / F.lit(ORDER_SPAN))
    return scale.ordered_rank(li, ["l_suppkey"], _LINE_ORDER, bucket, "rn", largest_cadence(spark, d))


def largest_cadence(spark, d) -> int:
    """Windows of the largest cadence of ``scores``: a count over one column."""
    return scale.largest_group(table(spark, d, "lineitem").select("l_suppkey"), ["l_suppkey"])


_RN = f"row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(_LINE_ORDER)})"


def scores(spark, d) -> DataFrame:
    """cadence_idx, f_start, score, method: one row per line item."""
    return _numbered_lines(spark, d).select(
        F.col("l_suppkey").alias("cadence_idx"),
        ((F.col("rn") - 1) * STRIDE).alias("f_start"),
        F.col("l_extendedprice").alias("score"),
        F.col("l_returnflag").alias("method"))


def plain_scores(spark, d) -> DataFrame:
    """cadence_idx, score, method for reports that need no window position."""
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("cadence_idx"), F.col("l_extendedprice").alias("score"),
        F.col("l_returnflag").alias("method"))


SCORES = f"""scores AS (SELECT l_suppkey AS cadence_idx, {STRIDE} * ({_RN} - 1) AS f_start,
  l_extendedprice AS score, l_returnflag AS method FROM lineitem)"""


def pixels(spark, d) -> DataFrame:
    """frame, t, ch, x: 32-channel frames of one supplier's line items."""
    i = F.col("rn") - 1
    return _numbered_lines(spark, d).select(
        F.col("l_suppkey").alias("frame"), F.floor(i / 32).alias("t"),
        F.pmod(i, F.lit(32)).alias("ch"), F.col("l_quantity").alias("x"))


PIXELS = f"""pixels AS (SELECT frame, i // 32 AS t, i % 32 AS ch, x FROM (
  SELECT l_suppkey AS frame, {_RN} - 1 AS i, l_quantity AS x FROM lineitem))"""


def map_rows(spark, d) -> DataFrame:
    """cadence_idx, f_start, obs_idx, cells: six observation rows of 64 cells per window."""
    e = table(spark, d, "embeddings")
    snippet = F.floor(F.col("vec_id") / 6)
    return e.select(
        F.pmod(snippet, F.lit(8)).alias("cadence_idx"),
        (F.floor(snippet / 8) * STRIDE).alias("f_start"),
        F.pmod(F.col("vec_id"), F.lit(6)).alias("obs_idx"),
        F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("cells"))


MAP_ROWS = f"""map_rows AS (SELECT (vec_id // 6) % 8 AS cadence_idx,
  (vec_id // 48) * {STRIDE} AS f_start, vec_id % 6 AS obs_idx,
  list_transform(embedding, lambda x: abs(x::DOUBLE)) AS cells FROM embeddings)"""
CELLS = MAP_ROWS + """, cells AS (SELECT cadence_idx, f_start, obs_idx,
  unnest(range(64)) AS col, unnest(cells) AS v FROM map_rows)"""


def map_scores(spark, d) -> DataFrame:
    """cadence_idx, f_start, score: mean of all cells of a window's map."""
    from cadrift.operators import scoring
    return scoring.reduce_maps(map_rows(spark, d), ["cadence_idx", "f_start"], "recon")


MAP_SCORES = CELLS + """, map_scores AS (SELECT cadence_idx, f_start, avg(v) AS score
  FROM cells GROUP BY ALL)"""


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vec"), "label")


def observations(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    t = F.unix_timestamp(F.date_trunc("second", "ts"))
    t0 = F.lit(1704067200)
    mjd_s = t - t0 + F.lit(60310 * 86400)
    fch1 = 1000.0 + 200.0 * F.pmod(F.col("user_id"), F.lit(7))
    return e.select(
        F.format_string("obs_%08d.h5", "event_id").alias("file"),
        F.col("event_id").alias("obs_id"),
        mjd_s.alias("abs_time_s"),
        F.floor(mjd_s / 86400).alias("mjd_day"), F.pmod(mjd_s, F.lit(86400)).alias("mjd_sec"),
        F.col("event_type").alias("target"),
        F.concat(F.lit("blc"), F.pmod(F.col("user_id"), F.lit(4)).cast("string")).alias("node"),
        F.col("user_id"),
        F.concat(F.lit("000"), F.pmod(F.col("user_id"), F.lit(3)).cast("string")).alias("product"),
        fch1.alias("f_start_mhz"), (fch1 + 187.5 + F.pmod("event_id", F.lit(3)) * 0.25).alias("f_stop_mhz"),
        F.col("value"))


OBSERVATIONS = """observations AS (SELECT *, abs_time_s // 86400 AS mjd_day,
  abs_time_s % 86400 AS mjd_sec,
  fch1 AS f_start_mhz, fch1 + 187.5 + (obs_id % 3) * 0.25 AS f_stop_mhz FROM (
  SELECT printf('obs_%08d.h5', event_id) AS file, event_id AS obs_id,
  epoch(date_trunc('second', ts))::BIGINT - 1704067200 + 60310::BIGINT * 86400 AS abs_time_s,
  event_type AS target, 'blc' || (user_id % 4) AS node, user_id,
  '000' || (user_id % 3) AS product, 1000.0::DOUBLE + 200.0 * (user_id % 7) AS fch1, value
  FROM events))"""


def names(spark, d) -> DataFrame:
    """File names: rawspec style, older two-dot style, and some malformed."""
    e = table(spark, d, "events")
    sec = F.unix_timestamp(F.date_trunc("second", "ts"))
    day = F.floor(sec / 86400) + 40587
    ident = F.format_string("blc%02d_guppi_%05d_%05d_", F.pmod("user_id", F.lit(4)), day,
                            F.pmod(sec, F.lit(86400)))
    target = F.concat("event_type", F.when(F.col("event_id") % 7 == 0, "_B").otherwise(""))
    prod = F.format_string("%04d", F.pmod("user_id", F.lit(3)))
    core = F.concat(ident, target, F.lit("_"), F.format_string("%04d", F.pmod("event_id", F.lit(9999))))
    good = F.when(F.col("event_id") % 11 == 0, F.concat(core, F.lit("."), prod, F.lit(".h5"))).otherwise(
        F.concat(core, F.lit(".rawspec."), prod, F.lit(".h5")))
    name = (F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("notes_"), F.col("event_type"), F.lit(".txt")))
            .when(F.col("event_id") % 50 == 1, F.concat(F.lit("a_b_"), "event_type", F.lit(".rawspec.0000.h5")))
            .when(F.col("event_id") % 50 == 2, F.regexp_replace(good, "guppi_6", "guppi_x"))
            .otherwise(good))
    return e.select(F.col("event_id"), name.alias("name"))


NAMES = """names AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'notes_' || event_type || '.txt'
  WHEN event_id % 50 = 1 THEN 'a_b_' || event_type || '.rawspec.0000.h5'
  WHEN event_id % 50 = 2 THEN replace(good, 'guppi_6', 'guppi_x') ELSE good END AS name FROM (
  SELECT event_id, event_type, core || CASE WHEN event_id % 11 = 0 THEN '.' ELSE '.rawspec.' END
   || printf('%04d', user_id % 3) || '.h5' AS good FROM (
  SELECT *, printf('blc%02d_guppi_%05d_%05d_', user_id % 4, sec // 86400 + 40587, sec % 86400)
   || event_type || CASE WHEN event_id % 7 = 0 THEN '_B' ELSE '' END || '_'
   || printf('%04d', event_id % 9999) AS core FROM (
  SELECT *, epoch(date_trunc('second', ts))::BIGINT AS sec FROM events))))"""


def labelled_names(spark, d) -> DataFrame:
    """Labelled file names from orders: one group per customer and year."""
    o = table(spark, d, "orders")
    star = (F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("TIC"), F.col("o_custkey").cast("string")))
            .when(F.col("o_custkey") % 3 == 1, F.concat(F.lit("HIP"), F.col("o_custkey").cast("string")))
            .otherwise(F.concat(F.lit("STAR"), F.col("o_custkey").cast("string"))))
    role = F.when(F.col("o_orderkey") % 2 == 0, "ON").otherwise("OFF")
    mjd = F.lit(51544) + (F.year("o_orderdate") - 2000)
    name = F.concat(
        F.lit("blc00_guppi_"), mjd.cast("string"), F.lit("_"),
        F.format_string("%08d", "o_orderkey"), F.lit("_"), star, F.lit("_"), role,
        F.lit("_0001.000"), F.when(F.col("o_orderkey") % 97 == 0, "x").otherwise("0"), F.lit(".h5"))
    return o.select("o_orderkey", F.concat(F.lit("/data/d"), F.pmod("o_custkey", F.lit(5)).cast("string"),
                                           F.lit("/"), name).alias("path"))


LABELLED_NAMES = """labelled_names AS (SELECT o_orderkey, '/data/d' || (o_custkey % 5) || '/blc00_guppi_'
  || (51544 + year(o_orderdate) - 2000) || '_' || printf('%08d', o_orderkey) || '_'
  || CASE o_custkey % 3 WHEN 0 THEN 'TIC' WHEN 1 THEN 'HIP' ELSE 'STAR' END || o_custkey
  || CASE WHEN o_orderkey % 2 = 0 THEN '_ON' ELSE '_OFF' END || '_0001.000'
  || CASE WHEN o_orderkey % 97 = 0 THEN 'x' ELSE '0' END || '.h5' AS path FROM orders)"""


def cadences(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("cadence"), F.col("c_nationkey").cast("long").alias("band"),
        F.col("c_mktsegment").alias("target"),
        F.pmod(F.col("c_custkey"), F.lit(5)).alias("day"),
        F.col("c_acctbal").alias("avail"))


CADENCES = """cadences AS (SELECT c_custkey AS cadence, c_nationkey::BIGINT AS band,
  c_mktsegment AS target, c_custkey % 5 AS day, c_acctbal AS avail FROM customer)"""


def labelled(spark, d) -> DataFrame:
    """doc_id, label (1 = toxic), quality, score, value of labelled documents."""
    l = table(spark, d, "labels")
    doc = table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    return l.join(doc, "doc_id").select(
        "doc_id", F.col("toxic").cast("long").alias("label"),
        F.col("quality").cast("long").alias("quality"),
        F.col("n_chars").cast("double").alias("score"), "lang")


LABELLED = """labelled AS (SELECT doc_id, toxic::BIGINT AS label, quality::BIGINT AS quality,
  n_chars::DOUBLE AS score, lang FROM labels JOIN documents USING (doc_id))"""


def trials(spark, d) -> DataFrame:
    p = F.col("o_totalprice")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("trial"), F.pmod("o_custkey", F.lit(10)).alias("cadence_idx"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("snr"),
        F.col("o_orderstatus").alias("morphology"), p.alias("score"),
        (p / 1000.0).alias("contrast"),
        (p > 100000).alias("s0_sigma3"), (p > 150000).alias("s1_far1pct"),
        (p > 200000).alias("s2_on_rows"), (p > 250000).alias("s3_short_list"),
        ((p > 250000) & (p > 150000)).alias("survives"),
        (p > 220000).alias("survives_min"),
        F.pmod("o_custkey", F.lit(60)).alias("rank"))


TRIALS = """trials AS (SELECT o_orderkey AS trial, o_custkey % 10 AS cadence_idx,
  substr(o_orderpriority, 1, 1)::DOUBLE AS snr, o_orderstatus AS morphology, o_totalprice AS score,
  o_totalprice / 1000.0::DOUBLE AS contrast,
  o_totalprice > 100000 AS s0_sigma3, o_totalprice > 150000 AS s1_far1pct,
  o_totalprice > 200000 AS s2_on_rows, o_totalprice > 250000 AS s3_short_list,
  o_totalprice > 250000 AS survives, o_totalprice > 220000 AS survives_min,
  o_custkey % 60 AS rank FROM orders)"""


def bands(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("f_lo"),
                    (F.col("p_retailprice") + F.col("p_size")).alias("f_hi"),
                    F.col("p_size").cast("double").alias("bw"), F.col("p_type").alias("product"))


BANDS = """bands AS (SELECT p_partkey AS id, p_retailprice AS f_lo, p_retailprice + p_size AS f_hi,
  p_size::DOUBLE AS bw, p_type AS product FROM part)"""
