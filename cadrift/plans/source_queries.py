"""Queries that write derived tables to the shared folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cadrift import schemas
from cadrift.operators import pools, search
from cadrift.plans import views as V
from cadrift.plans.prepare_queries import BLOCKS, blocks
from cadrift.plans.registry import query
from cadrift.plans.search_queries import CLUSTER_COLS, WIN, _clusters, _ABOVE, chains_sql, rnd, thr_sql
from cadrift.session import checkpoint_root
from cadrift.sources import io


def _path(spark, name):
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


@query("src2_read_headers", """SELECT 'blc0' || (p_partkey % 4) || '_guppi_60055_0' || printf('%04d', p_partkey % 9999) || '_' || p_type || '_0001.rawspec.0000.h5' AS file,
  round(p_retailprice, 6) AS fch1_mhz, round(-p_retailprice, 4) AS foff_hz, round(least(p_retailprice, p_retailprice - p_retailprice / 1e6 * 1024), 4) AS f_start_mhz,
  round(greatest(p_retailprice, p_retailprice - p_retailprice / 1e6 * 1024), 4) AS f_stop_mhz, round(p_retailprice / 1e6 * 1024, 4) AS bw_mhz,
  p_type AS target, '0000' AS product, 60055::BIGINT * 86400 + p_partkey % 9999 AS abs_time_s, round(p_size * 16, 2)::DOUBLE AS duration_s FROM part""")
def _(spark, d):
    p = V.table(spark, d, "part")
    name = F.concat(F.lit("blc0"), F.pmod("p_partkey", F.lit(4)).cast("string"), F.lit("_guppi_60055_0"),
                    F.format_string("%04d", F.pmod("p_partkey", F.lit(9999))), F.lit("_"), F.col("p_type"), F.lit("_0001.rawspec.0000.h5"))
    raw = p.select(name.alias("file"), F.col("p_retailprice").alias("fch1"), (-F.col("p_retailprice") / 1e6).alias("foff"),
                   F.lit(1024).cast("long").alias("nchans"), F.lit(16).cast("long").alias("ntime"), F.lit(1).cast("long").alias("nifs"),
                   F.col("p_size").cast("double").alias("tsamp"))
    out = _path(spark, "headers")
    raw.write.parquet(out)
    h = io.read_headers(spark, out)
    return h.select("file", "fch1_mhz", "foff_hz", "f_start_mhz", "f_stop_mhz", "bw_mhz", "target", "product", "abs_time_s", "duration_s")


@query("src4_read_manifest", """SELECT count(DISTINCT o_custkey)::BIGINT AS n_cadences, count(*)::BIGINT AS n_files, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders""")
def _(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_custkey").alias("cadence_idx"), F.col("o_orderkey").alias("obs_idx"),
                                           F.format_string("/data/%d.h5", "o_orderkey").alias("file"))
    out = _path(spark, "manifest")
    io.write_manifest(io.manifest_lines(o), out)
    m = io.read_manifest(spark, out).withColumn("k", F.regexp_extract("file", r"(\d+)\.h5$", 1).cast("long"))
    return m.agg(F.countDistinct("cadence_idx").alias("n_cadences"), F.count("*").alias("n_files"),
                 F.min("k").alias("first_key"), F.max("k").alias("last_key"))


@query("src5_manifest_lines", """SELECT o_custkey AS cadence_idx, list('/data/' || o_orderkey || '.h5' ORDER BY o_orderkey) AS files FROM orders GROUP BY 1""")
def _(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_custkey").alias("cadence_idx"), F.col("o_orderkey").alias("obs_idx"),
                                           F.format_string("/data/%d.h5", "o_orderkey").alias("file"))
    return io.manifest_lines(o)


@query("src6_spectra", f"WITH {BLOCKS} SELECT * FROM blocks")
def _(spark, d):
    out = _path(spark, "spectra")
    io.write_spectra(blocks(spark, d), out)
    return io.spectra(spark, out)


@query("src8_channel_window", f"""WITH {BLOCKS} SELECT cadence_idx, obs_idx, time_bin, block, greatest(block * 64, 100) AS ch0,
  power[greatest(block * 64, 100) - block * 64 + 1 : least((block + 1) * 64, 300) - block * 64] AS power FROM blocks WHERE block BETWEEN 1 AND 4""")
def _(spark, d):
    out = _path(spark, "spectra")
    io.write_spectra(blocks(spark, d), out)
    return io.channel_window(io.spectra(spark, out), 100, 200, 64)


@query("src9_snippet_cache", f"""WITH {V.MAP_ROWS} SELECT CASE WHEN cadence_idx < 2 THEN 'val' ELSE 'train' END AS split, count(*) AS n, round(sum(list_sum(cells)), 3) AS total FROM map_rows GROUP BY 1""")
def _(spark, d):
    m = V.map_rows(spark, d).select(*WIN, "obs_idx", F.col("cells").cast("array<float>").alias("frame"),
                                    F.when(F.col("cadence_idx") < 2, "val").otherwise("train").alias("split"))
    out = _path(spark, "cache")
    io.write_snippet_cache(m, out, {"fchans": 64, "seed": 42})
    s = F.aggregate(F.col("frame").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return io.read_snippet_cache(spark, out).groupBy("split").agg(F.count("*").alias("n"), F.round(F.sum(s), 3).alias("total"))


@query("src10_write_scores", f"WITH {V.SCORES} SELECT cadence_idx, f_start, score FROM scores")
def _(spark, d):
    out = _path(spark, "scores")
    io.write_scores(V.scores(spark, d).select(*WIN, "score"), out)
    return spark.read.schema(schemas.SCORES).parquet(out).select(*WIN, "score")


@query("src11_demux_scores", f"WITH {V.SCORES} SELECT cadence_idx, f_start, round(f_start / 1000.0::DOUBLE, 6) AS f_center_mhz, score FROM scores")
def _(spark, d):
    csv, out = _path(spark, "csv"), _path(spark, "demux")
    s = V.scores(spark, d).select(*WIN, F.round(F.col("f_start") / 1000.0, 6).alias("f_center_mhz"), "score")
    s.write.csv(csv, header=True)
    io.demux_scores(spark, csv, out)
    return spark.read.schema(schemas.SCORES).parquet(out)


@query("src12_write_candidates", f"""WITH {V.SCORES}, {thr_sql(far=0.99)}, {chains_sql("cl", _ABOVE, "true")}
  SELECT cadence_idx, 'topk' AS method, f_start_peak, round(peak_score, 6) AS peak_score, n_snippets, round(thresh_3, 6) AS thresh_3, round(thresh_5, 6) AS thresh_5, round(thresh_5, 6) AS off_ceiling
  FROM cl JOIN thr USING (cadence_idx)""")
def _(spark, d):
    c = _clusters(spark, d, 0.99)[1]
    t = search.threshold_values(V.plain_scores(spark, d), ["cadence_idx"]).select("cadence_idx", "thresh_3", "thresh_5")
    c = c.join(t, "cadence_idx").withColumn("off_ceiling", F.col("thresh_5")).withColumn("method", F.lit("topk"))
    out = _path(spark, "candidates")
    io.write_candidates(c, out)
    r = spark.read.schema(schemas.CANDIDATES).parquet(out)
    return rnd(r.select("cadence_idx", "method", "f_start_peak", "peak_score", "n_snippets", "thresh_3", "thresh_5", "off_ceiling"),
               "peak_score", "thresh_3", "thresh_5", "off_ceiling")


@query("src13_retain_maps", f"""WITH {V.MAP_SCORES}, q AS (SELECT cadence_idx, quantile_cont(score, 0.8) AS t FROM map_scores GROUP BY 1),
  live AS (SELECT cadence_idx, f_start, score, t FROM map_scores JOIN q USING (cadence_idx) WHERE cadence_idx <> 3),
  pw AS (SELECT cadence_idx, f_start FROM live QUALIFY row_number() OVER (PARTITION BY cadence_idx ORDER BY md5('1|' || cadence_idx || '|' || f_start), f_start) <= 2)
  SELECT cadence_idx, f_start, obs_idx, round(score, 6) AS score, round(t, 6) AS map_thresh, false AS is_probe FROM map_rows JOIN live USING (cadence_idx, f_start) WHERE score >= t
  UNION ALL SELECT cadence_idx, f_start, obs_idx, round(score, 6), round(t, 6), true FROM map_rows JOIN live USING (cadence_idx, f_start) SEMI JOIN pw USING (cadence_idx, f_start)""")
def _(spark, d):
    m, s = V.map_rows(spark, d), V.map_scores(spark, d)
    done = s.select("cadence_idx").distinct().filter("cadence_idx = 3")
    probe = pools.sample_per_group(s.select(*WIN), ["cadence_idx"], WIN, 2, 1)
    out = _path(spark, "maps")
    io.write_maps(io.retain_maps(m, s, 0.8, probe, done), out)
    r = spark.read.parquet(out).withColumn("cadence_idx", F.col("cadence_idx").cast("long"))
    return rnd(r.select(*WIN, "obs_idx", "score", "map_thresh", "is_probe"), "score", "map_thresh")


@query("src14_export_inventory", f"WITH {V.OBSERVATIONS} SELECT file, product, node, mjd_day, mjd_sec, abs_time_s, target, f_start_mhz, f_stop_mhz FROM observations")
def _(spark, d):
    out = _path(spark, "inventory")
    io.export_inventory(V.observations(spark, d), out)
    r = spark.read.schema(schemas.HEADERS).csv(out, header=True)
    return r.select("file", "product", "node", "mjd_day", "mjd_sec", "abs_time_s", "target", "f_start_mhz", "f_stop_mhz")
