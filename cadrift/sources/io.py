"""Sources and sinks. Sinks are range partitioned, so a hot cadence is written by many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadrift import schemas
from cadrift.functions.geometry import band_geometry
from cadrift.functions.names import PRODUCT_PATTERN, basename, parse_rawspec_name
from cadrift.operators import scale


def scan_observations(spark: SparkSession, root: str, product: str | None = None) -> DataFrame:
    """Paths of .h5 and .hdf5 files below ``root``; file contents are never read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.{h5,hdf5}").load(root).select("path", "length"))
    if product:
        files = files.filter(F.regexp_extract(basename(F.col("path")), PRODUCT_PATTERN, 1) == product)
    return files


def read_headers(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Header table with names parsed and band geometry derived; bad names keep their error."""
    raw = spark.read.schema(schemas.RAW_HEADERS).format(fmt).options(
        **({"header": "true"} if fmt == "csv" else {})).load(path)
    named = parse_rawspec_name(raw.withColumn("name", basename("file"))).drop("name")
    return band_geometry(named)


def quarantine(df: DataFrame, error: str = "parse_error", required: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with a reason): an error text, or a required column that is missing."""
    missing = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required]
    d = df.withColumn("_why", F.coalesce(F.col(error), *missing))
    return (d.filter(F.col("_why").isNull()).drop("_why"),
            d.filter(F.col("_why").isNotNull()).withColumn(error, F.col("_why")).drop("_why"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """cadence_idx, obs_idx, file from lines of space-separated paths; blank and # lines skipped."""
    lines = spark.read.text(path).select(
        F.trim("value").alias("line"), F.col("_metadata.file_path").alias("_f"),
        F.col("_metadata.file_block_start").alias("_o"), F.monotonically_increasing_id().alias("_i"))
    kept = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    order = ["_f", "_o", "_i"]
    numbered = scale.ordered_rank(kept, [], order, F.concat_ws("|", "_f", F.lpad(F.col("_o").cast("string"), 20, "0")),
                                  "_n", kept.count())
    return numbered.select((F.col("_n") - 1).alias("cadence_idx"),
                           F.posexplode(F.split("line", r"\s+")).alias("obs_idx", "file")).withColumn(
        "obs_idx", F.col("obs_idx").cast("long"))


def write_manifest(cadences: DataFrame, path: str, seed: int = 42) -> None:
    """One line of six paths per cadence (column ``files``), lines in seeded random order."""
    line = cadences.select(F.array_join("files", " ").alias("value"))
    h = line.withColumn("_h", scale.seeded_hash(seed, "value"))
    h.repartitionByRange("_h").sortWithinPartitions("_h").select("value").write.mode("overwrite").text(path)


def manifest_lines(rows: DataFrame) -> DataFrame:
    """Rows cadence_idx, obs_idx, file to one ``files`` array per cadence (a cadence has six)."""
    s = F.sort_array(F.collect_list(F.struct("obs_idx", "file")))
    return rows.groupBy("cadence_idx").agg(F.transform(s, lambda x: x["file"]).alias("files"))


def spectra(spark: SparkSession, path: str) -> DataFrame:
    """Spectrogram blocks: one row per cadence, observation, time bin and channel block."""
    return spark.read.schema(schemas.SPECTRA).parquet(path)


def write_spectra(df: DataFrame, path: str) -> None:
    """Blocks sorted so that a cadence, and a channel range in it, is a run of row groups within few files."""
    (df.withColumn("cadence_idx", F.col("cadence_idx").cast("long")).repartitionByRange("cadence_idx", "obs_idx", "block")
     .sortWithinPartitions("cadence_idx", "obs_idx", "block", "time_bin").write.mode("overwrite").parquet(path))


def channel_window(blocks: DataFrame, f_start: int, fchans: int, block: int = 512) -> DataFrame:
    """Blocks touching channels [f_start, f_start + fchans), cut to them, with their first channel.

    The range reaches the scan as a filter on ``block``.
    """
    b = blocks.filter(F.col("block").between(f_start // block, (f_start + fchans - 1) // block))
    first = F.greatest(F.col("block") * block, F.lit(f_start))
    last = F.least((F.col("block") + 1) * block, F.lit(f_start + fchans))
    part = F.slice("power", (first - F.col("block") * block + 1).cast("int"), (last - first).cast("int"))
    return b.select("cadence_idx", "obs_idx", "time_bin", "block", first.alias("ch0"), part.alias("power"))


def write_snippet_cache(df: DataFrame, out: str, meta: dict) -> None:
    """Raw snippets per split and one row of metadata with the counts."""
    d = df.repartitionByRange("split", "cadence_idx", "f_start")
    d.write.mode("overwrite").partitionBy("split").parquet(f"{out}/snippets")
    counts = df.groupBy().agg(F.count("*").alias("n_rows"), F.count_if(F.col("split") == "train").alias("n_train"),
                              F.count_if(F.col("split") == "val").alias("n_val"))
    counts.select("*", *[F.lit(v).alias(k) for k, v in meta.items()]).write.mode("overwrite").parquet(f"{out}/meta")


def read_snippet_cache(spark: SparkSession, out: str, split: str | None = None) -> DataFrame:
    d = spark.read.schema(schemas.SNIPPETS).parquet(f"{out}/snippets")
    return d if split is None else d.filter(F.col("split") == split)


def write_scores(df: DataFrame, out: str, mode: str = "overwrite") -> None:
    """All window scores of a run, sorted by cadence and f_start.

    A cadence is a run of row groups, which a filter on it finds by their statistics. Files are as
    many as tasks, whatever the number of cadences; a folder for each would be that many files.
    """
    (df.withColumn("cadence_idx", F.col("cadence_idx").cast("long")).repartitionByRange("cadence_idx", "f_start")
     .sortWithinPartitions("cadence_idx", "f_start").write.mode(mode).parquet(out))


def demux_scores(spark: SparkSession, csv: str, out: str) -> None:
    """Split one large score CSV by cadence, sorted by f_start, in one shuffle."""
    write_scores(spark.read.schema(schemas.SCORES).csv(csv, header=True), out)


def write_candidates(df: DataFrame, out: str) -> None:
    """Candidates with the thresholds that judged them, by method and sorted by cadence in files as ``write_scores`` has them."""
    missing = [c for c in ("off_ceiling", "thresh_3", "thresh_5") if c not in df.columns]
    if missing:
        raise ValueError(f"candidates without {', '.join(missing)} cannot be audited later")
    order = ["method", "cadence_idx", "f_start_peak"]
    (df.withColumn("cadence_idx", F.col("cadence_idx").cast("long")).repartitionByRange(*order).sortWithinPartitions(*order)
     .write.mode("overwrite").partitionBy("method").parquet(out))


def retain_maps(maps: DataFrame, scores: DataFrame, q: float = 0.95, probe: DataFrame | None = None,
                done: DataFrame | None = None) -> DataFrame:
    """Maps of windows at or above their cadence's score quantile, and the probe's, flagged.

    ``done`` lists finished cadences (cadence_idx), which are skipped.
    """
    win = ["cadence_idx", "f_start"]
    if done is not None:
        maps = maps.join(done, "cadence_idx", "left_anti")
        scores = scores.join(done, "cadence_idx", "left_anti")
    cut = scale.exact_quantiles(scores, ["cadence_idx"], "score", {"map_thresh": q})
    kept = scores.join(cut, "cadence_idx").filter(F.col("score") >= F.col("map_thresh"))
    out = maps.join(kept.select(*win, "score", "map_thresh"), win).withColumn("is_probe", F.lit(False))
    if probe is None:
        return out
    p = maps.join(probe.select(*win).distinct(), win, "left_semi").join(cut, "cadence_idx").join(
        scores.select(*win, "score"), win).withColumn("is_probe", F.lit(True))
    return out.unionByName(p)


def write_maps(retained: DataFrame, out: str) -> None:
    """Adds finished cadences to the map store; rerunning a cadence replaces only that cadence."""
    (retained.repartitionByRange("cadence_idx", "f_start").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("cadence_idx").parquet(out))


def export_inventory(df: DataFrame, out: str) -> None:
    """Fixed column list with header; columns the inventory does not know are ignored."""
    cols = schemas.HEADERS.names
    df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(schemas.HEADERS[c].dataType).alias(c) for c in cols]
              ).write.mode("overwrite").csv(out, header=True)
