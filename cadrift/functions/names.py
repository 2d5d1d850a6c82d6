"""File and folder names to columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name patterns, tried in this order; the first that matches names the target.
TARGET_PATTERNS = (
    r"(?i)(TIC\d+)_(ON|OFF)",
    r"(?i)(HIP\d+|GJ\d+[A-Za-z]?)_(ON|OFF)",
    r"([A-Za-z0-9]+)_(ON|OFF)(?:_|\.)",
)
TIMESTAMP_PATTERN = r"_(\d{5})_(\d+)_"
PRODUCT_PATTERN = r"(?i)\.(\d{4})\.(?:h5|hdf5)$"


def first_nonempty(*cols: Column) -> Column:
    """First argument that is not the empty string, else NULL; each is evaluated once."""
    return F.get(F.filter(F.array(*cols), lambda x: x != ""), F.lit(0))


def basename(path) -> Column:
    return F.substring_index(path, "/", -1)


def parse_rawspec_name(df: DataFrame, name: str = "name") -> DataFrame:
    """Adds node, backend, mjd_day, mjd_sec, abs_time_s, target, scan_num, product, parse_error."""
    n = F.col(name)
    rawspec = n.contains(".rawspec.") & n.endswith(".h5")
    old = r"^(.*)\.([0-9]+)\.h5$"
    # staged, so that every pattern is matched once per row
    d = df.withColumn("_core", F.when(rawspec, F.substring_index(n, ".rawspec.", 1)).otherwise(
        first_nonempty(F.regexp_extract(n, old, 1))))
    d = d.withColumn("_product", F.when(rawspec, F.regexp_extract(n, r"^.*?\.rawspec\.(.*)\.h5$", 1)).otherwise(
        F.regexp_extract(n, old, 2)))
    d = d.withColumn("_f", F.split("_core", "_"))
    size = F.size("_f")
    d = d.withColumn("_day", F.get("_f", F.lit(2)).try_cast("long")).withColumn(
        "_sec", F.get("_f", F.lit(3)).try_cast("long"))
    error = (F.when(F.col("_core").isNull(), F.concat(F.lit("no product in the name: "), n))
             .when(size < 6, F.concat(F.lit("fewer than six parts: "), "_core"))
             .when(F.col("_day").isNull() | F.col("_sec").isNull(), F.concat(
                 F.lit("day or second is no number: "), F.get("_f", F.lit(2)), F.lit(", "), F.get("_f", F.lit(3)))))
    d = d.withColumn("parse_error", error)

    def good(c):
        return F.when(F.col("parse_error").isNull(), c)

    target = F.array_join(F.slice("_f", F.lit(5), F.greatest(size - 5, F.lit(0))), "_")
    return d.select(
        *df.columns, good(F.get("_f", F.lit(0))).alias("node"), good(F.get("_f", F.lit(1))).alias("backend"),
        good(F.col("_day")).alias("mjd_day"), good(F.col("_sec")).alias("mjd_sec"),
        good(abs_time(F.col("_day"), F.col("_sec"))).alias("abs_time_s"),
        good(target).alias("target"), good(F.get("_f", size - 1)).alias("scan_num"),
        good(F.col("_product")).alias("product"), "parse_error")


def parse_labelled_name(df: DataFrame, path: str = "path") -> DataFrame:
    """Adds target, obs_type, mjd, secs, product; all NULL where the name does not fit."""
    d = df.withColumn("_n", basename(F.col(path)))

    def part(i):
        return first_nonempty(*[F.regexp_extract("_n", p, i) for p in TARGET_PATTERNS])

    # staged, so that every pattern is matched once per row
    d = d.select("*", first_nonempty(F.regexp_extract("_n", PRODUCT_PATTERN, 1)).alias("_p"),
                 part(1).alias("_t"), part(2).alias("_o"),
                 first_nonempty(F.regexp_extract("_n", TIMESTAMP_PATTERN, 1)).alias("_m"),
                 F.regexp_extract("_n", TIMESTAMP_PATTERN, 2).try_cast("long").alias("_s"))
    d = d.withColumn("_ok", F.col("_p").isNotNull() & F.col("_t").isNotNull())
    ok = F.col("_ok")
    return d.select(*df.columns, F.when(ok, F.col("_t")).alias("target"), F.when(ok, F.upper("_o")).alias("obs_type"),
                    F.when(ok, F.coalesce("_m", F.lit("00000"))).alias("mjd"),
                    F.when(ok, F.coalesce("_s", F.lit(0))).alias("secs"), F.when(ok, F.col("_p")).alias("product"))


def cadence_dirname(idx, target, fch1_mhz, mjd) -> Column:
    """cadNN_target_freqMHz_date; ``nodate`` when the start day is missing or zero."""
    freq = F.format_string("%.1f", F.bround(fch1_mhz, 1))
    date = F.when(mjd > 0, mjd_to_date(mjd)).otherwise("nodate")
    return F.concat(F.lit("cad"), F.lpad(idx.cast("string"), F.greatest(F.lit(2), F.length(idx.cast("string"))), "0"),
                    F.lit("_"), target, F.lit("_"), freq, F.lit("MHz_"), date)


# Fixed value: layout of a cadence folder name.
CADENCE_DIR = r"^cad(\d+)_(.+?)_[\d.]+MHz_\d+$"


def parse_cadence_dirname(name) -> tuple[Column, Column]:
    """(cadence index, target), both NULL where the folder name does not fit."""
    fits = name.rlike(CADENCE_DIR)
    return (F.when(fits, F.regexp_extract(name, CADENCE_DIR, 1).try_cast("long")),
            F.when(fits, F.regexp_extract(name, CADENCE_DIR, 2)))


def abs_time(day, sec) -> Column:
    return day * 86400 + sec


def mjd_to_date(mjd) -> Column:
    """yyyymmdd of a modified Julian date; day 0 is 1858-11-17."""
    return F.date_format(F.date_add(F.to_date(F.lit("1858-11-17")), F.floor(mjd).cast("int")), "yyyyMMdd")
