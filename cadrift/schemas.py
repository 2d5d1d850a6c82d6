"""Explicit schemas of the tables this package exchanges."""

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
          "array<float>": T.ArrayType(T.FloatType()), "array<double>": T.ArrayType(T.DoubleType())}


def _fields(spec: str) -> T.StructType:
    pairs = (f.split() for f in spec.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


HEADERS = _fields(
    "file string, product string, node string, mjd_day bigint, mjd_sec bigint, abs_time_s bigint, "
    "scan_num string, target string, f_start_mhz double, f_stop_mhz double, bw_mhz double, fch1_mhz double, "
    "foff_hz double, nchans bigint, ntime bigint, nifs bigint, tsamp_s double, duration_s double")
RAW_HEADERS = _fields("file string, fch1 double, foff double, nchans bigint, ntime bigint, nifs bigint, tsamp double")
SPECTRA = _fields("cadence_idx bigint, obs_idx bigint, time_bin bigint, block bigint, power array<float>")
SNIPPETS = _fields("cadence_idx bigint, f_start bigint, obs_idx bigint, frame array<float>, split string")
SCORES = _fields("cadence_idx bigint, f_start bigint, f_center_mhz double, score double")
CANDIDATES = _fields(
    "cadence_idx bigint, method string, f_start_peak bigint, freq_mhz_peak double, peak_score double, "
    "mean_score double, n_snippets bigint, f_start_first bigint, f_start_last bigint, cluster_width_channels bigint, "
    "on_off_contrast double, on_mean double, off_mean double, n_on_hits bigint, n_off_hits bigint, "
    "n_on_hits_full bigint, n_off_hits_full bigint, off_leak boolean, in_short_list boolean, off_ceiling double, "
    "thresh_3 double, thresh_5 double")
MAP_ROWS = _fields("cadence_idx bigint, f_start bigint, obs_idx bigint, cells array<double>")
