"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int | str = "*", app: str = "cadrift") -> SparkSession:
    """Local session with the settings the tests and the bench use."""
    parts = "8" if cpus == "*" else str(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by the cluster; a temporary one only where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return root


_CUTS: list[str] = []


def cut(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` under the checkpoint folder, with options of the writer, and read it back.

    A written table survives lost executors, prunes columns when it is read again and has
    a known size, so Catalyst decides by size whether a later join may broadcast it. It stays
    until ``drop_cuts`` is told that its readers are done.
    """
    path = f"{checkpoint_root(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _CUTS.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cuts() -> list[str]:
    """Tables that ``cut`` has written in this process and that are not dropped, oldest first."""
    return list(_CUTS)


def drop_cuts(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete written tables, by default all; nothing may read them afterwards."""
    for path in cuts() if paths is None else paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _CUTS.remove(path)
