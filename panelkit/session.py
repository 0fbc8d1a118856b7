"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_written: dict[str, list[tuple[str, str | None]]] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("panelkit")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder all executors can reach, under ``spark.checkpoint.dir``. Only a
    session within one process may leave that unset and gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="panelkit-")
    path = os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")
    _written.setdefault(spark.sparkContext.applicationId, []).append((path, None))
    return path


def release(spark: SparkSession) -> int:
    """Removes what this application has written to shared folders: tables leave the
    catalog, files go. Frames read from them can't be used any more."""
    written = _written.pop(spark.sparkContext.applicationId, [])
    for path, name in written:
        if name:
            spark.sql(f"drop table if exists {name}")
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(written)


def bucket_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def materialize(df: DataFrame, purpose: str, bucket_by: str | None = None, sort_by: tuple[str, ...] = (), buckets: int | None = None) -> DataFrame:
    """Write a frame once to the shared folder and read it back: later plans start at a
    table, so lineage is cut and a lost executor costs no recomputation.

    ``bucket_by`` stores hash buckets of a frame already partitioned by that column into
    ``buckets`` parts (by default ``bucket_count``), so later windows and joins on it need
    no exchange. It then is an external table of the session's catalog, whichever that is;
    ``release`` drops it.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    if bucket_by:
        name = f"panelkit_{purpose}_{uuid.uuid4().hex}".replace("-", "_")
        _written[spark.sparkContext.applicationId].append((path, name))
        writer = df.write.bucketBy(buckets or bucket_count(spark), bucket_by)
        writer.sortBy(bucket_by, *sort_by).option("path", path).saveAsTable(name)
        return spark.table(name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
