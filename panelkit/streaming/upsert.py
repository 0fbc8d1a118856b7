"""A panel that grows by upserts of whole months.

An arrival of archives touches the months of its rows. Those months are merged with what
the panel holds of them, the later file and line winning, and written as a new version
beside the old one; all other months keep their files. Which version of a month holds is
read from the folders: the highest that was finished. So

- a batch that is retried overwrites its own version and nothing else,
- a reader sees a month before or after an arrival, never between,
- work grows with the arrival and the months it touches, not with the history.

``panel/version=<batch>/month=<first day>/part-*``; Spark's ``_SUCCESS`` file marks a
finished version. ``drop_old`` removes versions that no month needs any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.functions import fixed_values as fv
from panelkit.operators.months import calendar_broadcast
from panelkit.session import materialize
from panelkit.sources.feeds import dedup_keep_last, lines_of, split_feed_lines, type_feed
from panelkit.streaming.ingest import BINARY_SCHEMA, STAGED_SCHEMA

HELD_SCHEMA = f"{STAGED_SCHEMA}, version bigint, month date"
NAMES = [c.strip().split(" ")[0] for c in STAGED_SCHEMA.split(",")]


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def finished_versions(spark: SparkSession, panel: str) -> list[int]:
    """Versions with their mark, in order; one per arrival."""
    fs, root = _folder(spark, panel)
    if not fs.exists(root):
        return []
    found = [s.getPath() for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("version=")]
    done = [p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("version=")) for p in done)


def _versions(spark: SparkSession, panel: str, before: int | None = None) -> DataFrame:
    """All rows of finished versions with their version and month; typed, also if none."""
    use = [f"{panel}/version={v}" for v in finished_versions(spark, panel) if before is None or v < before]
    if not use:
        return spark.createDataFrame([], HELD_SCHEMA)
    return spark.read.schema(HELD_SCHEMA).option("basePath", panel).parquet(*use)


def _newest(rows: DataFrame) -> DataFrame:
    """(month, version) that hold: read from the folders' names, one row per month."""
    return rows.groupBy("month").agg(F.max("version").alias("version"))


def held_rows(spark: SparkSession, panel: str, before: int | None = None) -> DataFrame:
    """The rows that hold, with their month, file and line."""
    rows = _versions(spark, panel, before)
    return rows.join(calendar_broadcast(_newest(rows)), ["month", "version"]).select(*NAMES, "month")


def panel_rows(spark: SparkSession, panel: str) -> DataFrame:
    """The panel as of the last finished arrival; no rows before the first."""
    return held_rows(spark, panel).select(*fv.FEED_COLUMNS)


def upsert(spark: SparkSession, rows: DataFrame, panel: str, version: int) -> None:
    """Merges typed rows (with file and pos) into the panel as ``version``."""
    new = materialize(rows.select(*NAMES, F.trunc("date", "MM").alias("month")), "arrival")
    months = new.select("month").distinct()
    held = held_rows(spark, panel, version).join(calendar_broadcast(months), "month", "left_semi")
    merged = dedup_keep_last(new.unionByName(held), ("date", "symbol"), keep_place=True)
    out = merged.withColumn("month", F.trunc("date", "MM"))
    # a month with very many symbols takes several files; one with few takes one
    out.hint("rebalance", "month").write.mode("overwrite").partitionBy("month").parquet(f"{panel}/version={version}")


def upsert_new(spark: SparkSession, archives: str, panel: str, checkpoint: str, max_files: int | None = None) -> None:
    """Takes the archives not seen before into the panel, then stops. The checkpoint
    remembers processed files; a batch keeps its number when it is retried."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))

    def merge(batch: DataFrame, batch_id: int) -> None:
        upsert(batch.sparkSession, type_feed(split_feed_lines(lines_of(batch))), panel, batch_id)

    query = (
        reader.load(archives).writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def drop_old(spark: SparkSession, panel: str) -> int:
    """Deletes the months of finished versions that a later version replaces; returns how
    many. Not to be run beside a reader that started before the last arrival."""
    rows = _versions(spark, panel)
    every = rows.select("month", "version").distinct()
    old = every.join(_newest(rows), ["month", "version"], "left_anti").collect()  # months and versions
    fs, _ = _folder(spark, panel)
    for r in old:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{panel}/version={r['version']}/month={r['month']}"), True)
    return len(old)
