"""Resume-safe ingest of new archives with Structured Streaming."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from panelkit.functions import fixed_values as fv
from panelkit.sources.feeds import dedup_keep_last, lines_of, split_feed_lines, type_feed

STAGED_SCHEMA = "file string, pos bigint, date date, symbol string, sector string, name string, open double, high double, low double, close double, volume bigint, ldcp double"
BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def ingest_new(spark: SparkSession, archives: str, staged: str, checkpoint: str, max_files: int | None = None) -> None:
    """Type the archives not seen before and stage them, then stop.

    The checkpoint remembers processed files. Each micro-batch owns one folder that it
    overwrites, so a batch retried after a lost executor leaves no duplicates, and the
    history is never rewritten.
    """
    reader = spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))

    def stage(batch: DataFrame, batch_id: int) -> None:
        typed = type_feed(split_feed_lines(lines_of(batch)))
        typed.write.mode("overwrite").parquet(f"{staged}/batch={batch_id}")

    query = (
        reader.load(archives).writeStream.foreachBatch(stage)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def staged_panel(spark: SparkSession, staged: str) -> DataFrame:
    """The panel over all staged batches; later files and lines win. It is deduplicated
    anew at each read; ``streaming.upsert`` keeps a panel that is not. Nothing staged yet:
    no rows."""
    try:
        rows = spark.read.schema(STAGED_SCHEMA).parquet(staged)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], STAGED_SCHEMA)
    return dedup_keep_last(rows).select(*fv.FEED_COLUMNS)
