"""Archives of any size as a Python data source: ``spark.read.format("feed_archives")``.

A binary file row holds a whole archive, which ends at 2 GB and at the memory of a task.
Here every file (small ones together) is a partition, and its lines are decompressed as
they are read and sent on in Arrow batches. A damaged archive must give no lines at all,
and that is known only at its end: the decompressed bytes are spooled by the task, in
memory up to ``SPOOL`` bytes and beyond that in an unlinked file that ends with the task,
so each archive is read and decompressed once. A retry starts again from the archive.

Files are opened through ``pyarrow.fs``: local and mounted folders, and stores it knows by
their URI. ``feeds.read_archives`` reads archives from any store that Spark reads.
"""

from __future__ import annotations

import gzip
import shutil
import tempfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from panelkit.sources.feeds import GZIP_MAGIC, LINES_SCHEMA, first_listing

#: Bytes of decompressed lines kept in memory before they go to an unlinked file.
SPOOL = 32 << 20
#: Bytes of lines in one Arrow batch, and of small archives in one partition.
BATCH, TOGETHER = 4 << 20, 32 << 20
DAMAGED = (OSError, EOFError, zipfile.BadZipFile, zlib.error, pa.ArrowInvalid)


@dataclass
class Files(InputPartition):
    """Archives that one task reads, in order."""

    paths: list[str]


def located(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def listing(path: str) -> list[tuple[str, int]]:
    """(uri, bytes) of all files below a folder, by name; hidden files are left out."""
    store, root = located(path)
    found = store.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
    prefix = path[: len(path) - len(root)] if path.endswith(root) else "file://"
    files = [(prefix + f.path, f.size) for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._"]
    return sorted(files)


def packed(files: list[tuple[str, int]], most: int = TOGETHER) -> list[Files]:
    """Small archives together, large ones alone."""
    out, held, size = [], [], 0
    for path, n in files:
        if held and size + n > most:
            out.append(Files(held))
            held, size = [], 0
        held.append(path)
        size += n
    return [*out, Files(held)] if held else out


def unpacked(raw: IO[bytes]) -> IO[bytes] | None:
    """The feed's bytes of one archive, spooled; None if it is damaged."""
    spool = tempfile.SpooledTemporaryFile(max_size=SPOOL)
    try:
        magic = raw.read(2)
        raw.seek(0)
        stream = gzip.GzipFile(fileobj=raw) if magic == GZIP_MAGIC else first_listing(zipfile.ZipFile(raw))
        shutil.copyfileobj(stream, spool, 1 << 20)
    except DAMAGED:
        spool.close()
        return None
    spool.seek(0)
    return spool


def line_batches(path: str, most: int = BATCH) -> Iterator[pa.RecordBatch]:
    """(file, pos, line) batches of one archive, of about ``most`` bytes."""
    store, name = located(path)
    with store.open_input_file(name) as raw:
        spool = unpacked(raw)
    if spool is None:
        return
    with spool:
        pos = 0
        while lines := spool.readlines(most):
            text = [x.decode("utf-8", errors="replace").rstrip("\r\n") for x in lines]
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(text)), pa.array(range(pos, pos + len(text)), pa.int64()), pa.array(text)], names=["file", "pos", "line"])
            pos += len(text)


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return packed(listing(self.path)) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            yield from line_batches(path)


class ArchiveSource(DataSource):
    """Option ``path``: the folder of the archives."""

    @classmethod
    def name(cls) -> str:
        return "feed_archives"

    def schema(self) -> str:
        return LINES_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options["path"])


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(file, pos, line) of all archives below a folder."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("feed_archives").load(folder)
