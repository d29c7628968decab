"""Recorded streams (gzipped, length-prefixed frames) as a data source, a task for each stream.

``spark.read.format("tidemark_frames")`` takes the folder and the stream config as options. Files are planned from the
config, by the names that the recorder gives them: no folder is listed, and files of other streams and days aren't
opened. With ``spark.sql.python.filterPushdown.enabled`` conditions on exchange, symbol, category and date leave out
files as well. A file is unzipped in blocks, so a task holds one block, one frame and one batch of the result, however
long the file is. Files are opened by pyarrow's file systems, at any address that those know.
"""

from __future__ import annotations

import gzip
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from tidemark.sources.market import Stream, StreamConfig, file_name, frames

SCHEMA = "category string, exchange string, symbol string, date string, seq long, payload binary"
#: Bytes read at once, and payload bytes (and frames) in one batch of the result.
BLOCK, BATCH_BYTES, BATCH_ROWS = 1 << 20, 4 << 20, 10_000


@dataclass
class _File(InputPartition):
    path: str
    stream: Stream
    date: str

    def value(self, column: str) -> str:
        return self.date if column == "date" else getattr(self.stream, column)


def _opened(path: str):
    from pyarrow import fs

    system, inner = (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)
    return system.open_input_stream(inner, compression=None)


class FrameReader(DataSourceReader):
    def __init__(self, options):
        config = StreamConfig.from_json(options["config"])
        self.files = [_File(os.path.join(options["path"], file_name(s, config.date)), s, config.date) for s in config.streams]

    def partitions(self) -> list[_File]:
        return self.files

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a config without streams
            return
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        fixed = [partition.value(c) for c in names[:4]]
        done, held, size = 0, [], 0

        def batch():
            n = len(held)
            return pa.RecordBatch.from_arrays([*[pa.array([v] * n, pa.string()) for v in fixed], pa.array(range(done, done + n), pa.int64()), pa.array(held, pa.binary())], names)

        with _opened(partition.path) as raw, gzip.GzipFile(fileobj=raw) as stream:
            for payload in frames(stream, BLOCK):
                held.append(payload)
                size += len(payload)
                if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                    yield batch()
                    done, held, size = done + len(held), [], 0
        if held:
            yield batch()


class PrunedReader(FrameReader):
    """Leaves out files by conditions on what is the same in all of a file."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column not in ("category", "exchange", "symbol", "date"):
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.files = [x for x in self.files if x.value(column) in values]


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PrunedReader(self.options) if self.options.get("pushdown") == "true" else FrameReader(self.options)


def read_frame_streams(spark: SparkSession, folder: str, config: StreamConfig) -> DataFrame:
    """category, exchange, symbol, date, seq, payload of the configured streams' files in a folder."""
    spark.dataSource.register(FrameSource)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("tidemark_frames").option("config", config.to_json()).option("pushdown", pushdown).load(folder)
