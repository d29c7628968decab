"""Market-data sources and sinks: schemas, message normalisers, stream selection, frames, samples, training scans."""

from __future__ import annotations

import gzip
import json
import struct
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import market as M
from tidemark.operators.scan import scan

#: Microseconds of a block in which rows are put in order.
HOUR_US = 3_600_000_000

LEVEL = T.StructType([T.StructField("price", T.DoubleType()), T.StructField("size", T.DoubleType())])
TRADE = T.StructType([T.StructField("price", T.DoubleType()), T.StructField("size", T.DoubleType()), T.StructField("exchange_time_us", T.LongType()), T.StructField("buy", T.BooleanType())])
DEPTH = T.StructType([T.StructField("bids", T.ArrayType(LEVEL)), T.StructField("asks", T.ArrayType(LEVEL)), T.StructField("exchange_time_us", T.LongType())])
QUOTE = T.StructType([T.StructField("bid", LEVEL), T.StructField("ask", LEVEL), T.StructField("exchange_time_us", T.LongType())])
#: A raw message: the time it was received and its JSON text.
RAW = T.StructType([T.StructField("local_time_us", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("message", T.StringType())])


def trade_messages(raw: DataFrame) -> DataFrame:
    """JSON trades (T ms, p, q strings, m: the buyer was the maker) as rows with a TRADE struct."""
    m = F.from_json("message", "T long, p string, q string, m boolean")
    return raw.withColumn("_m", m).select(*raw.columns, F.struct(M.number(F.col("_m.p")).alias("price"), M.number(F.col("_m.q")).alias("size"), M.ms_to_us(F.col("_m.T")).alias("exchange_time_us"), (~F.col("_m.m")).alias("buy")).alias("trade")).drop("message")


def depth_messages(raw: DataFrame) -> DataFrame:
    """JSON depth updates (E ms, b and a arrays of [price, size] strings) as rows with a DEPTH struct."""
    m = F.from_json("message", "E long, b array<array<string>>, a array<array<string>>")
    level = lambda x: F.struct(M.number(F.get(x, F.lit(0))).alias("price"), M.number(F.get(x, F.lit(1))).alias("size"))
    return raw.withColumn("_m", m).select(*raw.columns, F.struct(F.transform("_m.b", level).alias("bids"), F.transform("_m.a", level).alias("asks"), M.ms_to_us(F.col("_m.E")).alias("exchange_time_us")).alias("depth")).drop("message")


#: (exchange, category) -> DataFrame -> DataFrame.
NORMALIZERS: dict[tuple[str, str], Callable[[DataFrame], DataFrame]] = {("binance", "single_trades"): trade_messages, ("binance", "depth"): depth_messages}


def normalize(raw: DataFrame, exchange: str, category: str) -> DataFrame:
    try:
        return NORMALIZERS[exchange, category](raw)
    except KeyError:
        raise ValueError(f"no normaliser for {category} of {exchange}") from None


CATEGORIES = {"single_trades": "trade", "depth": "depth"}


@dataclass(frozen=True)
class Stream:
    category: str
    symbol: str
    exchange: str

    def __post_init__(self):
        if self.category not in CATEGORIES:
            raise ValueError(f"unknown category {self.category}")


@dataclass(frozen=True)
class StreamConfig:
    """Which streams of which day to read."""

    date: str
    streams: tuple[Stream, ...]

    @classmethod
    def from_json(cls, text: str) -> StreamConfig:
        d = json.loads(text)
        return cls(d["date"], tuple(Stream(**s) for s in d["streams"]))

    def to_json(self) -> str:
        return json.dumps({"date": self.date, "streams": [asdict(s) for s in self.streams]})


def file_name(stream: Stream, date: str) -> str:
    return f"{stream.exchange}_{CATEGORIES[stream.category]}_{stream.symbol}_{date}.md.gz"


PARTITIONS = ["category", "exchange", "symbol", "date"]


def write_streams(df: DataFrame, path: str) -> None:
    """Parquet below ``path``, partitioned so that a stream and day is one directory."""
    df.write.partitionBy(*PARTITIONS).option("compression", "snappy").mode("append").parquet(path)


def read_streams(spark: SparkSession, path: str, config: StreamConfig, schema: T.StructType) -> DataFrame:
    """The configured streams; only their directories are listed and read."""
    chosen = F.lit(False)
    for s in config.streams:
        chosen = chosen | ((F.col("category") == s.category) & (F.col("exchange") == s.exchange) & (F.col("symbol") == s.symbol))
    return spark.read.schema(schema).parquet(path).where((F.col("date") == config.date) & chosen)


def symbology(df: DataFrame) -> DataFrame:
    """(exchange, symbol, tid): dense numbers in order of first appearance (``key_us``, ``source``, ``seq``)."""
    first = df.groupBy("exchange", "symbol").agg(F.min(F.struct("key_us", "source", "seq")).alias("first"))
    # One row for each instrument: small enough for one window.
    return first.select("exchange", "symbol", (F.row_number().over(Window.orderBy("first", "exchange", "symbol")) - 1).alias("tid"))


# Length-prefixed frames: 4 bytes little-endian length, payload, the whole gzipped.
def write_frames(payloads, path: str) -> None:
    with gzip.open(path, "wb") as f:
        for p in payloads:
            f.write(struct.pack("<I", len(p)) + p)


def frames(stream, block: int = 1 << 20) -> Iterator[bytes]:
    """Payloads of an open binary stream, holding one block and one frame; a truncated frame is an error."""
    held = b""
    while True:
        while len(held) < 4 or len(held) < 4 + struct.unpack_from("<I", held)[0]:
            more = stream.read(block)
            if not more:
                if held:
                    raise ValueError("the last frame is cut short")
                return
            held += more
        at = 0
        while len(held) - at >= 4 and len(held) - at - 4 >= (n := struct.unpack_from("<I", held, at)[0]):
            yield held[at + 4 : at + 4 + n]
            at += 4 + n
        held = held[at:]


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """path, seq, payload of gzipped frame files; Spark's reader opens them, one task a file."""
    import io

    import pandas as pd

    def split(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                rows = []
                with gzip.GzipFile(fileobj=io.BytesIO(content)) as f:
                    for k, payload in enumerate(frames(f)):
                        rows.append((name, k, payload))
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=["path", "seq", "payload"])
                            rows = []
                yield pd.DataFrame(rows, columns=["path", "seq", "payload"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(split, "path string, seq long, payload binary")


#: Rows of a row group of samples.
GROUP_ROWS = 65_536


@dataclass
class SampleConfig:
    """What to sample: graph outputs, target, the flag that samples, the horizon."""

    outputs: list[str]
    target_output: str
    sample_on: str
    ms_future: int
    extra: dict = field(default_factory=dict)

    @classmethod
    def from_json(cls, text: str) -> SampleConfig:
        d = json.loads(text)
        return cls(d["outputs"], d["target_output"], d["sample_on"], int(d["ms_future"]))

    def to_json(self) -> str:
        return json.dumps({k: v for k, v in asdict(self).items() if k != "extra"})


def write_samples(rows: DataFrame, config: SampleConfig, path: str, time: str = "ts_us") -> None:
    """Sample rows as Parquet: the outputs as doubles, target, target_future, time (timestamp of microseconds), in row groups of
    at most GROUP_ROWS rows.

    Rows in which one of these is invalid are left out, as the columns are required ones.
    """
    numbers = [*config.outputs, "target", "target_future"]
    kept = rows.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in numbers], F.timestamp_micros(F.col(time)).alias("time"))
    valid = [F.col("time").isNotNull(), *(F.col(f"`{c}`").isNotNull() & ~F.isnan(f"`{c}`") for c in numbers)]
    kept = kept.where(reduce(lambda a, b: a & b, valid))
    # What can't be NULL becomes a required column.
    kept = kept.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(c) for c in numbers], F.coalesce("time", F.timestamp_micros(F.lit(0))).alias("time"))
    spark = rows.sparkSession
    before = spark.conf.get("spark.sql.parquet.outputTimestampType")
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    try:
        writer = kept.write.option("compression", "snappy").option("parquet.writer.version", "v2").option("parquet.block.row.count.limit", GROUP_ROWS)
        writer.parquet(path)
    finally:
        spark.conf.set("spark.sql.parquet.outputTimestampType", before)


def read_samples(spark: SparkSession, path: str, config: SampleConfig, skip: int = 1000) -> DataFrame:
    """Training rows in time order (equal times in the order of the files) without the first ``skip``; ``n`` numbers
    the rest from 0."""
    df = spark.read.parquet(path)
    wanted = [*config.outputs, "target", "target_future", "time"]
    if df.columns != wanted:
        raise ValueError(f"the columns are {df.columns}, not {wanted}")
    placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place")).na.drop()
    return number_rows(placed, F.unix_micros("time"), ties=["_file", "_place"]).where(F.col("n") >= skip).withColumn("n", F.col("n") - skip).drop("_file", "_place")


def number_rows(df: DataFrame, time_us: Column, name: str = "n", ties: Sequence[str] = (), block_us: int = HOUR_US) -> DataFrame:
    """Dense numbers in order of time, then of the columns ``ties`` (what is left of ties: by a hash of all columns),
    without a window over all rows in one task: rows are ordered within blocks of time, and counts of the blocks
    before are added."""
    timed = df.withColumn("_t", time_us).withColumn("_id", F.xxhash64(*df.columns))
    return scan(timed.withColumn("_all", F.lit(0)), ["_all"], ["_t", *ties, "_id"], {name: ("count", F.lit(1))}, block_us=block_us).withColumn(name, F.col(name) - 1).drop("_t", "_id", "_all")

