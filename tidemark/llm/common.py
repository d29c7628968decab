"""Helpers shared by the training-data operators: scratch tables, Arrow maps, bitmaps."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.sources.scratch import materialize, new_folder, scope  # noqa: F401

#: Rows and payload bytes handed to a Python function at once.
SLICE_ROWS, SLICE_BYTES = 1000, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame) -> DataFrame:
    """``row``, a number for each row of ``df``, and ``given``, a struct of all its columns, which no name clashes with.
    Numbers stay the same once the result is materialised."""
    return df.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("given"))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no piece holds over SLICE_ROWS rows or (one row aside) SLICE_BYTES bytes."""
    n = batch.num_rows
    if not n:
        return
    per_row = max(1, batch.nbytes // n)
    step = max(1, min(SLICE_ROWS, SLICE_BYTES // per_row))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def arrow_map(df: DataFrame, make: Callable[[], Callable], schema: T.StructType | str) -> DataFrame:
    """mapInArrow over small slices.

    ``make()`` runs once a task and returns ``f(*columns as lists) -> list of output columns``.
    """
    spark_schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    arrow = to_arrow_schema(spark_schema)

    def run(batches):
        f = make()
        for batch in batches:
            for part in slices(batch):
                out = f(*[c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, arrow)], schema=arrow)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, spark_schema)


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand texts to Python in batches of SLICE_ROWS: its default of 10,000 rows costs each task several
    copies of tens of MB on either side."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > SLICE_ROWS:
        spark.conf.set(key, SLICE_ROWS)


def batch_map(df: DataFrame, make: Callable[[], Callable]) -> DataFrame:
    """``df`` with each small RecordBatch replaced by what ``make()`` returns for it; the columns stay the same."""

    def run(batches):
        f = make()
        for batch in batches:
            for part in slices(batch):
                yield f(part)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)


#: A key in over HOT rows, and in more than one of MOST_HOT of them, is joined in SALTS parts.
HOT, MOST_HOT, SALTS = 5000, 100_000, 64


def is_hot(total: int, n: str = "n") -> F.Column:
    """Whether ``n`` is over HOT and over one of MOST_HOT of ``total``, the sum of all ``n`` or more."""
    return F.col(n) > max(HOT, total // MOST_HOT)


def hot_keys(counts: DataFrame, total: int, n: str = "n") -> DataFrame:
    """The rows of ``counts`` with :func:`is_hot`: fewer than MOST_HOT, which may be broadcast."""
    return counts.where(is_hot(total, n))


def any_hot(counts: DataFrame, total: int, n: str = "n") -> DataFrame | None:
    """:func:`hot_keys`, or None where ``total`` is too small for any: then joins are plain, which spares the driver plans."""
    return hot_keys(counts, total, n) if total > HOT else None


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], hot: DataFrame | None, spread, how: str = "inner", known=None) -> DataFrame:
    """``many`` joined with ``few``, which has each key once or a few times.

    The rows of ``many`` with a key of ``hot`` (of :func:`hot_keys`) are dealt over SALTS tasks by the LONG ``spread``,
    and those of ``few`` go to each of these; without ``hot`` the join is plain. ``spread`` must be the same when a task is
    run again: a hash of columns, or row numbers of a frame read from files. Null keys meet nothing, and neither side may
    have columns _hot or _salt.
    ``known`` is a condition that holds for the rows of ``few`` with a key of ``hot``, where its columns tell.
    """
    if hot is None:
        return many.join(few, keys, how)
    marked = F.broadcast(hot.select(*keys, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(spread, F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    salts = F.when(F.col("_hot") if known is None else known, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = many.join(marked, keys, "left").withColumn("_salt", salt).drop("_hot")
    given = (few.join(marked, keys, "left") if known is None else few).withColumn("_salt", F.explode(salts)).drop("_hot")
    return dealt.join(given, [*keys, "_salt"], how).drop("_salt")


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


#: Bytes of a text that are split into words at once.
WINDOW = 1 << 20
_WHITE = re.compile(rb"[\x20\x09-\x0d]")


def words_of(data: bytes) -> Iterator[list[bytes]]:
    """The maximal runs without ASCII white space (tab to carriage return, space), window by window."""
    at = 0
    while len(data) - at > WINDOW:
        end = _WHITE.search(data, at + WINDOW)
        if end is None:
            break
        yield data[at : end.start()].split()
        at = end.start()
    yield data[at:].split()


#: A hash bitmap has BITS_A_KEY bits for each key up to 2^MOST_LOG2 bits (32 MiB), which bounds what is sent to the
#: driver (twice that) and to the executors. With more keys it fills and rules out less.
BITS_A_KEY, LEAST_LOG2, MOST_LOG2 = 16, 16, 28


def hash_bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """Bloom filter of a LONG column of hashes (null ones left out), as words of 64 bits.

    A key sets two bits, named by its low and by its high digits. Both set may be a false positive, one clear never a
    false negative, so users confirm hits with an equality join.
    """
    known = keys.select(F.col(column).alias("key")).where("key is not null")
    log2 = min(MOST_LOG2, max(LEAST_LOG2, (known.count() * BITS_A_KEY).bit_length()))
    slots = F.array(F.col("key").bitwiseAND((1 << log2) - 1), F.shiftrightunsigned("key", 64 - log2))
    words = (
        known.select(F.explode(slots).alias("slot"))
        .select(F.shiftright("slot", 6).alias("w"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
    )
    bits = np.zeros(1 << (log2 - 6), np.uint64)
    got = words.toArrow()
    if got.num_rows:
        bits[got["w"].to_numpy()] = got["b"].to_numpy().astype(np.int64).view(np.uint64)
    return bits


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the int64/uint64 keys may be in the bitmap."""
    keys = keys.astype(np.uint64, copy=False)
    size = len(bits) * 64

    def is_set(slot):
        return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1

    return is_set(keys & np.uint64(size - 1)) & is_set(keys >> np.uint64(65 - size.bit_length()))


def held_out(doc_id) -> F.Column:
    """crc32 of the id's text modulo 4 is 2 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2
