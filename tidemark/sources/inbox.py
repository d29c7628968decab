"""Landing of recorded raw messages: files dropped into a folder become partitioned streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.market import CATEGORIES, PARTITIONS, normalize

#: exchange_category_symbol_date, as the recorder names its files; the category is a short name.
NAME = rf"^(.+?)_({'|'.join(CATEGORIES.values())})_(.+)_(\d{{4}}-\d{{2}}-\d{{2}})\.json"


def _named(lines: DataFrame) -> DataFrame:
    return lines.select("value", F.col("_metadata.file_name").alias("file"))


def _messages(lines: DataFrame) -> DataFrame:
    lines = lines.select("value", "file", F.monotonically_increasing_id().alias("seq"))
    part = lambda k: F.regexp_extract("file", NAME, k)
    category = part(2)
    for name, short in CATEGORIES.items():
        category = F.when(part(2) == short, F.lit(name)).otherwise(category)
    fields = [F.get_json_object("value", "$.local_time_us").cast("long").alias("local_time_us"), F.get_json_object("value", "$.message").alias("message")]
    return lines.where(F.col("file").rlike(NAME)).select("seq", *fields, category.alias("category"), part(1).alias("exchange"), part(3).alias("symbol"), part(4).alias("date"))


def raw_messages(spark: SparkSession, path: str) -> DataFrame:
    """Lines {"local_time_us": ..., "message": {...}} of the JSON files (gzipped or not) at ``path``, with the stream that
    each file's name tells; ``seq`` numbers a file's lines in order. Files of other names are left alone."""
    return _messages(_named(spark.read.text(path)))


def land(spark: SparkSession, inbox: str, path: str, exchange: str, category: str) -> None:
    """Normalise the dropped messages of an exchange's category and add them to the streams at ``path``, each file once.

    Files that an earlier call has landed are left alone, and a call that was cut off is repeated without doubling rows: the
    files are a stream whose checkpoint (below ``path``) knows what is read, and a batch has a folder of its own, which
    it overwrites when it runs again. Read the result with ``landed``.
    """
    place = _folder(path, exchange, category)

    def write(batch: DataFrame, number: int) -> None:
        raw = _messages(batch).where((F.col("exchange") == exchange) & (F.col("category") == category))
        normalize(raw, exchange, category).write.mode("overwrite").partitionBy(*PARTITIONS).option("compression", "snappy").parquet(f"{place}/batch={number}")

    lines = _named(spark.readStream.format("text").load(inbox))
    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/_checkpoints/{exchange}-{category}")
    writer.trigger(availableNow=True).start().awaitTermination()


def _folder(path: str, exchange: str, category: str) -> str:
    return f"{path}/{exchange}-{category}"


def landed(spark: SparkSession, path: str, exchange: str, category: str) -> DataFrame:
    """The streams that ``land`` has written. Conditions on symbol and date leave out their directories."""
    return spark.read.parquet(_folder(path, exchange, category)).drop("batch")
