"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Folders that new_folder has named.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    A session on a local master may lack the setting (tests): a folder is made once and stored in the session. On a
    cluster a folder of one machine would lose or split data, so there the setting is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the scratch tables that this process has written (but for the first ``since``); frames that still read
    them can't be used any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    while len(_made) > since:
        path = hadoop.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scope(spark: SparkSession):
    """Deletes the scratch tables that are written within it, and only those, when it is left. It gives a function like
    :func:`materialize` for tables that stay; these belong to the scope around it."""
    since, stay = len(_made), []

    def keep(df: DataFrame, label: str) -> DataFrame:
        out = materialize(df, label)
        stay.append(_made.pop())
        return out

    try:
        yield keep
    finally:
        release(spark, since)
        _made.extend(stay)


def new_folder(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/tidemark-{label}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
