"""The event log: one total order over streams, latched reads, as-of joins, future values and timer rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import DAY_US, Even, scan

ORDER = ["key_us", "source", "seq"]


def collate(streams: list[DataFrame], keys: list[str], time: str = "ts_us", block_us: int | Even = 4096) -> DataFrame:
    """Union of streams with an order key that merges them by time and keeps each stream's own order.

    Streams have columns ``seq`` and ``time``; the result adds ``source`` (number of the stream) and ``key_us``, the
    running maximum of a stream's time (over blocks of ``block_us`` numbers), so a row that is late within its stream sorts with what came before it.
    Order the result by ORDER. Rows of missing columns are NULL.
    """
    numbered = [s.withColumn("source", F.lit(i)) for i, s in enumerate(streams)]
    log = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    return scan(log.withColumn("_seq", F.col("seq")), ["source", *keys], ["_seq"], {"key_us": ("max", F.col(time))}, block_us=block_us, levels=2).drop("_seq")


def latch(log: DataFrame, keys: list[str], columns: dict[str, tuple[Column, Column]], order: list[str] = ORDER, block_us: int = DAY_US) -> DataFrame:
    """Latest written value of each column: name -> (value, written).

    A value is wrapped in a struct where it is written, so one that is written as invalid (NULL) replaces an
    older valid one, while rows that don't write it leave it alone.
    """
    specs = {f"_latched_{n}": ("last", F.when(written, F.struct(value.alias("v")))) for n, (value, written) in columns.items()}
    held = scan(log, keys, order, specs, block_us=block_us)
    return held.withColumns({n: F.col(f"_latched_{n}")["v"] for n in columns}).drop(*specs)


def edge_triggered(value: Column, written: Column) -> Column:
    """A value that is valid only in the row that writes it."""
    return F.when(written, value)


def with_default(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], time: str = "ts_us", block_us: int = DAY_US) -> DataFrame:
    """``left`` with the ``columns`` of the last row of ``right`` at or before it (equal times count), by seq on ties."""
    probe = left.withColumns({"source": F.lit(1), "_left": F.struct(*left.columns)}).select(*keys, F.col(time).alias("key_us"), "source", "seq", "_left")
    data = right.select(*keys, F.col(time).alias("key_us"), F.lit(0).alias("source"), "seq", F.struct(*columns).alias("_right"))
    log = data.unionByName(probe, allowMissingColumns=True)
    found = scan(log, keys, ORDER, {"_held": ("last", F.col("_right"))}, block_us=block_us)
    return found.where("source = 1").select("_left.*", *[F.col(f"_held.{c}").alias(c) for c in columns])


def future_value(rows: DataFrame, series: DataFrame, keys: list[str], column: str, horizon_us: int, name: str, time: str = "ts_us", block_us: int = DAY_US) -> DataFrame:
    """``rows`` with the value that ``column`` of ``series`` has ``horizon_us`` later (last row at or before then).

    Rows whose horizon isn't passed by the end of the series are dropped.
    """
    ends = series.groupBy(*keys).agg(F.max(time).alias("_end"))
    due = rows.withColumn("_due", F.col(time) + F.lit(horizon_us))
    cond = [due[k].eqNullSafe(ends[k]) for k in keys]
    matured = due.join(ends, cond).where("_due < _end").select(due["*"]) if keys else due.crossJoin(F.broadcast(ends)).where("_due < _end").select(due["*"])
    renamed = series.select(*keys, F.col(time).alias("_due"), "seq", F.col(column).alias(name))
    return as_of(matured, renamed, keys, [name], time="_due", block_us=block_us).drop("_due")


def timer_rows(log: DataFrame, keys: list[str], step_us: int, time: str = "ts_us") -> DataFrame:
    """Grid times of each key: from its first event every ``step_us``, up to its last; ``k`` numbers them."""
    if step_us <= 0:
        raise ValueError("a timer needs a positive step")
    span = log.groupBy(*keys).agg(F.min(time).alias("first"), F.max(time).alias("last"))
    # Two levels, so that one key's long history isn't one array.
    blocks = span.withColumn("n", F.floor((F.col("last") - F.col("first")) / step_us)).withColumn("b", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 4096))))
    return blocks.withColumn("k", F.explode(F.sequence(F.col("b") * 4096, F.least(F.col("n"), F.col("b") * 4096 + 4095)))).select(*keys, F.col("k").cast("long").alias("k"), (F.col("first") + F.col("k") * step_us).alias("ts_us"))


def lift(call_at: Column, first_event: Column) -> Column:
    """Timers set before the first event fire at it."""
    return F.greatest(call_at, first_event)
