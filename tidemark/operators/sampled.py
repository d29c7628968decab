"""Aggregates over sampling periods, and whole-column summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import DAY_US, Even, scan

UNIT_US = 10_000


def sampled(rows: DataFrame, keys: list[str], value: str, period_us: int, order: list[str] = ["ts_us", "seq"], block_us: int = DAY_US) -> DataFrame:
    """One row for each key and period with messages: n, mean, min, max, sum.

    * mean: of the values weighted by how long each held, in UNIT_US units, over the intervals that end in the
      period; invalid if a value in the period or one of those intervals' values is;
    * min and max: of the period's values and the one carried into it;
    * sum: of the period's values, invalid if one of them is.
    """
    before = scan(rows, keys, order, {"_was": ("lag", F.struct(F.col(value).alias("v"), F.col("ts_us").alias("t")))}, block_us=block_us)
    return _aggregates(before, [*keys, (F.floor(F.col("ts_us") / period_us) * period_us).alias("period_us")], value)


def sampled_between(rows: DataFrame, resets: DataFrame, keys: list[str], value: str, block_us: int | Even = DAY_US) -> DataFrame:
    """The same for periods that the rows of another stream, ``resets`` (keys, ts_us, seq), begin: keys, period (0 before the
    first reset), start_us (of the reset; NULL for period 0), n, mean, min, max, sum.

    A row at the time of a reset belongs to the period that it begins. Values are carried over resets, as over any border.
    """
    order = ["ts_us", "_source", "seq"]
    cuts = resets.select(*keys, "ts_us", "seq").withColumn("_source", F.lit(0))
    log = rows.select(*keys, "ts_us", "seq", value).withColumn("_source", F.lit(1)).unionByName(cuts, allowMissingColumns=True)
    placed = scan(log, keys, order, {
        "period": ("sum", (F.col("_source") == 0).cast("long")),
        "start_us": ("last", F.when(F.col("_source") == 0, F.col("ts_us"))),
    }, block_us=block_us)
    was, own = F.struct(F.col(value).alias("v"), F.col("ts_us").alias("t")), placed.where("_source = 1")
    before = scan(own, keys, ["ts_us", "seq"], {"_was": ("lag", was)}, block_us=block_us)
    return _aggregates(before, [*keys, "period", "start_us"], value)


def _aggregates(before: DataFrame, period: list, value: str) -> DataFrame:
    v, was = F.col(value), F.col("_was.v")
    length = F.floor((F.col("ts_us") - F.col("_was.t")) / UNIT_US)
    poisoned = F.max((v.isNull() | (F.col("_was").isNotNull() & was.isNull())).cast("int")) == 1
    weight = F.sum(length)
    return before.groupBy(*period).agg(
        F.count("*").alias("n"),
        F.when(~poisoned & (weight > 0), F.sum(was * length) / F.when(weight > 0, weight)).alias("mean"),
        F.min(F.least(v, was)).alias("min"),
        F.max(F.greatest(v, was)).alias("max"),
        F.when(F.max(v.isNull().cast("int")) == 0, F.sum(v)).alias("sum"),
    )


def summarize(df: DataFrame, columns: list[str]) -> dict[str, tuple[float | None, float]]:
    """(mean, deviation) of each column; the deviation is unbiased, 1 for up to one value. One aggregate."""
    out = df.agg(*[f for c in columns for f in (F.avg(c).alias(f"m_{c}"), F.when(F.count(c) > 1, F.stddev_samp(c)).otherwise(F.lit(1.0)).alias(f"s_{c}"))]).first()
    return {c: (out[f"m_{c}"], out[f"s_{c}"]) for c in columns}


def goodness(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """One row: n, mse, r2."""
    error = F.col(predicted) - F.col(actual)
    return df.agg(F.count(error).alias("n"), F.avg(error * error).alias("mse"), (F.lit(1.0) - F.sum(error * error) / (F.var_pop(actual) * F.count(actual))).alias("r2"))
