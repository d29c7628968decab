"""Trade and depth streams derived from the ``events`` table, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_US = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), F.expr(_US).alias("ts_us"), "user_id", "event_type", "value")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ts_us, sym, price, size, buy."""
    return events(spark, sf_dir).where("event_type in ('purchase', 'click')").selectExpr("seq", "ts_us", "concat('s', cast(user_id % 3 as string)) as sym", "100 + ((seq * 7919) % 41 - 20) * cast(0.05 as double) as price", "value as size", "event_type = 'purchase' as buy")


def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ts_us, sym, side (B, S), price, size: one level a message, size 0 deletes."""
    bid = "(event_type = 'view' or (event_type = 'error' and seq % 2 = 0))"
    return events(spark, sf_dir).where("event_type in ('view', 'signup', 'error')").selectExpr("seq", "ts_us", "concat('s', cast(user_id % 3 as string)) as sym", f"case when {bid} then 'B' else 'S' end as side", f"100 + (case when {bid} then -1 else 1 end) * (1 + (seq * 31) % 8) * cast(0.5 as double) as price", "case when event_type = 'error' then cast(0 as double) else value end as size")


_BID = "(event_type = 'view' or (event_type = 'error' and event_id % 2 = 0))"
#: The same as DuckDB common table expressions ``trades`` and ``depth``.
SQL = f"""trades as (
  select event_id as seq, epoch_us(ts) as ts_us, concat('s', cast(user_id % 3 as varchar)) as sym,
    100 + ((event_id * 7919) % 41 - 20) * cast(0.05 as double) as price, value as size, event_type = 'purchase' as buy
  from events where event_type in ('purchase', 'click')
), depth as (
  select event_id as seq, epoch_us(ts) as ts_us, concat('s', cast(user_id % 3 as varchar)) as sym,
    case when {_BID} then 'B' else 'S' end as side,
    100 + (case when {_BID} then -1 else 1 end) * (1 + (event_id * 31) % 8) * cast(0.5 as double) as price,
    case when event_type = 'error' then cast(0 as double) else value end as size
  from events where event_type in ('view', 'signup', 'error')
)"""
