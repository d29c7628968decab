"""Small helpers of the event log, instruments and units."""

import os
from pyspark.sql import functions as F

from tidemark.functions import market as M
from tidemark.operators import events
from tidemark.sources import market


def test_edges_and_timers(spark):
    df = spark.createDataFrame([(1, True, 5), (2, False, 30)], "a long, written boolean, call_at long")
    got = df.select(events.edge_triggered(F.col("a"), F.col("written")).alias("edge"), events.lift(F.col("call_at"), F.lit(20)).alias("at")).collect()
    assert [tuple(r) for r in got] == [(1, 20), (None, 30)]


def test_instruments_are_numbered_by_first_appearance(spark):
    rows = [("x", "b", 9, 0, 1), ("x", "a", 5, 0, 2), ("y", "a", 5, 0, 1), ("x", "b", 1, 1, 7), ("x", "a", 50, 0, 0)]
    got = {(r["exchange"], r["symbol"]): r["tid"] for r in market.symbology(spark.createDataFrame(rows, "exchange string, symbol string, key_us long, source int, seq long")).collect()}
    assert got == {("x", "b"): 0, ("y", "a"): 1, ("x", "a"): 2}


def test_units_and_fields(spark):
    df = spark.createDataFrame([(1_500_000, '{"a": {"b": "7"}}')], "us long, message string")
    r = df.select(F.unix_micros(M.us_to_timestamp(F.col("us"))).alias("t"), M.json_field(F.col("message"), "$.a.b").alias("b")).first()
    assert tuple(r) == (1_500_000, "7")


def test_a_scope_deletes_its_own_tables_only(spark):
    from tidemark.sources import scratch

    kept = scratch.materialize(spark.range(3), "kept")
    with scratch.scope(spark):
        inner = scratch.materialize(spark.range(4), "inner")
        assert inner.count() == 4
        path = scratch._made[-1].removeprefix("file://")
    assert kept.count() == 3 and not os.path.exists(path)
