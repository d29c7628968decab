import random

import pytest

from tidemark.operators import book
from tidemark.streaming import market as S


@pytest.fixture
def sink(spark, tmp_path):
    def run(df, mode="append"):
        name = f"t{random.getrandbits(40)}"
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return spark.table(name).collect()

    return run


def stream(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    half = len(rows) // 2
    for k, part in enumerate((rows[:half], rows[half:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return S.read_events(spark, path, spark.createDataFrame([], schema).schema)


def test_sessions_and_periods(spark, tmp_path, sink):
    second = 1_000_000
    rows = [(i, t * second, "x", 10.0, 2.0, b) for i, (t, b) in enumerate([(1, True), (2, True), (3, False), (30, True), (31, True), (100_000, True)])]
    schema = "seq long, ts_us long, sym string, price double, size double, buy boolean"
    got = sink(S.ticks(stream(spark, tmp_path, rows, schema), "10 seconds"))
    assert sorted((r["buy"], r["n"]) for r in got) == [(False, 1), (True, 2), (True, 2)]
    got = sink(S.periods(S.read_events(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), "price", "10 seconds"))
    assert sorted(r["n"] for r in got) == [2, 3]
    got = sink(S.periods(S.read_events(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), "price", "10 seconds", slide="5 seconds"))
    assert len(got) == 4


def test_keyed_state(spark, tmp_path, sink):
    pytest.importorskip("google.protobuf")
    r = random.Random(3)
    rows = [(i, i * 10, r.choice("xy"), r.choice("BS"), 0.0, r.choice([0.0, 1.0, 2.0])) for i in range(80)]
    rows = [(i, t, s, side, 100 + (-1 if side == "B" else 1) * r.randint(1, 4) * 0.5, q) for i, t, s, side, _, q in rows]
    schema = "seq long, ts_us long, sym string, side string, price double, size double"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        live = stream(spark, tmp_path, rows, schema)
        got = {x["seq"]: (x["bid"], x["ask"]) for x in sink(S.best_quotes(live))}
        snaps = book.snapshots(spark.createDataFrame(rows, schema), ["sym"], 1).collect()
        want = {x["seq"]: (x["bids"][0]["price"], x["asks"][0]["price"]) if x["bids"] and x["asks"] else (None, None) for x in snaps}
        assert {k: tuple(None if v is None or v != v else v for v in q) for k, q in got.items()} == want
        sampled = sink(S.count_sample(S.read_events(spark, str(tmp_path / "in"), live.schema), 5))
        assert len(sampled) == sum(sum(x[2] == s for x in rows) // 5 for s in "xy")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_ticks_end_on_idle_without_another_message(spark, tmp_path, sink):
    pytest.importorskip("google.protobuf")
    second = 1_000_000
    rows = [(0, 1, "x", True), (1, 2, "x", True), (2, 3, "x", False), (3, 4, "y", True), (4, 9, "y", True), (5, 100, "z", True), (6, 101, "z", True)]
    rows = [(i, t * second, s, 10.0, 2.0, b) for i, t, s, b in rows]
    schema = "seq long, ts_us long, sym string, price double, size double, buy boolean"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        path = str(tmp_path / "in")
        for part in (rows[:5], rows[5:6], rows[6:]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        live = S.read_events(spark, path, spark.createDataFrame([], schema).schema)
        got = sorted((r["sym"], r["start_us"] // second, r["stop_us"] // second, r["n"], r["buy"]) for r in sink(S.idle_ticks(live, 4 * second, "10 seconds")))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    # No trade of x or y follows their last runs: the timers end them. z's run is still open.
    assert got == [("x", 1, 2, 2, True), ("x", 3, 3, 1, False), ("y", 4, 4, 1, True), ("y", 9, 9, 1, True)]
