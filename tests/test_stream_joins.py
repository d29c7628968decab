"""Streaming latch, target and decay against their batch forms, rows in mixed order over many files."""

import random

import pytest

from tidemark.operators import decay, events
from tidemark.streaming import market as S
from tests.test_streaming import sink  # noqa: F401

SECOND = 1_000_000


@pytest.fixture(autouse=True)
def rocksdb(spark):
    pytest.importorskip("google.protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def rows_of(n, seed):
    rng = random.Random(seed)
    return [(rng.choice("xy"), rng.randrange(1, n // 2) * SECOND, k, rng.choice([None, float(rng.randrange(50))])) for k in range(n)]


SCHEMA = "sym string, ts_us long, seq long, price double"
END = [(s, 10_000 * SECOND, 10**6 + k, 0.0) for k, s in enumerate("xy")] + [(s, 10_001 * SECOND, 10**6 + 2 + k, 0.0) for k, s in enumerate("xy")]


def stream(spark, tmp_path, name, rows, files=4):
    """Each file's rows are in any order; files overlap by less than the watermark's delay."""
    path, rows = str(tmp_path / name), sorted(rows, key=lambda r: r[1] + random.Random(r[2]).randrange(20 * SECOND))
    size = -(-len(rows) // files)
    parts = [rows[k : k + size] for k in range(0, len(rows), size)] + [END[:2], END[2:]]
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return S.read_events(spark, path, spark.createDataFrame([], SCHEMA).schema)


def test_as_of_and_future_equal_batch(spark, tmp_path, sink):  # noqa: F811
    left, right = rows_of(120, 1), rows_of(160, 2)
    a, b = (spark.createDataFrame(r + END, SCHEMA) for r in (left, right))
    plain = lambda rows, c: {(r["sym"], r["ts_us"], r["seq"]): None if r[c] is None or r[c] != r[c] else r[c] for r in rows if r["ts_us"] < 5_000 * SECOND}
    live = S.as_of(stream(spark, tmp_path, "l", left), stream(spark, tmp_path, "r", right), ["price"], "60 seconds")
    want = plain(events.as_of(a.drop("price"), b, ["sym"], ["price"]).collect(), "price")
    assert plain(sink(live), "price") == want and len(want) == 120
    live = S.future_value(stream(spark, tmp_path, "l2", left), stream(spark, tmp_path, "r2", right), "price", 7 * SECOND, "60 seconds")
    want = plain(events.future_value(a.drop("price"), b, ["sym"], "price", 7 * SECOND, "future").collect(), "future")
    assert plain(sink(live), "future") == want and len(want) == 120


def test_ewma_equals_the_grid(spark, tmp_path, sink):  # noqa: F811
    rows = rows_of(100, 3)
    half_life = 30 * SECOND
    want = {}
    for r in decay.ewma(spark.createDataFrame(rows, SCHEMA), ["sym"], "price", half_life).collect():
        want[r["sym"], r["k"]] = (r["ts_us"], r["price"], r["ewma"])
    got = {}
    for r in sink(S.ewma(stream(spark, tmp_path, "e", rows), "price", half_life, "60 seconds")):
        got[r["sym"], r["k"]] = tuple(None if v is None or v != v else v for v in (r["ts_us"], r["signal"], r["ewma"]))
    assert set(want) <= set(got)
    for k, (ts, x, y) in want.items():
        assert got[k][:2] == (ts, x) and (y is None) == (got[k][2] is None) and (y is None or abs(y - got[k][2]) < 1e-9)
    # The timer went on where no row came, up to the watermark.
    assert max(r[0] for r in got.values()) > 5_000 * SECOND
