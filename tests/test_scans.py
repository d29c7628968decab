"""Running values in even blocks, in levels and with resets, against loops."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidemark.operators import decay, events, models, scan as S, trades
from tidemark.functions import numeric as N


def made(n, hot, seed=4):
    """Rows of three keys, most of one; a share ``hot`` of them at one instant."""
    rng, rows = random.Random(seed), []
    for seq in range(n):
        ts = 5_000 if rng.random() < hot else rng.randrange(10_000)
        rows.append((rng.choice("aaaaabc"), ts, seq, rng.choice([None, float(rng.randrange(-9, 9))]), rng.random() < 0.02))
    return rows


def loop(rows, resets):
    out, state = {}, {}
    for key, ts, seq, x, cut in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if resets and cut or key not in state:
            state[key] = {"sum": None, "count": 0, "min": None, "max": None, "last": None, "first": None, "lag": None}
        s = state[key]
        before = s.get("own")
        if x is not None:
            s["sum"] = x if s["sum"] is None else s["sum"] + x
            s["count"] += 1
            s["min"] = x if s["min"] is None else min(s["min"], x)
            s["max"] = x if s["max"] is None else max(s["max"], x)
            s["first"] = x if s["first"] is None else s["first"]
            s["last"] = x
        out[seq] = [s["sum"], s["count"], s["min"], s["max"], s["last"], s["first"], before]
        s["own"] = x
    return out


@pytest.mark.parametrize("resets", [False, True])
@pytest.mark.parametrize("blocks, fan, levels", [(10**9, 256, 1), (300, 256, 1), (40, 3, 4), (S.Even(40), 3, 1)])
def test_scan_equals_a_loop(spark, monkeypatch, resets, blocks, fan, levels):
    monkeypatch.setattr(S, "FAN", fan)
    rows = made(700, 0.4)
    df = spark.createDataFrame(rows, "key string, ts_us long, seq long, x double, cut boolean")
    kinds = ["sum", "count", "min", "max", "last", "first", "lag"]
    got = S.scan(df, ["key"], ["ts_us", "seq"], {k: (k, F.col("x")) for k in kinds}, block_us=blocks, resets=F.col("cut") if resets else None, levels=levels)
    assert {r["seq"]: [r[k] for k in kinds] for r in got.collect()} == loop(rows, resets)


def test_even_blocks_part_hot_keys_and_instants(spark):
    rows = made(6_000, 0.7)
    df = spark.createDataFrame(rows, "key string, ts_us long, seq long, x double, cut boolean")
    dealt, _ = S.blocks_of(df, ["key"], ["ts_us", "seq"], S.Even(200))
    sizes = Counter((r["key"], r["_block"]) for r in dealt.collect())
    assert max(sizes.values()) < 800 and len(sizes) > 20
    spans = defaultdict(list)
    for r in dealt.collect():
        spans[r["key"], r["_block"]].append((r["ts_us"], r["seq"]))
    for key in "abc":
        own = sorted((b, min(v), max(v)) for (k, b), v in spans.items() if k == key)
        assert all(x[2] < y[1] for x, y in zip(own, own[1:]))


def test_as_of_in_even_blocks(spark):
    rows = [r[:4] for r in made(400, 0.5)]
    df = spark.createDataFrame(rows, "key string, ts_us long, seq long, x double")
    right = df.where("seq % 3 = 0").withColumnRenamed("x", "y")
    want = sorted(map(tuple, events.as_of(df, right, ["key"], ["y"]).select("seq", "y").collect()))
    assert sorted(map(tuple, events.as_of(df, right, ["key"], ["y"], block_us=S.Even(30)).select("seq", "y").collect())) == want


def test_an_island_of_many_blocks_equals_a_loop(spark):
    """One tick of 100,000 trades among short ones: its windows are blocks, not the island."""
    import math

    rng, rows, ts = random.Random(2), [], 0
    for seq in range(101_000):
        ts += rng.randrange(1, 5) if 500 <= seq < 100_500 else rng.randrange(1, 400)
        buy = True if 500 <= seq < 100_500 else rng.random() < 0.5
        rows.append(("s", ts, seq, 100 + rng.randrange(-40, 40) / 8, float(rng.randrange(1, 4)) / 1024, buy, None if seq % 50 == 7 else 100.0))
    df = spark.createDataFrame(rows, "sym string, ts_us long, seq long, price double, size double, buy boolean, fair double")
    made_ = trades.tick_islands(df, ["sym"], 300, 10_000, block_us=20_000)
    got = {r["seq"]: r for r in trades.tick_impulse(made_, ["sym"], 1e-5, 2.0, block_us=20_000).collect()}
    island, was, longest, here = 0, None, 0, 0
    for sym, ts, seq, price, size, buy, fair in rows:
        if was is None or buy != was[0] or ts - was[1] > 300:
            island, ps, deep, running, here = island + 1, 0.0, price, None, 0
        ps, deep, was, here = ps + price * size, (min if buy else max)(deep, price), (buy, ts), here + 1
        longest = max(longest, here)
        if fair is not None:
            running = (1 if buy else -1) * (1 - math.exp(-1e-5 * ps)) * math.exp(-max(-3.0, 2.0 * (-1 if buy else 1) * (deep / fair - 1)))
        r = got[seq]
        assert r["island"] == island and (r["running"] is None) == (running is None)
        assert running is None or abs(r["running"] - running) <= 1e-9
    assert longest >= 100_000


@pytest.mark.parametrize("weight, initial", [(0.29, 1.0), (0.1, 0.3), (3.0, 10.0), (1.0, 1.0), (0.007, 12.5)])
def test_bucket_takes_decimals_exactly(spark, weight, initial):
    df = spark.range(3000).selectExpr("'s' as sym", "id as ts_us", "id as seq")
    got = {r["seq"] for r in trades.bucket_sample(df, ["sym"], weight, initial).where("should_sample").collect()}
    w, b, level, want = Fraction(str(weight)), Fraction(str(initial)), Fraction(str(initial)), set()
    for k in range(3000):
        level -= w
        if level <= 0:
            level += b
            want.add(k)
    assert got == want
    assert weight != 0.29 or 99 in got


def test_decay_forgets_nothing_early(spark):
    """A grid with hardly any decay, far longer than a block."""
    n = 4 * decay.BLOCK + 77
    grid = spark.range(n).selectExpr("'s' as sym", "id as k", "1.0D as x")
    got = {r["k"]: r["y"] for r in decay.decayed_sum(grid, ["sym"], F.col("x"), 1.0 - 1e-9, "y").collect()}
    y = 0.0
    for k in range(n):
        y = y * (1.0 - 1e-9) + 1
        assert abs(got[k] - y) <= 1e-9 * y


def test_staged_models_equal_nested_ones(spark):
    df = spark.range(50).selectExpr("id", "id - 20.5D as a", "cast(id % 7 as double) as b", "if(id % 9 = 0, null, id / 3D) as c", "1 as _let0")
    make = lambda: {"y": models.cascade([F.col(x) for x in "abc"], lambda n: F.lit(len(n) / 50.0)), "z": N.add(*models.small_mlp([F.col("a"), F.col("b")], lambda n: F.lit(0.1 + len(n) / 60.0)))}
    staged = models.staged(df, make)
    assert staged.columns == [*df.columns, "y", "z"]
    want = df.select(*df.columns, *[v.alias(k) for k, v in make().items()])
    for x, y in zip(sorted(map(tuple, staged.collect())), sorted(map(tuple, want.collect()))):
        assert x == pytest.approx(y, nan_ok=True) if None not in x else [a is None for a in x] == [b is None for b in y]
