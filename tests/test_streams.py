import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import book, decay, events, sampled, trades
from tidemark.operators.scan import scan
from tidemark.sources import market


def collated(spark, *sources):
    frames = [spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(s)], "seq long, ts_us long, tag long") for s in sources]
    log = events.collate(frames, [])
    return [(r["ts_us"], r["tag"]) for r in log.orderBy(*events.ORDER).collect()]


@pytest.mark.parametrize("sources, want", [
    ([[(1, 2), (2, 3)]], [(1, 2), (2, 3)]),
    ([[(2, 3), (1, 2)]], [(2, 3), (1, 2)]),
    ([[(1, 2), (2, 3)], [(0, 2), (4, 3)]], [(0, 2), (1, 2), (2, 3), (4, 3)]),
    ([[(1, 2), (2, 3)], [(4, 2), (0, 3)]], [(1, 2), (2, 3), (4, 2), (0, 3)]),
    ([[(1, 2), (2, 3), (5, 6)], [(0, 2), (4, 3)]], [(0, 2), (1, 2), (2, 3), (4, 3), (5, 6)]),
    ([[(1, 2), (2, 3)], [(0, 1), (4, 2), (0, 3)]], [(0, 1), (1, 2), (2, 3), (4, 2), (0, 3)]),
])
def test_collation(spark, sources, want):
    assert collated(spark, *sources) == want


def random_log(n=300, seed=0):
    r, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += r.choice([0, 1, 7, 40])
        out.append((i, t, r.choice("xy"), r.choice([None, r.randint(-5, 5) * 1.0])))
    return out


def test_scan_equals_a_loop(spark):
    rows = random_log()
    df = spark.createDataFrame(rows, "seq long, ts_us long, sym string, v double")
    got = {x["seq"]: x for x in scan(df, ["sym"], ["ts_us", "seq"], {"s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "last": ("last", F.col("v")), "was": ("lag", F.col("v")), "n": ("count", F.col("v"))}, block_us=50).collect()}
    state = {}
    for i, _, sym, v in rows:
        st = state.setdefault(sym, {"s": None, "lo": None, "last": None, "n": 0, "prev": None})
        was = st["prev"]
        if v is not None:
            st |= {"s": (st["s"] or 0) + v, "lo": v if st["lo"] is None else min(st["lo"], v), "last": v, "n": st["n"] + 1}
        st["prev"] = v
        assert (got[i]["s"], got[i]["lo"], got[i]["last"], got[i]["was"], got[i]["n"]) == (st["s"], st["lo"], st["last"], was, st["n"])


def test_latching_tells_invalid_from_unwritten(spark):
    rows = [(0, 1, 1.0, 2.0, None), (1, 2, None, None, 5.0), (2, 3, 3.0, 2.0, None)]
    df = spark.createDataFrame(rows, "seq long, key_us long, a double, b double, c double").withColumn("source", F.lit(0))
    held = events.latch(df, [], {"la": (F.col("a"), F.col("a").isNotNull()), "lb": (F.col("b"), F.col("b").isNotNull()), "lc": (F.col("c"), F.col("c").isNotNull())})
    assert [r[0] for r in held.orderBy("seq").select(F.col("la") + F.col("lb") + F.col("lc")).collect()] == [None, 8.0, 10.0]
    wiped = events.latch(df, [], {"la": (F.when(F.col("seq") != 1, F.col("a")), F.lit(True))})
    assert [r[0] for r in wiped.orderBy("seq").select("la").collect()] == [1.0, None, 3.0]


def test_as_of_and_future(spark):
    data = spark.createDataFrame([(0, 10, "x", 1.0), (1, 20, "x", 2.0), (2, 20, "x", 3.0), (3, 35, "x", None), (4, 50, "x", 5.0)], "seq long, ts_us long, sym string, v double")
    probe = spark.createDataFrame([(0, 5, "x"), (1, 20, "x"), (2, 40, "x"), (3, 60, "y")], "seq long, ts_us long, sym string")
    assert {r["seq"]: r["v"] for r in events.as_of(probe, data, ["sym"], ["v"], block_us=7).collect()} == {0: None, 1: 3.0, 2: None, 3: None}
    got = events.future_value(data.select("seq", "ts_us", "sym"), data, ["sym"], "v", 10, "f", block_us=7).collect()
    assert {r["seq"]: r["f"] for r in got} == {0: 3.0, 1: 3.0, 2: 3.0, 3: None}


def test_timer_grid(spark):
    log = spark.createDataFrame([("x", 100), ("x", 131)], "sym string, ts_us long")
    assert sorted((r["k"], r["ts_us"]) for r in events.timer_rows(log, ["sym"], 10).collect()) == [(0, 100), (1, 110), (2, 120), (3, 130)]
    with pytest.raises(ValueError):
        events.timer_rows(log, ["sym"], 0)


T2 = [("B", 0.5, 5.9), ("B", 0.3, 3.4), ("S", 1.0, 10.0), ("S", 0.9, 11.1)]
CASES = {
    "bid only": ([("B", 1.0, 10.0)], [(1.0, 10.0)], []),
    "both": ([("B", 0.5, 5.9), ("S", 1.0, 10.0)], [(0.5, 5.9)], [(1.0, 10.0)]),
    "two levels": (T2, [(0.5, 5.9), (0.3, 3.4)], [(0.9, 11.1), (1.0, 10.0)]),
    "replace": ([*T2, ("B", 0.5, 6.1), ("S", 0.9, 3.2)], [(0.5, 6.1), (0.3, 3.4)], [(0.9, 3.2), (1.0, 10.0)]),
    "delete": ([*T2, ("B", 0.5, 0.0), ("S", 0.9, 0.0)], [(0.3, 3.4)], [(1.0, 10.0)]),
    "empty side": ([*T2, ("B", 0.5, 0.0), ("B", 0.3, 0.0)], [], [(0.9, 11.1), (1.0, 10.0)]),
    "unknown": ([("B", 0.5, 0.0), ("S", 1.0, 2.0)], [], [(1.0, 2.0)]),
}


def test_books(spark):
    rows = [(name, k, k * 10, s, p, q) for name, (ms, _, _) in CASES.items() for k, (s, p, q) in enumerate(ms)]
    df = spark.createDataFrame(rows, "sym string, seq long, ts_us long, side string, price double, size double")
    last = {}
    for r in book.snapshots(df, ["sym"], block_us=15).orderBy("seq").collect():
        last[r["sym"]] = r
    for name, (ms, bids, asks) in CASES.items():
        r = last[name]
        assert r["seq"] == len(ms) - 1
        assert [tuple(x) for x in r["bids"]] == bids and [tuple(x) for x in r["asks"]] == asks, name
    quotes = {r["sym"]: r["q"] for r in book.snapshots(df, ["sym"]).withColumn("q", book.bbo(F.col("bids"), F.col("asks"))).orderBy("seq").collect()}
    assert quotes["empty side"] is None and quotes["both"]["bid"]["price"] == 0.5
    ups = book.level_updates(df.where("sym in ('replace', 'unknown')"), ["sym"]).orderBy("sym", "seq").collect()
    assert [(r["sym"], r["price"], r["previous_size"], r["size"]) for r in ups][4:] == [("replace", 0.5, 5.9, 6.1), ("replace", 0.9, 11.1, 3.2), ("unknown", 1.0, 0.0, 2.0)]


def test_fair_equals_the_whole_book(spark):
    r, rows, sizes = random.Random(4), [], {}
    want = []
    for k in range(200):
        side = r.choice("BS")
        price = 100 + (-1 if side == "B" else 1) * r.randint(1, 6) * 0.5
        size = r.choice([0.0, 1.0, 2.5, 7.0])
        unknown = size == 0 and not sizes.get((side, price))
        sizes[side, price] = size
        rows.append(("x", k, k * 5, side, price, size))
        if not unknown:
            of = lambda s: [(p, q) for (z, p), q in sizes.items() if z == s and q > 0]
            want.append((k, book.linear_impulse_fair(of("B"), of("S"), 0.3, 100.0)))
    df = spark.createDataFrame(rows, "sym string, seq long, ts_us long, side string, price double, size double")
    ups = book.level_updates(df, ["sym"], block_us=70)
    for reference in (100.0, 97.0):
        got = {x["seq"]: x["fair"] for x in book.book_fair(ups, ["sym"], 0.3, reference, block_us=70).collect()}
        assert len(got) == len(want)
        for k, v in want:
            assert (got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-6)


@pytest.mark.parametrize("scale", [0.1, 1.0, 2.0])
@pytest.mark.parametrize("width, bias", [(1.0, 0.0), (1.0, -0.5), (0.5, 1.0)])
def test_fair_of_one_level_a_side(scale, width, bias):
    mid = 10.0
    fair = book.linear_impulse_fair([(mid - width, 1.0)], [(mid + width, 1.0 + bias)], scale, 0.0)
    assert abs(fair - (mid - math.log(1 + bias) / (2 * scale))) < 2e-4


def greedy(levels, ratio, n):
    groups = [[levels[0][0], levels[0][1], levels[0][0] * levels[0][1]]]
    for p, s in levels[1:]:
        g = groups[-1]
        if len(groups) > 1 and abs(p / g[0] - 1) <= ratio:
            g[1] += s
            g[2] += p * s
        elif len(groups) < n:
            groups.append([p, s, p * s])
    return [(ps / s, s) for _, s, ps in groups]


def test_level_groups(spark):
    r = random.Random(1)
    rows = [(sorted({round(100 - r.random() * 5, 2): 1.0 + r.random() for _ in range(r.randint(1, 12))}.items(), reverse=True),) for _ in range(20)]
    df = spark.createDataFrame([([{"price": p, "size": s} for p, s in ls],) for (ls,) in rows], f"levels {book.LEVELS}")
    got = df.select(book.aggregate_levels(F.col("levels"), 0.01, 4).alias("g")).collect()
    for (ls,), x in zip(rows, got):
        assert [pytest.approx(t) for t in greedy(ls, 0.01, 4)] == [tuple(y) for y in x["g"]]
    assert spark.createDataFrame([([],)], f"levels {book.LEVELS}").select(book.aggregate_levels(F.col("levels"), 0.01, 4)).first()[0] is None


def test_ticks_equal_a_loop(spark):
    r, t, rows = random.Random(2), 0, []
    for i in range(150):
        t += r.choice([1, 2, 30, 300])
        rows.append((i, t, "x", 100.0 + r.randint(-5, 5), r.random(), r.random() < 0.5, None if r.random() < 0.1 else 100.0 + r.random()))
    df = spark.createDataFrame(rows, "seq long, ts_us long, sym string, price double, size double, buy boolean, fair double")
    made = trades.tick_impulse(trades.tick_islands(df, ["sym"], 100, 10_000, block_us=64), ["sym"], 1e-3, 50.0)
    got = {x["seq"]: x for x in made.collect()}
    island, prev, ends = 0, None, {}
    for i, ts, _, p, q, buy, fair in rows:
        if prev is None or buy != prev[0] or ts - prev[1] > 100:
            island, ps, deepest, running = island + 1, 0.0, p, None
        prev = (buy, ts)
        ps += p * q
        deepest = min(deepest, p) if buy else max(deepest, p)
        if fair is not None:
            running = (1 if buy else -1) * (1 - math.exp(-1e-3 * ps)) * math.exp(-max(-3, 50.0 * (-1 if buy else 1) * (deepest / fair - 1)))
        assert got[i]["island"] == island
        assert got[i]["running"] == (None if running is None else pytest.approx(running, rel=1e-9))
        ends[island] = running
    emitted = {x["island"]: x["tick"] for x in trades.tick_emit(made, ["sym"]).collect()}
    assert emitted == {k: (None if v is None else pytest.approx(v, rel=1e-9)) for k, v in ends.items() if k < island}


@pytest.mark.parametrize("w, init", [(1.0, 10.0), (3.0, 10.0), (0.5, 4.0), (10.0, 10.0)])
def test_bucket_sampler(spark, w, init):
    df = spark.range(200).selectExpr("id as seq", "id * 3 as ts_us", "'x' as sym")
    got = {r["seq"] for r in trades.bucket_sample(df, ["sym"], w, init, block_us=50).where("should_sample").collect()}
    weight, want = init, set()
    for i in range(200):
        weight -= w
        if weight <= 1e-12:
            want.add(i)
            weight += init
    assert got == want


def test_decay_equals_the_recursion(spark):
    half = 20 * 30
    r = random.Random(5)
    rows, t = [], 0
    for i in range(400):
        t += r.randint(1, 120)
        rows.append((i, t, "x", r.random() if r.random() > 0.02 else None))
    log = spark.createDataFrame(rows, "seq long, ts_us long, sym string, v double")
    d, step = decay.factor(half), decay.step_us(half)
    got = {x["k"]: x["running_sum"] for x in decay.running_sum(log, log.where("v is not null"), ["sym"], "v", half).collect()}
    average = {x["k"]: x["ewma"] for x in decay.ewma(log, ["sym"], "v", half, block_us=1000).collect()}
    t0, y, e, at, read = rows[0][1], 0.0, None, 0, 0
    signal = None
    for k in range((rows[-1][1] - t0) // step + 1):
        now = t0 + k * step
        y *= d
        while at < len(rows) and rows[at][1] <= now:
            y += rows[at][3] or 0.0
            at += 1
        while read < len(rows) and rows[read][1] < now:
            signal = rows[read][3]
            read += 1
        e = None if signal is None else signal if e is None else d * e + (1 - d) * signal
        assert got[k] == pytest.approx(y, rel=1e-9, abs=1e-9)
        assert average[k] == (None if e is None else pytest.approx(e, rel=1e-9))
    with pytest.raises(ValueError):
        decay.step_us(10)


def test_mixed_decay_equals_the_recursion(spark):
    r = random.Random(6)
    rows = [("x", n, r.choice([1.0, 0.98, 0.5]), r.random()) for n in range(300)]
    got = {x["n"]: x["y"] for x in decay.running_sum_mixed(spark.createDataFrame(rows, "sym string, n long, f double, c double"), ["sym"], ["n"], F.col("f"), F.col("c"), "y", block=16).collect()}
    y = 0.0
    for _, n, f, c in rows:
        y = y * f + c
        assert got[n] == pytest.approx(y, rel=1e-9)


def test_sampling_periods(spark):
    rows = [(0, 0, "x", 1.0), (1, 50_000, "x", 3.0), (2, 120_000, "x", None), (3, 150_000, "x", 2.0), (4, 210_000, "x", 5.0), (5, 230_000, "x", 4.0)]
    got = {r["period_us"]: r for r in sampled.sampled(spark.createDataFrame(rows, "seq long, ts_us long, sym string, v double"), ["sym"], "v", 100_000).collect()}
    assert (got[0]["mean"], got[0]["min"], got[0]["max"], got[0]["sum"]) == (1.0, 1.0, 3.0, 4.0)
    assert (got[100_000]["mean"], got[100_000]["min"], got[100_000]["sum"]) == (None, 2.0, None)
    assert (got[200_000]["mean"], got[200_000]["min"], got[200_000]["max"]) == ((2.0 * 6 + 5.0 * 2) / 8, 2.0, 5.0)


def test_sources(spark, tmp_path):
    raw = spark.createDataFrame([(5, 0, '{"T": 7, "p": "1.5", "q": "2", "m": true}')], market.RAW)
    assert market.normalize(raw, "binance", "single_trades").first()["trade"].asDict() == {"price": 1.5, "size": 2.0, "exchange_time_us": 7000, "buy": False}
    raw = spark.createDataFrame([(5, 0, '{"E": 7, "b": [["1", "2"], ["1", "3"]], "a": []}')], market.RAW)
    deep = market.normalize(raw, "binance", "depth").select("seq", "depth.bids", "depth.asks")
    assert [(r["side"], r["price"], r["size"], r["sub"]) for r in book.explode_messages(deep).collect()] == [("B", 1.0, 2.0, 0), ("B", 1.0, 3.0, 1)]
    with pytest.raises(ValueError):
        market.normalize(raw, "nowhere", "depth")
    config = market.StreamConfig.from_json('{"date": "2024-01-02", "streams": [{"category": "depth", "symbol": "abc", "exchange": "ex"}]}')
    assert market.StreamConfig.from_json(config.to_json()) == config
    assert market.file_name(config.streams[0], config.date) == "ex_depth_abc_2024-01-02.md.gz"
    with pytest.raises(ValueError):
        market.Stream("quotes", "a", "b")
    path = str(tmp_path / "streams")
    rows = spark.createDataFrame([("depth", "ex", "abc", "2024-01-02", 1), ("depth", "ex", "abc", "2024-01-03", 2), ("depth", "ex", "other", "2024-01-02", 3)], "category string, exchange string, symbol string, date string, v int")
    market.write_streams(rows, path)
    read = market.read_streams(spark, path, config, rows.schema)
    assert [r["v"] for r in read.collect()] == [1]
    assert "PartitionFilters: [" in read._jdf.queryExecution().toString()


def test_frames(spark, tmp_path):
    path = str(tmp_path / "a.md.gz")
    market.write_frames([b"one", b"", b"x" * 100_000], path)
    assert [(r["seq"], bytes(r["payload"])) for r in market.read_frames(spark, path).orderBy("seq").collect()] == [(0, b"one"), (1, b""), (2, b"x" * 100_000)]
    import io

    for block in (1, 3, 1000):
        data = b"\3\0\0\0abc\1\0\0\0z"
        assert list(market.frames(io.BytesIO(data), block)) == [b"abc", b"z"]
        with pytest.raises(ValueError):
            list(market.frames(io.BytesIO(data[:-1]), block))


def test_samples_and_numbers(spark, tmp_path):
    config = market.SampleConfig.from_json('{"outputs": ["a::out"], "target_output": "t", "sample_on": "s", "ms_future": 2000}')
    df = spark.createDataFrame([(float(i), 1.0, 2.0 if i != 3 else None, 1000 - i) for i in range(20)], "`a::out` double, target double, target_future double, ts_us long")
    path = str(tmp_path / "samples")
    market.write_samples(df, config, path)
    read = market.read_samples(spark, path, config, skip=4).orderBy("n").collect()
    assert [r["n"] for r in read] == list(range(15)) and read[0]["a::out"] == 15.0
    with pytest.raises(ValueError):
        market.read_samples(spark, path, market.SampleConfig(["b"], "t", "s", 1))


def test_rows_at_one_time_are_numbered_by_their_ties(spark):
    df = spark.createDataFrame([(k, 10 * (k // 6)) for k in range(60)], "seq long, ts_us long")
    for block in (1, 7, 1000):
        got = market.number_rows(df.repartition(5), F.col("ts_us"), ties=["seq"], block_us=block).collect()
        assert all(r["n"] == r["seq"] for r in got) and len(got) == 60


def test_samples_at_one_time_keep_the_order_of_the_file(spark, tmp_path):
    config, path = market.SampleConfig(["a"], "t", "s", 1), str(tmp_path / "tied")
    df = spark.createDataFrame([(float(k), 1.0, 2.0, 1_000_000) for k in range(50)], "a double, target double, target_future double, ts_us long")
    market.write_samples(df.coalesce(1), config, path)
    assert [r["a"] for r in market.read_samples(spark, path, config, skip=3).orderBy("n").collect()] == [float(k) for k in range(3, 50)]


@pytest.mark.parametrize("w, init, least", [(3.0, 7.0, 2.0), (5.0, 2.0, 0.5), (0.3, 1.0, 0.1), (1.0, 10.0, 10.0), (2.5, 2.5, 1.0)])
def test_bucket_with_a_least_level(spark, w, init, least):
    level, want = init, set()
    for k in range(200):
        if k % 7:
            level = round(level - w, 9)
        if level <= 0:
            level = round(level + init, 9)
            want.add(k)
        level = max(least, level)
    df = spark.createDataFrame([("a", k, k, k % 7 != 0) for k in range(200)], "sym string, ts_us long, seq long, ok boolean")
    got = {r["seq"] for r in trades.bucket_sample(df, ["sym"], w, init, F.col("ok"), block_us=50, least=least).where("should_sample").collect()}
    assert got == want
