"""Binary messages and dropped files."""

import gzip
import json
import random
import tracemalloc

import pytest

from tidemark.sources import binary, inbox, market
from tidemark.sources import frames as frame_source


def test_binary_messages_come_back(spark, tmp_path):
    r = random.Random(1)
    trades = [(k, r.random(), r.random(), k * 7, r.random() < 0.5) for k in range(50)]
    depths = [(k, [(r.random(), r.random()) for _ in range(r.randrange(4))], [(r.random(), r.random()) for _ in range(r.randrange(4))], -k) for k in range(50)]
    for name, rows, encode in (("t", trades, binary.encode_trade), ("d", depths, binary.encode_depth)):
        market.write_frames([encode(*x) for x in rows], str(tmp_path / f"{name}.md.gz"))
    read = lambda name, kind: sorted((x["local_time_us"], x[kind]) for x in binary.decoded(market.read_frames(spark, str(tmp_path / f"{name}.md.gz")), kind).collect())
    assert [(t, *m) for t, m in read("t", "trade")] == trades
    got = [(t, [tuple(x) for x in m["bids"]], [tuple(x) for x in m["asks"]], m["exchange_time_us"]) for t, m in read("d", "depth")]
    assert got == depths


def test_damaged_messages_are_errors():
    whole = binary.encode_depth(1, [(1.0, 2.0)], [(3.0, 4.0)], 5)
    for n in range(len(whole)):
        with pytest.raises(ValueError):
            binary.decode_depth(whole[:n])
    trade = binary.encode_trade(1, 2.0, 3.0, 4, True)
    for n in range(len(trade)):
        with pytest.raises(ValueError):
            binary.decode_trade(trade[:n])


def test_dropped_files_become_streams(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    for symbol, n in (("btcusdt", 3), ("ethusdt", 2)):
        with gzip.open(box / f"binance_trade_{symbol}_2024-01-02.json.gz", "wt") as f:
            for k in range(n):
                f.write(json.dumps({"local_time_us": 10 * k, "message": {"T": k, "p": f"{k}.5", "q": "2", "m": k % 2 == 0}}) + "\n")
    (box / "notes.json").write_text("{}\n")
    place = str(tmp_path / "streams")
    land = lambda: inbox.land(spark, str(box), place, "binance", "single_trades")
    times = lambda: sorted((x["symbol"], x["local_time_us"], x["trade"]["price"], x["trade"]["exchange_time_us"], x["trade"]["buy"]) for x in inbox.landed(spark, place, "binance", "single_trades").collect())
    land()
    want = [("btcusdt", 0, 0.5, 0, False), ("btcusdt", 10, 1.5, 1000, True), ("btcusdt", 20, 2.5, 2000, False), ("ethusdt", 0, 0.5, 0, False), ("ethusdt", 10, 1.5, 1000, True)]
    assert times() == want
    land()  # nothing new
    assert times() == want
    with gzip.open(box / "binance_trade_ethusdt_2024-01-03.json.gz", "wt") as f:
        f.write(json.dumps({"local_time_us": 30, "message": {"T": 9, "p": "9.5", "q": "2", "m": True}}) + "\n")
    land()
    commits = sorted((tmp_path / "streams" / "_checkpoints" / "binance-single_trades" / "commits").glob("[0-9]*"))
    for name in (commits[-1].name, f".{commits[-1].name}.crc"):  # as if the call had been cut off before it noted that the batch is done
        (commits[-1].parent / name).unlink(missing_ok=True)
    land()
    assert times() == [*want, ("ethusdt", 30, 9.5, 9000, False)]
    config = market.StreamConfig("2024-01-02", (market.Stream("single_trades", "btcusdt", "binance"),))
    got = market.read_streams(spark, f"{place}/binance-single_trades", config, inbox.landed(spark, place, "binance", "single_trades").schema)
    assert [x["local_time_us"] for x in got.orderBy("local_time_us").collect()] == [0, 10, 20]


def test_frames_are_planned_from_the_config(spark, tmp_path):
    streams = [market.Stream("single_trades", s, "binance") for s in ("a", "b")]
    for s in streams:
        market.write_frames([f"{s.symbol}{k}".encode() for k in range(25_000)], str(tmp_path / market.file_name(s, "2024-01-02")))
    (tmp_path / market.file_name(streams[0], "2024-01-03")).write_bytes(b"no gzip: opening it is an error")
    config = market.StreamConfig("2024-01-02", tuple(streams))
    df = frame_source.read_frame_streams(spark, str(tmp_path), config)
    assert df.rdd.getNumPartitions() == 2 and df.count() == 50_000
    rows = df.where("symbol = 'b' and seq >= 24998").orderBy("seq").collect()
    assert [(x["seq"], bytes(x["payload"]), x["date"]) for x in rows] == [(24_998, b"b24998", "2024-01-02"), (24_999, b"b24999", "2024-01-02")]
    key = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(key, "true")
    try:
        (tmp_path / market.file_name(streams[0], "2024-01-02")).write_bytes(b"not to be opened either")
        df = frame_source.read_frame_streams(spark, str(tmp_path), config)
        assert df.where("symbol = 'b' and exchange in ('binance', 'other')").count() == 25_000
        assert df.where("symbol = 'c'").count() == 0
    finally:
        spark.conf.unset(key)
    with pytest.raises(Exception):
        frame_source.read_frame_streams(spark, str(tmp_path), config).count()


def test_a_long_frame_file_is_read_in_bounded_memory(tmp_path):
    stream = market.Stream("depth", "x", "binance")
    market.write_frames((bytes(50_000) for _ in range(4_000)), str(tmp_path / market.file_name(stream, "2024-01-02")))  # 200 MB
    reader = frame_source.FrameReader({"config": market.StreamConfig("2024-01-02", (stream,)).to_json(), "path": str(tmp_path)})
    tracemalloc.start()
    assert sum(b.num_rows for b in reader.read(reader.partitions()[0])) == 4_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
