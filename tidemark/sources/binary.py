"""Market messages in the public FlatBuffers wire format: a trade or a depth update with its local time.

A table holds its fields' places in a vtable; a trade is a struct inside its table, a depth update a table of its
own with vectors of levels. Every place is checked against the message's end, so a damaged message is an error.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T

from tidemark.sources.market import DEPTH, TRADE

_TRADE, _LEVEL = struct.Struct("<ddq?7x"), struct.Struct("<dd")


def _get(kind: str, data: bytes, at: int):
    if at < 0 or at + struct.calcsize(kind) > len(data):
        raise ValueError("a message points past its end")
    return struct.unpack_from(kind, data, at)[0]


def _field(data: bytes, table: int, k: int) -> int | None:
    """Place of field ``k`` of the table, None where it is left out."""
    vtable = table - _get("<i", data, table)
    if 4 + 2 * k + 2 > _get("<H", data, vtable):
        return None
    offset = _get("<H", data, vtable + 4 + 2 * k)
    return table + offset if offset else None


def _follow(data: bytes, at: int) -> int:
    return at + _get("<I", data, at)


def _time(data: bytes, table: int, k: int) -> int:
    at = _field(data, table, k)
    return 0 if at is None else _get("<q", data, at)


def decode_trade(data: bytes) -> tuple[int, dict | None]:
    """(local_time_us, trade)."""
    root = _follow(data, 0)
    at = _field(data, root, 1)
    if at is None:
        return _time(data, root, 0), None
    if at + _TRADE.size > len(data):
        raise ValueError("a message points past its end")
    return _time(data, root, 0), dict(zip(TRADE.names, _TRADE.unpack_from(data, at)))


def _levels(data: bytes, table: int, k: int) -> list[dict]:
    at = _field(data, table, k)
    if at is None:
        return []
    at = _follow(data, at)
    n = _get("<I", data, at)
    if at + 4 + n * _LEVEL.size > len(data):
        raise ValueError("a message points past its end")
    return [{"price": p, "size": s} for p, s in _LEVEL.iter_unpack(data[at + 4 : at + 4 + n * _LEVEL.size])]


def decode_depth(data: bytes) -> tuple[int, dict | None]:
    """(local_time_us, depth update)."""
    root = _follow(data, 0)
    at = _field(data, root, 1)
    if at is None:
        return _time(data, root, 0), None
    update = _follow(data, at)
    return _time(data, root, 0), {"bids": _levels(data, update, 0), "asks": _levels(data, update, 1), "exchange_time_us": _time(data, update, 2)}


def encode_trade(local_time_us: int, price: float, size: float, exchange_time_us: int, buy: bool) -> bytes:
    head = struct.pack("<IHHHHi", 12, 8, 44, 4, 12, 8)
    return head + struct.pack("<q", local_time_us) + _TRADE.pack(price, size, exchange_time_us, buy)


def encode_depth(local_time_us: int, bids: Sequence[tuple[float, float]], asks: Sequence[tuple[float, float]], exchange_time_us: int) -> bytes:
    # The root: vtable at 4, table at 12, its time at 16, the place of the update at 24.
    root = struct.pack("<IHHHHiq", 12, 8, 16, 4, 12, 8, local_time_us)
    # The update: vtable at 28, table at 40 (bids 44, asks 48, time 56); vectors' lengths stand 4 before a multiple of 8.
    first, second = 68, 68 + 8 + _LEVEL.size * len(bids)
    update = struct.pack("<IHHHHHxxiII4xq", 40 - 24, 10, 24, 4, 8, 16, 40 - 28, first - 44, second - 48, exchange_time_us)
    pack = lambda levels: struct.pack("<I", len(levels)) + b"".join(_LEVEL.pack(*x) for x in levels)
    return root + update + bytes(4) + pack(bids) + bytes(4) + pack(asks)


_DECODERS = {"trade": (decode_trade, TRADE), "depth": (decode_depth, DEPTH)}


def decoded(frames: DataFrame, kind: str) -> DataFrame:
    """``frames`` (with a binary ``payload``) with local_time_us and the decoded ``kind`` (trade or depth) in its place."""
    decode, shape = _DECODERS[kind]
    kept = [f for f in frames.schema if f.name != "payload"]
    schema = T.StructType([*kept, T.StructField("local_time_us", T.LongType()), T.StructField(kind, shape)])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            found = [decode(x) for x in batch.column("payload").to_pylist()]
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([t for t, _ in found], pa.int64()), pa.array([m for _, m in found], arrow.field(kind).type)], schema=arrow)

    return frames.mapInArrow(run, schema)
