"""Column functions on quotes, sides and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import numeric as N


def bbo_mid(bbo: Column) -> Column:
    return F.lit(0.5) * (bbo["bid"]["price"] + bbo["ask"]["price"])


def bbo_wmid(bbo: Column) -> Column:
    """Mid weighted by the size on the other side."""
    bid, ask = bbo["bid"], bbo["ask"]
    return N.div(bid["price"] * ask["size"] + ask["price"] * bid["size"], bid["size"] + ask["size"])


def bbo_bid_price(bbo: Column) -> Column:
    return bbo["bid"]["price"]


def bbo_ask_price(bbo: Column) -> Column:
    return bbo["ask"]["price"]


def other_side(buy: Column) -> Column:
    return ~buy


def deeper(buy: Column, a: Column, b: Column) -> Column:
    """Whether ``a`` is deeper in the side's book than ``b``: lower for buys, higher for sells."""
    return F.when(buy, N.lt(a, b)).when(~buy, N.gt(a, b))


def deepest(buy: Column, a: Column, b: Column) -> Column:
    return F.when(buy, N.minimum(a, b)).when(~buy, N.maximum(a, b))


def more_aggressive(buy: Column, a: Column, b: Column) -> Column:
    return F.when(buy, N.gt(a, b)).when(~buy, N.lt(a, b))


def most_aggressive(buy: Column, a: Column, b: Column) -> Column:
    return F.when(buy, N.maximum(a, b)).when(~buy, N.minimum(a, b))


def flip_sign_if_buy(buy: Column, x: Column) -> Column:
    return F.when(buy, -x).when(~buy, x)


def ms_to_us(x: Column) -> Column:
    return x.cast("long") * 1000


def us_to_ns(x: Column) -> Column:
    return x.cast("long") * 1000


def ns_to_us(x: Column) -> Column:
    return F.floor(x / 1000).cast("long")


def us_to_timestamp(x: Column) -> Column:
    return F.timestamp_micros(x)


def number(x: Column) -> Column:
    """A numeric string; what isn't a finite number is invalid."""
    return N.finite(x.try_cast("double"))


def json_field(message: Column, path: str) -> Column:
    return F.get_json_object(message, path)
