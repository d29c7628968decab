"""Trade operators: ticks (runs of one-sided trades), their impulse, and count-based sampling."""

from __future__ import annotations

from fractions import Fraction
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import market as M
from tidemark.functions import numeric as N
from tidemark.operators.scan import DAY_US, Even, islands, scan

ORDER = ["ts_us", "seq"]


def tick_islands(trades: DataFrame, keys: list[str], gap_us: int, idle_us: int, block_us: int = DAY_US) -> DataFrame:
    """Adds ``island``, and ``begins``, true on its first trade: a new one where the side changes, the time gap is over ``gap_us`` or at least ``idle_us``."""
    before = scan(trades, keys, ORDER, {"_was": ("lag", F.struct("buy", "ts_us"))}, block_us=block_us)
    gap = F.col("ts_us") - F.col("_was.ts_us")
    starts = F.col("_was").isNull() | ~F.col("buy").eqNullSafe(F.col("_was.buy")) | (gap > gap_us) | (gap >= idle_us)
    return islands(before.withColumn("begins", starts), keys, ORDER, F.col("begins"), block_us=block_us).drop("_was")


def tick_impulse(ticks: DataFrame, keys: list[str], size_weight: float, distance_weight: float, block_us: int | Even = DAY_US) -> DataFrame:
    """Adds ``running``: the impulse of the tick so far after each trade (needs begins, as ``tick_islands`` adds it, and
    the latched fair).

    With an invalid fair the impulse stays what it was in the tick. A tick longer than a block is summed over several.
    """
    begins, price = F.col("begins"), F.col("price")
    sums = {"_ps": ("sum", price * F.col("size")), "_low": ("min", price), "_high": ("max", price)}
    rows = scan(ticks, keys, ORDER, sums, block_us=block_us, resets=begins)
    deepest = F.when(F.col("buy"), F.col("_low")).when(~F.col("buy"), F.col("_high"))
    score = M.flip_sign_if_buy(~F.col("buy"), F.lit(1.0) - F.exp(-size_weight * F.col("_ps")))
    signed = F.when(F.col("buy"), F.lit(-1.0)).otherwise(F.lit(1.0)) * (N.div(deepest, F.col("fair")) - 1)
    impulse = score * F.exp(-N.maximum(F.lit(-3.0), distance_weight * signed))
    valid = rows.withColumn("_impulse", impulse).drop(*sums)
    return scan(valid, keys, ORDER, {"running": ("last", F.col("_impulse"))}, block_us=block_us, resets=begins).drop("_impulse")


def tick_emit(impulses: DataFrame, keys: list[str]) -> DataFrame:
    """The final impulse of each tick, at the trade that begins the next one: keys, island, ts_us, seq, tick."""
    ends = impulses.groupBy(*keys, "island").agg(F.max_by("running", F.struct(*ORDER)).alias("tick"), F.min(F.struct(*ORDER)).alias("_first"))
    begins = ends.select(*keys, (F.col("island") - 1).alias("island"), F.col("_first.ts_us").alias("ts_us"), F.col("_first.seq").alias("seq"))
    a, b = ends.select(*keys, "island", "tick").alias("a"), begins.alias("b")
    same = F.col("a.island") == F.col("b.island")
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same).select(*[F.col(f"a.{k}") for k in keys], "a.island", "b.ts_us", "b.seq", "a.tick")


#: Steps after which a bucket's levels must have come round.
MOST_LEVELS = 10_000


def bucket_pattern(weight: float, initial: float, least: float) -> tuple[list[int], int, int]:
    """(places that sample, first place that comes round, period) of a bucket's levels after its valid trades.

    The level begins at ``initial``; each trade takes ``weight``, a level of 0 or less is filled by ``initial`` and
    samples, and a level below ``least`` is raised to it. It depends on nothing but the number of trades, and takes
    finitely many values (sums of the three numbers, as decimals, within bounds), so it comes round.
    """
    w, full, low = (Fraction(str(x)) for x in (weight, initial, least))
    level, seen, places = full, {}, []
    for k in range(MOST_LEVELS):
        if level in seen:
            return places, seen[level], k - seen[level]
        seen[level] = k
        level -= w
        if level <= 0:
            level += full
            places.append(k)
        level = max(low, level)
    raise ValueError(f"the bucket takes over {MOST_LEVELS} levels: use rounder numbers")


def bucket_sample(trades: DataFrame, keys: list[str], weight: float = 1.0, initial: float = 10.0, valid: Column | None = None, block_us: int = DAY_US, least: float | None = None) -> DataFrame:
    """Adds ``should_sample``: true each time the weights of valid trades have emptied a bucket of ``initial``.

    Without a ``least`` level the weight may be at most the bucket. With one (over 0) it may be any: a trade that takes
    more than the bucket holds samples once, and the level starts again from ``least`` if nothing is left.
    """
    if weight <= 0 or initial <= 0 or (weight > initial if least is None else not 0 < least <= initial):
        raise ValueError("the weight must be over 0 and at most the bucket, or the least level over 0 and at most the bucket")
    valid = F.lit(True) if valid is None else valid
    counted = scan(trades, keys, ORDER, {"_n": ("sum", F.when(valid, F.lit(1)).otherwise(F.lit(0)).cast("long"))}, block_us=block_us)
    if least is None:
        # As whole numbers: trade n samples where n * weight passes a multiple of the bucket.
        w, bucket = Fraction(str(weight)), Fraction(str(initial))
        w, bucket = w.numerator * bucket.denominator, bucket.numerator * w.denominator
        shared = gcd(w, bucket)
        w, bucket = (F.lit(x // shared).cast("decimal(38,0)") for x in (w, bucket))
        filled = F.expr("cast(_n as decimal(19,0))") * w % bucket  # what of the last bucket is used after the trade
        full = filled < w
    else:
        places, first, period = bucket_pattern(weight, initial, least)
        at = F.col("_n") - 1
        round_ = F.when(at >= first, (at - first) % period + first).otherwise(at)
        full = F.array_contains(F.array(*map(F.lit, places)), round_.cast("int")) if places else F.lit(False)
    return counted.withColumn("should_sample", valid & full).drop("_n")
