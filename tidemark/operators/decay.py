"""Exponential decay on a timer grid, and what is built on it.

y[k] = d y[k-1] + c[k] is summed in blocks of BLOCK grid points: inside a block as d^i times a running sum of
c[j] d^-j. A block maps the sum before it to the sum after it, y to y d + c, and such maps are put together in levels,
so what a block starts from is exact over all blocks before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import numeric as N
from tidemark.operators import events
from tidemark.operators.scan import DAY_US, _equal, scan
from tidemark.sources.scratch import materialize

STEPS_A_HALF_LIFE, BLOCK, LEAST_HALF_LIFE_US = 20, 512, 10
#: Blocks of a mixed running sum that are combined into one of the next level.
FAN = 64


def step_us(half_life_us: int) -> int:
    if half_life_us <= LEAST_HALF_LIFE_US:
        raise ValueError("the half-life is too short")
    return half_life_us // STEPS_A_HALF_LIFE


def factor(half_life_us: int) -> float:
    return 2.0 ** (-step_us(half_life_us) / half_life_us)


def decay_grid(log: DataFrame, keys: list[str], half_life_us: int) -> DataFrame:
    """Timer rows with the decay of each: keys, k, ts_us, decay. The first fire forgets all that was before."""
    d = factor(half_life_us)
    return events.timer_rows(log, keys, step_us(half_life_us)).withColumn("decay", F.when(F.col("k") == 0, F.lit(0.0)).otherwise(F.lit(d)))


def decayed_sum(grid: DataFrame, keys: list[str], value: Column, d: float, name: str) -> DataFrame:
    """Adds y[k] = d y[k-1] + value over the grid column ``k`` (dense within the keys)."""
    rows = grid.withColumn("_c", F.coalesce(value.cast("double"), F.lit(0.0))).withColumn("_b", F.floor(F.col("k") / BLOCK)).withColumn("_i", F.col("k") % BLOCK)
    inside = Window.partitionBy(*keys, "_b").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    local = F.pow(F.lit(d), F.col("_i")) * F.sum(F.col("_c") * F.pow(F.lit(d), -F.col("_i"))).over(inside)
    rows = rows.withColumn("_local", local)
    end = F.struct(F.pow(F.lit(d), F.max("_i") + 1).alias("d"), F.max_by("_local", "k").alias("c"))
    a, b = rows.alias("a"), _carried(rows.groupBy(*keys, "_b").agg(end.alias("_e")), keys).alias("b")
    value = F.col("a._local") + F.col("b._carry") * F.pow(F.lit(d), F.col("a._i") + 1)
    return a.join(b, _equal("a", "b", [*keys, "_b"])).select(*[F.col(f"a.{c}") for c in grid.columns], value.alias(name))


def _carried(ends: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _b, _carry: the running sum before each block, from the blocks' maps ``_e``."""
    ends = materialize(ends, "decay-ends")
    span = ends.agg(F.min("_b").alias("low"), F.max("_b").alias("high")).first()
    return _carries(ends, keys, span["low"] or 0, span["high"] or 0)


def running_sum(log: DataFrame, ticks: DataFrame, keys: list[str], column: str, half_life_us: int, name: str = "running_sum") -> DataFrame:
    """Decayed sum of the ticks on the grid of ``log``: a tick counts from the first grid point at or after it."""
    step, d = step_us(half_life_us), factor(half_life_us)
    grid = decay_grid(log, keys, half_life_us)
    start = log.groupBy(*keys).agg(F.min("ts_us").alias("_t0"))
    a, b = ticks.alias("a"), start.alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    due = a.join(b, same).select(*[F.col(f"a.{k}") for k in keys], F.ceil((F.col("a.ts_us") - F.col("b._t0")) / step).cast("long").alias("k"), F.col(f"a.{column}").alias("_x"))
    sums = due.groupBy(*keys, "k").agg(F.sum("_x").alias("_x"))
    a, b = grid.alias("a"), sums.alias("b")
    same = F.col("a.k") == F.col("b.k")
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return decayed_sum(a.join(b, same, "left").select("a.*", "b._x"), keys, F.col("_x"), d, name).drop("_x", "decay")


def running_sum_mixed(rows: DataFrame, keys: list[str], order: list[str], decay: Column, tick: Column, name: str = "running_sum", block: int = 16) -> DataFrame:
    """y = y * decay + tick on every row, each row with its own decay (NULL: none, 1; 0 forgets all before).

    Rows need a dense number ``n`` within the keys in ``order``. A row maps y to y d + c; such maps are put together
    within blocks of ``block`` rows, and the carry into a block is exact over all blocks before it.
    """
    step = F.struct(F.coalesce(decay.cast("double"), F.lit(1.0)).alias("d"), F.coalesce(tick.cast("double"), F.lit(0.0)).alias("c"))
    rows = rows.withColumns({"_step": step, "_b": F.floor(F.col("n") / block)})
    upto = Window.partitionBy(*keys, "_b").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_m", _together(F.collect_list("_step").over(upto)))
    a, b = rows.alias("a"), _carried(rows.groupBy(*keys, "_b").agg(F.max_by("_m", "n").alias("_e")), keys).alias("b")
    same = _equal("a", "b", [*keys, "_b"])
    keep = [c for c in rows.columns if not c.startswith("_")]
    return a.join(b, same).select(*[F.col(f"a.{c}") for c in keep], (F.col("a._m.c") + F.col("a._m.d") * F.col("b._carry")).alias(name))


def _together(steps: Column) -> Column:
    """One map for an array of maps (d, c) in their order."""
    nothing = F.struct(F.lit(1.0).alias("d"), F.lit(0.0).alias("c"))
    return F.aggregate(steps, nothing, lambda y, e: F.struct((y["d"] * e["d"]).alias("d"), (y["c"] * e["d"] + e["c"]).alias("c")))


def _carries(ends: DataFrame, keys: list[str], low: int, high: int) -> DataFrame:
    """keys, _b, _carry: the running sum before each block, of blocks ``low`` to ``high`` with maps ``_e`` (d, c).

    FAN blocks in a row are one block of the next level, whose carries are found in the same way, so no window or
    fold is over more than FAN rows.
    """
    rows = ends.withColumn("_g", F.floor((F.col("_b") - low) / FAN))
    before = Window.partitionBy(*keys, "_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_in", _together(F.collect_list("_e").over(before)))
    last = (high - low) // FAN
    if not last:
        return inside.select(*keys, "_b", F.col("_in.c").alias("_carry"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_b", "_e"))), lambda x: x["_e"])
    groups = rows.groupBy(*keys, F.col("_g").alias("_b")).agg(_together(ordered).alias("_e"))
    a, b = inside.alias("a"), _carries(materialize(groups, "decay-ends"), keys, 0, last).withColumnRenamed("_b", "_g").alias("b")
    return a.join(b, _equal("a", "b", [*keys, "_g"])).select(*[F.col(f"a.{k}") for k in [*keys, "_b"]], (F.col("a._in.c") + F.col("a._in.d") * F.col("b._carry")).alias("_carry"))


def ewma(log: DataFrame, keys: list[str], signal: str, half_life_us: int, name: str = "ewma", block_us: int = DAY_US) -> DataFrame:
    """Average of a latched signal on its grid: keys, k, ts_us, signal, ewma.

    A grid point reads the last message strictly before it; an invalid signal makes the average invalid and the
    next valid one starts it anew.
    """
    d = factor(half_life_us)
    grid = events.timer_rows(log, keys, step_us(half_life_us))
    probe = grid.withColumn("ts_us", F.col("ts_us") - 1).withColumn("seq", F.col("k"))
    read = events.as_of(probe, log.select(*keys, "ts_us", "seq", F.col(signal).alias("_signal")), keys, ["_signal"], block_us=block_us).withColumn("ts_us", F.col("ts_us") + 1).drop("seq").withColumnRenamed("_signal", signal)
    bad = F.col(signal).isNull()
    numbered = scan(read, keys, ["k"], {"_restart": ("sum", bad.cast("long"))}, block_us=4096, levels=2)
    valid = numbered.where(~bad)
    first = valid.groupBy(*keys, "_restart").agg(F.min("k").alias("_k0"))
    a, b = valid.alias("a"), first.alias("b")
    same = F.col("a._restart") == F.col("b._restart")
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    based = a.join(b, same).select(*[F.col(f"a.{k}") for k in keys], "a._restart", (F.col("a.k") - F.col("b._k0")).alias("k"), F.col("a.k").alias("_k"), "a.ts_us", f"a.{signal}")
    c = F.when(F.col("k") == 0, F.col(signal)).otherwise((1 - d) * F.col(signal))
    done = decayed_sum(based, [*keys, "_restart"], c, d, name).select(*keys, F.col("_k").alias("k"), "ts_us", signal, name)
    return done.unionByName(numbered.where(bad).select(*keys, "k", "ts_us", signal, F.lit(None).cast("double").alias(name)))


def returns_against(x: Column, average: Column, clamp: float | None = None) -> Column:
    out = N.div(x - average, x)
    return out if clamp is None else N.clamp(out, clamp)


def difference_to(x: Column, average: Column) -> Column:
    return x - average


def sided_returns(bid: Column, ask: Column, bid_average: Column, ask_average: Column) -> Column:
    """What the bid lost from, and the ask won over, its average."""
    return N.div(bid - N.maximum(bid_average, bid), bid) + N.div(ask - N.minimum(ask_average, ask), ask)
