"""Ordered running values that don't put a whole key into one task.

A window partitioned by symbol alone sorts each symbol's history in one task. Here rows are windowed within
(key, block), one small row per block is scanned over the blocks of a key, and the carry is joined back.
Every step is an aggregate, a window over a bounded block, or a join with the block table.

Blocks are spans of time, or :class:`Even` ones of about equal row counts, which a busy day, a hot key or a hot instant
can't fill. Carries go through one window over a key's blocks, or with ``levels`` through windows of at most FAN
blocks, then groups of blocks, and so on. With ``resets`` values start anew at the rows where it is true; a run between
two resets may be longer than a block and is then summed over several tasks like anything else.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import materialize

#: Microseconds of a block.
DAY_US = 86_400_000_000
#: Blocks (groups of blocks, ...) that one window of a carry holds.
FAN = 256
#: Rows of a block of time whose span goes by the rows.
SPAN_ROWS = 1 << 16


@dataclass(frozen=True)
class Even:
    """Blocks of about ``rows`` rows. Their borders in (keys, order) are quantiles of a sample, so rows of one instant
    part by the further columns of the order. The rows are written to the shared folder once, dealt to their blocks."""

    rows: int = 4096


def _equal(a: str, b: str, keys) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def blocks_of(df: DataFrame, keys: list[str], order: list[str], blocks: int | Even, time: str | None = None) -> tuple[DataFrame, int]:
    """``df`` with ``_block``, which never falls along ``order`` within the keys; the levels that carries need."""
    if not isinstance(blocks, Even):
        return df.withColumn("_block", F.floor(F.col(time or order[0]) / F.lit(blocks))), 1
    n = max(1, ceil(df.count() / blocks.rows))
    sort = [F.asc_nulls_first(c) for c in [*keys, *order]]
    dealt = materialize(df.repartitionByRange(n, *sort).withColumn("_block", F.spark_partition_id()), "even-blocks")
    return dealt, max(1, ceil(log(n + 1, FAN)))


def span_for(df: DataFrame, keys: list[str], most: int, rows: int = SPAN_ROWS, time: str = "ts_us") -> int:
    """The span of a block of time, ``most`` at most, with which a key's blocks have about ``rows`` rows on average."""
    of = df.groupBy(*keys).agg(F.count("*").alias("n"), (F.max(time) - F.min(time)).alias("span"))
    found = of.agg(F.min(F.col("span") * F.lit(float(rows)) / F.col("n")).alias("x")).first()["x"]
    return most if found is None else max(1, min(most, int(found)))


#: How a running value of a block's rows (or of blocks) is computed, and what it is of a whole block.
_RUNNING = {
    "sum": F.sum,
    "count": F.sum,
    "min": F.min,
    "max": F.max,
    "last": lambda c: F.last(c, ignorenulls=True),
    "lag": lambda c: F.last(c, ignorenulls=True),
    "first": lambda c: F.first(c, ignorenulls=True),
}
_WHOLE = {
    "last": lambda c, place: F.max_by(c, F.when(c.isNotNull(), place)),
    "lag": lambda c, place: F.max_by(c, place),
    "first": lambda c, place: F.min_by(c, F.when(c.isNotNull(), place)),
}


def _put_together(kind: str, before: Column, here: Column) -> Column:
    if kind in ("sum", "count"):
        return F.when(here.isNotNull() | before.isNotNull(), F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0)))
    if kind in ("min", "max"):
        return (F.least if kind == "min" else F.greatest)(here, before)
    return F.coalesce(before, here) if kind == "first" else F.coalesce(here, before)


def _carries(ends: DataFrame, keys: list[str], kinds: dict[str, str], levels: int, resets: bool, at: str = "_block") -> DataFrame:
    """keys, ``at``, _before_<name> (and _cut): what the blocks before each block (since the last reset, if one of
    them has any) make of the blocks' values, which are columns of the names (and _cut)."""
    group = f"{at}_group"
    part = keys if levels == 1 else [*keys, group]
    rows = ends if levels == 1 else ends.withColumn(group, F.floor(F.col(at) / FAN))
    along = Window.partitionBy(*part).orderBy(at)
    if resets:
        rows = rows.withColumn("_part", F.sum(F.col("_cut").cast("long")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
        upto = Window.partitionBy(*part, "_part").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumns({f"_run_{n}": _RUNNING[k](F.col(n)).over(upto) for n, k in kinds.items()})
        before = {f"_before_{n}": F.lag(f"_run_{n}").over(along) for n in kinds} | {"_cut_before": F.coalesce(F.lag("_part").over(along) > 0, F.lit(False))}
        whole = [F.max_by(f"_run_{n}", at).alias(n) for n in kinds] + [(F.max("_part") > 0).alias("_cut")]
    else:
        earlier = along.rowsBetween(Window.unboundedPreceding, -1)
        before = {f"_before_{n}": _RUNNING[k](F.col(n)).over(earlier) for n, k in kinds.items()} | {"_cut_before": F.lit(False)}
        whole = [(_WHOLE[k](F.col(n), F.col(at)) if k in _WHOLE else _RUNNING[k](F.col(n))).alias(n) for n, k in kinds.items()]
    inside = rows.withColumns(before)
    if levels == 1:
        return inside.select(*keys, at, *before)
    outer = _carries(rows.groupBy(*part).agg(*whole), keys, kinds, levels - 1, resets, group)
    found = inside.alias("i").join(outer.alias("o"), _equal("i", "o", part))
    cut = F.col("i._cut_before")
    both = [F.when(cut, F.col(f"i._before_{n}")).otherwise(_put_together(k, F.col(f"o._before_{n}"), F.col(f"i._before_{n}"))).alias(f"_before_{n}") for n, k in kinds.items()]
    return found.select(*[F.col(f"i.{c}") for c in [*keys, at]], *both, (cut | F.col("o._cut_before")).alias("_cut_before"))


def scan(df: DataFrame, keys: list[str], order: list[str], specs: dict[str, tuple[str, Column]], time: str | None = None, block_us: int | Even = DAY_US, resets: Column | None = None, levels: int = 1) -> DataFrame:
    """``df`` with a column for each spec, a (kind, value) pair, up to and including each row in ``order``.

    Kinds: ``sum``, ``count`` (of valid values), ``min``, ``max``; ``first`` and ``last`` (earliest and latest valid
    value) and ``lag`` (value of the row before, valid or not). ``order`` must be total within the keys, and its first
    column (or ``time``) numbers the blocks, so it must never fall along the order. A row that ``resets`` begins anew:
    it and the rows after it see nothing from before it.
    """
    kinds = {n: k for n, (k, _) in specs.items()}
    if unknown := set(kinds.values()) - set(_RUNNING):
        raise ValueError(f"no kind {', '.join(sorted(unknown))}")
    inputs = {f"_in_{n}": (F.struct(v.alias("v")) if k == "lag" else v) for n, (k, v) in specs.items()}
    if resets is not None:
        inputs["_reset"] = F.coalesce(resets, F.lit(False)).cast("long")
    rows, even_levels = blocks_of(df.withColumns(inputs), keys, order, block_us, time)
    part, sort, place = [*keys, "_block"], [F.asc_nulls_first(c) for c in order], F.struct(*order)
    along = part
    if resets is not None:
        rows = rows.withColumn("_part", F.sum("_reset").over(Window.partitionBy(*part).orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)))
        along = [*part, "_part"]
    plain = Window.partitionBy(*along).orderBy(*sort)
    upto = plain.rowsBetween(Window.unboundedPreceding, 0)
    local, whole = {}, []
    for n, kind in kinds.items():
        x = F.col(f"_in_{n}")
        f = F.count if kind == "count" else _RUNNING[kind]
        local[n] = F.lag(x).over(plain) if kind == "lag" else f(x).over(upto)
        whole.append((_WHOLE[kind](x, place) if kind in _WHOLE else f(x)).alias(n))
    rows = rows.withColumns(local)
    if resets is None:
        ends = rows.groupBy(*part).agg(*whole)
    else:  # the running values of a block's last row are those of its last part
        last = [F.max_by(f"_in_{n}" if k == "lag" else n, place).alias(n) for n, k in kinds.items()]
        ends = rows.groupBy(*part).agg(*last, (F.max("_part") > 0).alias("_cut"))
    carry = _carries(ends, keys, kinds, max(levels, even_levels), resets is not None)
    joined = rows.alias("r").join(carry.alias("c"), _equal("r", "c", part), "left")
    out = []
    for n, kind in kinds.items():
        here = F.col(f"r.{n}")
        value = _put_together(kind, F.col(f"c._before_{n}"), here)
        if resets is not None:
            value = F.when(F.col("r._part") > 0, here).otherwise(value)
        out.append((value["v"] if kind == "lag" else value).alias(n))
    return joined.select(*[F.col(f"r.{c}") for c in df.columns if c not in specs], *out)


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island", block_us: int | Even = DAY_US) -> DataFrame:
    """Number the runs of rows that begin where ``starts`` is true."""
    return scan(df, keys, order, {name: ("sum", F.when(starts, F.lit(1)).otherwise(F.lit(0)).cast("long"))}, block_us=block_us)
