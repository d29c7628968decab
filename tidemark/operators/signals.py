"""Compositions: signals of a market built from the book, decay and model operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import numeric as N
from tidemark.operators import book, decay, models


def static_book_returns(bids: Column, asks: Column, mid: Column, ratios: Sequence[float], scales: Sequence[float], groups: int = 4, corrected: bool = True) -> list[Column]:
    """Relative distance of the static fair price from the mid, for each aggregation ratio and scale.

    A group that isn't there counts with size 0.
    """
    out = []
    for ratio in ratios:

        def fairs(b, a, m):
            sides = [[(F.coalesce(F.get(x, F.lit(i))["price"], m), F.coalesce(F.get(x, F.lit(i))["size"], F.lit(0.0))) for i in range(groups)] for x in (b, a)]
            return F.array(*[book.static_fair(*sides, m, scale, corrected=corrected) for scale in scales])

        # Levels are grouped once for each ratio, whatever the number of scales.
        values = models.let([book.aggregate_levels(bids, ratio, groups), book.aggregate_levels(asks, ratio, groups), mid], fairs)
        out += [models.let([F.get(values, F.lit(i)), mid], lambda f, m: N.div(f - m, m)) for i in range(len(scales))]
    return out


def decay_move(signals: Sequence[tuple[Column, Column]], quotes: tuple[Column, Column], quote_averages: tuple[Column, Column], parameter: Callable[[str], object], name: str = "decay", clamp: float = 0.01) -> Column:
    """Clamped returns of (signal, average) pairs against their averages, and the quotes' sided return, combined."""
    moves = [decay.returns_against(x, a, clamp) for x, a in signals]
    moves.append(decay.sided_returns(*quotes, *quote_averages))
    return models.cascade(moves, parameter, name)
