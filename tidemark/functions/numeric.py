"""Scalar algebra with strict nulls: NULL is "invalid", and any invalid input makes the output invalid.

Arithmetic follows IEEE 754 where Spark's ANSI mode would raise or return NULL (division by zero, logarithms);
comparisons with NaN are false. The sign of a negative zero denominator isn't kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def finite(x: Column) -> Column:
    """A source value: invalid if it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(INF)), F.lit(None)).otherwise(x)


def both(a: Column, b: Column, then: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), then)


def add(a, b):
    return a + b


def sub(a, b):
    return a - b


def mul(a, b):
    return a * b


def div(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return both(a, b, F.when(b == 0, by_zero).otherwise(a / F.when(b != 0, b)))


def minimum(a, b):
    return both(a, b, F.least(a, b))


def maximum(a, b):
    return both(a, b, F.greatest(a, b))


def _ordered(a, b, test):
    number = ~F.isnan(a.cast("double")) & ~F.isnan(b.cast("double"))
    return both(a, b, number & test)


def lt(a, b):
    return _ordered(a, b, a < b)


def le(a, b):
    return _ordered(a, b, a <= b)


def gt(a, b):
    return _ordered(a, b, a > b)


def ge(a, b):
    return _ordered(a, b, a >= b)


def eq(a, b):
    return _ordered(a, b, a == b)


def absolute(a):
    return F.abs(a)


def exp(a):
    return F.exp(a)


def log(a: Column) -> Column:
    """Natural logarithm: 0 gives -inf, a negative gives NaN."""
    a = a.cast("double")
    return F.when(a == 0, F.lit(-INF)).when(a < 0, F.lit(NAN)).when(F.isnan(a), F.lit(NAN)).otherwise(F.ln(a))


def neg(a):
    return -a


def sqrt(a):
    return F.sqrt(a)


def power(base: float, x: Column) -> Column:
    """base ** -x, the decay form of a fast exponential with that base."""
    return F.pow(F.lit(float(base)), -x)


def select(a: Column, b: Column, chosen: Column) -> Column:
    """``a`` where chosen, else ``b``; the other side may be invalid, an invalid choice is invalid."""
    return F.when(chosen, a).when(~chosen, b)


def index(array: Column, n: int) -> Column:
    if n < 0:
        raise ValueError("a static index is at least 0")
    return F.get(array, F.lit(n))


def constant(value) -> Column:
    return F.lit(value)


def triggered_constant(value, tick: Column) -> Column:
    """Valid only in the row in which ``tick`` is valid."""
    return F.when(tick.isNotNull(), F.lit(value))


def clamp(a: Column, to: float) -> Column:
    if to <= 0:
        raise ValueError("clamp needs a positive bound")
    return minimum(F.lit(float(to)), maximum(F.lit(-float(to)), a))


def discount_by(a: Column, b: Column) -> Column:
    """Shrink ``a`` towards zero by what of ``b`` points the same way, never past zero."""
    zero = F.lit(0.0)
    down, up = a - maximum(a, minimum(b, zero)), a - minimum(a, maximum(b, zero))
    return both(a, b, F.when(a <= 0, down).otherwise(up))


def sigmoid(x):
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def tanh_half(x):
    """2 sigmoid(x) - 1, the hyperbolic tangent of x / 2."""
    return F.lit(2.0) * sigmoid(x) - F.lit(1.0)


def relu(x):
    return maximum(F.lit(0.0), x)


def linear(x):
    return x


def tree(items: Sequence, op):
    """Balanced pairwise reduction; an odd last item is folded into the last pair. Empty input is an error."""
    items = list(items)
    if not items:
        raise ValueError("nothing to reduce")
    while len(items) > 1:
        paired = [op(items[i], items[i + 1]) for i in range(0, len(items) - 1, 2)]
        if len(items) % 2:
            paired[-1] = op(paired[-1], items[-1])
        items = paired
    return items[0]


def tree_sum(items):
    return tree(items, lambda a, b: a + b)


def tree_min(items):
    return tree(items, minimum)


def tree_max(items):
    return tree(items, maximum)


def ephemeral_sum(slots: Sequence[Column]) -> Column:
    """Sum of the slots that are written (valid) in this row; 0 if none is."""
    return F.aggregate(F.filter(F.array(*slots), lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x)
