"""Model building on columns: regressions, bounded sums, symmetric moves, matrices and layers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import numeric as N


#: Length of the expressions, as text, that one method of generated code takes in; more partitions than a frame has.
REGION, MOST_PARTITIONS = 500, 1_000_000


class _Stages:
    """A frame that gets the values of each ``let`` as columns, by a select of its own.

    Adjacent selects become one method of generated code, and the JVM leaves methods of over 8,000 bytes of byte code
    uncompiled, which makes them ten times slower. So after every REGION of expressions the frame is "coalesced" to more
    partitions than it has: that moves no row, but ends the method.
    """

    def __init__(self, df: DataFrame):
        self.df, self.made, self.size = df, 0, 0
        self.prefix = "_let"
        while any(c.startswith(self.prefix) for c in df.columns):
            self.prefix = "_" + self.prefix

    def let(self, values: Sequence[Column]) -> list[Column]:
        names = [f"{self.prefix}{self.made + i}" for i in range(len(values))]
        self.made += len(values)
        self.df = self.df.withColumns(dict(zip(names, values)))
        self.size += sum(len(str(v)) for v in values)
        if self.size > REGION:
            self.size = 0
            self.df = self.df.coalesce(MOST_PARTITIONS)
        return [F.col(n) for n in names]


_open: list[_Stages] = []


def staged(df: DataFrame, make: Callable[[], dict[str, Column]]) -> DataFrame:
    """``df`` with the columns that ``make()`` names. Inside it every ``let`` is a select of its own, so the expressions
    are code-generated, where the lambda that ``let`` is elsewhere isn't."""
    stages = _Stages(df)
    _open.append(stages)
    try:
        columns = make()
    finally:
        _open.pop()
    return stages.df.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], *[v.alias(n) for n, v in columns.items()])


def let(values: Sequence[Column], f: Callable) -> Column:
    """f of the values, each computed once: without it an expression that uses its inputs several times grows
    exponentially with depth, past what code generation takes."""
    if _open:
        return f(*_open[-1].let(values))
    names = [f"v{i}" for i in range(len(values))]
    bound = F.array(F.struct(*[v.alias(n) for v, n in zip(values, names)]))
    return F.get(F.transform(bound, lambda s: f(*[s[n] for n in names])), F.lit(0))


def linreg(xs: Sequence, ws: Sequence, bias=None):
    if len(xs) != len(ws):
        raise ValueError("as many weights as inputs are needed")
    total = N.tree_sum([x * w for x, w in zip(xs, ws)])
    return total if bias is None else total + bias


def bounded_sum(vs: Sequence[Column], fs: Sequence) -> Column:
    """Weighted sum, kept between the least and the greatest input."""
    return N.maximum(N.tree_min(vs), N.minimum(N.tree_max(vs), linreg(vs, fs)))


def soft_bounded_sum(vs: Sequence[Column], fs: Sequence, scale, post: Sequence) -> Column:
    """Inputs weighted by a softmax of factor times scaled magnitude, each with its post coefficient."""
    def sums(*xs):
        # Named in a struct, so that each input and each weight is in the expression once, however deep calls nest.
        weights = [F.exp(f * (scale * F.abs(x))) for x, f in zip(xs, fs)]
        return let(weights, lambda *ws: F.struct(N.tree_sum([w * x * p for w, x, p in zip(ws, xs, post)]).alias("top"), N.tree_sum(list(ws)).alias("all")))

    return let([let(list(vs), sums)], lambda s: N.div(s["top"], s["all"]))


def symmetric_move(vs: Sequence[Column], fs: Sequence[Sequence], scale, post: Sequence[Sequence], clamp: float | None = None) -> Column:
    """Each input discounted by the soft bounded sum of the others, then their soft bounded sum."""
    n = len(vs)
    if n < 2:
        raise ValueError("a symmetric move needs at least two inputs")
    discounted = []
    for i in range(n):
        others = [j for j in range(n) if j != i]
        d = let([vs[i], soft_bounded_sum([vs[j] for j in others], [fs[i][j] for j in others], scale, [post[i][j] for j in others])], N.discount_by)
        discounted.append(d if clamp is None else let([d], lambda x: N.clamp(x, clamp)))
    return soft_bounded_sum(discounted, [fs[i][i] for i in range(n)], scale, [post[i][i] for i in range(n)])


class Matrix:
    """A row-major matrix of expressions."""

    def __init__(self, values: Sequence, rows: int, columns: int):
        values = list(values)
        if rows < 1 or columns < 1 or len(values) != rows * columns:
            raise ValueError(f"{len(values)} values don't make {rows} x {columns}")
        self.values, self.rows, self.columns = values, rows, columns

    @classmethod
    def of(cls, make: Callable[[int, int], object], rows: int, columns: int) -> Matrix:
        return cls([make(i, j) for i in range(rows) for j in range(columns)], rows, columns)

    def at(self, i: int, j: int):
        return self.values[i * self.columns + j]

    def apply(self, f: Callable) -> Matrix:
        return Matrix([f(v) for v in self.values], self.rows, self.columns)

    def __add__(self, other: Matrix) -> Matrix:
        if (self.rows, self.columns) != (other.rows, other.columns):
            raise ValueError("shapes differ")
        return Matrix([a + b for a, b in zip(self.values, other.values)], self.rows, self.columns)

    def __matmul__(self, other: Matrix) -> Matrix:
        if self.columns != other.rows:
            raise ValueError("inner sizes differ")
        return Matrix.of(lambda i, j: N.tree_sum([self.at(i, k) * other.at(k, j) for k in range(self.columns)]), self.rows, other.columns)


class Layer:
    """activation(W x + b) with named parameters."""

    def __init__(self, name: str, size_in: int, size_out: int, activation: Callable, parameter: Callable[[str], object]):
        self.weights = Matrix.of(lambda i, j: parameter(f"{name}_w_{i}_{j}"), size_out, size_in)
        self.bias = Matrix.of(lambda i, _: parameter(f"{name}_b_{i}"), size_out, 1)
        self.activation = activation

    def __call__(self, x: Matrix) -> Matrix:
        return (self.weights @ x + self.bias).apply(self.activation)


def mlp(xs: Sequence, layers: Sequence[Layer]) -> list:
    xs = list(xs)
    if not all(isinstance(x, Column) for x in xs):
        x = Matrix(xs, len(xs), 1)
        for layer in layers:
            x = layer(x)
        return x.values
    bound = F.array(*xs)
    for layer in layers:
        size = len(xs)
        inner = lambda s, layer=layer, size=size: F.array(*layer(Matrix([F.get(s, F.lit(i)) for i in range(size)], size, 1)).values)
        bound = let([bound], _one_argument(inner))
        xs = [F.get(bound, F.lit(i)) for i in range(layer.weights.rows)]
    return xs


def wide_mlp(xs: Column, weights: Sequence[Sequence[Sequence[float]]], biases: Sequence[Sequence[float]], activations: Sequence[Callable]) -> Column:
    """The same over an array column with literal parameters: constant plan size per layer, however wide."""
    for w, b, act in zip(weights, biases, activations):
        rows = F.array(*[F.struct(F.array(*map(F.lit, map(float, r))).alias("w"), F.lit(float(c)).alias("b")) for r, c in zip(w, b)])
        xs = _layer(rows, xs, act)
    return xs


def _layer(rows: Column, inputs: Column, act: Callable) -> Column:
    return F.transform(rows, lambda r: act(F.aggregate(F.zip_with(r["w"], inputs, lambda x, y: x * y), r["b"], lambda s, v: s + v)))


def _one_argument(f: Callable) -> Callable:
    return lambda s: f(s)


class Normalizer:
    """(x - mean) / deviation and back."""

    def __init__(self, mean, deviation):
        self.mean, self.deviation = mean, deviation

    def normalize(self, x):
        return N.div(x - self.mean, self.deviation if isinstance(self.deviation, Column) else F.lit(float(self.deviation)))

    def denormalize(self, x):
        return x * self.deviation + self.mean


def cascade(xs: Sequence[Column], parameter: Callable[[str], object], name: str = "cascade", normalizer: Normalizer | None = None, move: bool = True) -> Column:
    """Soft bounded sum, symmetric move and regression of normalised inputs, added up."""
    xs = [normalizer.normalize(x) for x in xs] if normalizer else list(xs)
    n, p = len(xs), lambda k: parameter(f"{name}_{k}")
    parts = [soft_bounded_sum(xs, [p(f"soft_f_{i}") for i in range(n)], p("soft_scale"), [p(f"soft_p_{i}") for i in range(n)]), linreg(xs, [p(f"lin_{i}") for i in range(n)])]
    if move and n > 1:
        grid = lambda k: [[p(f"{k}_{i}_{j}") for j in range(n)] for i in range(n)]
        parts.append(symmetric_move(xs, grid("move_f"), p("move_scale"), grid("move_p")))
    total = N.tree_sum(parts)
    return normalizer.denormalize(total) if normalizer else total


def small_mlp(xs: Sequence[Column], parameter: Callable[[str], object], name: str = "mlp") -> list[Column]:
    """n inputs through 2n tanh, 2n relu and n tanh units."""
    n = len(xs)
    return mlp(xs, [Layer(f"{name}_0", n, 2 * n, N.tanh_half, parameter), Layer(f"{name}_1", 2 * n, 2 * n, N.relu, parameter), Layer(f"{name}_2", 2 * n, n, N.tanh_half, parameter)])
