"""The model operators as SQL text, for checking queries: named expressions that a SELECT computes one after another.

DuckDB lets an expression use the names given before it in the same SELECT list.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from tidemark.functions import numeric as N


class Steps:
    """Definitions (name, expression) in order."""

    def __init__(self):
        self.made: list[tuple[str, str]] = []

    def let(self, name: str, sql: str) -> str:
        self.made.append((name, sql))
        return name

    def select(self, columns: str, source: str) -> str:
        return f"select {columns}, " + ", ".join(f"{sql} as {name}" for name, sql in self.made) + f" from {source}"


def total(terms: Sequence[str]) -> str:
    return N.tree(list(terms), lambda a, b: f"({a} + {b})")


def div(a: str, b: str) -> str:
    """IEEE 754, as division by zero is NULL in DuckDB."""
    return f"(case when {b} = 0 then case when {a} = 0 then 'nan'::double when {a} > 0 then 'inf'::double else '-inf'::double end else {a} / {b} end)"


def clamp(x: str, to: float) -> str:
    return f"least({to!r}, greatest(-{to!r}, {x}))"


def soft_bounded_sum(steps: Steps, name: str, xs: Sequence[str], fs: Sequence[float], scale: float, post: Sequence[float]) -> str:
    ws = [steps.let(f"{name}_w{i}", f"exp({f!r} * ({scale!r} * abs({x})))") for i, (x, f) in enumerate(zip(xs, fs))]
    return steps.let(name, f"{total([f'{w} * {x} * {p!r}' for w, x, p in zip(ws, xs, post)])} / {total(ws)}")


def discount(a: str, b: str) -> str:
    return f"(case when {a} <= 0 then {a} - greatest({a}, least({b}, 0)) else {a} - least({a}, greatest({b}, 0)) end)"


def cascade(steps: Steps, name: str, xs: Sequence[str], parameter: Callable[[str], float], normalizer: tuple[str, str] | None = None) -> str:
    """The SQL of ``models.cascade``; ``normalizer`` names the mean and the deviation."""
    p = lambda k: parameter(f"{name}_{k}")
    n = len(xs)
    if normalizer:
        xs = [steps.let(f"{name}_n{i}", f"({x} - {normalizer[0]}) / {normalizer[1]}") for i, x in enumerate(xs)]
    every = range(n)
    soft = soft_bounded_sum(steps, f"{name}_soft", xs, [p(f"soft_f_{i}") for i in every], p("soft_scale"), [p(f"soft_p_{i}") for i in every])
    parts = [soft, total([f"{x} * {p(f'lin_{i}')!r}" for i, x in enumerate(xs)])]
    if n > 1:
        discounted = []
        for i in every:
            others = [j for j in every if j != i]
            rest = soft_bounded_sum(steps, f"{name}_o{i}", [xs[j] for j in others], [p(f"move_f_{i}_{j}") for j in others], p("move_scale"), [p(f"move_p_{i}_{j}") for j in others])
            discounted.append(steps.let(f"{name}_d{i}", discount(xs[i], rest)))
        parts.append(soft_bounded_sum(steps, f"{name}_move", discounted, [p(f"move_f_{i}_{i}") for i in every], p("move_scale"), [p(f"move_p_{i}_{i}") for i in every]))
    out = total(parts)
    return steps.let(name, f"({out}) * {normalizer[1]} + {normalizer[0]}" if normalizer else out)


def layer(steps: Steps, name: str, xs: Sequence[str], size: int, activation: Callable[[str], str], parameter: Callable[[str], float]) -> list[str]:
    return [steps.let(f"{name}_{i}", activation(f"({total([f'{parameter(f'{name}_w_{i}_{j}')!r} * {x}' for j, x in enumerate(xs)])} + {parameter(f'{name}_b_{i}')!r})")) for i in range(size)]


def small_mlp(steps: Steps, xs: Sequence[str], parameter: Callable[[str], float], name: str = "mlp") -> list[str]:
    tanh_half, relu = (lambda x: f"2 / (1 + exp(-{x})) - 1"), (lambda x: f"greatest(0, {x})")
    for k, (size, f) in enumerate(((2 * len(xs), tanh_half), (2 * len(xs), relu), (len(xs), tanh_half))):
        xs = layer(steps, f"{name}_{k}", xs, size, f, parameter)
    return xs
