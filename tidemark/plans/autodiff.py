"""Differentiable sub-graphs: discovery, gradients as columns, training and metrics.

The differentiable part of a signal graph is a DAG of edges (inputs from data), parameters, constants, operators
and summaries. Reverse-mode differentiation runs on that DAG symbolically, so the loss and the gradient of every
parameter are plain columns, and an epoch is one aggregate over the data; the driver holds the parameters only.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import numeric as N
from tidemark.plans.graph import Output, SignalGraph


@dataclass(frozen=True)
class Node:
    """kind: edge, param, constant or an operator's name."""

    kind: str
    name: str
    inputs: tuple[int, ...] = ()
    value: float | None = None


class Graph:
    """Nodes with inputs first; the last is the root."""

    def __init__(self, nodes: list[Node]):
        self.nodes = nodes

    @classmethod
    def discover(cls, output: Output) -> Graph:
        """Walk from an output; stops at externals, blocked outputs and components that can't be differentiated."""
        graph: SignalGraph = output.graph
        nodes: list[Node] = []
        seen: dict[str, int] = {}

        def add(key: str, node: Node) -> int:
            seen[key] = len(nodes)
            nodes.append(node)
            return seen[key]

        needed = graph._needed([output])
        for name in graph.order():
            c = graph.components[name]
            d = graph.definitions[c.definition]
            for o in d.outputs:
                key = f"{name}::{o}"
                if key not in needed:
                    continue
                if c.definition == "parameter":
                    add(key, Node("param", name))
                elif c.definition == "constant":
                    add(key, Node("constant", name, value=float(c.params["value"])))
                elif not d.differentiable or c.block_propagation or c.definition not in FORWARD:
                    add(key, Node("edge", key))
                else:
                    ins = []
                    for i in d.inputs:
                        x = c.inputs[i]
                        if x.key not in seen:
                            add(x.key, Node("edge", x.key))
                        ins.append(seen[x.key])
                    add(key, Node(c.definition, name, tuple(ins)))
        if output.key not in seen:
            add(output.key, Node("edge", output.key))
        root = seen[output.key]
        return cls(nodes[: root + 1]).pruned()

    def pruned(self) -> Graph:
        live, todo = set(), [len(self.nodes) - 1]
        while todo:
            i = todo.pop()
            if i not in live:
                live.add(i)
                todo.extend(self.nodes[i].inputs)
        number = {old: new for new, old in enumerate(sorted(live))}
        return Graph([Node(n.kind, n.name, tuple(number[j] for j in n.inputs), n.value) for i, n in enumerate(self.nodes) if i in live])

    def edges(self) -> list[str]:
        return sorted({n.name for n in self.nodes if n.kind == "edge"})

    def parameter_names(self) -> list[str]:
        return sorted({n.name for n in self.nodes if n.kind == "param"})

    def mark_stored(self, graph: SignalGraph) -> None:
        """Make the edges' components keep their outputs."""
        for e in self.edges():
            parent = e.split("::")[0]
            if parent != "external":
                graph.components[parent].force_stored = True

    def to_json(self) -> str:
        return json.dumps([{"kind": n.kind, "name": n.name, "inputs": n.inputs, "value": n.value} for n in self.nodes])

    @classmethod
    def from_json(cls, text: str) -> Graph:
        return cls([Node(d["kind"], d["name"], tuple(d["inputs"]), d["value"]) for d in json.loads(text)])

    def pretty(self, at: int | None = None) -> str:
        n = self.nodes[len(self.nodes) - 1 if at is None else at]
        if n.kind in ("edge", "param"):
            return n.name
        if n.kind == "constant":
            return repr(n.value)
        return f"{n.kind}({', '.join(self.pretty(i) for i in n.inputs)})"

    # -- evaluation
    def forward(self, edges: dict[str, Column], params: dict[str, Column | float], summaries: dict[int, Column | float] | None = None) -> list[Column]:
        """A column for every node."""
        out: list[Column] = []
        for i, n in enumerate(self.nodes):
            if n.kind == "edge":
                col = edges[n.name]
            elif n.kind == "param":
                p = params[n.name]
                col = p if isinstance(p, Column) else F.lit(float(p))
            elif n.kind == "constant":
                col = F.lit(n.value)
            elif n.kind in ("mean", "std"):
                v = (summaries or {})[i]
                col = v if isinstance(v, Column) else F.lit(float(v))
            else:
                col = FORWARD[n.kind](*[out[j] for j in n.inputs])
            out.append(col)
        return out

    def summary_nodes(self) -> list[int]:
        return [i for i, n in enumerate(self.nodes) if n.kind in ("mean", "std")]

    def summaries(self, df: DataFrame, edges: dict[str, Column], params: dict[str, float]) -> dict[int, float]:
        """Values of mean and std nodes, inner ones first."""
        got: dict[int, float] = {}
        for i in self.summary_nodes():
            sub = Graph(self.nodes[: i])
            col = sub.forward(edges, params, got)[self.nodes[i].inputs[0]]
            f = F.avg(col) if self.nodes[i].kind == "mean" else F.when(F.count(col) > 1, F.stddev_samp(col)).otherwise(F.lit(1.0))
            got[i] = df.agg(f.alias("x")).first()["x"]
        return got

    def backward(self, values: list[Column], seed: Column, upto: int | None = None) -> list[Column | None]:
        """The seed times the root's derivative by each node (None: it doesn't depend on it), per row."""
        grads: list[Column | None] = [None] * len(self.nodes)
        root = len(self.nodes) - 1 if upto is None else upto
        grads[root] = seed
        wanted = [False] * len(self.nodes)
        for i, n in enumerate(self.nodes):
            wanted[i] = n.kind == "param" or any(wanted[j] for j in n.inputs)
        for i in range(root, -1, -1):
            n, g = self.nodes[i], grads[i]
            if g is None or not n.inputs or n.kind in ("mean", "std"):
                continue
            for j, d in zip(n.inputs, BACKWARD[n.kind](g, values[i], *[values[k] for k in n.inputs])):
                if d is not None and wanted[j]:
                    grads[j] = d if grads[j] is None else grads[j] + d
        return grads

    def parameter_gradients(self, values: list[Column], seed: Column) -> dict[str, Column]:
        """Per-row terms whose average is the gradient, summaries taken as constants."""
        grads = self.backward(values, seed)
        out = {p: F.lit(0.0) for p in self.parameter_names()}
        for n, g in zip(self.nodes, grads):
            if n.kind == "param" and g is not None:
                out[n.name] = out[n.name] + g
        return out

    def gradients(self, df: DataFrame, edges: dict[str, Column], params: dict[str, float], loss_seed: Callable[[Column], tuple[Column, Column]]) -> tuple[float, dict[str, float]]:
        """(loss, gradient): ``loss_seed(root)`` gives the per-row loss and its derivative by the root.

        Summaries get their own terms: a mean node with downstream gradient G (summed over rows) adds G/n to each
        row's input, a deviation node G (x - mean) / ((n - 1) std). Those are found innermost last, one more
        aggregate for each summary that depends on a parameter.
        """
        got = self.summaries(df, edges, params)
        values = self.forward(edges, params, got)
        loss, seed = loss_seed(values[-1])
        depends = [False] * len(self.nodes)
        for i, n in enumerate(self.nodes):
            depends[i] = n.kind == "param" or any(depends[j] for j in n.inputs)
        inner = [i for i in self.summary_nodes() if depends[i]]
        grads = self.backward(values, seed)
        count = F.count(loss)
        terms = {p: [] for p in self.parameter_names()}

        def collect(gs, scale):
            for n, g in zip(self.nodes, gs):
                if n.kind == "param" and g is not None:
                    terms[n.name].append(F.sum(g) * scale)

        collect(grads, 1.0)
        first = df.agg(F.avg(loss).alias("loss"), count.alias("n"), *[F.sum(grads[i]).alias(f"s{i}") if grads[i] is not None else F.lit(0.0).alias(f"s{i}") for i in inner], *[(sum(ts[1:], ts[0]) if ts else F.lit(0.0)).alias(f"p_{k}") for k, (_, ts) in enumerate(terms.items())]).first()
        total = {p: first[f"p_{k}"] or 0.0 for k, p in enumerate(terms)}
        down = {i: first[f"s{i}"] or 0.0 for i in inner}
        for i in reversed(inner):
            x = values[self.nodes[i].inputs[0]]
            if self.nodes[i].kind == "mean":
                per_row = F.lit(down[i])
                divide = df.agg(F.count(x).alias("n")).first()["n"]
            else:
                stats = df.agg(F.avg(x).alias("m"), F.count(x).alias("n")).first()
                per_row = F.lit(down[i]) * (x - F.lit(stats["m"])) / F.lit(got[i])
                divide = max(1, stats["n"] - 1)
            gs = self.backward(values, per_row, upto=self.nodes[i].inputs[0])
            cols = [F.sum(g).alias(f"p{k}") if g is not None else F.lit(0.0).alias(f"p{k}") for k, g in enumerate(gs) if self.nodes[k].kind == "param" or k in down]
            keys = [k for k in range(len(gs)) if self.nodes[k].kind == "param" or k in down]
            row = df.agg(*cols).first()
            for k, v in zip(keys, row):
                if self.nodes[k].kind == "param":
                    total[self.nodes[k].name] += (v or 0.0) / divide
                elif k != i:
                    down[k] += (v or 0.0) / divide
        return first["loss"], {p: t / max(1, first["n"]) for p, t in total.items()}


FORWARD: dict[str, Callable] = {
    "add": N.add, "sub": N.sub, "mul": N.mul, "div": N.div, "min": N.minimum, "max": N.maximum, "lt": N.lt, "le": N.le, "gt": N.gt, "ge": N.ge,
    "abs": N.absolute, "exp": N.exp, "log": N.log, "neg": N.neg, "sqrt": N.sqrt, "select": N.select, "mean": None, "std": None,
}


def _sided(first):
    def f(g, y, a, b):
        return F.when(first(a, b), g).otherwise(F.lit(0.0)), F.when(first(a, b), F.lit(0.0)).otherwise(g)

    return f


_none = lambda g, y, *xs: [None] * len(xs)
BACKWARD: dict[str, Callable] = {
    "add": lambda g, y, a, b: (g, g),
    "sub": lambda g, y, a, b: (g, -g),
    "mul": lambda g, y, a, b: (g * b, g * a),
    "div": lambda g, y, a, b: (N.div(g, b), -N.div(g * y, b)),
    "min": _sided(lambda a, b: a <= b),
    "max": _sided(lambda a, b: a >= b),
    "lt": _none, "le": _none, "gt": _none, "ge": _none,
    "abs": lambda g, y, a: (g * F.signum(a),),
    "exp": lambda g, y, a: (g * y,),
    "log": lambda g, y, a: (N.div(g, a),),
    "neg": lambda g, y, a: (-g,),
    "sqrt": lambda g, y, a: (N.div(g, F.lit(2.0) * y),),
    "select": lambda g, y, a, b, c: (F.when(c, g).otherwise(F.lit(0.0)), F.when(c, F.lit(0.0)).otherwise(g), None),
}


def squared_error(target: Column) -> Callable[[Column], tuple[Column, Column]]:
    return lambda root: ((root - target) * (root - target), F.lit(2.0) * (root - target))


class Adam:
    def __init__(self, rate: float, beta1: float = 0.9, beta2: float = 0.999, epsilon: float = 1e-8):
        self.rate, self.b1, self.b2, self.eps, self.t = rate, beta1, beta2, epsilon, 0
        self.m: dict[str, float] = {}
        self.v: dict[str, float] = {}

    def step(self, params: dict[str, float], grads: dict[str, float], scale: float = 1.0) -> dict[str, float]:
        self.t += 1
        out = dict(params)
        for p, g in grads.items():
            self.m[p] = self.b1 * self.m.get(p, 0.0) + (1 - self.b1) * g
            self.v[p] = self.b2 * self.v.get(p, 0.0) + (1 - self.b2) * g * g
            out[p] -= self.rate * scale * (self.m[p] / (1 - self.b1**self.t)) / (math.sqrt(self.v[p] / (1 - self.b2**self.t)) + self.eps)
        return out


class Sgd:
    def __init__(self, rate: float):
        self.rate = rate

    def step(self, params: dict[str, float], grads: dict[str, float], scale: float = 1.0) -> dict[str, float]:
        return {p: v - self.rate * scale * grads.get(p, 0.0) for p, v in params.items()}


@dataclass
class Fit:
    params: dict[str, float]
    losses: list[float]


def fit(graph: Graph, df: DataFrame, edges: dict[str, Column], target: Column, optimizer, epochs: int, initial: dict[str, float] | None = None, stop_below: float | None = None, schedule: Callable[[int], float] | None = None, seed: int = 0) -> Fit:
    """Minimise the mean squared error; parameters without an initial value start uniform in (0, 1)."""
    import random

    r = random.Random(seed)
    params = {p: (initial or {}).get(p, r.random()) for p in graph.parameter_names()}
    losses: list[float] = []
    for epoch in range(epochs):
        loss, grads = graph.gradients(df, edges, params, squared_error(target))
        if loss is None or math.isnan(loss) or any(math.isnan(g) for g in grads.values()):
            raise ArithmeticError(f"the loss or a gradient isn't a number at epoch {epoch}")
        losses.append(loss)
        if stop_below is not None and loss < stop_below:
            break
        params = optimizer.step(params, grads, schedule(epoch) if schedule else 1.0)
    return Fit(params, losses)


@dataclass
class Split:
    train: DataFrame
    test: DataFrame
    mean: float
    std: float


def train_test(samples: DataFrame, share: float = 0.8, scale_by: float = 1.0) -> Split:
    """The first ``share`` of samples (by ``n``) and the rest, with ``y``: the relative future move of the target,
    normalised by the training part's mean and unbiased deviation."""
    total = samples.count()
    move = N.div(F.col("target_future") - F.col("target"), F.col("target"))
    rows = samples.withColumn("move", move)
    cut = int(total * share)
    train, test = rows.where(F.col("n") < cut), rows.where(F.col("n") >= cut)
    stats = train.agg(F.avg("move").alias("m"), F.when(F.count("move") > 1, F.stddev_samp("move")).otherwise(F.lit(1.0)).alias("s")).first()
    y = (F.col("move") * scale_by - F.lit(stats["m"])) / F.lit(stats["s"] or 1.0)
    return Split(train.withColumn("y", y), test.withColumn("y", y), stats["m"], stats["s"])
