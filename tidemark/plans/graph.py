"""Signal graphs: the builder, its validation, trigger analysis, lowering to columns, and (de)serialisation.

A graph is a DAG of components. Each has an operator (its Definition), inputs that are outputs of other components
or externals, parameters and options. Equal components (operator, inputs, generics, parameters) are one. Lowering
turns outputs into Spark columns over the event log's columns.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import numeric as N


@dataclass(frozen=True)
class OutputSpec:
    """A stored output keeps its value between triggers; an ephemeral one lives in the trigger that wrote it."""

    type: str = "double"
    ephemeral: bool = False
    always_valid: bool = False
    assume_invalid: bool = False
    assume_default: bool = False
    default: object = None


@dataclass(frozen=True)
class Callset:
    """Runs when every input in ``written`` was written; also reads ``observes``, writes ``outputs``."""

    written: frozenset
    observes: frozenset = frozenset()
    outputs: frozenset = frozenset()
    name: str | None = None


@dataclass
class Definition:
    """An operator: inputs (names; those in ``arrays`` take lists), outputs, callsets and its column form.

    A stateful one has a ``stage`` instead, which adds its outputs to the event log (see ``plans.stateful``); one with a
    timer has ``timer_rows``, which make the log's rows for its fires. A ``costly`` column form is worked out in the rows
    that read it only; an invalid input, or an invalid one in an array, makes all outputs of a ``strict`` one invalid.
    """

    name: str
    inputs: tuple[str, ...]
    outputs: dict[str, OutputSpec]
    lower: Callable | None = None
    arrays: frozenset = frozenset()
    optional: frozenset = frozenset()
    generic: Callset | None = None
    callsets: tuple[Callset, ...] = ()
    groups: tuple[tuple[str, ...], ...] = ()
    timer: Callset | None = None
    generics: tuple[str, ...] = ()
    differentiable: bool = True
    stage: Callable | None = None
    timer_rows: Callable | None = None
    costly: bool = False
    strict: bool = False

    def validate(self) -> None:
        known = set(self.inputs)
        if len(known) != len(self.inputs):
            raise ValueError(f"{self.name}: inputs repeat")
        if not self.outputs:
            raise ValueError(f"{self.name}: no output")
        every = [*self.callsets, *([self.generic] if self.generic else []), *([self.timer] if self.timer else [])]
        for c in every:
            if c.written - known or c.observes - known:
                raise ValueError(f"{self.name}: a callset names an unknown input")
            if c.outputs - set(self.outputs):
                raise ValueError(f"{self.name}: a callset names an unknown output")
            if c.written & c.observes:
                raise ValueError(f"{self.name}: an input is both written and observed")
        names = [c.name for c in self.callsets if c.name]
        if len(set(names)) != len(names):
            raise ValueError(f"{self.name}: callset names repeat")
        if len({c.written for c in self.callsets}) != len(self.callsets):
            raise ValueError(f"{self.name}: two callsets for the same inputs")
        for g in self.groups:
            if set(g) - set(names) or len(set(g)) != len(g):
                raise ValueError(f"{self.name}: a group names unknown callsets")
        for n, o in self.outputs.items():
            if o.always_valid and o.assume_invalid:
                raise ValueError(f"{self.name}.{n}: can't be always valid and assumed invalid")
            if o.assume_default and o.assume_invalid:
                raise ValueError(f"{self.name}.{n}: can't be assumed invalid and default")
            if o.assume_default and o.default is None:
                raise ValueError(f"{self.name}.{n}: needs a default value")
            if o.ephemeral and o.always_valid and not (o.assume_default or o.default is not None):
                raise ValueError(f"{self.name}.{n}: an ephemeral output that is always valid needs a default")


def find_callsets(definition: Definition, written: frozenset) -> list[Callset]:
    """Callsets that run when ``written`` inputs were written, in order.

    A callset matches if all its inputs were written. One match runs; several need names and a group of exactly
    those names, which gives the order; none falls back on the generic callset.
    """
    found = [c for c in definition.callsets if c.written and c.written <= written]
    if len(found) == 1:
        return found
    if not found:
        if definition.generic is None:
            raise ValueError(f"{definition.name}: nothing to call for {sorted(written)}")
        return [definition.generic]
    if any(c.name is None for c in found):
        raise ValueError(f"{definition.name}: several callsets match {sorted(written)} and one has no name")
    by_name = {c.name: c for c in found}
    for g in definition.groups:
        if set(g) == set(by_name):
            return [by_name[n] for n in g]
    raise ValueError(f"{definition.name}: no group orders {sorted(by_name)}")


class Output:
    """An output of a component, with operators that add components to its graph."""

    def __init__(self, graph: SignalGraph, parent: str, name: str = "out"):
        self.graph, self.parent, self.name = graph, parent, name

    @property
    def key(self) -> str:
        return f"{self.parent}::{self.name}"

    def _op(self, op: str, *others, swap: bool = False) -> Output:
        args = [self, *[o if isinstance(o, Output) else self.graph.make_constant(o) for o in others]]
        return self.graph.op(op, *(args[::-1] if swap else args))

    def __add__(self, o):
        return self._op("add", o)

    def __radd__(self, o):
        return self._op("add", o, swap=True)

    def __sub__(self, o):
        return self._op("sub", o)

    def __rsub__(self, o):
        return self._op("sub", o, swap=True)

    def __mul__(self, o):
        return self._op("mul", o)

    def __rmul__(self, o):
        return self._op("mul", o, swap=True)

    def __truediv__(self, o):
        return self._op("div", o)

    def __rtruediv__(self, o):
        return self._op("div", o, swap=True)

    def __neg__(self):
        return self._op("neg")

    def __lt__(self, o):
        return self._op("lt", o)

    def __le__(self, o):
        return self._op("le", o)

    def __gt__(self, o):
        return self._op("gt", o)

    def __ge__(self, o):
        return self._op("ge", o)

    def equals(self, o):
        return self._op("eq", o)

    def __getitem__(self, n: int):
        if not isinstance(n, int) or n < 0:
            raise ValueError("a static index is an int of at least 0")
        return self.graph.make_component("index", {"a": self}, generics={"N": str(n)}).output()

    def __hash__(self):
        return hash((id(self.graph), self.key))

    def __eq__(self, other):
        return isinstance(other, Output) and self.graph is other.graph and self.key == other.key


@dataclass
class Component:
    name: str
    definition: str
    inputs: dict[str, object]
    generics: dict[str, str] = field(default_factory=dict)
    params: dict[str, object] = field(default_factory=dict)
    force_stored: bool = False
    block_propagation: bool = False
    graph: object = None

    def output(self, name: str = "out") -> Output:
        if name not in self.graph.definitions[self.definition].outputs:
            raise ValueError(f"{self.name} has no output {name}")
        self.graph.used.add(self.name)
        return Output(self.graph, self.name, name)


def _binary(name, f, type_="double"):
    return Definition(name, ("a", "b"), {"out": OutputSpec(type_)}, lambda i, g, p: f(i["a"], i["b"]), generic=Callset(frozenset(), frozenset({"a", "b"}), frozenset({"out"})))


def _unary(name, f):
    return Definition(name, ("a",), {"out": OutputSpec()}, lambda i, g, p: f(i["a"]), generic=Callset(frozenset(), frozenset({"a"}), frozenset({"out"})))


def standard_definitions() -> dict[str, Definition]:
    out = [_binary(n, getattr(N, n)) for n in ("add", "sub", "mul", "div")]
    out += [_binary("min", N.minimum), _binary("max", N.maximum)]
    out += [_binary(n, getattr(N, n), "bool") for n in ("lt", "le", "gt", "ge", "eq")]
    out += [_unary("abs", N.absolute), _unary("exp", N.exp), _unary("log", N.log), _unary("neg", N.neg), _unary("sqrt", N.sqrt)]
    out.append(Definition("select", ("a", "b", "choose"), {"out": OutputSpec()}, lambda i, g, p: N.select(i["a"], i["b"], i["choose"]), generic=Callset(frozenset(), frozenset({"a", "b", "choose"}), frozenset({"out"}))))
    out.append(Definition("index", ("a",), {"out": OutputSpec()}, lambda i, g, p: N.index(i["a"], int(g["N"])), generics=("N",), differentiable=False, generic=Callset(frozenset(), frozenset({"a"}), frozenset({"out"}))))
    out.append(Definition("constant", (), {"out": OutputSpec(always_valid=True)}, lambda i, g, p: F.lit(p["value"]), generic=Callset(frozenset(), outputs=frozenset({"out"}))))
    out.append(Definition("parameter", (), {"out": OutputSpec(always_valid=True)}, None, generic=Callset(frozenset(), outputs=frozenset({"out"}))))
    out.append(Definition("triggered_constant", ("tick",), {"out": OutputSpec(ephemeral=True, assume_invalid=True)}, lambda i, g, p: N.triggered_constant(p["value"], i["tick"]), differentiable=False, generic=Callset(frozenset(), frozenset({"tick"}), frozenset({"out"}))))
    out += [Definition(n, ("a",), {"out": OutputSpec(always_valid=True)}, None, generic=Callset(frozenset(), frozenset({"a"}), frozenset({"out"}))) for n in ("mean", "std")]
    out.append(Definition("ephemeral_sum", ("a",), {"out": OutputSpec(ephemeral=True, assume_default=True, default=0.0)}, lambda i, g, p: N.ephemeral_sum(i["a"]), arrays=frozenset({"a"}), differentiable=False, generic=Callset(frozenset(), frozenset({"a"}), frozenset({"out"}))))
    return {d.name: d for d in out}


class SignalGraph:
    """Builder of a graph."""

    def __init__(self, definitions: dict[str, Definition] | None = None):
        self.definitions = standard_definitions()
        self.externals: dict[str, dict] = {}
        self.components: dict[str, Component] = {}
        self.call_structs: dict[str, dict[str, str]] = {}
        self.call_groups: dict[str, dict[str, str]] = {}
        self.index: dict[str, str] = {}
        self.used: set[str] = set()
        for d in (definitions or {}).values():
            self.add_definition(d)

    # -- building
    def add_definition(self, definition: Definition) -> None:
        definition.validate()
        if definition.name in self.definitions and self.definitions[definition.name] is not definition:
            raise ValueError(f"{definition.name} is defined already")
        self.definitions[definition.name] = definition

    def get_external(self, name: str, type: str = "double", must_trigger: bool = False) -> Output:
        known = self.externals.setdefault(name, {"type": type, "must_trigger": must_trigger})
        if known["type"] != type:
            raise ValueError(f"external {name} is a {known['type']}, not a {type}")
        known["must_trigger"] |= must_trigger
        return Output(self, "external", name)

    source = get_external

    def make_component(self, definition: str, inputs: dict[str, object] | None = None, name: str | None = None, generics: dict[str, str] | None = None, params: dict | None = None, force_stored: bool = False, block_propagation: bool = False) -> Component:
        if definition not in self.definitions:
            raise ValueError(f"no definition {definition}")
        d, inputs = self.definitions[definition], dict(inputs or {})
        if set(inputs) - set(d.inputs) or set(d.inputs) - set(inputs) - d.optional:
            raise ValueError(f"{definition} takes {d.inputs}, not {tuple(inputs)}")
        if set(generics or {}) != set(d.generics):
            raise ValueError(f"{definition} needs generics {d.generics}")
        for k, v in inputs.items():
            many = isinstance(v, (list, tuple))
            if many != (k in d.arrays):
                raise ValueError(f"{definition}.{k} takes {'a list' if k in d.arrays else 'one output'}")
            for o in v if many else [v]:
                if not isinstance(o, Output) or o.graph is not self:
                    raise ValueError(f"{definition}.{k}: not an output of this graph")
        key = json.dumps([definition, {k: [o.key for o in v] if isinstance(v, (list, tuple)) else v.key for k, v in sorted(inputs.items())}, generics or {}, params or {}], sort_keys=True, default=str)
        if key in self.index:
            found = self.components[self.index[key]]
            if name and name != found.name and not name.startswith("_"):
                if found.name.startswith("_"):
                    self.rename_component(found.name, name, quietly=True)
                else:
                    raise ValueError(f"{name} is the same as {found.name}")
            found.force_stored |= force_stored
            found.block_propagation |= block_propagation
            return found
        name = name or f"_{definition}_{len(self.components)}"
        if name in self.components or name == "external":
            raise ValueError(f"the name {name} is taken")
        made = Component(name, definition, inputs, dict(generics or {}), dict(params or {}), force_stored, block_propagation, self)
        self.components[name], self.index[key] = made, name
        return made

    def op(self, definition: str, *inputs, **more) -> Output:
        d = self.definitions[definition]
        return self.make_component(definition, dict(zip(d.inputs, inputs)), **more).output()

    def make_constant(self, value, name: str | None = None) -> Output:
        return self.make_component("constant", name=name, params={"value": value}).output()

    def make_triggered_constant(self, value, on: Output, name: str | None = None) -> Output:
        return self.make_component("triggered_constant", {"tick": on}, name=name, params={"value": value}).output()

    def make_parameter(self, name: str, required: bool = False, force_stored: bool = False) -> Output:
        if name in self.components:
            return self.components[name].output()
        return self.make_component("parameter", name=name, params={"name": name, "required": required}, force_stored=force_stored).output()

    def summarize(self, a: Output, kind: str, name: str | None = None) -> Output:
        if kind not in ("mean", "std"):
            raise ValueError("a summary is mean or std")
        return self.make_component(kind, {"a": a}, name=name).output()

    def rename_component(self, old: str, new: str, quietly: bool = False) -> None:
        """Not after the component has been used by another."""
        if new in self.components:
            raise ValueError(f"the name {new} is taken")
        if any(o.parent == old for c in self.components.values() for o in _outputs(c)):
            raise ValueError(f"{old} is in use")
        c = self.components.pop(old)
        c.name = new
        self.components[new] = c
        self.index = {k: (new if v == old else v) for k, v in self.index.items()}

    def lookup(self, name: str, output: str = "out") -> Output:
        if name not in self.components:
            raise KeyError(name)
        return self.components[name].output(output)

    def add_call_struct(self, name: str, fields: dict[str, str]) -> None:
        if name in self.call_structs and self.call_structs[name] != fields:
            raise ValueError(f"call struct {name} differs")
        self.call_structs[name] = dict(fields)

    def add_call_group(self, name: str, struct: str, mapping: dict[str, str]) -> None:
        """One trigger: the struct's fields write the mapped externals, whose types must be the same."""
        if struct not in self.call_structs:
            raise ValueError(f"no call struct {struct}")
        for f, external in mapping.items():
            if f not in self.call_structs[struct]:
                raise ValueError(f"{struct} has no field {f}")
            if external not in self.externals:
                raise ValueError(f"no external {external}")
            if self.call_structs[struct][f] != self.externals[external]["type"]:
                raise ValueError(f"{struct}.{f} and {external} have different types")
        if len(set(mapping.values())) != len(mapping):
            raise ValueError("an external is written twice")
        self.call_groups[name] = {"struct": struct, "mapping": dict(mapping)}

    def validate(self) -> None:
        for d in self.definitions.values():
            d.validate()
        written = {e for g in self.call_groups.values() for e in g["mapping"].values()}
        for name, e in self.externals.items():
            if e["must_trigger"] and name not in written:
                raise ValueError(f"no trigger writes {name}")
        self.order()

    # -- analysis
    def order(self) -> list[str]:
        """Components so that inputs come first."""
        done, out, open_ = set(), [], set()

        def visit(n):
            if n in done or n == "external":
                return
            if n in open_:
                raise ValueError(f"{n} depends on itself")
            if n not in self.components:
                raise ValueError(f"no component {n}")
            open_.add(n)
            for o in _outputs(self.components[n]):
                visit(o.parent)
            open_.discard(n)
            done.add(n)
            out.append(n)

        for n in self.components:
            visit(n)
        return out

    def called(self, externals: Sequence[str]) -> list[tuple[str, list[Callset]]]:
        """Components that a trigger writing ``externals`` calls, in order, with their callsets.

        A component is called if an input that one of its callsets is written by might have been written.
        """
        return self.called_from({f"external::{e}" for e in externals})

    def called_from(self, written: set[str]) -> list[tuple[str, list[Callset]]]:
        """The same for a trigger that writes the outputs of these keys, such as those of a timer."""
        written, out = set(written), []
        for name in self.order():
            c = self.components[name]
            d = self.definitions[c.definition]
            touched = frozenset(k for k, v in c.inputs.items() if any(o.key in written for o in (v if isinstance(v, (list, tuple)) else [v])))
            if not touched:
                continue
            triggers = frozenset().union(*[s.written for s in d.callsets]) if d.callsets else frozenset()
            if d.callsets and d.generic is None and not touched & triggers:
                continue
            sets = find_callsets(d, touched)
            out.append((name, sets))
            for s in sets:
                written |= {f"{name}::{o}" for o in (s.outputs or d.outputs)}
        return out

    def triggers(self) -> dict[str, set[str]]:
        """The keys that each trigger writes by itself: call groups by their names, timers by their components'."""
        out = {n: {f"external::{e}" for e in g["mapping"].values()} for n, g in self.call_groups.items()}
        for n, c in self.components.items():
            if (timer := self.definitions[c.definition].timer) is not None:
                out[n] = {f"{n}::{o}" for o in timer.outputs}
        return out

    def writes(self, trigger: str) -> set[str]:
        """All keys that a trigger may write, by itself or through what it calls."""
        keys = self.triggers()[trigger]
        return keys.union(*({f"{n}::{o}" for s in sets for o in (s.outputs or self.definitions[self.components[n].definition].outputs)} for n, sets in self.called_from(keys)))

    def stored(self) -> set[str]:
        """Outputs that must be latched: those that some trigger reads without having written them."""
        keep = {f"{n}::{o}" for n, c in self.components.items() for o, s in self.definitions[c.definition].outputs.items() if c.force_stored and not s.ephemeral}
        for keys in self.triggers().values():
            calls, fresh = self.called_from(keys), set(keys)
            for name, sets in calls:
                c = self.components[name]
                for o in _outputs(c):
                    if o.key not in fresh and not self._spec(o).ephemeral and not self._spec(o).assume_invalid and self._kind(o) not in ("constant", "parameter", "mean", "std"):
                        keep.add(o.key)
                for s in sets:
                    fresh |= {f"{name}::{o}" for o in (s.outputs or self.definitions[c.definition].outputs)}
        return keep

    def _kind(self, o: Output) -> str:
        return "external" if o.parent == "external" else self.components[o.parent].definition

    def _spec(self, o: Output) -> OutputSpec:
        return OutputSpec(self.externals[o.name]["type"]) if o.parent == "external" else self.definitions[self.components[o.parent].definition].outputs[o.name]

    # -- lowering
    def lower(self, outputs: Sequence[Output], params: dict[str, float] | None = None, externals: dict[str, Column] | None = None, summaries: dict[str, Column] | None = None, missing: float | None = 0.0) -> list[Column]:
        """Columns of the outputs over the externals' columns (by default those of the same names).

        A parameter without a value is ``missing``, unless it is required.
        """
        params, made = params or {}, {}

        def column(o: Output) -> Column:
            if o.key in made:
                return made[o.key]
            if o.parent == "external":
                col = (externals or {}).get(o.name, F.col(f"`{o.name}`"))
            else:
                c = self.components[o.parent]
                d = self.definitions[c.definition]
                if c.definition == "parameter":
                    if c.name in params:
                        value = params[c.name]
                    elif c.params.get("required") or missing is None:
                        raise ValueError(f"parameter {c.name} has no value")
                    else:
                        value = missing
                    col = value if isinstance(value, Column) else F.lit(float(value))
                elif c.definition in ("mean", "std"):
                    if c.name not in (summaries or {}):
                        raise ValueError(f"summary {c.name} has no value")
                    value = summaries[c.name]
                    col = value if isinstance(value, Column) else F.lit(float(value))
                elif d.lower is None:
                    raise ValueError(f"{c.definition} has no column form")
                else:
                    ins = {k: [column(x) for x in v] if isinstance(v, (list, tuple)) else column(v) for k, v in c.inputs.items()}
                    made_by = d.lower(ins, c.generics, c.params)
                    col = made_by[o.name] if isinstance(made_by, dict) else made_by
                spec = self._spec(o)
                if spec.assume_default or (spec.always_valid and spec.default is not None):
                    col = F.coalesce(col, F.lit(spec.default))
            made[o.key] = col
            return col

        for n in self.order():  # inputs first, so that a deep graph doesn't recurse deeply
            for o in self.definitions[self.components[n].definition].outputs:
                if f"{n}::{o}" in self._needed(outputs):
                    column(Output(self, n, o))
        return [column(o) for o in outputs]

    def _needed(self, outputs: Sequence[Output]) -> set[str]:
        key = tuple(o.key for o in outputs)
        if getattr(self, "_needed_for", None) != key:
            seen, todo = set(), list(outputs)
            while todo:
                o = todo.pop()
                if o.key in seen:
                    continue
                seen.add(o.key)
                if o.parent != "external":
                    todo.extend(_outputs(self.components[o.parent]))
            self._needed_for, self._needed_keys = key, seen
        return self._needed_keys

    def evaluate(self, df: DataFrame, outputs: dict[str, Output], params: dict[str, float] | None = None) -> DataFrame:
        """``df`` with the outputs; mean and std summaries are computed first, one aggregate for each level of them."""
        summaries: dict[str, float] = {}
        needed = self._needed(list(outputs.values()))
        left = [n for n in self.order() if self.components[n].definition in ("mean", "std") and f"{n}::out" in needed]
        while left:
            ready = [n for n in left if not self._needed([self.components[n].inputs["a"]]) & {f"{m}::out" for m in left}]
            columns = self.lower([self.components[n].inputs["a"] for n in ready], params, summaries=summaries)
            found = df.agg(*[self._summary(n, col).alias(f"x{i}") for i, (n, col) in enumerate(zip(ready, columns))]).first()
            summaries |= {n: found[f"x{i}"] for i, n in enumerate(ready)}
            left = [n for n in left if n not in summaries]
        return df.withColumns(dict(zip(outputs, self.lower(list(outputs.values()), params, summaries=summaries))))

    def _summary(self, n: str, col: Column) -> Column:
        if self.components[n].definition == "mean":
            return F.avg(col)
        return F.when(F.count(col) > 1, F.stddev_samp(col)).otherwise(F.lit(1.0))

    # -- files
    def to_dict(self) -> dict:
        comps = []
        for n in self.order():
            c = self.components[n]
            d = {k: v for k, v in asdict_shallow(c).items() if k not in ("graph", "inputs")}
            d["inputs"] = {k: [o.key for o in v] if isinstance(v, (list, tuple)) else v.key for k, v in c.inputs.items()}
            comps.append(d)
        return {"externals": self.externals, "components": comps, "call_structs": self.call_structs, "call_groups": self.call_groups}

    @classmethod
    def from_dict(cls, d: dict, definitions: dict[str, Definition] | None = None) -> SignalGraph:
        g = cls(definitions)
        for name, e in d["externals"].items():
            g.get_external(name, e["type"], e["must_trigger"])
        out = lambda key: Output(g, *key.split("::"))
        for c in d["components"]:
            inputs = {k: [out(x) for x in v] if isinstance(v, list) else out(v) for k, v in c["inputs"].items()}
            g.make_component(c["definition"], inputs, c["name"], c["generics"], c["params"], c["force_stored"], c["block_propagation"])
        for n, s in d["call_structs"].items():
            g.add_call_struct(n, s)
        for n, s in d["call_groups"].items():
            g.add_call_group(n, s["struct"], s["mapping"])
        return g

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=1)

    @classmethod
    def from_json(cls, text: str, definitions: dict[str, Definition] | None = None) -> SignalGraph:
        return cls.from_dict(json.loads(text), definitions)

    def parameters(self) -> dict[str, dict]:
        return {n: c.params for n, c in self.components.items() if c.definition == "parameter"}

    def dot(self, trigger: Sequence[str] | None = None) -> str:
        """Graphviz text. With a trigger, what it doesn't call or only observes is dashed."""
        called = None if trigger is None else {n for n, _ in self.called(trigger)}
        lines = ["digraph signals {"]
        for e in self.externals:
            lines.append(f'  "external::{e}" [shape=box{"" if trigger is None or e in trigger else ", style=dashed"}];')
        for n in self.order():
            c = self.components[n]
            lines.append(f'  "{n}" [label="{n}\\n{c.definition}"{"" if called is None or n in called else ", style=dashed"}];')
            for o in _outputs(c):
                tail = o.key if o.parent == "external" else o.parent
                seen = called is None or (o.parent in called if o.parent != "external" else o.name in trigger)
                lines.append(f'  "{tail}" -> "{n}"{"" if seen else " [style=dashed]"};')
        return "\n".join([*lines, "}"])


def _outputs(c: Component) -> list[Output]:
    return [o for v in c.inputs.values() for o in (v if isinstance(v, (list, tuple)) else [v])]


def asdict_shallow(c: Component) -> dict:
    return {k: getattr(c, k) for k in c.__dataclass_fields__}


_active: list[SignalGraph] = []


@contextmanager
def building(graph: SignalGraph):
    """Make ``graph`` the one that :func:`active` returns; not re-entrant."""
    if _active:
        raise ValueError("a graph is being built already")
    _active.append(graph)
    try:
        yield graph
    finally:
        _active.pop()


def active() -> SignalGraph:
    if not _active:
        raise ValueError("no graph is being built")
    return _active[0]
