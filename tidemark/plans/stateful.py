"""Graphs with stateful components, compiled to stages over one event log.

The log has a row for each trigger: a call group's row holds the externals it writes, and each timer of the graph adds
rows of its own. Columns then hold outputs as they are *after* each row. Which outputs a row may write follows from its
trigger alone, so that is worked out on the graph:

* a column operator all of whose inputs are known at every row is a column of them, at every row;
* an output that some trigger reads without writing it is latched: the last written value, where a write may be of an
  invalid value. All outputs that wait for it are latched by one scan;
* a stateful operator ends a stage. The log so far is written to the shared folder, and the operator's ``stage`` takes
  the rows whose triggers call it and adds its outputs. Columns that nothing reads any more are left out;
* a costly column operator is worked out where it is read: in the rows that a stage is called by, that write what it
  goes into, or that are asked for. Where those read its last valid value, it is worked out in the rows that hold one of
  these, and in all rows that write it only if one of them is invalid.

An ephemeral output is valid only in rows that write it, or has its default.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import numeric as N
from tidemark.operators import book, decay, models, trades
from tidemark.operators.scan import DAY_US, Even, _equal, scan
from tidemark.plans.graph import Callset, Component, Definition, Output, OutputSpec, SignalGraph, _outputs
from tidemark.sources.scratch import materialize

#: The order of the log's rows within the keys: time, then timers before call groups, then their number.
ORDER = ["ts_us", "_rank", "seq"]


@dataclass
class Site:
    """What a stage gets: names of its inputs' columns (lists for arrays), those of its outputs, and its settings."""

    keys: list[str]
    inputs: dict[str, object]
    outputs: dict[str, str]
    params: dict
    block_us: int | Even


def _only(df: DataFrame, called: Column, make, site: Site) -> DataFrame:
    """``make`` of the rows that are called; the others write nothing."""
    made = make(df.where(called))
    rest = df.where(~called)
    for o in site.outputs.values():
        rest = rest.withColumn(o, F.lit(None).cast(made.schema[o].dataType))
    return made.select(*rest.columns).unionByName(rest)


def _written(value: Column, wrote: Column | None = None) -> Column:
    """A written value; NULL where nothing is written."""
    held = F.struct(value.alias("v"))
    return held if wrote is None else F.when(wrote, held)


# -- stages: each takes the rows that call it and adds a struct of the value for each output
def _tick_detector(rows: DataFrame, site: Site) -> DataFrame:
    named = rows.withColumns({"buy": F.col(site.inputs["buy"])})
    found = trades.tick_islands(named, site.keys, site.params["gap_us"], site.params["idle_us"], block_us=site.block_us)
    return found.withColumn(site.outputs["tick"], _written(F.lit(True), F.col("begins") & (F.col("island") > 1))).drop("buy", "island", "begins")


def _tick_aggregator(rows: DataFrame, site: Site) -> DataFrame:
    own = {n: F.col(site.inputs[n]) for n in ("price", "size", "buy", "fair")}
    named = rows.withColumns(own | {"begins": F.col(site.inputs["tick"]).isNotNull()})
    running = trades.tick_impulse(named, site.keys, site.params["size_weight"], site.params["distance_weight"], block_us=site.block_us)
    before = scan(running, site.keys, ORDER, {"_before": ("lag", F.col("running"))}, block_us=site.block_us)
    ended = _written(F.coalesce("_before", F.lit(0.0)), F.col("begins"))
    return before.withColumns({site.outputs["running"]: _written(F.col("running")), site.outputs["tick"]: ended}).drop(*own, "begins", "running", "_before")


def _summed(rows: DataFrame, site: Site, factor: Column, term: Column, output: str, valid: Column | None = None) -> DataFrame:
    numbered = scan(rows.withColumns({"_factor": factor, "_term": term}), site.keys, ORDER, {"n": ("count", F.lit(1))}, block_us=site.block_us)
    steps = materialize(numbered.withColumn("n", F.col("n") - 1).withColumnsRenamed({"_rank": "rank_", "_factor": "factor_", "_term": "term_"} | {c: f"kept{c}" for c in rows.columns if c.startswith("_") and c != "_rank"}), "steps")
    done = decay.running_sum_mixed(steps, site.keys, ["n"], F.col("factor_"), F.col("term_"), "y")
    back = done.withColumnsRenamed({"rank_": "_rank"} | {f"kept{c}": c for c in rows.columns if c.startswith("_") and c != "_rank"})
    y = F.col("y") if valid is None else F.when(valid, F.col("y"))
    return back.withColumn(site.outputs[output], _written(y)).drop("n", "y", "factor_", "term_")


def _running_sum(rows: DataFrame, site: Site) -> DataFrame:
    """Each valid decay multiplies, then a valid tick is added."""
    factor = reduce(lambda a, b: a * b, [F.coalesce(c, F.lit(1.0)) for c in site.inputs["decay"]], F.lit(1.0))
    return _summed(rows, site, factor, F.coalesce(F.col(site.inputs["tick"]), F.lit(0.0)), "running_sum")


def _ewma(rows: DataFrame, site: Site) -> DataFrame:
    """An invalid signal makes the average invalid; the next valid one begins it anew."""
    x = F.col(site.inputs["signal"])
    d = reduce(lambda a, b: a * b, [F.coalesce(c, F.lit(1.0)) for c in site.inputs["decay"]])
    before = scan(rows, site.keys, ORDER, {"_was": ("lag", x)}, block_us=site.block_us)
    first = F.col("_was").isNull()
    factor = F.when(x.isNull() | first, F.lit(0.0)).otherwise(d)
    term = F.when(x.isNull(), F.lit(0.0)).when(first, x).otherwise((1 - d) * x)
    return _summed(materialize(before, "ewma-log"), site, factor, term, "ewma", x.isNotNull()).drop("_was")


def _book_fair(rows: DataFrame, site: Site) -> DataFrame:
    named = rows.withColumns({n: F.col(site.inputs[n]) for n in ("side", "price", "size")})
    known = materialize(book.level_updates(named, site.keys, ORDER, site.block_us, every=True), "updates")
    unknown = "size = 0 and previous_size = 0"
    fair = book.book_fair(known.where(f"not ({unknown})"), site.keys, site.params["scale"], order=ORDER, block_us=site.block_us)
    out = site.outputs["fair"]
    fair = fair.withColumn(out, _written(F.col("fair"))).drop("fair")
    return fair.unionByName(known.where(unknown).withColumn(out, F.lit(None).cast(fair.schema[out].dataType))).drop("side", "price", "size", "previous_size")


def _book_updater(rows: DataFrame, site: Site) -> DataFrame:
    named = rows.select(*site.keys, *ORDER, *[F.col(site.inputs[n]).alias(n) for n in ("side", "price", "size")]).withColumnRenamed("_rank", "rank")
    order = ["ts_us", "rank", "seq"]
    books = book.snapshots(named, site.keys, site.params.get("levels"), order, site.block_us).withColumnRenamed("rank", "_rank").alias("b")
    on = reduce(lambda a, b: a & b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*site.keys, *ORDER]])
    found = rows.alias("a").join(books, on)
    return found.select("a.*", *[_written(F.col(f"b.{o}")).alias(n) for o, n in site.outputs.items()])


def _bucket_sampler(rows: DataFrame, site: Site) -> DataFrame:
    found = trades.bucket_sample(rows, site.keys, site.params.get("weight", 1.0), site.params.get("initial", 10.0), block_us=site.block_us)
    return found.withColumn(site.outputs["should_sample"], _written(F.col("should_sample"))).drop("should_sample")


def _valid(rows: DataFrame, site: Site) -> DataFrame:
    x = F.col(site.inputs["value"])
    return rows.withColumn(site.outputs["out"], _written(x, x.isNotNull()))


def _decay_fires(log: DataFrame, site: Site) -> DataFrame:
    grid = decay.decay_grid(log, site.keys, site.params["half_life_us"])
    return grid.select(*site.keys, "ts_us", F.col("k").alias("seq"), _written(F.col("decay")).alias(site.outputs["decay"]))


def _of(*names: str) -> frozenset:
    return frozenset(names)


def stateful_definitions() -> dict[str, Definition]:
    """The stateful components; ``hold``, a value as it was in the last row that wrote ``on``; and ``valid``, the last
    valid value."""
    gone = OutputSpec(ephemeral=True, assume_invalid=True)
    out = [
        Definition("exp_decay_source", (), {"decay": OutputSpec(ephemeral=True, always_valid=True, assume_default=True, default=1.0)}, timer=Callset(_of(), outputs=_of("decay")), timer_rows=_decay_fires, differentiable=False),
        Definition("tick_detector", ("buy",), {"tick": gone}, callsets=(Callset(_of("buy"), outputs=_of("tick")),), stage=_tick_detector, differentiable=False),
        Definition(
            "tick_aggregator", ("price", "size", "buy", "fair", "tick"), {"running": OutputSpec(), "tick": gone},
            callsets=(Callset(_of("price", "size", "buy"), _of("fair"), _of("running"), "trade"), Callset(_of("tick"), outputs=_of("running", "tick"), name="tick")),
            groups=(("tick", "trade"),), stage=_tick_aggregator, differentiable=False,
        ),
        Definition(
            "running_sum", ("tick", "decay"), {"running_sum": OutputSpec(always_valid=True)}, arrays=_of("decay"),
            callsets=(Callset(_of("tick"), name="tick"), Callset(_of("decay"), name="decay")), groups=(("decay", "tick"),), stage=_running_sum, differentiable=False,
        ),
        Definition("ewma", ("signal", "decay"), {"ewma": OutputSpec()}, arrays=_of("decay"), callsets=(Callset(_of("decay"), _of("signal")),), stage=_ewma, differentiable=False),
        Definition("book_fair", ("side", "price", "size"), {"fair": OutputSpec()}, callsets=(Callset(_of("side", "price", "size")),), stage=_book_fair, differentiable=False),
        Definition("book_updater", ("side", "price", "size"), {"bids": gone, "asks": gone}, callsets=(Callset(_of("side", "price", "size")),), stage=_book_updater, differentiable=False),
        Definition("bucket_sampler", ("trade",), {"should_sample": gone}, callsets=(Callset(_of("trade")),), stage=_bucket_sampler, differentiable=False),
        Definition("valid", ("value",), {"out": OutputSpec()}, callsets=(Callset(_of("value")),), stage=_valid, differentiable=False),
        Definition("hold", ("value", "on"), {"out": OutputSpec()}, lambda i, g, p: i["value"], callsets=(Callset(_of("on"), _of("value")),), differentiable=False),
    ]
    return {d.name: d for d in out}


class _Run:
    """The evaluation of one graph over one log."""

    def __init__(self, graph: SignalGraph, log: DataFrame, keys: list[str], outputs: Sequence[Output], at: Sequence[str], params: dict[str, float], block_us: int | Even, only: Output | None = None):
        self.graph, self.keys, self.params, self.block_us, self.at, self.only = graph, keys, params, block_us, at, only
        asked = [*outputs, *([] if only is None else [only])]
        self.asked = {o.key for o in asked}
        self.early = set() if only is None else {k.split("::")[0] for k in graph._needed([only])}
        self.needed = graph._needed(asked)
        self.nodes = sorted((n for n in graph.order() if any(k.startswith(f"{n}::") for k in self.needed)), key=lambda n: n not in self.early)
        self.readers: dict[str, list[str]] = {}
        for n in self.nodes:
            for o in _outputs(graph.components[n]):
                self.readers.setdefault(o.key, []).append(n)
        triggers = [t for t in graph.triggers() if t in graph.call_groups or t in self.nodes]
        self.writers: dict[str, list[str]] = {}
        for t in triggers:
            for k in graph.writes(t):
                self.writers.setdefault(k, []).append(t)
        self.stored = graph.stored() | {o.key for o in asked if not graph._spec(o).ephemeral and set(at) - set(self.writers.get(o.key, []))}
        self.names: dict[str, str] = {}
        self.columns: dict[str, Column] = {}
        self.literals: dict[str, Column] = {}
        self.waiting: dict[str, Column] = {}
        self.kept: set[str] = set()  # keys whose columns hold the value at every row
        self.done: set[str] = set()
        self.lazy: dict[str, bool] = {}  # column operators that aren't worked out yet: whether they follow kept inputs
        self.late: dict[str, DataFrame] = {}  # keys whose columns hold a number, and their values by it
        self._restart(self._log(log))

    def name(self, key: str) -> str:
        return self.names.setdefault(key, f"_v{len(self.names)}")

    def _part(self, n: str) -> tuple[Component, Definition]:
        c = self.graph.components[n]
        return c, self.graph.definitions[c.definition]

    def _log(self, log: DataFrame) -> DataFrame:
        used = [k for k in sorted(self.needed) if k.startswith("external::")]
        groups = {n: i + 1 for i, n in enumerate(self.graph.call_groups)}
        rank = F.coalesce(*[F.when(F.col("trigger") == n, F.lit(i)) for n, i in groups.items()])
        out = log.select(*self.keys, "ts_us", rank.alias("_rank"), "seq", "trigger", *[F.col(f"`{k[10:]}`").alias(self.name(k)) for k in used])
        for k in used:
            self._place(k, F.col(self.name(k)), self.graph._spec(Output(self.graph, *k.split("::"))))
        for n in self.nodes:
            c, d = self._part(n)
            if d.timer_rows is None:
                continue
            names = {o: self.name(f"{n}::{o}") for o in d.outputs}
            of = log.where(F.col("trigger") == c.params["on"]) if "on" in c.params else log
            fires = d.timer_rows(of, Site(self.keys, {}, names, c.params, self.block_us))
            out = out.unionByName(fires.withColumns({"_rank": F.lit(0), "trigger": F.lit(n)}), allowMissingColumns=True)
            for o, spec in d.outputs.items():
                self._place(f"{n}::{o}", None, spec, F.col(names[o]))
        return out

    def wrote(self, key: str) -> Column:
        return F.col("trigger").isin(self.writers.get(key, []))

    def _latched(self, key: str, spec: OutputSpec) -> bool:
        return key in self.stored and not spec.ephemeral and not spec.assume_invalid

    def _place(self, key: str, value: Column | None, spec: OutputSpec, held: Column | None = None) -> None:
        """Note how an output is read: a value, or a struct ``held`` that is NULL where nothing is written."""
        if self._latched(key, spec):
            self.waiting[key] = _written(value, self.wrote(key)) if held is None else held
            return
        value = held["v"] if held is not None else value
        if spec.assume_default or (spec.always_valid and spec.default is not None):
            value = F.coalesce(value, F.lit(spec.default))
        self.columns[key] = value

    def _restart(self, df: DataFrame, table: bool = False) -> None:
        """Go on with a frame whose columns are named, perhaps a table; intermediate ones are left behind."""
        self.stages, self.table = models._Stages(df), table

    def _live(self) -> set[str]:
        """Keys that are still to be read."""
        live = set(self.asked)
        for n in reversed(self.nodes):
            if n not in self.done or (n in self.lazy and any(f"{n}::{o}" in live for o in self._part(n)[1].outputs)):
                live |= {o.key for o in _outputs(self.graph.components[n])}
        return live

    def _frame(self) -> DataFrame:
        """The log so far: base columns and what is still to be read."""
        live = self._live()
        for held in (self.columns, self.waiting):
            for k in held.keys() - live:
                del held[k]
        made = {self.name(k): c for k, c in [*self.columns.items(), *self.waiting.items()]}
        df = self.stages.df.select(*self.keys, *ORDER, "trigger", *[c.alias(n) for n, c in made.items()])
        for held in (self.columns, self.waiting):
            held.update({k: F.col(self.name(k)) for k in held})
        return df

    def _cut(self) -> DataFrame:
        """The same as a table, or as little more than one."""
        cheap = self.table and not self.stages.made
        df = self._frame()
        return df if cheap else materialize(df, "graph-log")

    def _is_lazy(self, o: Output) -> bool:
        return o.parent in self.lazy and o.key not in self.columns

    def read(self, o: Output) -> Column:
        if o.key in self.waiting:
            df = self._cut()
            specs = {self.name(k): ("last", F.col(self.name(k))) for k in self.waiting}
            self._restart(scan(df, self.keys, ORDER, specs, block_us=self.block_us))
            for k in list(self.waiting):
                del self.waiting[k]
                self.kept.add(k)
                spec, value = self.graph._spec(Output(self.graph, *k.split("::"))), F.col(self.name(k))["v"]
                self.columns[k] = F.coalesce(value, F.lit(spec.default)) if spec.default is not None else value
        if self._is_lazy(o):
            del self.lazy[o.parent]
            self._column(o.parent)
        return self.literals[o.key] if o.key in self.literals else self.columns[o.key]

    def _ready(self, o: Output) -> None:
        """Do the scans that a value, or what a lazy one is worked out from, waits for."""
        if self._is_lazy(o):
            for x in _outputs(self.graph.components[o.parent]):
                self._ready(x)
        else:
            self.read(o)

    def _each(self, c: Component, of) -> dict:
        return {k: [of(o) for o in v] if isinstance(v, (list, tuple)) else of(v) for k, v in c.inputs.items()}

    def _lowered(self, n: str, inputs: dict, stages: models._Stages) -> dict[str, Column]:
        c, d = self._part(n)
        models._open.append(stages)
        try:
            made = d.lower(inputs, c.generics, c.params)
            made = made if isinstance(made, dict) else {next(iter(d.outputs)): made}
            return dict(zip(made, stages.let(list(made.values()))))
        finally:
            models._open.pop()

    def _follows(self, n: str) -> bool:
        """Whether an operator's inputs keep their values, so that its outputs are known at every row."""
        c, d = self._part(n)
        return d.generic is not None and all(o.key in self.kept or o.key in self.waiting for o in _outputs(c))

    def _work_out(self, rows: DataFrame, outputs: Sequence[Output]) -> DataFrame:
        """Rows of the log as :meth:`_cut` has it, with the values of lazy outputs as columns of their names."""
        stages, made = models._Stages(rows), {}

        def value(o: Output) -> Column:
            if not self._is_lazy(o):
                return self.read(o)
            if o.key not in made:
                for name, x in self._lowered(o.parent, self._each(self.graph.components[o.parent], value), stages).items():
                    key, spec = f"{o.parent}::{name}", self._part(o.parent)[1].outputs[name]
                    x = x if self.lazy[o.parent] and not spec.ephemeral else F.when(self.wrote(key), x)
                    some = spec.assume_default or (spec.always_valid and spec.default is not None)
                    made[key] = F.coalesce(x, F.lit(spec.default)) if some else x
            return made[o.key]

        found = {self.name(o.key): value(o) for o in outputs}
        return stages.df.select(*[c for c in rows.columns if c not in found], *[v.alias(n) for n, v in found.items()])

    def _work_out_at(self, outputs: Sequence[Output], triggers: Sequence[str]) -> None:
        """Columns of lazy outputs, NULL in the rows of other triggers."""
        for o in outputs:
            self._ready(o)
        df, called = self._cut(), F.col("trigger").isin(sorted(triggers))
        made = self._work_out(df.where(called), outputs)
        rest = df.where(~called).withColumns({n: F.lit(None).cast(made.schema[n].dataType) for n in map(self.name, dict.fromkeys(o.key for o in outputs))})
        self._restart(made.unionByName(rest))
        self.columns |= {o.key: F.col(self.name(o.key)) for o in outputs}

    def node(self, n: str) -> None:
        if n in self.done:
            return
        c, d = self._part(n)
        if d.timer_rows is not None:
            pass
        elif c.definition == "parameter":
            if n not in self.params and c.params.get("required"):
                raise ValueError(f"parameter {n} has no value")
            self._fixed(n, float(self.params.get(n, 0.0)))
        elif c.definition == "constant":
            self._fixed(n, c.params["value"])
        elif c.definition in ("mean", "std"):
            self._summaries(c.inputs["a"])
        elif d.stage is None:
            self._column(n)
        elif not (c.definition == "valid" and self._latest(n)):
            lazy = [o for o in _outputs(c) if self._is_lazy(o)]
            if lazy:
                self._work_out_at(lazy, self._callers(n))
            self._stage(n)
            for o in lazy:  # known in these rows only
                self.columns.pop(o.key, None)
        self.done.add(n)

    def _fixed(self, n: str, value) -> None:
        self.literals[f"{n}::out"] = F.lit(value)
        self.kept.add(f"{n}::out")

    def _callers(self, n: str) -> list[str]:
        return sorted({t for o in self._part(n)[1].outputs for t in self.writers.get(f"{n}::{o}", [])})

    def _summaries(self, a: Output) -> None:
        """All summaries of one output, by one aggregate."""
        some = self._is_lazy(a)
        if some:
            self._work_out_at([a], self.writers.get(a.key, []))
        else:
            self.read(a)
        self._restart(self._cut(), table=True)
        x = F.when(self.wrote(a.key), self.read(a))
        own = [n for n in self.nodes if self.graph.components[n].definition in ("mean", "std") and self.graph.components[n].inputs["a"] == a]
        found = self.stages.df.agg(*[self.graph._summary(n, x).alias(f"x{i}") for i, n in enumerate(own)]).first()
        for i, n in enumerate(own):
            self._fixed(n, found[i])
            self.done.add(n)
        if some and a.key in self.kept:  # known in the rows that write it only
            del self.columns[a.key]

    def _column(self, n: str) -> None:
        c, d = self._part(n)
        follows, outputs = self._follows(n), _outputs(c)
        lazy = [o for o in outputs if self._is_lazy(o)]
        latched = not follows and any(self._latched(f"{n}::{o}", s) for o, s in d.outputs.items())
        if n not in self.done and not latched and (d.costly or lazy or any(o.key in self.late for o in outputs)):
            self.lazy[n] = follows
            self.kept |= {f"{n}::{o}" for o, s in d.outputs.items() if follows and not s.ephemeral}
            return
        if lazy and not follows:
            self._work_out_at(lazy, self._callers(n))
        for o in outputs:  # all scans first: they give the columns new homes
            self.read(o)
        for o, value in self._lowered(n, self._each(c, self.read), self.stages).items():
            key, spec = f"{n}::{o}", d.outputs[o]
            if follows and not spec.ephemeral:  # follows its inputs, which keep their values
                self.columns[key] = value if not spec.assume_default else F.coalesce(value, F.lit(spec.default))
                self.kept.add(key)
            else:
                self._place(key, F.when(self.wrote(key), value), spec)
        if not follows:
            for o in lazy:  # known in these rows only
                self.columns.pop(o.key, None)

    def _stage(self, n: str) -> None:
        c, d = self._part(n)
        for o in _outputs(c):
            self.read(o)
        df = self._cut()
        names = {o: self.name(f"{n}::{o}") for o in d.outputs}
        inputs = {k: [self.read(o) for o in v] if isinstance(v, (list, tuple)) else self.name(v.key) for k, v in c.inputs.items()}
        single = [v for v in c.inputs.values() if isinstance(v, Output)]
        df = df.withColumns({self.name(v.key): self.literals[v.key] for v in single if v.key in self.literals})
        for v in single:
            if self.name(v.key) not in df.columns:
                raise ValueError(f"{n}: {v.key} has no column")
        site = Site(self.keys, inputs, names, c.params, self.block_us)
        called = F.col("trigger").isin(self._callers(n))
        self._restart(materialize(_only(df, called, lambda rows: d.stage(rows, site), site), "graph-log"), table=True)
        for o, spec in d.outputs.items():
            self._place(f"{n}::{o}", None, spec, F.col(names[o]))

    def _asked_rows(self) -> Column:
        at = F.col("trigger").isin(list(self.at))
        return at if self.only is None else at & F.coalesce(self.read(self.only), F.lit(False))

    def _at_the_end(self, key: str) -> bool:
        """Whether an output is read by column operators that lead to what is asked for, and by nothing else."""
        for r in self.readers.get(key, []):
            d = self._part(r)[1]
            if d.lower is None or d.generic is None or any(f"{r}::{o}" in self.stored or not self._at_the_end(f"{r}::{o}") for o in d.outputs):
                return False
        return True

    def _latest(self, n: str) -> bool:
        """The last valid value of a lazy input that only the rows that are asked for read: rows that may write one are
        numbered, and it is worked out in those whose number one of them has. False if that doesn't do."""
        x, key = self.graph.components[n].inputs["value"], f"{n}::out"
        if not self._is_lazy(x) or n in self.early or not self._at_the_end(key):
            return False
        self._ready(x)
        if self.only is not None:
            self.read(self.only)
        df = self._cut()
        made, d = self._part(x.parent)
        known = [self.columns[o.key] for o in _outputs(made) if o.key in self.columns] if d.strict else []
        may = reduce(lambda a, b: a & b, [k.isNotNull() for k in known], F.col("trigger").isin(self._callers(n)))
        number = self.name(key)
        self.done.add(n)  # what only its input is worked out from isn't carried on
        narrow = [self.name(k) for k in [*self.columns, *self.waiting] if k in self._live()]
        self.done.discard(n)
        numbered = df.withColumn("_may", may).select(*self.keys, *ORDER, "trigger", "_may", *narrow)
        numbered = materialize(scan(numbered, self.keys, ORDER, {number: ("sum", F.col("_may").cast("long"))}, block_us=self.block_us), "graph-log")
        asked = numbered.where(self._asked_rows()).select(*self.keys, number).distinct()
        own = numbered.where("_may").select(*self.keys, *ORDER, number).alias("a").join(asked.alias("b"), _equal("a", "b", [*self.keys, number]), "left_semi")
        found = df.where(may).alias("a").join(own.alias("b"), _equal("a", "b", [*self.keys, *ORDER])).select("a.*", F.col(f"b.{number}").alias(number))
        value = self.name(x.key)
        found = materialize(self._work_out(found, [x]).select(*self.keys, number, value), "graph-latest")
        if found.where(F.col(value).isNull()).limit(1).count():
            self._restart(df, table=True)
            return False
        self._restart(numbered, table=True)
        self.columns[key], self.late[key] = F.col(number), found.withColumnRenamed(value, "_value")
        self.kept.add(key)
        return True

    def finish(self, outputs: dict[str, Output]) -> DataFrame:
        for o in outputs.values():
            self._ready(o)
        asked = self._asked_rows()
        if not self.late and not any(self._is_lazy(o) for o in outputs.values()):
            rows, columns = self.stages.df.where(asked), {name: self.read(o) for name, o in outputs.items()}
        else:
            self.stages.df = self.stages.df.where(asked)
            rows = materialize(self._frame(), "graph-asked")
            for key, found in self.late.items():
                number = self.name(key)
                both = rows.alias("a").join(found.alias("b"), _equal("a", "b", [*self.keys, number]), "left")
                rows = both.select(*[F.col(f"a.{c}") for c in rows.columns if c != number], F.col("b._value").alias(number))
            if self.late:
                rows = materialize(rows, "graph-asked")
            rows = self._work_out(rows, [o for o in outputs.values() if self._is_lazy(o)])
            columns = {name: F.col(self.name(o.key)) if self._is_lazy(o) else self.read(o) for name, o in outputs.items()}
        return rows.select(*self.keys, "ts_us", "seq", "trigger", *[c.alias(name) for name, c in columns.items()])


def run(graph: SignalGraph, log: DataFrame, keys: list[str], outputs: dict[str, Output], at: Sequence[str], params: dict[str, float] | None = None, block_us: int | Even = DAY_US, only: Output | None = None) -> DataFrame:
    """keys, ts_us, seq, trigger and the outputs, as they are after each row whose trigger is one of ``at``, and in which
    the output ``only`` is true if one is given.

    ``log`` has the keys, ts_us, seq, trigger (a call group's name) and the externals that the row writes, by name. Rows
    of one time go by timers first, then call groups in the order they were added, then seq.
    """
    graph.validate()
    unknown = set(at) - set(graph.call_groups)
    if unknown:
        raise ValueError(f"no call group {', '.join(sorted(unknown))}")
    going = _Run(graph, log, keys, list(outputs.values()), at, params or {}, block_us, only)
    for n in going.nodes:
        going.node(n)
    return going.finish(outputs)
