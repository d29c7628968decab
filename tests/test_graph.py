import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import numeric as N
from tidemark.operators import models
from tidemark.plans import autodiff
from tidemark.plans.graph import Callset, Definition, OutputSpec, SignalGraph, active, building, find_callsets


def sets(*names):
    return frozenset(names)


TEST = Definition(
    "test", tuple("abcde"), {"out": OutputSpec()}, generic=Callset(frozenset(), sets("a", "b", "c")),
    callsets=(Callset(sets("a", "b"), name="ab"), Callset(sets("b", "c"), name="bc"), Callset(sets("c", "d"), name="cd"), Callset(sets("c", "d", "e"))),
    groups=(("bc", "ab"),),
)


def test_callset_resolution():
    TEST.validate()
    names = lambda w: [c.name for c in find_callsets(TEST, sets(*w))]
    assert names("ab") == ["ab"] and names("bc") == ["bc"] and names("abc") == ["bc", "ab"]
    assert all(find_callsets(TEST, sets(x)) == [TEST.generic] for x in "abc")
    for w in ("abcd", "cde"):
        with pytest.raises(ValueError):
            find_callsets(TEST, sets(*w))
    bare = Definition("bare", ("a", "b"), {"out": OutputSpec()}, callsets=(Callset(sets("a", "b")),))
    with pytest.raises(ValueError):
        find_callsets(bare, sets("a"))


@pytest.mark.parametrize("bad", [
    Definition("x", ("a", "a"), {"out": OutputSpec()}),
    Definition("x", ("a",), {}),
    Definition("x", ("a",), {"out": OutputSpec()}, callsets=(Callset(sets("z")),)),
    Definition("x", ("a",), {"out": OutputSpec()}, callsets=(Callset(sets("a"), sets("a")),)),
    Definition("x", ("a",), {"out": OutputSpec()}, callsets=(Callset(sets("a"), outputs=sets("q")),)),
    Definition("x", ("a",), {"out": OutputSpec(always_valid=True, assume_invalid=True)}),
    Definition("x", ("a",), {"out": OutputSpec(assume_default=True)}),
    Definition("x", ("a",), {"out": OutputSpec()}, groups=(("n",),)),
])
def test_bad_definitions(bad):
    with pytest.raises(ValueError):
        bad.validate()


def test_building():
    g = SignalGraph()
    a, b = g.get_external("a"), g.get_external("b")
    assert (a + b).key == (a + b).key and (a + b).key != (b + a).key
    named = g.make_component("mul", {"a": a, "b": b}, name="product")
    assert g.lookup("product").key == (a * b).key
    g.make_component("sub", {"a": a, "b": b}, name="first")
    g.rename_component("first", "second")
    assert "second" in g.components
    _ = -named.output()
    for wrong in (
        lambda: g.rename_component("product", "other"),
        lambda: g.make_component("nothing", {}),
        lambda: g.make_component("add", {"a": a}),
        lambda: g.make_component("add", {"a": a, "b": [b]}),
        lambda: g.make_component("add", {"a": a, "b": SignalGraph().get_external("b")}),
        lambda: g.make_component("add", {"a": a, "b": a}, name="product"),
        lambda: g.get_external("a", "bool"),
        lambda: a[-1],
        lambda: g.summarize(a, "median"),
    ):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(KeyError):
        g.lookup("nowhere")
    with building(g):
        assert active() is g
        with pytest.raises(ValueError), building(g):
            pass
    with pytest.raises(ValueError):
        active()


def test_triggers_and_files():
    g = SignalGraph()
    a, b, c = (g.get_external(x, must_trigger=x == "a") for x in "abc")
    total = (a + b) + c
    g.add_call_struct("two", {"x": "double", "y": "double"})
    g.add_call_struct("one", {"z": "double"})
    with pytest.raises(ValueError):
        g.validate()
    g.add_call_group("ab", "two", {"x": "a", "y": "b"})
    g.add_call_group("c", "one", {"z": "c"})
    g.validate()
    assert len(g.called(["a", "b"])) == 2 and [n for n, _ in g.called(["c"])] == [total.parent]
    assert g.stored() == {"external::c", (a + b).key}
    for wrong in (lambda: g.add_call_group("q", "one", {"z": "zz"}), lambda: g.add_call_group("q", "one", {"w": "a"}), lambda: g.add_call_group("q", "none", {}), lambda: g.add_call_group("q", "two", {"x": "a", "y": "a"})):
        with pytest.raises(ValueError):
            wrong()
    again = SignalGraph.from_json(g.to_json())
    assert again.to_json() == g.to_json()
    assert "dashed" in g.dot(["c"]) and "dashed" not in g.dot()


def test_lowering(spark):
    g = SignalGraph()
    a, b = g.get_external("a"), g.get_external("b")
    p = g.make_parameter("p")
    y = g.op("select", a / b, g.op("max", a, b), a < b) * p + g.make_constant(1.0)
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0), (None, 1.0), (1.0, 0.0)], "a double, b double")
    assert [r["y"] for r in g.evaluate(df, {"y": y}, {"p": 2.0}).collect()] == [2.0, 7.0, None, 3.0]
    assert [r["y"] for r in g.evaluate(df, {"y": y}).collect()][:2] == [1.0, 1.0]
    with pytest.raises(ValueError):
        g.lower([g.make_parameter("q", required=True)])
    arr = g.get_external("arr", "array")
    df = spark.createDataFrame([([5.0, 7.0], 1.0)], "arr array<double>, a double")
    assert g.evaluate(df, {"z": arr[1] + a}).first()["z"] == 8.0


def numeric(graph, rows, params, loss):
    out = {}
    for p in params:
        h = 1e-5
        out[p] = (loss({**params, p: params[p] + h}) - loss({**params, p: params[p] - h})) / (2 * h)
    return out


def test_gradients_equal_differences(spark):
    g = SignalGraph()
    a, b = g.get_external("a"), g.get_external("b")
    w, v, u = (g.make_parameter(x) for x in ("w", "v", "u"))
    inner = g.op("exp", a * w * 0.1) + g.op("max", b * v, a) - g.op("min", b, u) + g.op("abs", a - v) / (g.op("sqrt", g.op("abs", b) + 1.0) + w * w)
    y = (inner - g.summarize(inner, "mean")) / g.summarize(inner, "std") + g.op("select", w * a, v * b, a < b) + g.op("log", g.op("exp", u * 0.5) + 1.0)
    r = random.Random(0)
    df = spark.createDataFrame([(r.uniform(-2, 2), r.uniform(-2, 2), r.uniform(-1, 1)) for _ in range(50)], "a double, b double, t double").cache()
    graph = autodiff.Graph.from_json(autodiff.Graph.discover(y).to_json())
    assert graph.edges() == ["external::a", "external::b"] and graph.parameter_names() == ["u", "v", "w"]
    edges = {e: F.col(e[-1]) for e in graph.edges()}
    params = {"w": 0.7, "v": 0.4, "u": 0.3}
    seed = autodiff.squared_error(F.col("t"))
    loss = lambda p: graph.gradients(df, edges, p, seed)[0]
    _, got = graph.gradients(df, edges, params, seed)
    want = numeric(graph, df, params, loss)
    for p in params:
        assert got[p] == pytest.approx(want[p], rel=1e-4, abs=1e-6)


def test_discovery_stops(spark):
    g = SignalGraph()
    a = g.get_external("a")
    blocked = g.make_component("exp", {"a": a}, name="cut", block_propagation=True).output()
    graph = autodiff.Graph.discover(blocked * g.make_parameter("p") + 2.0)
    assert graph.edges() == ["cut::out"] and "p" in graph.pretty()
    graph.mark_stored(g)
    assert g.components["cut"].force_stored


def test_fitting(spark):
    rows = [(x, y, 2 * x - 0.4 * y) for x, y in zip([1.0, 2.0, 3.0, 4.0, 5.0], [-4.0, -2.0, -1.0, 4.0, -5.0])]
    df = spark.createDataFrame(rows, "a double, b double, z double").coalesce(1).cache()
    g = SignalGraph()
    a, b = g.get_external("a"), g.get_external("b")
    graph = autodiff.Graph.discover(a * g.make_parameter("wa") + b * g.make_parameter("wb"))
    edges = {e: F.col(e[-1]) for e in graph.edges()}
    done = autodiff.fit(graph, df, edges, F.col("z"), autodiff.Sgd(0.03), 60, {"wa": 0.5, "wb": 0.5}, stop_below=1e-6)
    assert done.losses[-1] < 1e-4 and done.params["wa"] == pytest.approx(2, abs=1e-2) and done.params["wb"] == pytest.approx(-0.4, abs=1e-2)
    adam = autodiff.fit(graph, df, edges, F.col("z"), autodiff.Adam(0.1), 15)
    assert adam.losses[-1] < adam.losses[0]
    split = autodiff.train_test(spark.range(10).selectExpr("id as n", "1.0d as target", "1.0d + id as target_future"))
    assert split.train.count() == 8 and split.test.count() == 2 and split.mean == pytest.approx(3.5)


def test_matrices():
    m = models.Matrix([1, 2, 3, 4], 2, 2)
    assert (m @ m).values == [7, 10, 15, 22] and (m + m).values == [2, 4, 6, 8] and m.apply(lambda x: -x).at(1, 0) == -3
    for wrong in (lambda: models.Matrix([1], 2, 2), lambda: m @ models.Matrix([1, 2, 3], 3, 1), lambda: m + models.Matrix([1, 2], 2, 1), lambda: models.linreg([1], [1, 2]), lambda: models.symmetric_move([F.lit(1.0)], [[1]], F.lit(1.0), [[1]])):
        with pytest.raises(ValueError):
            wrong()
    layer = models.Layer("l", 2, 1, lambda x: x * 10, lambda name: {"l_w_0_0": 1, "l_w_0_1": 2, "l_b_0": 3}[name])
    assert models.mlp([5, 7], [layer]) == [220]


def test_static_fair_of_a_symmetric_book(spark):
    from tidemark.operators.book import static_fair

    one = [(F.lit(99.0), F.lit(4.0))], [(F.lit(101.0), F.lit(4.0))]
    assert spark.range(1).select(static_fair(*one, F.lit(100.0), 0.01, corrected=True)).first()[0] == pytest.approx(100.0)
    assert N is not None


def test_summaries_of_a_level_are_one_aggregate(spark, monkeypatch):
    """Means of a and of b come together, the mean of what is made of them after it."""
    from pyspark.sql import DataFrame

    g = SignalGraph()
    a, b = g.get_external("a"), g.get_external("b")
    x = (a - g.summarize(a, "mean")) / g.summarize(a, "std") + (b - g.summarize(b, "mean"))
    y = x - g.summarize(x * x, "mean")
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 7.0), (6.0, 0.0)], "a double, b double")
    asked, plain = [], df.agg
    monkeypatch.setattr(type(df), "agg", lambda self, *c: asked.append(len(c)) or plain(*c) if self is df else DataFrame.agg(self, *c))
    got = [r["y"] for r in g.evaluate(df, {"y": y}).collect()]
    assert sorted(asked) == [1, 3]
    d = (((1 - 3) ** 2 + (2 - 3) ** 2 + (6 - 3) ** 2) / 2) ** 0.5
    xs = [(p - 3) / d + (q - 4) for p, q in ((1, 5), (2, 7), (6, 0))]
    assert got == pytest.approx([v - sum(w * w for w in xs) / 3 for v in xs])
