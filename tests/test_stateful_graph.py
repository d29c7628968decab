"""Graphs with stateful components against the operators by hand and against loops over triggers."""

import math
import random

import pytest

from tidemark.operators import book, decay
from tidemark.plans import stateful
from tidemark.plans.graph import SignalGraph

HALF_LIFE = 2_000


def wide():
    g = SignalGraph(stateful.stateful_definitions())
    a, b, c = (g.get_external(x) for x in "abc")
    g.add_call_struct("two", {"x": "double", "y": "double"})
    g.add_call_struct("one", {"z": "double"})
    g.add_call_group("ab", "two", {"x": "a", "y": "b"})
    g.add_call_group("c", "one", {"z": "c"})
    return g, a, b, c


def log_of(spark, rows):
    return spark.createDataFrame(rows, "sym string, ts_us long, seq long, trigger string, a double, b double, c double")


def test_stored_outputs_are_latched_between_triggers(spark):
    """A sum of two triggers' externals: the second reads what the first stored, also if it is invalid."""
    g, a, b, c = wide()
    rows = [("k", 10, 0, "ab", 1.0, 2.0, None), ("k", 11, 1, "c", None, None, 5.0), ("k", 12, 2, "ab", 3.0, 2.0, None), ("k", 13, 3, "ab", None, 2.0, None), ("k", 14, 4, "c", None, None, 1.0), ("k", 15, 5, "ab", 1.0, 1.0, None), ("j", 16, 6, "c", None, None, 9.0)]
    got = {r["seq"]: r["y"] for r in stateful.run(g, log_of(spark, rows), ["sym"], {"y": (a + b) + c}, ["ab", "c"]).collect()}
    assert got == {0: None, 1: 8.0, 2: 10.0, 3: None, 4: None, 5: 3.0, 6: None}


def test_ephemeral_outputs_live_in_their_trigger(spark):
    g, a, b, c = wide()
    once = g.make_triggered_constant(7.0, c)
    held = g.op("hold", a + b, c)
    rows = [("k", 1, 0, "ab", 1.0, 2.0, None), ("k", 2, 1, "c", None, None, 5.0), ("k", 3, 2, "ab", 4.0, 4.0, None), ("k", 4, 3, "c", None, None, None)]
    got = {r["seq"]: (r["once"], r["held"]) for r in stateful.run(g, log_of(spark, rows), ["sym"], {"once": once, "held": held}, ["ab", "c"]).collect()}
    assert got == {0: (None, None), 1: (7.0, 3.0), 2: (None, 3.0), 3: (None, 8.0)}


def test_random_graphs_equal_a_loop(spark):
    """Sums and products of three externals under two triggers, as an interpreter of triggers has them."""
    rng = random.Random(11)
    for _ in range(3):
        g, *ext = wide()
        nodes = list(ext)
        for _ in range(6):
            x, y = rng.choice(nodes), rng.choice(nodes)
            nodes.append(rng.choice([x + y, x * y, g.op("min", x, y), g.op("hold", x, ext[2])]))
        rows = [("k", t, t, *rng.choice([("ab", float(rng.randrange(4)), rng.choice([None, 2.0, 3.0]), None), ("c", None, None, rng.choice([None, 1.0, 5.0]))])) for t in range(40)]
        out = {f"o{i}": o for i, o in enumerate(dict.fromkeys(nodes[3:], 0)) if not isinstance(o, str)}
        got = {r["seq"]: [r[k] for k in out] for r in stateful.run(g, log_of(spark, rows), ["sym"], out, ["ab", "c"]).collect()}
        held: dict = {}
        for _, t, _, trigger, a, b, c in rows:
            held |= {"external::a": a, "external::b": b} if trigger == "ab" else {"external::c": c}
            for n, _ in g.called("ab" if trigger == "ab" else ["c"]):
                i = {k: held.get(o.key) for k, o in g.components[n].inputs.items()}
                kind = g.components[n].definition
                if kind == "hold":
                    held[f"{n}::out"] = i["value"]
                else:
                    x, y = i["a"], i["b"]
                    held[f"{n}::out"] = None if x is None or y is None else {"add": x + y, "mul": x * y, "min": min(x, y)}[kind]
            assert got[t] == [held.get(o.key) for o in out.values()], (t, trigger)


def market(n=500):
    rng, rows, ts = random.Random(5), [], 0
    for seq in range(n):
        ts += rng.randrange(1, 90)
        if rng.random() < 0.5:
            rows.append(("s", ts, seq, "trade", 100 + rng.randrange(-8, 8) / 4, float(rng.randrange(1, 9)), rng.random() < 0.5, None, None, None))
        else:
            side = rng.choice("BS")
            rows.append(("s", ts, seq, "depth", None, None, None, side, 100.0 + (-1 if side == "B" else 1) * rng.randrange(1, 5), rng.choice([0.0, 1.0, 4.0])))
    return rows


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(market(), "sym string, ts_us long, seq long, trigger string, price double, size double, buy boolean, side string, level_price double, level_size double")


def market_graph():
    g = SignalGraph(stateful.stateful_definitions())
    price, size, buy = g.get_external("price"), g.get_external("size"), g.get_external("buy", "bool")
    level = {"side": g.get_external("side", "string"), "price": g.get_external("level_price"), "size": g.get_external("level_size")}
    g.add_call_struct("depth", {"side": "string", "price": "double", "size": "double"})
    g.add_call_struct("trade", {"price": "double", "size": "double", "buy": "bool"})
    g.add_call_group("depth", "depth", {"side": "side", "price": "level_price", "size": "level_size"})
    g.add_call_group("trade", "trade", {"price": "price", "size": "size", "buy": "buy"})
    fair = g.make_component("book_fair", level, params={"scale": 0.1}).output("fair")
    tick = g.make_component("tick_detector", {"buy": buy}, params={"gap_us": 150, "idle_us": 10_000}).output("tick")
    ticks = g.make_component("tick_aggregator", {"price": price, "size": size, "buy": buy, "fair": fair, "tick": tick}, params={"size_weight": 1e-3, "distance_weight": 5.0})
    fires = g.make_component("exp_decay_source", params={"half_life_us": HALF_LIFE, "on": "trade"}).output("decay")
    pressure = g.make_component("running_sum", {"tick": ticks.output("tick"), "decay": [fires, g.make_triggered_constant(0.9, ticks.output("tick"))]}).output("running_sum")
    ewma = g.make_component("ewma", {"signal": price, "decay": [fires]}).output("ewma")
    return g, {"fair": fair, "running": ticks.output("running"), "tick": ticks.output("tick"), "pressure": pressure, "ewma": ewma, "far": (price - ewma) / price}


def test_a_market_equals_a_loop_over_its_events(spark, log):
    g, outputs = market_graph()
    assert SignalGraph.from_json(g.to_json(), stateful.stateful_definitions()).to_json() == g.to_json()
    assert len(g.triggers()) == 3
    got = {(r["trigger"], r["seq"]): r for r in stateful.run(g, log, ["sym"], outputs, ["trade", "depth"], block_us=3_000).collect()}
    rows = market()
    assert len(got) == len(rows)
    first, last = (f(r[1] for r in rows if r[3] == "trade") for f in (min, max))
    step, d = decay.step_us(HALF_LIFE), decay.factor(HALF_LIFE)
    due, levels, price, fair, was, y, average, running, ps, deep = first, {"B": {}, "S": {}}, None, None, None, 0.0, None, None, 0.0, None
    for _, ts, seq, trigger, p, size, buy, side, at, amount in rows:
        while due <= min(ts, last):
            factor = 0.0 if due == first else d
            y *= factor
            average = None if price is None else price if average is None else factor * average + (1 - factor) * price
            due += step
        tick = None
        if trigger == "depth":
            if amount or at in levels[side]:
                levels[side].pop(at, None)
                if amount:
                    levels[side][at] = amount
                fair = book.linear_impulse_fair(levels["B"].items(), levels["S"].items(), 0.1, 100.0) if levels["B"] and levels["S"] else None
        else:
            price = p
            if was is not None and (buy != was[0] or ts - was[1] > 150):
                tick = running or 0.0
                y = y * 0.9 + tick
            if was is None or tick is not None:
                running, ps, deep = None, 0.0, p
            was, ps, deep = (buy, ts), ps + p * size, (min if buy else max)(deep, p)
            if fair is not None:
                running = (1 if buy else -1) * (1 - math.exp(-1e-3 * ps)) * math.exp(-max(-3.0, 5.0 * (-1 if buy else 1) * (deep / fair - 1)))
        r = got[trigger, seq]
        for name, x in (("fair", fair), ("running", running), ("tick", tick), ("pressure", y), ("ewma", average), ("far", None if average is None else (price - average) / price)):
            assert (r[name] is None) == (x is None) and (x is None or abs(r[name] - x) < 1e-9 * max(1, abs(x))), (seq, name, r[name], x)


def test_unknown_triggers_and_missing_parameters(spark, log):
    g, outputs = market_graph()
    with pytest.raises(ValueError):
        stateful.run(g, log, ["sym"], outputs, ["nothing"])
    p = outputs["fair"] * g.make_parameter("k", required=True)
    with pytest.raises(ValueError):
        stateful.run(g, log, ["sym"], {"p": p}, ["trade"])
    q = outputs["far"] * g.make_parameter("w")
    rows = stateful.run(g, log, ["sym"], {"far": outputs["far"], "q": q}, ["trade"], {"w": 2.0}).collect()
    assert rows and all(r["q"] == 2 * r["far"] for r in rows if r["far"] is not None)


def test_empty_log(spark, log):
    g, outputs = market_graph()
    assert stateful.run(g, log.limit(0), ["sym"], outputs, ["trade"]).count() == 0
