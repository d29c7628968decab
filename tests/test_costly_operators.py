"""Costly column operators of a graph are worked out in the rows that read them, with the values they have anywhere."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark import queries
from tidemark.operators import models
from tidemark.operators.scan import span_for
from tidemark.plans import stateful
from tidemark.plans.graph import Callset, Definition, OutputSpec, SignalGraph
from tidemark.sources import derived

FOLDER = "/root/testdata/sf0.001"


def model(costly, strict, ephemeral=False):
    """a + 2 b, which is invalid for the first of 3 to 5 too."""
    lower = lambda i, g, p: models.let([i["a"], i["b"]], lambda a, b: F.when(~a.between(3, 5), a + 2 * b))
    return Definition("model", ("a", "b"), {"out": OutputSpec(ephemeral=ephemeral, assume_invalid=ephemeral)}, lower, generic=Callset(frozenset(), frozenset({"a", "b"})), costly=costly, strict=strict)


def evaluated(spark, rows, costly, strict=True, ephemeral=False, pick=None):
    g = SignalGraph(stateful.stateful_definitions() | {"model": model(costly, strict, ephemeral)})
    a, b, c = (g.get_external(x) for x in "abc")
    g.add_call_struct("two", {"x": "double", "y": "double"})
    g.add_call_struct("one", {"z": "double"})
    g.add_call_group("ab", "two", {"x": "a", "y": "b"})
    g.add_call_group("c", "one", {"z": "c"})
    first = g.op("model", a, b)
    second = g.op("model", first, b)
    last = g.make_component("valid", {"value": second}).output()
    sampled = g.make_component("bucket_sampler", {"trade": c}, params={"initial": 4.0}).output("should_sample")
    outputs = {
        "last": last + c, "held": g.op("hold", g.op("model", c, last), c) if pick == "read" else g.op("hold", g.op("model", c, b), c),
        "mean": first - g.summarize(first, "mean") if pick != "last" else last, "std": c * g.summarize(first, "std"), "both": g.op("model", last, c), "sampled": sampled,
    }
    log = spark.createDataFrame(rows, "sym string, ts_us long, seq long, trigger string, a double, b double, c double")
    done = stateful.run(g, log, ["sym"], outputs, ["c"], block_us=7, only=sampled)
    return {(r["sym"], r["seq"]): tuple(r)[4:] for r in done.collect()}


@pytest.mark.parametrize("strict, ephemeral, invalid, pick", [(True, False, 2, None), (True, True, 2, "last"), (False, False, 5, None), (True, False, 5, "read")])
def test_costly_operators_equal_plain_ones(spark, strict, ephemeral, invalid, pick):
    """Also where the last value is invalid, and where stages and held values read them."""
    rng, rows = random.Random(3), []
    for t in range(160):
        a = rng.choice([None, 1.0, 2.0]) if invalid == 2 else rng.choice([None, 1.0, 3.0, 4.0])
        rows.append((rng.choice("kj"), t // 2, t, *(("ab", a, rng.choice([None, 0.5, 7.0]), None) if rng.random() < 0.5 else ("c", None, None, rng.choice([1.0, 4.0, 9.0])))))
    want, got = (evaluated(spark, rows, costly, strict, ephemeral, pick) for costly in (False, True))
    assert len(want) > 15 and any(x[0] is not None for x in want.values())
    assert got == want


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_models_of_market_graph_run_where_they_are_read(spark, monkeypatch):
    """The cascade over books in the books that sampled trades read, the market's in those trades, the move on the grid."""
    counts, real = {k: spark.sparkContext.accumulator(0) for k in ("static", "market", "decay")}, models.cascade

    def counting(name):
        ran = counts[name]

        def count(x):
            ran.add(1)
            return x

        return F.udf(count, "double").asNondeterministic()

    monkeypatch.setattr(models, "cascade", lambda xs, parameter, name="cascade", **more: real([models.let([counting(name)(xs[0])], lambda x: x), *xs[1:]], parameter, name, **more))
    sampled = queries.QUERIES["market_graph"](spark, FOLDER).count()
    symbols, fires = 3, 601
    assert 0 < sampled <= counts["market"].value <= derived.trades(spark, FOLDER).count() / 10
    assert 0 < counts["static"].value <= derived.trades(spark, FOLDER).count() / 10
    assert 0 < counts["decay"].value <= symbols * fires


def test_spans_go_by_the_rows_of_the_fullest_key(spark):
    rows = spark.range(1000).selectExpr("'s' as sym", "id * 10 as ts_us").unionByName(spark.range(10).selectExpr("'t' as sym", "id * 1000 as ts_us"))
    assert span_for(rows, ["sym"], 10**9, 100) == 999
    assert span_for(rows, ["sym"], 50, 100) == 50
    assert span_for(rows.limit(0), ["sym"], 50) == 50
    assert span_for(rows.withColumn("ts_us", F.lit(5)), ["sym"], 50) == 1
