import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import market as M
from tidemark.functions import numeric as N

VALUES = [None, float("nan"), float("inf"), -float("inf"), -2.0, -0.5, 0.0, 0.5, 1.0, 3.0]


def same(x, y):
    if x is None or y is None or isinstance(y, bool):
        return x is y
    return (math.isnan(x) and math.isnan(y)) or x == y or abs(x - y) <= 1e-9 * max(1, abs(y))


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(a, b) for a in VALUES for b in VALUES], "a double, b double")


def divide(a, b):
    if b == 0:
        return math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a)
    return a / b if not (math.isinf(a) and math.isinf(b)) else math.nan


BINARY = {
    "div": (N.div, divide),
    "lt": (N.lt, lambda a, b: a < b),
    "ge": (N.ge, lambda a, b: a >= b),
    "eq": (N.eq, lambda a, b: a == b),
}


@pytest.mark.parametrize("name", BINARY)
def test_binary_operators_are_ieee_and_strict(pairs, name):
    f, want = BINARY[name]
    for r in pairs.withColumn("y", f(F.col("a"), F.col("b"))).collect():
        assert same(r["y"], None if r["a"] is None or r["b"] is None else want(r["a"], r["b"])), r


@pytest.mark.parametrize("f, least", [(N.minimum, True), (N.maximum, False)])
def test_extremes_need_both(pairs, f, least):
    for r in pairs.where("not isnan(a) and not isnan(b) or a is null or b is null").withColumn("y", f(F.col("a"), F.col("b"))).collect():
        if r["a"] is None or r["b"] is None:
            assert r["y"] is None
        else:
            assert r["y"] == (min if least else max)(r["a"], r["b"])


def test_logarithm_and_finite(pairs):
    for r in pairs.select("a", N.log(F.col("a")).alias("l"), N.finite(F.col("a")).alias("f")).distinct().collect():
        a = r["a"]
        want = None if a is None else math.nan if math.isnan(a) or a < 0 else -math.inf if a == 0 else math.log(a) if a < math.inf else math.inf
        assert same(r["l"], want)
        assert same(r["f"], a if a is not None and math.isfinite(a) else None)


@pytest.mark.parametrize("base", [1.1, 2, math.e, 5, 10])
def test_powers(spark, base):
    xs = [0.5, 1.0, 2.0, 5.0, -0.5, -2.0, -5.0, 0.0]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").withColumn("y", N.power(base, F.col("x"))).collect():
        assert abs(r["y"] / base ** -r["x"] - 1) < 1e-4


def test_select_reads_only_the_chosen_side(spark):
    rows = spark.createDataFrame([(1.0, None, True), (1.0, None, False), (None, 2.0, False), (1.0, 2.0, None)], "a double, b double, c boolean")
    assert [r[0] for r in rows.select(N.select(F.col("a"), F.col("b"), F.col("c"))).collect()] == [1.0, None, 2.0, None]


def test_shrinking_never_passes_zero(spark):
    rows = spark.createDataFrame([(3.0, 1.0), (3.0, 5.0), (3.0, -1.0), (-3.0, -1.0), (-3.0, -9.0), (-3.0, 2.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in rows.select(N.discount_by(F.col("a"), F.col("b"))).collect()] == [2.0, 0.0, 3.0, -2.0, 0.0, -3.0, None]


def test_trees_keep_pair_order():
    seen = []
    N.tree(list("abcde"), lambda x, y: seen.append((x, y)) or x + y)
    assert seen == [("a", "b"), ("c", "d"), ("cd", "e"), ("ab", "cde")]
    with pytest.raises(ValueError):
        N.tree_sum([])
    with pytest.raises(ValueError):
        N.clamp(F.lit(1.0), 0)
    with pytest.raises(ValueError):
        N.index(F.array(F.lit(1)), -1)


def test_slots_and_sides(spark):
    row = spark.range(1).select(
        N.ephemeral_sum([F.lit(None).cast("double"), F.lit(2.0), F.lit(3.0)]).alias("s"),
        N.ephemeral_sum([F.lit(None).cast("double")]).alias("z"),
        M.deepest(F.lit(True), F.lit(1.0), F.lit(2.0)).alias("d"),
        M.deeper(F.lit(False), F.lit(1.0), F.lit(2.0)).alias("e"),
        M.number(F.lit("1.5")).alias("n"),
        M.number(F.lit("x")).alias("bad"),
        N.triggered_constant(4, F.lit(None)).alias("t"),
    ).first()
    assert tuple(row) == (5.0, 0.0, 1.0, False, 1.5, None, None)
