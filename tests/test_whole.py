"""Queries without SQL against brute force over whole tables."""

import math
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark import queries
from tidemark.operators import book, decay
from tidemark.sources import derived

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def books(spark):
    """(sym, seq): both sides' (price, size), best first, after each message."""
    out, live = {}, {}
    for r in sorted(derived.depth(spark, FOLDER).collect(), key=lambda r: (r["ts_us"], r["seq"])):
        b = live.setdefault(r["sym"], book.Book())
        b.apply(r["side"], r["price"], r["size"])
        out[r["sym"], r["seq"]] = [[(x["price"], x["size"]) for x in b.levels(side)] for side in "BS"]
    return out


def groups(levels, ratio, most):
    """(price, size) of the best level and of up to most - 1 groups behind it."""
    out, start = [], None
    for p, s in levels:
        if start is not None and len(out) > 1 and abs(p / start - 1) <= ratio:
            out[-1] = (out[-1][0] + p * s, out[-1][1] + s)
        elif len(out) < most:
            out.append((p * s, s))
            start = p
    return [(ps / s, s) for ps, s in out]


def test_book_aggregate_of_all_messages(spark, books):
    got = {(r["sym"], r["seq"], r["side"], r["level"]): (r["price"], r["size"]) for r in queries.QUERIES["book_aggregate_whole"](spark, FOLDER).collect()}
    want = {(*k, side, i): g for k, sides in books.items() for side, ls in zip("BS", sides) for i, g in enumerate(groups(ls, queries.RATIO, queries.GROUPS))}
    assert len({k[1] % 7 for k in want}) == 7
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)
    part = queries.QUERIES["book_aggregate"](spark, FOLDER).collect()
    assert {(r["sym"], r["seq"], r["side"], r["level"]): (r["price"], r["size"]) for r in part} == got


def number(name):
    return ((sum(map(ord, name)) * 37) % 100) / 200.0 + 0.05


def test_static_book_combo_of_all_books(spark, books):
    got = {(r["sym"], r["seq"]): r for r in queries.QUERIES["static_book_combo"](spark, FOLDER).collect()}
    assert got.keys() == {k for k, (bids, asks) in books.items() if bids and asks} and len({k[1] % 7 for k in got}) == 7
    returns, mids = {}, {}
    for k, r in got.items():
        bids, asks = books[k]
        mid, want = (bids[0][0] + asks[0][0]) / 2, []
        for ratio in queries.RATIOS:
            for scale in queries.SCALES:
                b, a = (sum(math.sqrt(s) * math.exp(sign * scale * 1e4 * (p - mid) / mid) for p, s in groups(ls, ratio, 4)) for ls, sign in ((bids, 1), (asks, -1)))
                want.append(math.log(b / a) / (2 * scale) / 1e4)
        returns[k], mids[k] = want, mid
        assert list(r[2:11]) == pytest.approx(want, abs=2e-6)
    first = [x[0] for x in returns.values()]
    mean, deviation = statistics.mean(first), statistics.stdev(first)
    for k in list(got)[::37]:
        x = cascaded([(v - mean) / deviation for v in returns[k]], "static") * deviation + mean
        assert got[k]["projected"] == pytest.approx(x * mids[k] + mids[k], abs=2e-5)


def soft(vs, fs, scale, post):
    ws = [math.exp(f * scale * abs(v)) for v, f in zip(vs, fs)]
    return sum(w * v * p for w, v, p in zip(ws, vs, post)) / sum(ws)


def discounted(a, b):
    return a - max(a, min(b, 0)) if a <= 0 else a - min(a, max(b, 0))


def cascaded(xs, name):
    n, p = len(xs), lambda k: number(f"{name}_{k}")
    total = soft(xs, [p(f"soft_f_{i}") for i in range(n)], p("soft_scale"), [p(f"soft_p_{i}") for i in range(n)]) + sum(x * p(f"lin_{i}") for i, x in enumerate(xs))
    f, q, moved = (lambda i, j: p(f"move_f_{i}_{j}")), (lambda i, j: p(f"move_p_{i}_{j}")), []
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        moved.append(discounted(xs[i], soft([xs[j] for j in rest], [f(i, j) for j in rest], p("move_scale"), [q(i, j) for j in rest])))
    return total + soft(moved, [f(i, i) for i in range(n)], p("move_scale"), [q(i, i) for i in range(n)])


def test_cascade_combo(spark):
    want = []
    for k, n, a, b, c in queries._items(spark, FOLDER).collect():
        y = cascaded([(x - 0.1) / 2 for x in (a / 25, b / 5, c * 10)], "cascade") * 2 + 0.1
        m = [a / 25, b / 5]
        for layer, (size, act) in enumerate([(4, lambda x: math.tanh(x / 2)), (4, lambda x: max(0.0, x)), (2, lambda x: math.tanh(x / 2))]):
            m = [act(sum(v * number(f"mlp_{layer}_w_{i}_{j}") for j, v in enumerate(m)) + number(f"mlp_{layer}_b_{i}")) for i in range(size)]
        want.append((k, n, y, *m))
    got = sorted(tuple(r) for r in queries.QUERIES["cascade_combo"](spark, FOLDER).collect())
    assert len(got) == len(want)
    assert all(g[:2] == w[:2] and g[2:] == pytest.approx(w[2:], abs=2e-6) for g, w in zip(got, sorted(want)))


def test_mixed_decay_of_any_strength(spark):
    """Decays that leave nothing representable, 0, and none."""
    r = random.Random(12)
    rows = [(k, n, {"strong": 0.01, "tiny": 1e-200, "zero": 0.0 if n % 5 == 0 else 1.0, "any": r.choice([0.0, 0.5, None, 1.0])}[k], r.random()) for k in ("strong", "tiny", "zero", "any") for n in range(1000)]
    df = spark.createDataFrame(rows, "sym string, n long, f double, c double")
    got = {(x["sym"], x["n"]): x["y"] for x in decay.running_sum_mixed(df, ["sym"], ["n"], F.col("f"), F.col("c"), "y").collect()}
    y = 0.0
    for k, n, f, c in rows:
        y = (y if n else 0.0) * (1.0 if f is None else f) + c
        assert got[k, n] == pytest.approx(y, rel=1e-12)


@pytest.mark.parametrize("block", [4, 256])
def test_mixed_decay_carries_over_all_blocks(spark, block):
    r = random.Random(11)
    rows = [(k, n, 1.0 if k == "plain" else r.choice([1.0, 1.0, 0.9999]), 1.0 if k == "plain" else r.random()) for k in ("plain", "mixed") for n in range(20_001)]
    df = spark.createDataFrame(rows, "sym string, n long, f double, c double")
    got = {(x["sym"], x["n"]): x["y"] for x in decay.running_sum_mixed(df, ["sym"], ["n"], F.col("f"), F.col("c"), "y", block=block).collect()}
    assert len(got) == len(rows) and got["plain", 20_000] == 20_001
    y = 0.0
    for k, n, f, c in rows:
        y = (y if n else 0.0) * f + c
        assert got[k, n] == pytest.approx(y, rel=1e-9)
