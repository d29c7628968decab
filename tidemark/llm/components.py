"""Connected components by alternating large-star and small-star rounds.

The centre of a star meets its neighbours in several tasks where it has very many (:func:`tidemark.llm.common.salted_join`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _meet(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """a, b, m: each edge with the m of its a; ``least`` has a, m and n, the number of edges."""
    hot = common.hot_keys(least, total) if total > 2 * common.HOT else None  # a node has half of these at most
    return common.salted_join(edges, least.select("a", "m", "n"), ["a"], hot, F.xxhash64("b"), known=common.is_hot(total))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node's larger neighbours go to the least of it and its neighbours."""
    both = _both_ways(edges)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    return _meet(both.where("b > a"), least, total).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node and its smaller neighbours go to the least of those."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = _meet(down, least, total).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) LONG edges -> (node, component): the least node reachable, for every node that has an edge.

    Each round is written to the shared folder; only two numbers come to the driver.
    """
    mark = lambda d: d.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    edges = common.materialize(edges.where("a <> b").distinct(), "edges")
    seen = mark(edges)
    for _ in range(most_rounds):
        if not seen["n"]:
            break
        total = 2 * seen["n"]  # a star step has at most an edge for each direction
        edges = common.materialize(_small_star(_large_star(edges, total), total), "edges")
        now = mark(edges)
        if (now["n"], now["x"]) == (seen["n"], seen["x"]):
            break
        seen = now
    else:
        raise RuntimeError(f"no components after {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
