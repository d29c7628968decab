"""Keys that very many rows share are dealt over several tasks, with the same results."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, media, repeats, simhash
from tidemark.llm.components import components


@pytest.fixture
def low(monkeypatch):
    """A key in over three rows is hot."""
    monkeypatch.setattr(common, "HOT", 3)


def test_salted_join_spreads_hot_keys(spark, monkeypatch, low):
    monkeypatch.setattr(common, "SALTS", 8)
    many = spark.range(400).select("id", F.when(F.col("id") % 4 > 0, 7).when(F.col("id") % 8 > 0, F.col("id")).alias("k"))
    few = spark.createDataFrame([(7, "hot"), (4, "cold"), (5, "unused")], "k long, v string")
    hot = common.hot_keys(many.groupBy("k").agg(F.count("*").alias("n")), 400)
    order = lambda rows: sorted(rows, key=lambda r: r["id"])
    for how in ("inner", "left"):
        got = common.salted_join(many, few, ["k"], hot, F.col("id"), how)
        assert order(got.collect()) == order(many.join(few, "k", how).collect())
    # Small sides would be broadcast and small partitions put together.
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        parts = common.salted_join(many, few, ["k"], hot, F.col("id"))
        assert parts.where("k = 7").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_hot_keys_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 1)
    monkeypatch.setattr(common, "MOST_HOT", 10)
    counts = spark.range(1, 100).select("id", F.lit(20).alias("n"))
    assert common.hot_keys(counts, 99 * 20).count() == 0
    assert common.hot_keys(counts.limit(5), 5 * 20).count() == 5


def test_media_that_many_documents_share(spark, tmp_path, low):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    head = " ".join(word() for _ in range(4000))
    texts = [head + " ".join(word() for _ in range(300)) for _ in range(12)] + [None, ""] * 10 + [head] * 9
    # Copies with one id and with none.
    docs = spark.createDataFrame([(None if k % 3 == 0 else 1, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["payload_sha256"]) for r in media.round_trip(docs, str(tmp_path / "store")).collect())
    want = sorted((0 if k % 3 == 0 else 1, hashlib.sha256(media.payload(t)).hexdigest()) for k, t in enumerate(texts))
    assert got == want


@pytest.mark.parametrize("most", [4000, 1])
def test_removal_from_many_copies(spark, most, low):
    r = random.Random(most)
    make = lambda n: "".join(r.choice("abc d") for _ in range(n))
    share = make(90)
    texts = [make(30) + share + make(30) for _ in range(15)] + [make(100)] * 12 + [make(200), "", None]
    docs = spark.createDataFrame([(k if k < 20 else None, t) for k, t in enumerate(texts)], "doc_id long, text string")
    found = repeats.remove(docs, length=40, passage=25, anchor=12, most=most, words=5)
    key = lambda k: (k is not None, k or 0)
    got = sorted((key(r["doc_id"]), bytes(r["kept"])) for r in found.collect())
    want = sorted((key(k if k < 20 else None), kept) for k, kept in enumerate(brute_kept(texts, 40)))
    assert got == want


def brute_kept(texts, size):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for raw in raws:
        for at in range(len(raw) - size + 1):
            seen[raw[at : at + size]] = seen.get(raw[at : at + size], 0) + 1
    for raw in raws:
        gone = set()
        for at in range(len(raw) - size + 1):
            if seen[raw[at : at + size]] > 1:
                gone.update(range(at, at + size))
        yield bytes(b for k, b in enumerate(raw) if k not in gone)


def test_components_of_large_stars(spark, low):
    r = random.Random(3)
    edges = [(0, k) for k in range(10, 60)] + [(k, 100) for k in range(40, 70)] + [(200, k) for k in range(201, 240)] + [(300, 301)]
    edges = [(a, b) if r.random() < 0.5 else (b, a) for a, b in edges]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: 0 if n <= 100 else 200 if n < 300 else 300 for edge in edges for n in edge}


def test_near_duplicates_of_many_copies(spark, low):
    texts = ["one two three four five six"] * 30 + [""] * 20 + [None] * 5 + ["quite another text of some words here"]
    docs = spark.createDataFrame([(None if k == 40 else k % 50, t) for k, t in enumerate(texts)], "doc_id long, text string")
    # Rows 50 to 55 have the ids 0 to 5 again: nulls are like empty texts, so both are named 0.
    same = simhash.near_duplicates(docs).groupBy("fp").agg(F.count("*").alias("n"), F.countDistinct("component_id").alias("c"), F.min("component_id").alias("least"))
    assert sorted(tuple(x)[1:] for x in same.collect()) == [(1, 1, 5), (25, 1, 0), (30, 1, 0)]
    assert Counter(x["component_id"] for x in simhash.similar(docs).collect()) == {0: 55, 5: 1}
