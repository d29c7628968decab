"""What similar() compares grows with the texts, not with the square of a text's changed copies."""

import random

from pyspark.sql import functions as F

from tidemark.llm import common, simhash


def test_copies_that_are_not_alike_are_not_paired(spark, monkeypatch):
    """60 copies of a text, each with other changes: 0.4 of the shingles of two are common, and 1,770 pairs share some."""
    rng = random.Random(3)
    base, texts = [f"w{i}" for i in range(400)], []
    for k in range(60):
        copy = list(base)
        for j in range(22):
            copy[18 * j + rng.randrange(10)] = f"new{k}x{j}"
        texts.append(" ".join(copy))
    texts += [" ".join([*base[:399], "last"]), " ".join(base)]  # two that are alike
    made, write = [], common.materialize

    def counted(df, label):
        out = write(df, label)
        if label == "simhash-pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(common, "materialize", counted)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {**{i: i for i in range(60)}, 60: 60, 61: 60}
    assert sum(made) <= 200


def test_joins_that_can_have_no_hot_key_are_plain(spark):
    counts = spark.range(3).select(F.col("id").alias("k"), F.lit(1).alias("n"))
    assert common.any_hot(counts, common.HOT) is None and common.any_hot(counts, common.HOT + 1) is not None
    joined = common.salted_join(counts, counts.select("k", F.lit("v").alias("v")), ["k"], None, F.col("k"))
    assert sorted(r["k"] for r in joined.collect()) == [0, 1, 2] and joined.columns == ["k", "n", "v"]
