"""The near_dedup stage where ids repeat or are null."""

import corpus_pipeline


def test_one_row_of_each_component_stays(spark, tmp_path):
    one, two = ("alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight nine")
    three, four = ("red green blue black white brown grey pink", "north south east west up down left right")
    rows = [(1, one), (1, two), (2, two), (1, one), (None, three), (None, three), (None, two), (3, four), (None, four)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k long")
    kept = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(1, one), (1, two), (None, three), (3, four)], key=str)
