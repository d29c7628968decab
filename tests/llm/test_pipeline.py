import hashlib

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.conftest import ODD
from tests.llm.test_tokens import reference


@pytest.fixture
def folder(spark, tmp_path):
    item = " ".join(f"word{i}" for i in range(30))
    base = [(i, f"{t} number {i} " + " ".join(f"{t[:3]}{i}x{k}" for k in range(30)), lang) for i, (t, lang) in enumerate([("the house and the water of the people", "en"), ("das haus und das wasser der leute", "de")] * 20)]
    rows = base + [(100, base[0][1], "en"), (101, f"the people of the house {item}", "en"), (102, "the house mail a.b@example.com and the water " + " ".join(f"z{k}" for k in range(20)), "en"), (103, "!!! 123", "en"), (104, None, "de")]
    spark.createDataFrame([(i, t, lang, "src0", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder)
        assert kept.columns == docs.columns, name
    left = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert {100, 101, 103, 104}.isdisjoint(left) and 102 in left
    assert "[EMAIL]" in left[102] and "@" not in left[102]
    assert len(left) == 41
    want = {i: np.array(reference().encode_ordinary(t), "<u4").tobytes() for i, t in left.items()}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert {i: hashlib.sha256(b).hexdigest() for i, b in want.items()} == {i: r["ids_sha256"] for i, r in got.items()}
    assert all(r["decoded_sha256"] == hashlib.sha256(left[i].encode()).hexdigest() for i, r in got.items())


def test_stages_on_odd_and_empty_tables(spark, odd, folder):
    docs = odd.selectExpr("doc_id", "text", "lang", "'s' as source", "cast(length(text) as long) as n_chars")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, frame, folder).count() <= len(ODD)
