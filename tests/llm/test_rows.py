"""Stages judge rows, whatever ids and columns they have; scans of long texts take time in proportion."""

import time

import pytest

import corpus_pipeline
from tidemark.llm import decontaminate, pii

ITEM = " ".join(f"item{i}" for i in range(20))
CLEAN = ["the house and the water of the people", "some quite other words stand in here instead of those", "nothing that is like the rest can be read here at all"]


@pytest.fixture
def clashing(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, ITEM), (7, ITEM), (7, CLEAN[0]), (8, CLEAN[1]), (None, CLEAN[2]), (None, None), (9, "")]
    names = ["_row", "_spans", "_new", "row", "given", "spans", "new"]
    schema = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([(*r, *[f"{n}{k}" for n in names]) for k, r in enumerate(rows)], schema), str(tmp_path)


def plain(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_decontamination_judges_rows(spark, clashing):
    docs, folder = clashing
    kept = corpus_pipeline.drop_contaminated(spark, docs, folder)
    assert kept.columns == docs.columns and plain(kept) == [r for r in plain(docs) if r[1] != ITEM]


def test_near_dedup_keeps_every_column(spark, clashing):
    docs, folder = clashing
    kept = plain(corpus_pipeline.drop_near_copies(spark, docs, folder))
    assert set(kept) <= set(plain(docs)) and sorted(str(r[1] or "") for r in kept) == sorted(["", ITEM, *CLEAN])
    assert [r[0] for r in kept if r[1] == ITEM] == [7]  # a null id is the greatest


@pytest.mark.parametrize("most", [pii.BROADCAST_PATTERNS, -1])
def test_masking_keeps_every_column(spark, clashing, monkeypatch, most):
    docs, _ = clashing
    monkeypatch.setattr(pii, "BROADCAST_PATTERNS", most)
    mailed = docs.selectExpr(*[f"concat(text, ' a@b.c') as {c}" if c == "text" else c for c in docs.columns])
    want = sorted(((*r[:1], r[1] and r[1].replace("a@b.c", "[EMAIL]"), *r[2:]) for r in plain(mailed)), key=str)
    assert plain(pii.redacted(mailed)) == want


@pytest.mark.parametrize("text", ["1.1.1.1," * 600_000, "a1b2c3d4 " * 500_000, "x" * 2_000_000 + " " + "a@b.c," * 400_000, "|" * 2_000_000 + "9.9.9.9 " * 100_000 + "( " * 1_000_000])
def test_contexts_of_many_entities_are_linear(text):
    begun = time.process_time()
    base = pii.base_spans(text)
    spans = [s[1:] for s in base] + pii.candidates(text, base)
    of = pii.Contexts(text, spans)
    assert spans and sum(len(of(*s)) for s in spans) > 0
    assert time.process_time() - begun < 30  # some 5 s; hours if it took squares


def test_context_words_end_at_entities():
    text = "mail a@b.c,d@e.f now"
    of = pii.Contexts(text, [(5, 10), (11, 16)])
    assert of(5, 10) == ["ba mail | d@e.f"]
    assert of(11, 16) == ["b2 mail a@b.c", "ba a@b.c | now"]


def test_tiles_of_repeated_words_are_linear():
    begun = time.process_time()
    assert decontaminate.tile((["a"] * 9_999 + ["b"]) * 10, ["a"] * 10_000) == [(0, 0, 9_999)]
    assert decontaminate.tile(["a"] * 100_000, ["a"] * 10_000)[0] == (0, 0, 10_000)
    assert time.process_time() - begun < 60
