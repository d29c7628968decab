"""What similar() keeps on disk: shingles of the texts of candidate pairs only, and no table that nothing reads any more."""

import glob

from tidemark.llm import common, simhash
from tidemark.sources.scratch import scope, shared_dir


def tables(spark):
    return {p.rsplit("/", 1)[-1].rsplit("-", 1)[0].removeprefix("tidemark-") for p in glob.glob(f"{shared_dir(spark).removeprefix('file://')}/tidemark-*")}


def test_shingles_are_kept_of_candidate_pairs_only(spark, monkeypatch):
    """All texts share a line, hence first shingles of short ones; only two of them may be alike."""
    line = "one line that all of them share"
    texts = [f"{line} {' '.join(f'w{i}x{k}' for k in range(3 + i % 4))}" for i in range(300)]
    long = [f"l{k}" for k in range(100)]
    texts += [" ".join(long), " ".join([*long[:99], "new"])]
    kept, write = [], simhash.common.materialize

    def counted(df, label):
        out = write(df, label)
        if label == "simhash-shingles":
            kept.append(out.count())
        return out

    monkeypatch.setattr(common, "materialize", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    with scope(spark):
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs).collect()}
        left = tables(spark)
    assert got == {**{i: i for i in range(300)}, 300: 300, 301: 300}
    assert kept and sum(kept) <= 10
    assert "simhash-texts" in left and not left & {"simhash-views", "simhash-marked", "simhash-shingles", "simhash-keys"}


def test_a_scope_keeps_what_it_is_told_to(spark):
    rows = spark.range(5)
    with scope(spark):
        with scope(spark) as keep:
            with scope(spark) as inner:
                common.materialize(rows, "scope-gone")
                a, b = keep(rows, "scope-a"), inner(rows, "scope-b")
            assert b.count() == 5 and not tables(spark) & {"scope-gone"}
        assert a.count() == 5 and tables(spark) & {"scope-a", "scope-b", "scope-gone"} == {"scope-a"}
    assert not tables(spark) & {"scope-a", "scope-b"}
