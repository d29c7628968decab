"""Contexts of quoted identifiers, and patterns induced from found ones."""

import pytest

from tidemark.llm import pii


@pytest.mark.parametrize("text, entity", [('set the token = "ed85f0" now', "ed85f0"), ("set the token: (10.0.0.1) now", "10.0.0.1"), ("set the token #<a@b.c> now", "a@b.c"), ("set the token: ed85f0, now", "ed85f0")])
def test_contexts_skip_punctuation(text, entity):
    at = text.index(entity)
    assert pii._contexts(text, at, at + len(entity)) == ["b2 the token", "ba token | now", "lb token"]


def test_quoted_identifiers_are_seeds_and_found(spark):
    rows = [f'note {i} call phone: "+1 555 010-{1000 + i}" today' for i in range(12)] + ['they said phone = ("555-010-77") today', 'version "2.0.1x" of the code']
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))).collect()}
    start = rows[12].index("555")
    assert got[12] == f"id:{start}:{start + 10}" and got[13] == ""


def word(i):
    return "".join(chr(97 + int(c)) for c in f"{i:03d}")


def test_found_identifiers_induce_patterns(spark):
    """Ids that a phone pattern finds support a second label, whose own id no base seed reaches."""
    rows = [f"q{word(i)} phone: +1 555 010-{1000 + i} r{word(i)}" for i in range(100)]
    rows += [f"s{word(i)} phone: ab-{700 + i}-k t{word(i)}" for i in range(12)] + [f"u{word(i)} ticket: ab-{700 + i}-k v{word(i)}" for i in range(12)]
    rows += ["w ticket: zz-999-k x", "y other: zz-123-k z"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(docs)).collect()}
    assert got[124] == "id:10:18" and got[125] == ""
    assert all(got[i].startswith("id:") for i in range(100, 124))
    once = {r["doc_id"]: r["n_added"] for r in pii.digest(pii.find(docs, rounds=1)).collect()}
    assert once[124] == 0 and once[111] == 1
