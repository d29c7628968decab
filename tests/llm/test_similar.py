"""Near copies by word fingerprints, verified by sketches of five-word shingles, against exact shares of shingles."""

import random

import numpy as np
import pytest

from tidemark.llm import simhash


def shingles(text, n=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def share(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def family(rng, vocabulary, words, copies, edits):
    base = [rng.choice(vocabulary) for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(copies):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        out.append(" ".join(copy))
    return out


def test_sketches_estimate_the_common_share():
    rng = random.Random(2)
    vocabulary, view = [f"w{i}" for i in range(3000)], simhash.Views()
    for words in (6, 30, 200, 3000):
        texts = family(rng, vocabulary, words, 12, max(1, words // 40))
        marks = np.array([np.frombuffer(view(t)[1], np.uint8) for t in texts])
        got = simhash.common_share(marks[1:], marks[0])
        want = [share(t, texts[0]) for t in texts[1:]]
        assert np.abs(got - want).max() < (0.05 if words < 40 else 0.12)
        assert all(g == 1 for g, w in zip(got, want) if w == 1)
    assert view(None) == view(" \n") == ([0] * simhash.VIEWS, bytes(simhash.RANGES))


@pytest.mark.parametrize("most", [2048, 3])
def test_similar_texts_are_linked_and_others_are_not(spark, most):
    """Nearly all pairs of 0.85 or more are joined, whichever way hot keys go; no component joins what isn't alike."""
    rng = random.Random(7)
    vocabulary = [f"{rng.choice('abcdefg')}{i}" for i in range(2500)]
    common = ["the", "of", "and", "to"]
    families = [family(rng, vocabulary + common * 150, rng.choice([40, 150, 600]), 6, 2) for _ in range(25)]
    texts = [t for f in families for t in f]
    texts += [texts[0], texts[0].upper(), None, "", "  ", "one", "ONE", "two words"] + [" ".join(rng.choice(common) for _ in range(200)) for _ in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs, most).collect()}
    assert sorted(got) == list(range(len(texts)))
    assert got[len(texts) - 14] == got[len(texts) - 13] == got[0] and len({got[k] for k in range(len(texts) - 12, len(texts) - 9)}) == 1
    pairs = [(a, b, share(texts[a], texts[b])) for a in range(len(texts)) for b in range(a)]
    alike = [got[a] == got[b] for a, b, s in pairs if s >= 0.85]
    assert sum(alike) / len(alike) >= 0.95
    assert not [1 for a, b, s in pairs if s < 0.4 and got[a] == got[b]]


def test_similar_odd_rows(odd, none):
    got = simhash.similar(odd).collect()
    assert len(got) == odd.count() and {r["component_id"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert simhash.similar(none).count() == 0


def test_texts_of_the_same_words_in_other_orders(spark):
    """All have one fingerprint and few are alike; the crowd is parted by bands of the sketches, which loses no copy."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(900):
        rng.shuffle(words)
        texts.append(" ".join(words))
    near = [" ".join([*t.split()[1:], t.split()[0]]) for t in texts[:40]]  # a rotated text: 0.85 of its shingles and more
    docs = spark.createDataFrame(list(enumerate(texts + near)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs, most=100).collect()}
    assert sum(got[900 + k] == k for k in range(40)) >= 38 and all(got[k] == k for k in range(900))
