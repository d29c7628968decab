"""similar() joins exactly the texts that are connected by shares of 0.8 and more, whatever the fingerprints."""

import random

import pytest

from tests.llm.test_similar import share
from tidemark.llm import simhash


def brute(texts):
    least = list(range(len(texts)))
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if share(texts[a], texts[b]) >= 0.8]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return dict(enumerate(least))


@pytest.mark.parametrize("most", [2048, 5])
def test_components_are_those_of_all_pairs(spark, most):
    """Copies with one block of other words: near the limit of 0.8, and far apart by their words' fingerprints; a line
    that most texts have, and texts of equal words in other orders."""
    rng = random.Random(5)
    line = " ".join(f"line{i}" for i in range(12))
    texts = []
    for family in range(30):
        size = rng.choice([30, 80, 200])
        base = [f"f{family}w{rng.randrange(12 if family % 3 == 0 else 500)}" for _ in range(size)]
        for _ in range(6):
            at, n = rng.randrange(size), rng.randrange(size // 7 + 1)
            copy = base[:at] + [f"new{rng.randrange(10**6)}" for _ in range(n)] + base[at + n :]
            texts.append(" ".join(copy) + (" " + line if rng.random() < 0.7 else ""))
    words = [f"o{i}" for i in range(40)]
    for _ in range(60):
        rng.shuffle(words)
        texts += [" ".join(words), " ".join([*words[2:], *words[:2]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar(docs, most).collect()} == brute(texts)
