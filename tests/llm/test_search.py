"""The threshold algorithm against scores of every document."""

import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+").findall


def terms(text):
    return TERM("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    total, df = sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in sorted(set(items), key=str):
        scores = []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * len(held) // total
            s = sum(floor(1000 * log((2 * len(held) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item_id, n + 1, None if u else i, -s) for n, (s, u, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, k=10):
    docs = spark.createDataFrame([(*d, 1.0, 2) for d in docs], "doc_id long, text string, score double, rank int")
    items = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in lexical.search(docs, items, k).collect()), key=str)


def made(rng, n):
    words = ["w%d" % (rng.paretovariate(0.7) % 300) for _ in range(n)]
    return rng.choice([" ", ", ", "\n", "\x00"]).join(w.upper() if rng.random() < 0.2 else w for w in words)


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(i, made(rng, rng.randrange(1, 80))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(None, docs[7][1]), (None, None), (5000, ""), (5001, " - "), (8, docs[8][1]), (5002, "été naïve ÉTÉ 中文 w1")]
    items = [(i, made(rng, rng.randrange(1, 30))) for i in range(25)] + [(90, docs[7][1]), (91, "w1 w1 w1 w2"), (92, "nothing of this"), (93, None), (94, ""), (None, "w3 w4"), (91, "w1 w1 w1 w2"), (95, "été É 中文")]
    want = brute(docs, items)
    assert found(spark, docs, items) == want
    monkeypatch.setattr(lexical, "ITEM_BYTES", 500)  # several blocks of items
    assert found(spark, docs, items) == want


def test_odd_and_empty_tables(spark, odd, none):
    items = spark.createDataFrame([(1, "the dog and the cat"), (2, "z" * 3000)], "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = sorted((tuple(r) for r in lexical.search(odd, items).collect()), key=str)
    assert got == brute(rows, [(1, "the dog and the cat"), (2, "z" * 3000)])
    assert lexical.search(none, items).count() == 0 and lexical.search(odd, items.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [1, 50])
def test_reading_stops_early_and_blocks_do_not_matter(copies):
    """One short document holds the item's rare terms; the lists of common terms aren't read to their ends."""
    rng, best, depths = random.Random(1), lexical.Best(3), []
    for b in range(4):
        stops, terms_, impacts = [0], [], []
        for d in range(2000):
            own = sorted(rng.sample(range(40), 10)) + ([40, 41] if d % (2000 // copies) == 0 else [])
            terms_ += own
            impacts += [rng.randrange(1, 50) if t < 40 else 10_000 for t in own]
            stops.append(len(terms_))
        block = lexical.Block(pa.array(range(b * 2000, b * 2000 + 2000), pa.int64()), np.array(impacts), np.array(terms_), np.array(stops), np.full(42, 2, np.int64))
        depths.append(block.search(np.array([1, 2, 40, 41]), np.array([1, 2, 1, 1]), best))
        every = block.times.copy()
        assert not every.any() and not block.seen.any()
    if copies == 50:
        assert max(depths) < 300
    assert list(best.score) == sorted(best.score, reverse=True)


def test_long_texts_are_split_in_windows(monkeypatch):
    text = "Ab-c d9 é" * 2000
    want = lexical.terms_of(text)
    monkeypatch.setattr(lexical.common, "WINDOW", 50)
    assert lexical.terms_of(text) == want == Counter(t.encode() for t in terms(text))
