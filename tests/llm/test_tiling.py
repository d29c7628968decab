"""Tiles against a quadratic greedy tiler, and whole results against brute force."""

import random

from tidemark.llm import decontaminate as D


def slow_tiles(doc, item, match=D.MATCH):
    """Marks the longest free match again and again, of equal ones the first in the document, then in the item."""
    match = min(match, len(item))
    free_d, free_i, tiles = [True] * len(doc), [True] * len(item), []
    while True:
        best = None
        for d in range(len(doc)):
            for k in range(len(item)):
                n = 0
                while d + n < len(doc) and k + n < len(item) and free_d[d + n] and free_i[k + n] and doc[d + n] == item[k + n]:
                    n += 1
                if n >= match and n and (best is None or (-n, d, k) < best):
                    best = (-n, d, k)
        if best is None:
            return tiles
        n, d, k = -best[0], *best[1:]
        free_d[d : d + n], free_i[k : k + n] = [False] * n, [False] * n
        tiles.append((d, k, n))


def mixed(rng, letters, most):
    """Words with long repeats in them."""
    out = []
    while len(out) < most:
        if out and rng.random() < 0.4:
            a = rng.randrange(len(out))
            out += out[a : a + rng.randrange(1, 12)]
        else:
            out.append(rng.choice(letters))
    return out[:most]


def test_tiles_equal_a_quadratic_tiler():
    rng = random.Random(3)
    for k in range(1500):
        letters = "ab" if k % 3 == 0 else "abcdefgh"
        item = mixed(rng, letters, rng.randrange(1, 30))
        doc = mixed(rng, letters, rng.randrange(1, 40))
        if rng.random() < 0.7:
            for _ in range(3):
                a, b = rng.randrange(len(item)), rng.randrange(len(doc))
                doc[b:b] = item[a : a + rng.randrange(1, 20)]
        match = rng.choice([2, 3, 5])
        got, want = D.tile(doc, item, match), slow_tiles(doc, item, match)
        assert sorted(got) == sorted(want), (doc, item, match)
        assert [n for _, _, n in got] == sorted((n for _, _, n in got), reverse=True)


def test_contaminated_pairs_equal_brute_force(spark):
    """Every pair is tiled in the brute force, so no bound may lose one; a phrase that all share makes no pairs."""
    rng = random.Random(4)
    phrase = "as all of us know well today".split()
    items = [phrase + [rng.choice("bcdefghijk") + rng.choice("xyz") for _ in range(rng.randrange(8, 25))] for _ in range(12)] + [phrase, ["one", "two"]]
    docs = []
    for k in range(120):
        doc = [rng.choice("bcdefghijk") + rng.choice("xyz") for _ in range(rng.randrange(10, 40))] + phrase
        if k % 2:
            item = rng.choice(items)
            cut = rng.randrange(1, len(item) + 1)
            doc += item[cut:] + ["or"] * (k % 3) + item[:cut]
        docs.append(doc)
    got = D.contaminated(spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(items)], "item_id long, text string")).collect()
    want = {}
    for k, d in enumerate(docs):
        for j, item in enumerate(items):
            n = sum(n for _, _, n in slow_tiles(d, item))
            if n >= D.COVERAGE * len(item):
                want[k, j] = n
    assert {(r["doc_id"], r["item_id"]): r["matched_words"] for r in got} == want and len(want) > 60
