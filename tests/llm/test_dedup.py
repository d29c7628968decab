import hashlib
import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import repeats, simhash
from tidemark.llm import bwt
from tidemark.llm.bwt import repeated
from tidemark.llm.components import components


def brute_fingerprint(text, shingle=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(values):
    left, out = dict(values), {}
    while left:
        seed = min(left)
        todo, group = [seed], []
        fps = {seed: left.pop(seed)}
        while todo:
            k = todo.pop()
            group.append(k)
            near = [j for j, v in left.items() if (v ^ fps[k]).bit_count() <= 3]
            for j in near:
                fps[j] = left.pop(j)
                todo.append(j)
        out |= dict.fromkeys(group, min(group))
    return out


def test_fingerprint_is_as_defined():
    r = random.Random(2)
    for n in (0, 1, 2, 3, 4, 50, 400):
        text = " ".join(r.choice(["The", "cat", "É", "dog\t", "ran"]) for _ in range(n))
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("most", [2048, 3])
def test_links_connect_what_is_within_three_bits(spark, most):
    """``most`` = 3 sends nearly every key through the recursion."""
    r = random.Random(most)
    fps = set()
    for _ in range(12):
        centre = r.getrandbits(64)
        for _ in range(20):
            v = centre
            for _ in range(r.randint(0, 4)):
                v ^= 1 << r.randrange(64)
            fps.add(v)
    fps |= {0, 1, 3, 7, 15, 2**64 - 1, 2**63}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    frame = spark.createDataFrame([(signed(v),) for v in fps], "fp long")
    got = {x["node"]: x["component"] for x in components(simhash.links(frame, most)).collect()}
    want = brute_components({signed(v): v for v in fps})
    classes = lambda m: {frozenset(k for k in m if m[k] == c) for c in set(m.values())}
    assert classes({signed(v): got.get(signed(v), signed(v)) for v in fps}) == classes(want)


def test_components_of_a_chain(spark):
    edges = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {r["component"] for r in components(edges).collect()} == {0}
    assert components(edges.limit(0)).count() == 0


def test_near_duplicates_of_odd_rows(odd, none):
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.digest(simhash.near_duplicates(odd)).collect()}
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for i, text in rows:
        fp = brute_fingerprint(text)
        linked = [j for j, t in rows if j is not None and (brute_fingerprint(t) ^ fp).bit_count() <= 3]
        assert (i, f"{fp:016x}", min(linked, default=None)) in got
    assert simhash.near_duplicates(none).count() == 0


def brute_mask(pieces, size):
    seen = Counter(p[i : i + size] for p in pieces for i in range(len(p) - size + 1))
    return [[i + size <= len(p) and seen[p[i : i + size]] > 1 for i in range(len(p))] for p in pieces]


def test_transform_finds_repeated_windows():
    r = random.Random(3)
    for turn in range(120):
        size, base = r.choice([1, 2, 5, 17, 40]), bytes(r.choice(b"ab" if turn % 2 else b"abcdefgh") for _ in range(60))
        pieces = []
        for _ in range(r.randint(1, 8)):
            p = bytearray(base[r.randint(0, 20) :][: r.randint(0, 60)])
            for _ in range(r.randint(0, 2)):
                if p:
                    p[r.randrange(len(p))] = r.choice(b"abz\0\xff")
            pieces.append(bytes(p))
        assert [m.tolist() for m in repeated(pieces, size)] == brute_mask(pieces, size)


def test_thresholds_with_own_starts(monkeypatch):
    """Several thresholds in one expansion; starts that aren't a piece's own neither count nor are found; both sorts."""
    r = random.Random(6)
    for turn in range(80):
        monkeypatch.setattr(bwt, "WORD", r.choice([1 << 21, 4]))
        base = bytes(r.choice(b"ab" if turn % 2 else b"abcdefgh") for _ in range(60))
        pieces = [base[r.randint(0, 20) :][: r.randint(1, 60)] for _ in range(r.randint(1, 8))]
        own = [r.randint(0, len(p)) for p in pieces]
        for size, masks in zip((3, 9, 20), bwt.repeated_at(pieces, [3, 9, 20], own)):
            seen = Counter(p[i : i + size] for p, n in zip(pieces, own) for i in range(min(n, len(p) - size + 1)))
            want = [[i < n and i + size <= len(p) and seen[p[i : i + size]] > 1 for i in range(len(p))] for p, n in zip(pieces, own)]
            assert [m.tolist() for m in masks] == want


def brute_removal(texts, size):
    raws = [(t or "").encode() for t in texts]
    out = []
    for raw, mask in zip(raws, brute_mask(raws, size)):
        gone = bytearray(len(raw))
        for i, m in enumerate(mask):
            if m:
                gone[i : i + size] = b"\1" * size
        runs = sum(1 for i in range(len(gone)) if gone[i] and (not i or not gone[i - 1]))
        out.append((len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return out


def brute_passages(texts, size, words):
    raws = [(t or "").encode() for t in texts]
    out = []
    for raw, mask in zip(raws, brute_mask(raws, size)):
        gone = bytearray(len(raw))
        for i, m in enumerate(mask):
            if m:
                gone[i : i + size] = b"\1" * size
        runs, at = [], 0
        while (a := gone.find(1, at)) >= 0:
            at = b if (b := gone.find(0, a)) >= 0 else len(gone)
            runs.append(raw[a:at])
        out.append(sum(len(r.split()) >= words for r in runs))
    return out


@pytest.mark.parametrize("most", [4000, 1])
def test_removal_equals_brute_force(spark, most):
    """``most`` = 1 sends every contested anchor to counting."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 6)))
    passages = [" ".join(word() for _ in range(20)) for _ in range(6)]
    texts = [" ".join(r.choice([r.choice(passages), word(), word()]) for _ in range(r.randint(0, 12))) for _ in range(60)]
    texts += [texts[0], None, "", "a" * 300, "a" * 41, "xyz" * 60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = repeats.digest(repeats.remove(docs, length=40, passage=25, anchor=12, most=most, words=5)).collect()
    got = {x["doc_id"]: tuple(x)[1:5] for x in found}
    assert [got[i] for i in range(len(texts))] == brute_removal(texts, 40)
    passages = {x["doc_id"]: x["n_passages"] for x in found}
    assert [passages[i] for i in range(len(texts))] == brute_passages(texts, 25, 5) and max(passages.values()) > 1


def test_anchors_do_not_depend_on_blocks():
    r = random.Random(4)
    raw = bytes(r.choice(b"ab") for _ in range(3000)) + b"a" * 500
    one, two = repeats.Anchors(40, 12), repeats.Anchors(40, 12, block=100)
    spread = lambda x: [a for n, a in zip(x[1].tolist(), x[2].tolist()) for _ in range(n)]
    assert spread(one(raw)) == spread(two(raw))


def test_anchors_are_sparse():
    r = random.Random(11)
    raw = bytes(r.choice(b"etaoin shrdlu") for _ in range(50_000))
    first, n, _ = repeats.Anchors(400, 128)(raw)
    assert int(n.sum()) == len(raw) - 399 and len(first) < 3 * len(raw) / 273
    moved = repeats.Anchors(400, 128)(b"x" * 7 + raw)[2].tolist()
    assert len(set(moved) & set(repeats.Anchors(400, 128)(raw)[2].tolist())) >= len(first) - 4


def test_removal_of_odd_rows(odd, none):
    rows = odd.collect()
    got = sorted(tuple(r)[1:5] for r in repeats.digest(repeats.remove(odd)).collect())
    assert got == sorted(brute_removal([r["text"] for r in rows], 400))
    assert repeats.remove(none).count() == 0
