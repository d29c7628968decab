"""The bitmap audit against filters applied one after the other."""

import random
from itertools import permutations

import numpy as np

from tidemark.llm import audit


def fails(rows, k):
    i, text, _ = rows[k]
    text = text or ""
    ws = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    earlier = any(j is not None and i is not None and j < i and (t or "") == text for j, t, _ in rows)
    return [len(ws) < 200, 100 * len(set(ws)) < 50 * len(ws), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text), earlier]


def brute(rows, labels):
    out, marks = {}, {}
    for i, quality, toxic in labels:
        good, bad = marks.get(i, (False, False))
        marks[i] = (good or quality == 1, bad or toxic == 1)
    failed = [fails(rows, k) for k in range(len(rows))]
    for part in {lang or "" for _, _, lang in rows}:
        own = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        shapley = [0] * 5
        for order in permutations(range(5)):
            left = own
            for step, f in enumerate(order):
                gone = [k for k in left if failed[k][f]]
                left = [k for k in left if not failed[k][f]]
                label = [sum(marks.get(rows[k][0], (0, 0))[n] for k in gone if rows[k][0] is not None) for n in (0, 1)]
                redundant = sum(failed[k][f] for k in own) - len(gone)
                unique = sum(failed[k] == [g == f for g in range(5)] for k in own)
                shapley[f] += len(gone)
                out[part, "".join("ABCDE"[x] for x in order), step + 1] = [len(left), len(gone), redundant, unique, *label, f]
        for key in [x for x in out if x[0] == part]:
            out[key][-1] = shapley[out[key][-1]]
    return out


def rows_of(frame):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in frame.collect()}


def made(rng, i):
    words = [f"w{rng.randrange(rng.choice([40, 4000]))}" for _ in range(rng.choice([20, 199, 200, 260]))]
    if rng.random() < 0.3:
        words += ["ABCDEFGHIJ"] * rng.randrange(8)
    if rng.random() < 0.3:
        words.append(rng.choice("#$%&*|"))
    return rng.choice([" ", "\t\n", "\x0b"]).join(words)


def test_audit_equals_filters_in_turn(spark, monkeypatch):
    monkeypatch.setattr(audit, "BLOCK", 64)
    rng = random.Random(9)
    rows = [(i, made(rng, i), rng.choice(["en", "de", None, ""])) for i in range(180)]
    rows += [(200 + i, rows[rng.randrange(180)][1], rng.choice(["en", "fr"])) for i in range(60)]
    rows += [(300, None, "en"), (301, "", "de"), (299, "", None), (None, "", "en"), (None, rows[0][1], "de"), rows[3], rows[3], (-5, rows[9][1], "it")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 320, 2)] + [(4, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, digest int, part string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert rows_of(audit.audit(docs, marks)) == brute(rows, labels)
    assert audit.audit(docs.limit(0), marks).count() == 0
    assert rows_of(audit.audit(docs, marks.limit(0))) == brute(rows, [])


def test_blocks_count_parts_that_share_words():
    rng = np.random.default_rng(3)
    parts, failed, good, toxic = rng.integers(0, 9, 700), rng.integers(0, 32, 700), rng.random(700) < 0.5, rng.random(700) < 0.2
    seen = dict(audit.block_counts(parts, failed, good, toxic))
    for p, counts in seen.items():
        for s in range(32):
            for f in range(5):
                if not s >> f & 1:
                    left = (parts == p) & (failed & s == 0)
                    gone = left & (failed >> f & 1 == 1)
                    assert counts[s, f].tolist() == [(left & ~gone).sum(), gone.sum(), (gone & good).sum(), (gone & toxic).sum()]
