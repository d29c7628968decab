"""The bootstrap against a brute-force version, secrets found by it, and hostile texts."""

import math
import random
import re
import time
from collections import defaultdict

from tidemark.llm import pii

_EDGE = pii._EDGE


def brute_contexts(text, start, end):
    """The rules of the docstring, by splitting the text around the entity."""
    head, tail = text[:start], text[end:]
    kept = head.rstrip("".join(pii._SKIP) + " \n\t")
    between = head[len(kept) :]
    words = [w for w in (x.strip(_EDGE).lower() for x in kept.split()) if w]
    rest = tail.lstrip("".join(pii._SKIP) + " \n\t").split()
    after = rest[0].strip(_EDGE).lower() if rest else ""
    out = [f"b2 {words[-2]} {words[-1]}"] if len(words) > 1 else []
    if words and after:
        out.append(f"ba {words[-1]} | {after}")
    if words and set(between) & set(":=#"):
        out.append(f"lb {words[-1]}")
    return out


def brute(rows, confidence=pii.CONFIDENCE, support=pii.MIN_SUPPORT):
    """Added spans of each text."""
    seeds, members, places = set(), defaultdict(set), []
    for k, text in enumerate(rows):
        base = pii.base_spans(text)
        for _, a, b in base:
            seeds.add(text[a:b].lower())
            for c in brute_contexts(text, a, b):
                members[c].add((text[a:b].lower(), True))
        for m in re.finditer(r"\S*[0-9]\S*", text):
            word = m[0]
            a, b = m.start() + len(word) - len(word.lstrip(_EDGE)), m.start() + len(word.rstrip(_EDGE))
            if b - a >= pii.MIN_ID and not any(x < b and a < y for _, x, y in base):
                entity = text[a:b].lower()
                cs = brute_contexts(text, a, b)
                places.append((k, a, b, cs))
                for c in cs:
                    members[c].add((entity, pii.secret_shape(text[a:b])))
    graph = {c: {e: max(s for x, s in es if x == e) for e, _ in es} for c, es in members.items()}
    accepted, own = {}, {}
    while True:
        fresh = {}
        for c, es in graph.items():
            trust = [max(float(s), own.get(e, 0.0)) for e, s in es.items()]
            if sum(t > 0 for t in trust) >= support:
                score = sum(trust) / len(trust) * min(1, math.log2(1 + sum(trust)) / math.log2(1 + support))
                if score >= confidence:
                    fresh[c] = score
        done = len(fresh) <= len(accepted)
        accepted = fresh
        if done:
            break
        own = defaultdict(float)
        for c, score in accepted.items():
            for e in graph[c]:
                own[e] = max(own[e], score)
    out = [[] for _ in rows]
    for k, a, b, cs in places:
        if any(c in accepted for c in cs):
            out[k].append(f"id:{a}:{b}")
    return [",".join(x) for x in out]


def test_bootstrap_equals_brute_force(spark):
    rng = random.Random(5)
    labels, words = ["token =", "phone:", "ref #", "key", "from"], ["ab", "cd", "ef", "gh", "(", "\"", "ij"]
    make = [lambda: f"+1 555 010-{rng.randrange(1000, 9999)}", lambda: f"10.0.0.{rng.randrange(256)}", lambda: "%040x" % rng.getrandbits(160), lambda: f"x-{rng.randrange(100000, 999999)}", lambda: str(rng.randrange(10, 999))]
    for _ in range(3):
        rows = []
        for _ in range(300):
            k = rng.randrange(5)
            entity = make[k if rng.random() < 0.8 else rng.randrange(5)]()
            rows.append(f"{rng.choice(words)} {rng.choice(words)} {labels[k]} {rng.choice(['', chr(34)])}{entity}{rng.choice(['', chr(34), '.'])} {rng.choice(words)}")
        found = pii.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
        got = {r["doc_id"]: ",".join(f"id:{s['start']}:{s['stop']}" for s in r["added"]) for r in found.collect()}
        want = brute(rows)
        assert [got[k] for k in range(len(rows))] == want and any(want)


def test_secrets_need_an_accepted_pattern(spark):
    rows = [f'so token = "{i + 1:030x}abc7de4f91" here' for i in range(8)] + ["alone 4f3a2b1c" * 4, 'the token = "kiwi-77" there', "number 7086638319846192 of"]
    got = [r["spans"] for r in pii.digest(pii.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))).orderBy("doc_id").collect()]
    assert all(x.startswith("id:12:") for x in got[:8]) and got[9] == "id:13:20" and got[8] == got[10] == ""


def test_long_digits_and_tokens_take_linear_time(spark):
    rows = ["1" * 5000 + ".1.1.1", "9" * 3_000_000, "a" * 5_000_000 + " 7", "0" * 5000 + "1.2.3.4", "1." * 300_000, "+1" * 300_000, "a@" * 300_000, "x" * 2_000_000 + "1 " + "." * 1_000_000 + " 1234567"]
    begun = time.time()
    got = [r["n_ip"] for r in pii.digest(pii.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))).orderBy("doc_id").collect()]
    assert got[0] == 0 and got[3] == 1 and time.time() - begun < 60
