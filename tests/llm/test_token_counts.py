"""Token counts against the library on whole texts."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from tidemark.llm import token_counts as C
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return lambda texts: [len(model.encode(t or "")) for t in texts]


def odd_texts(n=5000):
    rng, letters = random.Random(2), " ▁\t\na é中<s>1é🎉\x00  "
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(n)] + [" ", "", "▁", "a ", "  a  ", "</s> <unk>", "a" * 3000 + " " + "b1" * 500]


@pytest.mark.parametrize("held", [0, 3, 400])
def test_counts_equal_the_library(library, held):
    texts = odd_texts()
    words, numbers, _ = C.pre_tokens(texts)
    order = np.argsort(-np.bincount(numbers), kind="stable")
    common = [w for w in words.take(pa.array(order)).to_pylist() if len(w.encode()) <= C.KEY_BYTES][:held]
    table = C.Table(C.keys(pa.array(common, pa.large_string()))[0], np.array(C.Counts(PATH, None).encoded(common), np.uint8)) if held else None
    count = C.Counts(PATH, table)
    assert count(texts) == library(texts) == [n for t in texts for n in count([t])]


def test_a_full_cache_and_an_undivided_model_change_nothing(library, monkeypatch):
    texts, count = odd_texts(400), C.Counts(PATH, None)
    monkeypatch.setattr(C, "CACHED", 20)
    assert [n for t in texts for n in count([t, t])] == [n for n in library(texts) for _ in range(2)]
    count.divides = False
    assert count(texts) == library(texts)


def test_table_finds_whole_keys_only():
    words = [f"w{i}" for i in range(3000)] + ["", "a\x00", "a", "é" * 7]
    table = C.Table(C.keys(pa.array(words, pa.large_string()))[0], np.arange(len(words)) % 200)
    other = ["w3000", "a\x00\x00", "b", "x" * 15, "w1 "]
    key, short = C.keys(pa.array([*words, *other, "y" * 16], pa.large_string()))
    assert table.find(key[short]).tolist() == [i % 200 for i in range(len(words))] + [-1] * len(other) and not short[-1]


def test_summaries_keep_frequent_words_whatever_is_merged():
    rng, parts = random.Random(1), []
    for p in range(6):
        own = C.Summary(20)
        for _ in range(30):
            words = [f"hot{rng.randrange(8)}" if rng.random() < 0.6 else f"rare{rng.randrange(10**6)}" for _ in range(50)]
            own.add(pa.array(words, pa.large_string()), pa.array([1] * len(words)))
        parts.append(own.cut())
    whole = C.Summary(20)
    for p in parts:
        whole.add(p["word"].combine_chunks(), p["n"].combine_chunks())
    assert {f"hot{i}" for i in range(8)} <= set(whole.cut()["word"].to_pylist()) and whole.rows <= 20


def test_count_on_odd_and_empty_tables(spark, odd, none, library):
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in C.count(odd, PATH, limit=20).collect())
    sizes = library([t for _, t, _ in ODD])
    assert got == sorted((str(i), len((t or "").encode()), n, n > 20) for (i, t, _), n in zip(ODD, sizes))
    assert C.count(none, PATH).count() == 0
