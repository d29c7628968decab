import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe, token_file
from tidemark.llm.common import new_folder

RANKS, JSON = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def texts():
    r = random.Random(5)
    out = ["", " ", "  a   b \n\n c\t", "日本語 テキスト 🎉 नमस्ते ½²Ⅷ", "a" * 700 + " " * 300 + "b", "x's DON'T 'S", "é" * 300]
    return out + ["".join(r.choice("ab \n\t'sé1!\x1c\x85") for _ in range(r.randint(0, 60))) for _ in range(200)]


def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(RANKS).ranks, special_tokens={})


def test_encoding_equals_the_library():
    encode, want = bpe.encoder(RANKS, public_tokenizers.PATTERN), reference()
    for text, ids in zip(texts(), encode(texts())):
        assert np.frombuffer(ids, "<u4").tolist() == want.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=6))
def test_encoding_equals_the_library_on_any_text(given_texts):
    encode, want = bpe.encoder(RANKS, public_tokenizers.PATTERN), reference()
    for text, ids in zip(given_texts, encode(given_texts)):
        assert np.frombuffer(ids, "<u4").tolist() == want.encode_ordinary(text)
        assert bpe.vocabulary(RANKS).decode(ids) == text.encode()


def test_heap_and_matrix_agree():
    v, r = bpe.vocabulary(RANKS), random.Random(1)
    for _ in range(200):
        raw = bytes(r.choice(b"theandion \xc3\xa9") for _ in range(r.randint(2, 40)))
        out = [b""]
        v._matrix([(0, raw)], -(-len(raw) // 4) * 4, out)
        assert out[0] == v._long(raw).astype("<u4").tobytes()


def test_round_trip_of_odd_rows(odd, none):
    got = bpe.round_trip(odd, RANKS, public_tokenizers.PATTERN).collect()
    want = reference()
    assert sorted(r["n_tokens"] for r in got) == sorted(len(want.encode_ordinary(r["text"] or "")) for r in odd.collect())
    assert bpe.round_trip(none, RANKS, public_tokenizers.PATTERN).count() == 0
    encoded = bpe.encode_texts(odd, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode_ids(encoded, RANKS).collect()
    assert sorted(r["decoded"] for r in back) == sorted((r["text"] or "").encode() for r in odd.collect())


def test_library_encoder_behind_caches():
    encode, _ = token_file.encoder(JSON)
    library = Tokenizer.from_file(JSON)
    every = [*texts(), "hi <|endoftext|> yo\n\n  <|endoftext|>"]
    for text, ids in zip(every, encode(every)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_documents_are_dealt_to_files_in_order(spark, monkeypatch):
    monkeypatch.setattr(token_file, "DOCS_A_FILE", 10)
    docs = spark.range(57).selectExpr("(id * 37) % 57 as doc_id", "repeat('word ', cast(id as int)) as text")
    manifest = token_file.write(docs, JSON, new_folder(spark, "tokens"))
    assert manifest.count() > 3
    got = sorted(token_file.read(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == list(range(57))
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))


def test_token_files(spark, odd, none):
    manifest = token_file.write(odd, JSON, new_folder(spark, "tokens"))
    got = sorted((r for r in token_file.read(manifest).collect()), key=lambda r: r["start"])
    library = Tokenizer.from_file(JSON)
    at, ids = 0, sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r["doc_id"] for r in got] == [i for i, _ in ids]
    for row, (_, text) in zip(got, ids):
        want = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)
    uri = manifest.first()["uri"]
    assert token_file.read_documents(uri, [2, 0])[1].tolist()[-1] == 0
    path = uri.removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    raw[20] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(Exception):
        token_file.read_documents(uri, [0])
    assert token_file.read(token_file.write(none, JSON, new_folder(spark, "tokens"))).count() == 0


def test_a_hot_id_and_null_ids_are_dealt_to_several_files(spark, monkeypatch):
    """A third of the rows share an id, a sixth have none: no file holds much more than its share, and the order holds."""
    monkeypatch.setattr(token_file, "DOCS_A_FILE", 50)
    rows = [(7 if k % 3 == 0 else None if k % 6 == 1 else k, f"text number {k}") for k in range(1200)]
    manifest = token_file.write(spark.createDataFrame(rows, "doc_id long, text string"), JSON, new_folder(spark, "tokens"))
    sizes = sorted((r["file"], r["n_docs"]) for r in manifest.collect())
    assert max(n for _, n in sizes) <= 110 and len(sizes) >= 16
    got = sorted(token_file.read(manifest).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))


def test_an_unknown_split_is_refused(tmp_path):
    import json

    data = json.loads(open(JSON, encoding="utf-8").read())
    data["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(data), encoding="utf-8")
    with pytest.raises(ValueError):
        token_file.encoder(str(tmp_path / "other.json"))
