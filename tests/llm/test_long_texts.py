"""Texts of some megabytes in the operators that read texts word by word."""

import re

import public_tokenizers
import sentencepiece

from tidemark.llm import audit, lexical, token_counts

LONG = "The quick-brown fox, jumps over the lazy dog #1 " * 60_000 + "z" * 100_000


def test_terms_of_a_long_text():
    found = lexical.terms_of(LONG)
    assert found[b"the"] == 120_000 and found[b"quick"] == found[b"1"] == 60_000 and found[b"z" * 100_000] == 1
    assert found.total() == 10 * 60_000 + 1


def test_filters_on_a_long_text():
    words = re.split("[\x20\x09-\x0d]+", LONG)
    digest, fails = audit.failures(LONG)
    assert len(words) > 200 and fails == 0b1010  # few distinct words, and a symbol


def test_token_counts_of_a_long_text():
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert token_counts.Counts(path, None)([LONG, " " + LONG]) == [len(model.encode(t)) for t in (LONG, " " + LONG)]
