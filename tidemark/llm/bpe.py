"""Byte-level BPE encoding and decoding on length-bucketed numpy matrices.

Pre-tokens of similar byte length share a padded id matrix. Each round every row merges its leftmost pair of
minimum rank (pairs are found in an open-addressed hash table), the row closes up, and finished rows leave the
matrix. Pre-tokens over LONG bytes go through an equivalent heap, as rounds would cost their length squared.

Defined cases: null text counts as empty (0 ids, digests of no bytes); rows may repeat; columns other than
``doc_id`` and ``text`` are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm import common
from tidemark.llm.wordcache import CachedEncoder

#: Bytes above which one pre-token is merged with a heap.
LONG = 256
NONE = np.int32(2**31 - 1)


class PairTable:
    """(left id, right id) -> merged id, by open addressing over numpy arrays."""

    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(len(keys) * 4 + 16))))
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        self.mask = np.int64(size - 1)
        at, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = self.keys[at[left]] == -1
            _, first = np.unique(at[left][free], return_index=True)
            won = left[free][first]
            self.keys[at[won]], self.values[at[won]] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            taken = self.keys[at[left]] != keys[left]
            left = left[taken]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where the pair isn't known or a side is padding (-1)."""
        keys = (left.astype(np.int64) << 32) | right
        keys[(left < 0) | (right < 0)] = -2
        at = self._slot(keys)
        out = np.full(keys.shape, NONE, np.int32)
        todo = np.flatnonzero(keys != -2)
        for _ in range(self.probes):
            if not len(todo):
                break
            seen = self.keys[at[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (seen != -1)]
            at[todo] = (at[todo] + 1) & self.mask
        return out


class Vocabulary:
    """Ranks of byte strings; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.full(256, -1, np.int32)
        for b in range(256):
            self.single[b] = ranks.get(bytes([b]), -1)
        if (self.single < 0).any():
            raise ValueError("the vocabulary lacks some single bytes")
        pairs, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs.append((a << 32) | b)
                    merged.append(rank)
        self.pairs = PairTable(np.array(pairs, np.int64), np.array(merged, np.int32))
        n = max(ranks.values()) + 1
        self.length = np.zeros(n, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)
        self.offset = np.cumsum(self.length) - self.length
        self.blob = np.zeros(int(self.length.sum()), np.uint8)
        for token, rank in ranks.items():
            self.blob[self.offset[rank] : self.offset[rank] + len(token)] = np.frombuffer(token, np.uint8)

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))})

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each pre-token as little-endian uint32 bytes."""
        out: list[bytes] = [b""] * len(words)
        buckets: dict[int, list[tuple[int, bytes]]] = {}
        for i, word in enumerate(words):
            raw = common.utf8(word)
            whole = self.ranks.get(raw)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(raw) > LONG:
                out[i] = self._long(raw).tobytes()
            elif raw:
                buckets.setdefault((len(raw) + 3) // 4, []).append((i, raw))
        for width, bucket in buckets.items():
            for at in range(0, len(bucket), 16384):
                self._matrix(bucket[at : at + 16384], width * 4, out)
        return out

    def _matrix(self, bucket: list[tuple[int, bytes]], width: int, out: list[bytes]) -> None:
        lengths = np.array([len(r) for _, r in bucket])
        raw = np.frombuffer(b"".join(r.ljust(width, b"\0") for _, r in bucket), np.uint8).reshape(len(bucket), width)
        columns = np.arange(width)
        ids = np.where(columns < lengths[:, None], self.single[raw], -1)
        ids = np.concatenate([ids, np.full((len(bucket), 1), -1, np.int32)], 1).astype(np.int32)
        ranks = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(bucket), width)
        rows = np.arange(len(bucket))
        while True:
            best = ranks.argmin(1)
            low = np.take_along_axis(ranks, best[:, None], 1)[:, 0]
            done = low == NONE
            if done.any():
                for r, line, n in zip(rows[done], ids[done], lengths[done]):
                    out[bucket[r][0]] = line[:n].tobytes()
                keep = ~done
                rows, ids, ranks, lengths, best, low = rows[keep], ids[keep], ranks[keep], lengths[keep], best[keep], low[keep]
                if not len(rows):
                    return
                most = int(lengths.max())
                ids, ranks = ids[:, : most + 1], ranks[:, :most]
            shift = np.arange(ids.shape[1]) > best[:, None]
            moved = np.concatenate([ids[:, 1:], np.full((len(rows), 1), -1, np.int32)], 1)
            ids = np.where(shift, moved, ids)
            moved = np.concatenate([ranks[:, 1:], np.full((len(rows), 1), NONE, np.int32)], 1)
            ranks = np.where(shift[:, :-1], moved, ranks)
            lengths = lengths - 1
            every = np.arange(len(rows))
            ids[every, best] = low
            ranks[every, best] = self.pairs.get(ids[every, best], ids[every, best + 1])
            inner = best > 0
            ranks[every[inner], best[inner] - 1] = self.pairs.get(ids[every[inner], best[inner] - 1], ids[every[inner], best[inner]])

    def _long(self, raw: bytes) -> np.ndarray:
        n, get = len(raw), self.ranks.get
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := get(raw[i : end[j]])) is not None:
                heapq.heappush(heap, (rank, i, end[i], end[j]))

        heap: list[tuple[int, int, int, int]] = []
        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, middle, stop = heapq.heappop(heap)
            if not alive[i] or end[i] != middle or after[i] >= n or end[after[i]] != stop:
                continue
            j = after[i]
            alive[j], end[i], after[i] = False, stop, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([self.ranks[raw[i : end[i]]] for i in range(n) if alive[i]], np.uint32)

    def decode(self, ids: bytes) -> bytes:
        """Bytes of little-endian uint32 ids."""
        tokens = np.frombuffer(ids, "<u4").astype(np.int64)
        lengths = self.length[tokens]
        stops = np.cumsum(lengths)
        if not len(tokens):
            return b""
        return self.blob[np.arange(int(stops[-1])) + np.repeat(self.offset[tokens] - (stops - lengths), lengths)].tobytes()


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary.from_file(path)


@lru_cache(2)
def encoder(path: str, pattern: str) -> CachedEncoder:
    return CachedEncoder(pattern, vocabulary(path).encode_words)


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary, little-endian uint32) of every text."""

    def make():
        encode = encoder(path, pattern)
        return lambda ids, texts: [ids, encode([t or "" for t in texts])]

    return common.arrow_map(docs.select("doc_id", "text"), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """The inverse of :func:`encode_texts`: doc_id, decoded (binary). Null ids count as none."""

    def make():
        vocab = vocabulary(path)
        return lambda ids, tokens: [ids, [vocab.decode(t or b"") for t in tokens]]

    return common.arrow_map(encoded.select("doc_id", "ids"), make, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, with the text decoded from the ids in the same pass."""

    def make():
        encode, vocab = encoder(path, pattern), vocabulary(path)

        def f(ids, texts):
            tokens = encode([t or "" for t in texts])
            digest = lambda b: hashlib.sha256(b).hexdigest()
            return [ids, [len(t) // 4 for t in tokens], [digest(t) for t in tokens], [digest(vocab.decode(t)) for t in tokens]]

        return f

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.arrow_map(docs.select("doc_id", "text"), make, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
