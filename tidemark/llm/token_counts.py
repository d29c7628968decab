"""Token counts by a two-tier lookup on the map side; no pre-token is shuffled.

A sentencepiece BPE model whose pieces never hold a space mark after another character can't merge over the start of a
run of spaces, so a text's count is the sum over its pre-tokens: runs of spaces with what follows. The first pass
counts pre-tokens in every task in a summary of bounded size, and summaries are merged a few at a time into the FREQUENT most
frequent ones. Their token counts make the first tier: an open-addressed table of numpy arrays, some MB, sent to all
workers, which looks up all distinct pre-tokens of a slice at once and compares whole keys. The rest goes through the
second tier, a bounded cache in each worker, whose misses the library encodes. The tables only save work: counts are the
library's whatever they hold. A model that normalises, strips spaces or whose pieces cross words gets whole texts instead.

Edge cases: a null text counts as empty, with no tokens; the mark U+2581 in a text is a space, as in the library; its
control strings (``<s>``) are plain text; repeated rows count each; an empty table has no row; a long run without
spaces goes to the library in one piece, but isn't cached.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

MARK = "▁"
#: Pre-tokens in a summary and in the first tier; summaries merged at once on the driver; bytes of a pre-token there.
FREQUENT, LOTS, KEY_BYTES = 1 << 15, 32, 15
#: Pre-tokens in a worker's cache, and bytes of one.
CACHED, CACHED_BYTES = 500_000, 64
_SPACED = re.compile(f"[ {MARK}]+[^ {MARK}]*").findall


def load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def divisible(model) -> bool:
    """Whether texts may be cut before runs of spaces."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    spec.ParseFromString(model.serialized_model_proto())
    rules = spec.normalizer_spec
    plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and not rules.remove_extra_whitespaces and rules.escape_whitespaces
    words = spec.trainer_spec.model_type == spec.trainer_spec.BPE and not spec.trainer_spec.treat_whitespace_as_suffix
    return plain and words and not any(MARK in p.piece.lstrip(MARK) for p in spec.pieces)


def pre_tokens(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pre-tokens of the texts, the numbers of each text's, and where each text's numbers begin (and the last end).

    A pre-token is given without its first space; the text has one put before it, as the library does. Texts without
    runs of spaces are cut by Arrow.
    """
    column = pa.array(texts, pa.large_string())
    odd = pc.or_(pc.or_(pc.match_substring(column, "  "), pc.match_substring(column, MARK)), pc.starts_with(column, " "))
    cut = pc.split_pattern(pc.if_else(odd, pa.scalar("", pa.large_string()), column), " ")
    sizes = np.diff(cut.offsets.to_numpy())
    values = cut.values.slice(cut.offsets[0].as_py(), int(sizes.sum()))
    rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    if len(rows):
        found = [[w[1:].replace(MARK, " ") for w in _SPACED(" " + texts[i])] for i in rows.tolist()]
        lists = pa.array([w for ws in found for w in ws], pa.large_string())
        longer = np.array([len(ws) for ws in found])
        begins = np.cumsum(sizes) - sizes
        sizes[rows], begins[rows] = longer, len(values) + np.cumsum(longer) - longer
        take = np.arange(int(sizes.sum())) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
        values = pa.concat_arrays([values, lists])
        coded = values.dictionary_encode()
        numbers = coded.indices.to_numpy()[take]
    else:
        coded = values.dictionary_encode()
        numbers = coded.indices.to_numpy()
    return coded.dictionary, numbers, np.concatenate([[0], np.cumsum(sizes)])


def keys(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers that hold the bytes and the length of each word, and which words are short enough."""
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    size = np.diff(at)
    short = size <= KEY_BYTES
    kept, begin = np.where(short, size, 0), at[:-1]
    packed = np.zeros((len(words), 16), np.uint8)
    row = np.repeat(np.arange(len(words)), kept)
    column = np.arange(int(kept.sum())) - np.repeat(np.cumsum(kept) - kept, kept)
    data = words.buffers()[2]
    if data is not None and len(row):
        packed[row, column] = np.frombuffer(data, np.uint8)[np.repeat(begin, kept) + column]
    packed[:, 15] = kept + 1
    return packed.view("<u8"), short


class Table:
    """Open-addressed table from keys to small counts; a zero key is an empty slot."""

    def __init__(self, key: np.ndarray, count: np.ndarray):
        self.bits = max(4, (2 * len(key)).bit_length())
        self.key, self.count = np.zeros((1 << self.bits, 2), np.uint64), np.zeros(1 << self.bits, np.uint8)
        slot, left = self._slots(key), np.arange(len(key))
        while len(left):
            free = self.key[slot[left], 1] == 0
            first = np.unique(slot[left[free]], return_index=True)[1]  # of those that want a slot one gets it
            put = left[free][first]
            self.key[slot[put]], self.count[slot[put]] = key[put], count[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slots(self, key: np.ndarray) -> np.ndarray:
        mixed = (key[:, 0] ^ (key[:, 1] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
        return (mixed * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Counts; -1 where a key is missing."""
        out, slot, left = np.full(len(key), -1, np.int64), self._slots(key), np.arange(len(key))
        while len(left):
            there = self.key[slot[left]]
            same = (there == key[left]).all(1)
            out[left[same]] = self.count[slot[left[same]]]
            left = left[~same & (there[:, 1] != 0)]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        return out


class Summary:
    """The most frequent of many words in bounded memory: of more than ``size`` all lose the count of the first one that
    has no place, and those at zero go. Each count is at most its share too low, and sums of summaries keep that."""

    def __init__(self, size: int = FREQUENT):
        self.size, self.held, self.rows = size, [], 0

    def add(self, words: pa.Array, counts: pa.Array) -> None:
        self.held.append(pa.table([words, counts], ["word", "n"]))
        self.rows += len(words)
        if self.rows > 8 * self.size:
            self.cut()

    def cut(self) -> pa.Table:
        found = pa.concat_tables(self.held) if self.held else pa.table([pa.array([], pa.large_string()), pa.array([], pa.int64())], ["word", "n"])
        found = found.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
        if found.num_rows > self.size:
            n = found["n"].to_numpy()
            least = np.partition(n, -self.size - 1)[-self.size - 1]
            found = found.set_column(1, "n", pa.array(n - least)).filter(pa.array(n > least))
        self.held, self.rows = [found], found.num_rows
        return found


_SUMMARY = "lot int, words array<string>, counts array<long>"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = Summary()
    for batch in batches:
        for part in common.slices(batch):
            words, numbers, _ = pre_tokens([t or "" for t in part.column(0).to_pylist()])
            n = np.bincount(numbers, minlength=len(words)).astype(np.int64)
            short = pc.less_equal(pc.binary_length(words), KEY_BYTES)
            own.add(words.filter(short), pa.array(n).filter(short))
    yield _packed(own, TaskContext.get().partitionId() % LOTS)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = Summary()
    for batch in batches:
        for i in range(batch.num_rows):
            own.add(batch.column(1)[i].values.cast(pa.large_string()), batch.column(2)[i].values)
    yield _packed(own, 0)


def _packed(own: Summary, lot: int) -> pa.RecordBatch:
    found = own.cut()
    words, n = found["word"].combine_chunks().cast(pa.string()), found["n"].combine_chunks()
    ends = pa.array([0, len(words)], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([lot], pa.int32()), pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, n)], ["lot", "words", "counts"])


def frequent(docs: DataFrame) -> list[str]:
    """About the FREQUENT most frequent pre-tokens of all texts, up to KEY_BYTES bytes long."""
    common.small_batches(docs.sparkSession)
    each = docs.select("text").mapInArrow(_summaries, _SUMMARY)
    lots = each.repartition(LOTS, "lot").mapInArrow(_merged, _SUMMARY).where(F.size("words") > 0)
    whole = Summary()
    for r in lots.toLocalIterator():
        whole.add(pa.array(r["words"], pa.large_string()), pa.array(r["counts"], pa.int64()))
    return whole.cut()["word"].to_pylist()


class Counts:
    """Token counts of texts, with both tiers."""

    def __init__(self, path: str, table: Table | None):
        self.model, self.table, self.cache = load(path), table, {}
        self.divides = divisible(self.model)
        self.before = len(self.model.encode("a"))

    def encoded(self, words: list[str]) -> list[int]:
        """Tokens of pre-tokens by the library, each behind a letter that its first space keeps apart."""
        return [len(ids) - self.before for ids in self.model.encode([f"a {w}" for w in words], num_threads=1)]

    def _missing(self, words: list[str]) -> list[int]:
        cache = self.cache
        new = [w for w in words if w not in cache]
        if len(cache) + len(new) > CACHED:
            cache.clear()
            new = words
        found = dict(zip(new, self.encoded(new))) if new else {}
        cache.update((w, n) for w, n in found.items() if len(w) <= CACHED_BYTES)
        return [found[w] if w in found else cache[w] for w in words]

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.divides:
            return [len(ids) for ids in self.model.encode(texts, num_threads=1)]
        words, numbers, begins = pre_tokens(texts)
        counts = np.full(len(words), -1, np.int64)
        if self.table is not None and len(words):
            key, short = keys(words)
            counts[short] = self.table.find(key[short])
        missing = np.flatnonzero(counts < 0)
        if len(missing):
            counts[missing] = self._missing(words.take(pa.array(missing)).to_pylist())
        sums = np.concatenate([[0], np.cumsum(counts[numbers])])
        total = sums[begins[1:]] - sums[begins[:-1]]
        return [n if t else 0 for n, t in zip(total.tolist(), texts)]


def count(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each document, by the sentencepiece model at ``path``."""
    counts, table = Counts(path, None), None
    if counts.divides:
        words = frequent(docs)
        if words:
            number = np.array(counts.encoded(words))
            table = Table(keys(pa.array(words, pa.large_string()))[0], number.astype(np.uint8))
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def make():
        of = Counts(path, sent.value)

        def run(ids, texts):
            texts = [t or "" for t in texts]
            n = of(texts)
            return [ids, [len(common.utf8(t)) for t in texts], n, [x > limit for x in n]]

        return run

    return common.arrow_map(docs.select("doc_id", "text"), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
