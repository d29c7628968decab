"""Exact removal of long repeated byte strings over a whole corpus.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. On the way, shorter passages are
found too: a passage is a maximal run of bytes covered by strings of PASSAGE bytes that start elsewhere as well,
of WORDS words or more; a passage of few letters a word falls short of LENGTH bytes, is reported and not removed.

Every window of PASSAGE bytes is assigned to its anchor, the leftmost least hash among its ANCHOR-byte strings;
equal windows have equal anchors at the same place, so windows need comparing only within an anchor's hash, and
so do the longer windows that begin with them. The windows of one text that share an anchor are consecutive and
make a fragment: their starts are its own, and its bytes reach to the end of the last one's LENGTH bytes.

1. Texts give (anchor, fragment digest, place) rows. Aggregates count them: a fragment that occurs twice is
   repeated as a whole; an anchor with one fragment that occurs once has nothing to compare.
2. For the other, contested anchors, a second pass over the texts (a bitmap tells candidates) deals the distinct
   fragments' bytes by anchor. Groups are put together up to BATCH_BYTES and their repeated windows found by
   threshold-bounded interval expansion on a Burrows-Wheeler transform (:mod:`tidemark.llm.bwt`), which passes
   PASSAGE and stops at LENGTH; only own starts count, so a place counts once though several fragments show it.
3. An anchor with over MOST_FRAGMENTS distinct fragments isn't gathered in a task: the 128-bit digests of its
   fragments' windows are counted by an aggregate instead, which has the same result.

Texts are keyed by their MD5, so copies share their spans. Within a task the third and later copies of a text or
fragment add nothing to "occurs twice" and are left out before the shuffle. Only texts that lose bytes or hold a
passage (a bitmap of their keys tells them, false positives included) are shuffled to meet their spans. Fragments that
very many texts share and texts with very many copies are dealt over several tasks there
(:func:`tidemark.llm.common.salted_join`); windows that very many fragments share are left to Spark's skewed joins.

Fragments are told apart by a 64-bit digest within an anchor's 64-bit hash.

Defined cases: null text counts as empty; texts under LENGTH bytes and empty ones lose nothing; rows may repeat (a
repeated row is a copy); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.bwt import repeated_at

LENGTH = 400
#: Bytes of the windows that passages are made of, and words of a passage; bytes of an anchor.
PASSAGE, WORDS, ANCHOR = 288, 50, 40
#: Distinct fragments of an anchor that are compared in one task, and bytes put into one transform.
MOST_FRAGMENTS, BATCH_BYTES = 4000, 1 << 18
#: Bytes hashed at once, few enough for a core's cache (places must fit beside 43 bits of hash).
BLOCK = 1 << 16
#: Texts and fragments a task remembers in order to leave out repeated ones.
REMEMBER = 200_000

_ODD = 0x9E3779B97F4A7C15 | 1
_TOP = np.uint64(2**64 - 1)


class Anchors:
    """Fragments of texts: arrays of the text's number, first window, number of windows and anchor hash."""

    def __init__(self, length: int = PASSAGE, anchor: int = ANCHOR, block: int = BLOCK):
        self.length, self.anchor, self.width, self.block = length, anchor, length - anchor + 1, block
        inverse = pow(_ODD, -1, 1 << 64)
        n = block + length + 1
        powers = lambda base: np.multiply.accumulate(np.array([1] + [base] * n, np.uint64))
        self.down, self.up = powers(inverse), powers(_ODD)

    def _hashes(self, raw: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.down[: len(raw)], out=sums[1:])
        n = len(raw) - self.anchor + 1
        h = (sums[self.anchor :] - sums[:n]) * self.up[:n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h

    def _least(self, key: np.ndarray) -> np.ndarray:
        """Minimum of each run of ``width`` keys, by block prefix and suffix minima."""
        w, n = self.width, len(key) - self.width + 1
        blocks = -(-len(key) // w)
        padded = np.full(blocks * w, _TOP)
        padded[: len(key)] = key
        grid = padded.reshape(blocks, w)
        ahead = np.minimum.accumulate(grid, 1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
        return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])

    def _of_buffer(self, array: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Fragments of the texts that lie in ``array`` one after the other."""
        h = self._hashes(array)
        key = (h >> np.uint64(21) << np.uint64(21)) | np.arange(len(h), dtype=np.uint64)
        stops = np.cumsum(sizes)
        stop_of = np.repeat(stops, sizes)
        if len(sizes) > 1:
            key[stop_of[: len(h)] < np.arange(len(h)) + self.anchor] = _TOP
        place = (self._least(key) & np.uint64((1 << 21) - 1)).astype(np.int64)
        starts = np.flatnonzero(stop_of[: len(place)] >= np.arange(len(place)) + self.length)
        place = place[starts]
        cut = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        first = starts[cut]
        owner = np.searchsorted(stops, first, "right")
        return owner, first - (stops - sizes)[owner], np.diff(np.concatenate([cut, [len(starts)]])), h[place[cut]].view(np.int64)

    def many(self, raws: list[bytes]) -> tuple[np.ndarray, ...]:
        """owner, first, n, anchor of the fragments of texts of ``length`` bytes or more, by text and place."""
        found, held, total, base = [], [], 0, 0

        def flush():
            nonlocal held, total, base
            if held:
                owner, first, n, anchor = self._of_buffer(np.frombuffer(b"".join(held), np.uint8), np.array([len(x) for x in held]))
                found.append((owner + base, first, n, anchor))
                base += len(held)
            held, total = [], 0

        for raw in raws:
            if total + len(raw) > self.block:
                flush()
            if len(raw) <= self.block:
                held.append(raw)
                total += len(raw)
                continue
            array, windows = np.frombuffer(raw, np.uint8), len(raw) - self.length + 1
            for at in range(0, windows, self.block):
                part = array[at : at + min(self.block, windows - at) + self.length - 1]
                _, first, n, anchor = self._of_buffer(part, np.array([len(part)]))
                found.append((np.full(len(first), base), first + at, n, anchor))
            base += 1
        flush()
        return tuple(map(np.concatenate, zip(*found))) if found else (np.zeros(0, np.int64),) * 4

    def __call__(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.many([raw] if len(raw) >= self.length else [])[1:]


def _digest(part) -> int:
    h = xxhash.xxh3_64_intdigest(part)
    return h - (1 << 64) if h >> 63 else h


def _seen(memory: dict, key, limit: int) -> bool:
    """Whether the key has been met ``limit`` times before, as far as the memory goes."""
    n = memory.get(key, 0)
    if n >= limit:
        return True
    if len(memory) > REMEMBER:
        memory.clear()
    memory[key] = n + 1
    return False


def _of_texts(batches, lengths: tuple[int, int], anchor: int, copies: int):
    """For each slice of texts: MD5s, texts and their fragments, at most ``copies`` of each text from a task."""
    short, long = lengths
    find, memory = Anchors(short, anchor), {}
    for batch in batches:
        for part in common.slices(batch):
            raws = [raw for raw in map(common.utf8, part.column(0).to_pylist()) if len(raw) >= short]
            keys = [hashlib.md5(raw).digest() for raw in raws]
            kept = [k for k, key in enumerate(keys) if not _seen(memory, key, copies)]
            raws, keys = [raws[k] for k in kept], [keys[k] for k in kept]
            owner, first, n, anchors = find.many(raws)
            sizes = np.array([len(raw) for raw in raws], np.int64)[owner] if len(raws) else np.zeros(0, np.int64)
            full = np.clip(sizes - long + 1 - first, 0, n)
            yield keys, [memoryview(raw) for raw in raws], owner, first, n, full, anchors, np.minimum(sizes, first + n - 1 + long)


_PLACE = [("first", pa.int64()), ("n", pa.int32()), ("full", pa.int32()), ("anchor", pa.int64()), ("frag", pa.int64())]


def _fragments(docs: DataFrame, lengths: tuple[int, int], anchor: int) -> DataFrame:
    """tkey, places (first, n, full, anchor, frag) of the texts, at most two of each text from a task; ``n`` windows of
    PASSAGE bytes start in a fragment, and at the first ``full`` of them one of LENGTH bytes too."""

    def run(batches):
        for keys, raws, owner, first, n, full, anchors, stop in _of_texts(batches, lengths, anchor, 2):
            frags = [_digest(raws[o][a:b]) for o, a, b in zip(owner.tolist(), first.tolist(), stop.tolist())]
            values = [pa.array(first), pa.array(n.astype(np.int32)), pa.array(full.astype(np.int32)), pa.array(anchors), pa.array(frags, pa.int64())]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(keys)))]).astype(np.int32)
            places = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(values, fields=[pa.field(*x) for x in _PLACE]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), places], names=["tkey", "places"])

    common.small_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "tkey binary, places array<struct<first:bigint,n:int,full:int,anchor:bigint,frag:bigint>>")


_PART = pa.schema([("anchor", pa.int64()), ("frag", pa.int64()), ("n", pa.int32()), ("full", pa.int32()), ("hot", pa.bool_()), ("part", pa.binary())])


def _contested_bytes(docs: DataFrame, contested: np.ndarray, hot: np.ndarray, lengths: tuple[int, int], anchor: int) -> DataFrame:
    """anchor, frag, n, full, hot, part (the fragment's bytes) of fragments whose anchor may be contested."""
    shared = docs.sparkSession.sparkContext.broadcast((contested, hot))

    def run(batches):
        maybe, hots = shared.value
        met = {}
        for _, raws, owner, first, n, full, anchors, stop in _of_texts(batches, lengths, anchor, 1):
            keep = common.in_bitmap(maybe, anchors.view(np.uint64))
            is_hot = common.in_bitmap(hots, anchors[keep].view(np.uint64))
            out = [[] for _ in _PART]
            for o, x, y, m, z, end, h in zip(*[c[keep].tolist() for c in (owner, first, n, full, anchors, stop)], is_hot.tolist()):
                part = raws[o][x:end]
                frag = _digest(part)
                if not _seen(met, (z, frag), 1):
                    for column, value in zip(out, (z, frag, y, m, h, bytes(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, _PART)], schema=_PART)

    return docs.select("text").mapInArrow(run, "anchor long, frag long, n int, full int, hot boolean, part binary")


_RANGES = pa.schema([("anchor", pa.int64()), ("frag", pa.int64()), ("removed", pa.bool_()), ("start", pa.int32()), ("stop", pa.int32())])
_RANGES_SQL = "anchor long, frag long, removed boolean, start int, stop int"


def _by_transform(parts: DataFrame, lengths: tuple[int, int]) -> DataFrame:
    """anchor, frag, removed, start, stop: runs of repeated windows of each fragment, relative to its first; of LENGTH
    bytes where ``removed``, else of PASSAGE bytes."""

    def run(batches):
        names, owns, pieces, size = [], [], [], 0
        last, members = None, set()

        def done():
            out = [[] for _ in _RANGES]
            for removed, masks in zip((False, True), repeated_at(pieces, list(lengths), owns)):
                for (a, f), n, mask in zip(names, owns, masks):
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask[:n].astype(np.int8), [0]])))
                    for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
                        for column, value in zip(out, (a, f, removed, x, y)):
                            column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, _RANGES)], schema=_RANGES)

        for batch in batches:
            for piece in common.slices(batch):
                for a, f, n, part in zip(*[c.to_pylist() for c in piece.columns]):
                    if a != last:
                        if len(members) == 1:  # nothing to compare with
                            size -= len(pieces.pop())
                            names.pop()
                            owns.pop()
                        if size > BATCH_BYTES:
                            yield done()
                            names, owns, pieces, size = [], [], [], 0
                        last, members = a, set()
                    if f not in members:
                        members.add(f)
                        names.append((a, f))
                        owns.append(n)
                        pieces.append(part)
                        size += len(part)
        if pieces:
            yield done()

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.where("not hot").select("anchor", "frag", "n", "part").repartition(n, "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, _RANGES_SQL)


def _by_counting(parts: DataFrame, lengths: tuple[int, int]) -> DataFrame:
    """The same for hot anchors, by counting window digests."""

    def make():
        def f(anchors, frags, ns, fulls, datas):
            digest = xxhash.xxh3_128_digest
            out = []
            for n, full, d in zip(ns, fulls, datas):
                d = memoryview(d)
                out.append([{"removed": removed, "start": k, "w": digest(d[k : k + size])} for removed, size, count in ((False, lengths[0], n), (True, lengths[1], full)) for k in range(count)])
            return [anchors, frags, out]

        return f

    listed = common.arrow_map(parts.where("hot").select("anchor", "frag", "n", "full", "part"), make, "anchor long, frag long, windows array<struct<removed:boolean,start:int,w:binary>>").dropDuplicates(["anchor", "frag"])
    windows = listed.select("anchor", "frag", F.explode("windows").alias("x")).select("anchor", "frag", "x.removed", "x.start", "x.w")
    twice = windows.groupBy("anchor", "removed", "w").agg(F.count("*").alias("n")).where("n > 1")
    return windows.join(twice, ["anchor", "removed", "w"]).select("anchor", "frag", "removed", "start", (F.col("start") + 1).alias("stop"))


def spans(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, anchor: int = ANCHOR, most: int = MOST_FRAGMENTS) -> DataFrame:
    """tkey (MD5 of the text), spans (array of removed, start, stop): ranges of the starts of repeated windows, of
    ``length`` bytes where ``removed`` and of ``passage`` bytes else."""
    lengths = (passage, length)
    if not anchor <= passage <= length:
        raise ValueError("an anchor can't be longer than a passage's window, nor that than what is removed")
    places = common.materialize(_fragments(docs, lengths, anchor), "places")
    each = places.select("tkey", F.explode("places").alias("p")).select("tkey", "p.*")
    counted = common.materialize(each.groupBy("anchor", "frag").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("full").alias("full")), "fragments")
    groups = common.materialize(counted.groupBy("anchor").agg(F.count("*").alias("k"), F.min("c").alias("least")).where("k > 1 and least = 1").select("anchor", "k"), "contested")
    contested, hot = common.hash_bitmap(groups, "anchor"), common.hash_bitmap(groups.where(F.col("k") > most), "anchor")
    whole = F.explode(F.array(F.struct(F.lit(False).alias("removed"), F.col("n").alias("stop")), F.struct(F.lit(True).alias("removed"), F.col("full").alias("stop"))))
    found = counted.where("c > 1").select("anchor", "frag", whole.alias("x")).select("anchor", "frag", "x.removed", F.lit(0).alias("start"), "x.stop").where("stop > 0")
    if contested.any():
        parts = _contested_bytes(docs, contested, hot, lengths, anchor)
        if hot.any():
            parts = common.materialize(parts, "contested-bytes")
            found = found.unionByName(_by_counting(parts, lengths))
        found = found.unionByName(_by_transform(parts, lengths))
    ranges = found.groupBy("anchor", "frag").agg(F.collect_list(F.struct("removed", "start", "stop")).alias("ranges"))
    moved = F.transform("ranges", lambda r: F.struct(r["removed"].alias("removed"), (F.col("first") + r["start"]).alias("start"), (F.col("first") + r["stop"]).alias("stop")))
    total = counted.agg(F.sum("c").alias("n")).first()["n"] or 0
    key = ["anchor", "frag"]
    hits = common.salted_join(each.select("tkey", "first", *key), ranges, key, common.hot_keys(counted, total, "c"), F.xxhash64("tkey", "first"))
    hits = hits.select("tkey", "first", moved.alias("r"))
    # Copies of a text come from many tasks: one of each fragment is kept before a text's fragments are put together.
    return hits.groupBy("tkey", "first").agg(F.first("r").alias("r")).groupBy("tkey").agg(F.flatten(F.collect_list("r")).alias("spans"))


def _copied(docs: DataFrame, passage: int) -> DataFrame:
    """tkey of the texts with so many copies that they are dealt over several tasks, found by digests alone."""
    raw = F.col("text").cast("binary")
    counts = docs.where(F.octet_length(raw) >= passage).groupBy(F.unhex(F.md5(raw)).alias("tkey")).agg(F.count("*").alias("n"))
    return common.materialize(common.hot_keys(counts, docs.count()).select("tkey"), "copied")


def removed(starts: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal byte runs covered by windows whose starts lie in the given ranges."""
    out: list[list[int]] = []
    for a, b in sorted(starts):
        stop = b + length - 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([a, stop])
    return [(a, b) for a, b in out]


def remove(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, anchor: int = ANCHOR, most: int = MOST_FRAGMENTS, words: int = WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), n_passages of every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, n_passages long"
    found = common.materialize(spans(docs, length, passage, anchor, most), "spans")
    bits = common.hash_bitmap(found.select(F.xxhash64("tkey").alias("key")), "key")
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def keys_in(part: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
        """MD5 of each text, and which may have spans; texts stay in Arrow."""
        raws = part.column("text").cast(pa.large_binary()).fill_null(b"").to_pylist()
        keys = [hashlib.md5(raw).digest() if len(raw) >= passage else b"" for raw in raws]
        may = common.in_bitmap(shared.value, np.array([xxhash.xxh64_intdigest(k, 42) for k in keys], np.uint64))
        return keys, may & np.array([bool(k) for k in keys], bool)

    def untouched(batches):
        for batch in batches:
            for part in common.slices(batch):
                yield part.filter(pa.array(~keys_in(part)[1]))

    def touched(batches):
        for batch in batches:
            for part in common.slices(batch):
                keys, may = keys_in(part)
                mask = pa.array(may)
                yield pa.RecordBatch.from_arrays([*part.filter(mask).columns, pa.array(keys, pa.binary()).filter(mask)], names=["doc_id", "text", "tkey"])

    def cut():
        def f(ids, texts, given):
            out = [[] for _ in range(5)]
            for raw, spans_ in zip(map(common.utf8, texts), given):
                gone = removed([(s["start"], s["stop"]) for s in spans_ or [] if s["removed"]], length)
                runs = removed([(s["start"], s["stop"]) for s in spans_ or [] if not s["removed"]], passage)
                left, at = [], 0
                for a, b in gone:
                    left.append(raw[at:a])
                    at = b
                left.append(raw[at:])
                row = len(raw), sum(b - a for a, b in gone), len(gone), b"".join(left), sum(len(raw[a:b].split()) >= words for a, b in runs)
                for column, value in zip(out, row):
                    column.append(value)
            return [ids, *out]

        return f

    both = docs.select("doc_id", "text")
    zero = F.lit(0).cast("long")
    kept = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    whole = both.mapInArrow(untouched, both.schema).select("doc_id", F.octet_length(kept).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), kept.alias("kept"), zero.alias("n_passages"))
    held = both.mapInArrow(touched, f"doc_id {kind}, text string, tkey binary")
    # Rows are numbered as they are read, so copies with one id, or none, are spread too.
    held = common.salted_join(held, found, ["tkey"], _copied(docs, passage), F.monotonically_increasing_id(), "left").select("doc_id", "text", "spans")
    return whole.unionByName(common.arrow_map(held, cut, schema))


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages")
