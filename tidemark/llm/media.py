"""Media columns: content-defined chunking of payloads, a deduplicated chunk store, and verified reading.

A text's payload (UTF-8, zero bytes appended to a positive multiple of ALIGN) is stored as a greyscale PGM image
of ALIGN columns: a short header and 8-bit samples, lossless. The media's bytes are cut where a rolling gear hash
of the last 32 bytes has its low bits zero, between least and most chunk sizes, so equal stretches give equal
chunks wherever they stand.

The store has two parts, both Parquet in the shared folder:

* a chunk that occurs once in the corpus stays with its document, in a pack of (media digest, list of chunks);
* documents with a chunk that occurs again keep only the ordered list of chunk digests, and each such chunk is
  stored once, found by an aggregate over the digests.

Whether a chunk occurs again is known from a first pass that moves digests only; the second pass asks a bitmap of
fixed size, whose false positives merely send a document the second way. Reading joins lists with chunks on the
digest, once for each distinct list (copies share it), puts the chunks in order, and checks the media's SHA-256
against the one taken when it was cut. Features are computed from the bytes read. Chunks that very many lists hold, and
media that very many documents share, are dealt over several tasks (:func:`tidemark.llm.common.salted_join`).

Defined cases: null text counts as empty (ALIGN zero bytes); rows may repeat; other columns are ignored; an empty
table gives no rows. Media that can't be restored raise an error, they are never dropped.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

ALIGN = 64
#: Least, average (a power of two) and most bytes of a chunk.
LEAST, AVERAGE, MOST = 1024, 4096, 16384
WINDOW = 32
#: Chunks a task remembers in order to write repeated ones once.
REMEMBER = 100_000

_GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)


def payload(text: str | None) -> bytes:
    raw = common.utf8(text)
    return raw + bytes(-len(raw) % ALIGN) if raw else bytes(ALIGN)


def to_media(data: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (ALIGN, len(data) // ALIGN) + data


def from_media(media: bytes) -> bytes:
    """The samples of a PGM image."""
    magic, size, depth, samples = media.split(b"\n", 3)
    columns, rows = map(int, size.split())
    if magic != b"P5" or depth != b"255" or len(samples) != columns * rows:
        raise ValueError("not an 8-bit greyscale image")
    return samples


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling gear hash after each byte: sum of G[b] << age over the last WINDOW bytes, by doubling."""
    h, span = _GEAR[data], 1
    while span < WINDOW:
        longer = h.copy()
        longer[span:] += h[:-span] << np.uint32(span)
        h, span = longer, span * 2
    return h


def cuts(media: bytes, least: int = LEAST, average: int = AVERAGE, most: int = MOST, block: int = 1 << 20) -> list[int]:
    """Ends of the chunks."""
    data = np.frombuffer(media, np.uint8)
    marks = []
    for at in range(0, len(data), block):
        back = min(at, WINDOW)
        h = gear(data[at - back : at + block])[back:]
        marks.append(np.flatnonzero(h >> np.uint32(32 - average.bit_length() + 1) == 0) + at + 1)
    marks = np.concatenate(marks) if marks else np.zeros(0, np.int64)
    out, start = [], 0
    while len(media) - start > least:
        k = np.searchsorted(marks, start + least)
        stop = int(marks[k]) if k < len(marks) else len(media)
        stop = min(stop, start + most, len(media))
        out.append(stop)
        start = stop
    if start < len(media):
        out.append(len(media))
    return out


def chunks(media: bytes) -> list[bytes]:
    ends = cuts(media)
    return [media[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def describe(data: bytes) -> str:
    """Features of the samples: mean, deviation, share of zeros, entropy in bits."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = counts[counts > 0] / len(data)
    values = np.arange(256)
    mean = float((counts * values).sum() / len(data))
    deviation = float(np.sqrt(max(0.0, (counts * values * values).sum() / len(data) - mean * mean)))
    return f"mean={mean:.3f};std={deviation:.3f};zero={counts[0] / len(data):.4f};entropy={float(-(share * np.log2(share)).sum()):.4f}"


_FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(media: bytes) -> tuple:
    data = from_media(media)
    return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-ALIGN:]), len(media), hashlib.sha256(media).hexdigest(), describe(data)


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (SHA-256), chunks (ordered digests): no payload bytes."""

    def make():
        def f(ids, texts):
            sizes, names, lists = [], [], []
            for t in texts:
                media = to_media(payload(t))
                sizes.append(len(common.utf8(t)))
                names.append(hashlib.sha256(media).digest())
                lists.append([hashlib.sha256(c).digest() for c in chunks(media)])
            return [ids, sizes, names, lists]

        return f

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.arrow_map(docs.select("doc_id", "text"), make, f"doc_id {kind}, n_bytes long, media binary, chunks array<binary>")


def repeated_chunks(known: DataFrame) -> DataFrame:
    """digest, n of the chunks that occur more than once."""
    return common.materialize(known.select(F.explode("chunks").alias("digest")).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"), "chunks-again")


def store(docs: DataFrame, again: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Write the store below ``folder``, given the repeated chunks; returns what is read back: packs (media, parts) and
    shared chunks (digest, data)."""
    spark = docs.sparkSession
    bits = common.hash_bitmap(_signed_key(again), "key")
    shared = spark.sparkContext.broadcast(bits)

    def make():
        repeated, met = shared.value, {}
        pack = zstandard.ZstdCompressor(level=3).compress

        def f(texts):
            out = [[], [], [], []]

            def put(*row):
                for column, value in zip(out, row):
                    column.append(value)

            for t in texts:
                media = to_media(payload(t))
                parts = chunks(media)
                names = [hashlib.sha256(c).digest() for c in parts]
                if not common.in_bitmap(repeated, np.array([_key(d) for d in names], np.int64).view(np.uint64)).any():
                    put(hashlib.sha256(media).digest(), [pack(c) for c in parts], None, None)
                    continue
                for d, c in zip(names, parts):
                    if d not in met:
                        if len(met) > REMEMBER:
                            met.clear()
                        met[d] = True
                        put(None, None, d, pack(c))
            return out

        return f

    rows = common.arrow_map(docs.select("text"), make, "media binary, parts array<binary>, digest binary, data binary")
    staged = f"{folder}/packs"
    rows.withColumn("kind", F.when(F.col("media").isNotNull(), "own").otherwise("shared")).write.partitionBy("kind").parquet(staged)
    read = spark.read.schema("media binary, parts array<binary>, digest binary, data binary, kind string").parquet(staged)
    read.where("kind = 'shared'").groupBy("digest").agg(F.first("data").alias("data")).write.parquet(f"{folder}/chunks")
    return read.where("kind = 'own'").select("media", "parts"), spark.read.schema("digest binary, data binary").parquet(f"{folder}/chunks")


def _signed_key(rows: DataFrame) -> DataFrame:
    def make():
        return lambda digests: [[_key(d) for d in digests]]

    return common.arrow_map(rows.select("digest"), make, "key long")


def restore(known: DataFrame, again: DataFrame, packs: DataFrame, shared: DataFrame) -> DataFrame:
    """media and features of every distinct media, from the stored bytes."""

    def of_packs():
        unpack = zstandard.ZstdDecompressor().decompress

        def f(names, parts):
            return [names, *_checked(names, [b"".join(map(unpack, p)) for p in parts])]

        return f

    def of_lists():
        unpack = zstandard.ZstdDecompressor().decompress

        def f(names, parts):
            return [names, *_checked(names, [b"".join(unpack(p["data"]) for p in sorted(ps, key=lambda p: p["pos"])) for ps in parts])]

        return f

    own = common.arrow_map(packs, of_packs, "media binary, " + _FEATURES)
    lists = known.groupBy("media").agg(F.first("chunks").alias("chunks")).join(packs.select("media"), "media", "left_anti")
    total = known.agg(F.sum(F.size("chunks"))).first()[0] or 0
    listed = lists.select("media", F.posexplode("chunks").alias("pos", "digest"))
    joined = common.salted_join(listed, shared, ["digest"], common.hot_keys(again, total), F.xxhash64("media", "pos"), "left")
    ordered = joined.groupBy("media").agg(F.collect_list(F.struct("pos", "data")).alias("parts"))
    return own.unionByName(common.arrow_map(ordered, of_lists, "media binary, " + _FEATURES))


def _checked(names: list[bytes], medias: list[bytes]) -> list[list]:
    for name, media in zip(names, medias):
        if hashlib.sha256(media).digest() != name:
            raise ValueError(f"media {name.hex()} is damaged")
    return list(map(list, zip(*map(_features, medias)))) if medias else [[] for _ in range(6)]


def round_trip(docs: DataFrame, folder: str) -> DataFrame:
    """Store every text as media below ``folder`` and describe what is read back, one row for each document."""
    known = common.materialize(recipes(docs), "recipes")
    again = repeated_chunks(known)
    packs, shared = store(docs, again, folder)
    # A false positive of the bitmap sends copies of a text one way, so a pack's media occurs once.
    features = restore(known, again, packs, shared)
    copied = common.hot_keys(known.groupBy("media").agg(F.count("*").alias("n")), known.count())
    # Rows are numbered as they are read, so copies with one id, or none, are spread too.
    both = common.salted_join(known.select("doc_id", "n_bytes", "media"), features, ["media"], copied, F.monotonically_increasing_id(), "left")
    return both.select("doc_id", "n_bytes", *[c.split()[0] for c in _FEATURES.split(", ")])
