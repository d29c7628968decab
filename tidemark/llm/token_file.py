"""Token-id files of independent zstandard frames with a trailing seek table.

A file holds one frame for each document: its ids, little-endian, in 2 bytes where the vocabulary allows it and
else 4. Frames carry zstandard's own content checksum. The last frame is skippable and follows the public
seekable format: compressed size, decompressed size and checksum (low half of XXH64 of the content) of each
frame, then the number of frames, a descriptor and a magic number. The frame before it is skippable too and
holds the ids' width. A reader fetches the seek table and then only the frames it is asked for.

Documents are dealt to files by ranges of doc_id, so the files in order hold ascending doc_ids, and each file is one
task's partition. An id that fills several ranges, and null ids, are dealt by ranges of their frames' checksums. A
file is written under a temporary name and renamed, so a task that runs again replaces it with the same bytes.

Defined cases: doc_id is an integer column; null text counts as empty, so a document always has its end id; rows
with a null doc_id come first; rows that repeat a doc_id are kept, ordered by checksum, length and frame; an empty
table gives no files and no rows.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.wordcache import PATTERN, CachedEncoder

SKIPPABLE, TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
LEVEL = 3
#: Documents of a file, as long as there are no more than MOST_FILES files.
DOCS_A_FILE, MOST_FILES = 8192, 100_000


@lru_cache(2)
def encoder(path: str) -> tuple[Encoder, int]:
    """The library's encoder behind caches, and the number of its ids.

    Pre-tokens of plain characters go to the library's BPE model one by one; strings with other characters (the
    library's pre-tokeniser may know another Unicode version) or with the text of a special token go to its
    whole chain undivided.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    split = json.loads(tokenizer.to_str())
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if split["normalizer"] is not None or {k: (split["pre_tokenizer"] or {}).get(k) for k in plain} != plain:
        raise ValueError("the tokenizer doesn't split texts as the fast path for plain characters does")
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    model = tokenizer.model.tokenize
    shown = sorted([*range(33, 127), *range(161, 173), *range(174, 256)])
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}

    def words(ws: list[str]) -> list[bytes]:
        return [array("I", [t.id for t in model(w.encode().decode("latin-1").translate(letters))]).tobytes() for w in ws]

    def whole(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    return Encoder(CachedEncoder(PATTERN, words, whole), whole, special), tokenizer.get_vocab_size()


class Encoder:
    """Sends texts that hold a special token's string to the library as they are."""

    def __init__(self, cached: CachedEncoder, whole, special: list[str]):
        self.cached, self.whole, self.special = cached, whole, special

    def __call__(self, texts: list[str]) -> list[bytes]:
        held = [any(s in t for s in self.special) for t in texts]
        out = self.cached(["" if h else t for h, t in zip(held, texts)])
        return [self.whole([t])[0] if h else o for h, t, o in zip(held, texts, out)]


class TokenFileWriter:
    """Appends frames to an open binary stream."""

    def __init__(self, stream, width: int):
        self.stream, self.entries, self.size = stream, [], 0
        self._put(struct.pack("<III", SKIPPABLE, 4, width))

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def add(self, frame: bytes, length: int, checksum: int) -> None:
        self._put(frame)
        self.entries.append((len(frame), length, checksum))

    def close(self) -> None:
        body = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), CHECKSUMS, SEEKABLE)
        self._put(struct.pack("<II", TABLE, len(body)) + body)


class TokenFile:
    """Random access to one file; ``ids(k)`` reads and decompresses only frame k."""

    HEAD = 12

    def __init__(self, file):
        self.file = file
        self.width = struct.unpack("<III", self._read(0, self.HEAD))[2]
        size = file.size()
        count, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        self.table = np.frombuffer(self._read(size - 9 - 12 * count, 12 * count), "<u4").reshape(count, 3)
        self.starts = self.HEAD + np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        self.decompressor = zstandard.ZstdDecompressor()

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError("the file is cut short")
        return data

    def __len__(self) -> int:
        return len(self.table)

    def ids(self, k: int) -> np.ndarray:
        size, length, checksum = map(int, self.table[k])
        raw = self.decompressor.decompress(self._read(int(self.starts[k]), size), max_output_size=length)
        if len(raw) != length or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return np.frombuffer(raw, f"<u{self.width}")


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


class Deal:
    """Numbers of files for documents: ``cuts`` are ascending ids at which a new file begins, with repeats where one id
    fills several, and null ids fill the first ``null_files``."""

    def __init__(self, cuts: list[int], null_files: int = 0):
        self.edges, times = np.unique(np.array(cuts, np.int64), return_counts=True)
        self.null_files, self.count = null_files, null_files + 1
        self.own, self.after = [], []  # (first file, files) of an edge's own id, file of the ids after it
        for n in times.tolist():
            self.own.append((self.count, n) if n > 1 else None)
            self.count += n if n > 1 else 0
            self.after.append(self.count)
            self.count += 1

    def __call__(self, doc_id: int | None, checksum: int) -> int:
        if doc_id is None:
            return checksum * max(1, self.null_files) >> 32
        k = int(np.searchsorted(self.edges, doc_id, "right")) - 1
        if k < 0:
            return self.null_files
        own = self.own[k]
        if own and self.edges[k] == doc_id:
            return own[0] + (checksum * own[1] >> 32)
        return self.after[k]


def frames(docs: DataFrame, path: str, end_id: int = 0, deal: Deal | None = None) -> DataFrame:
    """doc_id, file, n_tokens, length, checksum, frame: each text's ids with the end id, compressed on its own."""
    deal = deal or Deal([])

    def make():
        encode, size = encoder(path)
        width = 2 if max(size, end_id + 1) <= 1 << 16 else 4
        pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True).compress
        end = int(end_id).to_bytes(4, "little")

        def f(ids, texts):
            raws = [np.frombuffer(t + end, "<u4").astype(f"<u{width}").tobytes() for t in encode([t or "" for t in texts])]
            sums = [xxhash.xxh64_intdigest(r) & 0xFFFFFFFF for r in raws]
            return [ids, list(map(deal, ids, sums)), [len(r) // width for r in raws], [width] * len(ids), [len(r) for r in raws], sums, [pack(r) for r in raws]]

        return f

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.arrow_map(docs.select("doc_id", "text"), make, f"doc_id {kind}, file int, n_tokens long, width int, length long, checksum long, frame binary")


def write(docs: DataFrame, path: str, folder: str, end_id: int = 0) -> DataFrame:
    """Write the files into ``folder`` (any URI that pyarrow opens on each executor).

    Returns the manifest, one row for each file: file, uri, n_docs, n_tokens, first_token, doc_ids.
    """
    spark = docs.sparkSession
    counts = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("named")).first()
    size = max(DOCS_A_FILE, -(-counts["n"] // MOST_FILES))
    files = -(-counts["named"] // size)
    cuts = docs.approxQuantile("doc_id", [i / files for i in range(1, files)], 1 / (8 * files)) if files > 1 else []
    deal = Deal([int(c) for c in cuts], -(-(counts["n"] - counts["named"]) // size))
    dealt = frames(docs, path, end_id, deal)
    dealt = dealt.repartitionById(deal.count, "file").sortWithinPartitions("file", F.asc_nulls_first("doc_id"), "checksum", "n_tokens", "frame")

    def run(batches):
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        current = None

        def finish():
            number, stream, writer, temporary, ids, tokens = current
            writer.close()
            stream.close()
            fs.move(temporary, f"{base}/tokens-{number:06d}.zst")
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([f"{folder}/tokens-{number:06d}.zst"]), pa.array([len(ids)], pa.int64()), pa.array([tokens], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], names=["file", "uri", "n_docs", "n_tokens", "doc_ids"])

        for batch in batches:
            for part in common.slices(batch):
                for row in part.to_pylist():
                    if current is None or current[0] != row["file"]:
                        if current is not None:
                            yield finish()
                        temporary = f"{base}/.tokens-{row['file']:06d}.{uuid.uuid4().hex}"
                        stream = fs.open_output_stream(temporary)
                        current = [row["file"], stream, TokenFileWriter(stream, row["width"]), temporary, [], 0]
                    current[2].add(row["frame"], row["length"], row["checksum"])
                    current[4].append(row["doc_id"])
                    current[5] += row["n_tokens"]
        if current is not None:
            yield finish()

    schema = "file int, uri string, n_docs long, n_tokens long, doc_ids array<bigint>"
    manifest = common.materialize(dealt.mapInArrow(run, schema), "token-manifest")
    sizes = sorted((r["file"], r["n_tokens"]) for r in manifest.select("file", "n_tokens").collect())  # MOST_FILES rows at most
    starts, at = [], 0
    for number, tokens in sizes:
        starts.append((number, at))
        at += tokens
    first = spark.createDataFrame(starts, "file int, first_token long")
    return manifest.join(F.broadcast(first), "file")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, file, frame, start, n_tokens, ids_crc32 of every document, from the files."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = _open(row["uri"])
                with fs.open_input_file(path) as handle:
                    file, at = TokenFile(handle), row["first_token"]
                    for begin in range(0, len(file), 4096):
                        span = range(begin, min(begin + 4096, len(file)))
                        starts, sizes, sums = [], [], []
                        for k in span:
                            ids = file.ids(k)
                            starts.append(at)
                            sizes.append(len(ids))
                            sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                            at += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"][begin : begin + len(span)], pa.int64()), pa.array([row["file"]] * len(span), pa.int32()), pa.array(list(span), pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "file", "frame", "start", "n_tokens", "ids_crc32"])

    spark = manifest.sparkSession
    n = max(1, min(MOST_FILES, spark.sparkContext.defaultParallelism * 4))
    return manifest.repartitionById(n, "file").mapInArrow(run, "doc_id long, file int, frame int, start long, n_tokens long, ids_crc32 long")


def read_documents(uri: str, numbers: list[int]) -> list[np.ndarray]:
    """Ids of the chosen frames of one file."""
    fs, path = _open(uri)
    with fs.open_input_file(path) as handle:
        file = TokenFile(handle)
        return [file.ids(k) for k in numbers]
