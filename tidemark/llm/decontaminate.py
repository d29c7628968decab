"""Benchmark decontamination by greedy string tiling.

Texts are sequences of lower-cased words. Seeds are shingles of MATCH words that a document shares with a
benchmark item: the benchmark's seed hashes form a bitmap that every executor holds, a document keeps the
stretches of its words whose seeds are in it, and an equality join with the benchmark's seeds gives the
(document, item) pairs. On each pair tiles are set greedily by running Karp-Rabin: hashes of all windows of the
current length roll over both texts, equal ones are extended to maximal matches, and these are marked strictly
from the longest on (ties by the place in the document, then in the item). A match that a longer tile has cut
into goes back into the queue with what is left of it. The length halves when no match as long is left, until it
is MATCH. A document is contaminated by an item if tiles cover at least COVERAGE of the item's words; since tiles
may lie in any order, reordered passages count.

Two exact bounds keep hopeless pairs from being tiled. Every MATCH words in a row of a tile are a shared seed, so
tiles can only cover those words of the item that lie in some seed which the document has too. Hence

* an item is joined by its rarest seeds only: its seeds most frequent among documents are left out as long as
  they cover less than COVERAGE of it together, as a document that shares none but those can't be contaminated by
  it. A phrase that many documents and items have in common thus makes no pairs;
* a pair is tiled only if its shared seeds cover COVERAGE of the item's words.

An item of fewer than MATCH words is matched as a whole, as one seed of its own length.

Defined cases: null and empty texts and items without words match nothing; repeated rows of a document or an item
are judged each by itself, and an item's results are equal for equal texts; other columns are ignored; an empty
table on either side gives no pairs.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: Words of the shortest tile, and the least share of an item's words under tiles.
MATCH, COVERAGE = 5, 0.8
#: An item's rows go to every executor up to this many bytes of benchmark text; beyond it they are shuffled.
BROADCAST_BYTES = 8 << 20
#: Numbers of contaminated rows go to every executor up to this many (4 MB).
BROADCAST_ROWS = 500_000

#: Base and modulus of the rolling hash; matches are compared word by word.
BASE, PRIME = 1_000_003, (1 << 61) - 1

_words = re.compile(r"\w+").findall


def words(text: str | None) -> list[str]:
    return _words(text.lower()) if text else []


def _hash(ws: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(ws).encode("utf-8", "surrogatepass"))


def seed_hashes(ws: list[str], match: int = MATCH) -> list[int]:
    """Hashes of all shingles of ``match`` words; of the whole where there are fewer."""
    if not ws:
        return []
    return [_hash(ws[i : i + match]) for i in range(max(1, len(ws) - match + 1))]


class Marks:
    """Marked stretches of a text, disjoint and in order."""

    def __init__(self, size: int):
        self.size, self.starts, self.stops = size, [], []

    def free(self, a: int, b: int) -> list[tuple[int, int]]:
        """The free runs within [a, b)."""
        out, k = [], bisect_right(self.stops, a)
        while k < len(self.starts) and self.starts[k] < b:
            if self.starts[k] > a:
                out.append((a, self.starts[k]))
            a = self.stops[k]
            k += 1
        return [*out, (a, b)] if a < b else out

    def mark(self, a: int, b: int) -> None:
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.stops.insert(k, b)


class Hashed:
    """Word numbers of a text with the polynomial hashes of its prefixes, from which a window's hash is rolled."""

    def __init__(self, numbers: list[int], powers: list[int]):
        self.numbers, self.bytes, self.powers = numbers, np.array(numbers, np.int64).tobytes(), powers
        self.prefix = [0]
        for x in numbers:
            self.prefix.append((self.prefix[-1] * BASE + x) % PRIME)

    def of(self, at: int, size: int) -> int:
        return (self.prefix[at + size] - self.prefix[at] * self.powers[size]) % PRIME

    def windows(self, marks: Marks, size: int) -> Iterator[tuple[int, int, int, int]]:
        """(place, hash, word before it or 0, end of its free run) of each free window of ``size`` words."""
        numbers, prefix, top = self.numbers, self.prefix, self.powers[size]
        for a, b in marks.free(0, len(numbers)):
            for k in range(a, b - size + 1):
                yield k, (prefix[k + size] - prefix[k] * top) % PRIME, numbers[k - 1] if k > a else 0, b


def _common(d: Hashed, at: int, i: Hashed, k: int, least: int, most: int) -> int:
    """Equal words from the places at and k on, at most ``most``; 0 if not ``least`` are."""
    if d.bytes[at * 8 : (at + least) * 8] != i.bytes[k * 8 : (k + least) * 8]:
        return 0
    n = least
    while n < most:  # windows of doubling size; then the last of them is halved
        step = min(n, most - n)
        if d.of(at + n, step) != i.of(k + n, step):
            break
        n += step
    else:
        step = 0
    while step > 1:
        step -= step // 2
        if n + step <= most and d.of(at + n, step) == i.of(k + n, step):
            n += step
    if n < most and d.numbers[at + n] == i.numbers[k + n]:
        n += 1
    while d.bytes[at * 8 : (at + n) * 8] != i.bytes[k * 8 : (k + n) * 8]:
        n -= 1  # hashes of different words were equal
    return n


def tile(doc: list[str], item: list[str], match: int = MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles (position in doc, position in item, length), longest first.

    Takes time in proportion to the texts, for each halving of the length, and to the number of maximal matches: only
    the first words of those are paired, as windows are looked up by their hash and by the word before them.
    """
    match, number = min(match, len(item)), {}
    powers = [1]
    for _ in range(max(len(doc), len(item))):
        powers.append(powers[-1] * BASE % PRIME)
    d_words = Hashed([number.setdefault(w, len(number) + 1) for w in doc], powers)
    i_words = Hashed([number.setdefault(w, len(number) + 1) for w in item], powers)
    d_marks, i_marks, tiles = Marks(len(doc)), Marks(len(item)), []

    def scan(size):
        """Maximal free matches of at least ``size`` words, as (-length, place in doc, place in item)."""
        table, found = defaultdict(lambda: defaultdict(list)), []
        for k, h, before, stop in i_words.windows(i_marks, size):
            table[h][before].append((k, stop))
        for d, h, before, d_stop in d_words.windows(d_marks, size) if table else ():
            if h not in table:
                continue
            for own, places in table[h].items():
                if own and own == before:
                    continue  # part of the match one word before
                for k, stop in places:
                    n = _common(d_words, d, i_words, k, size, min(d_stop - d, stop - k))
                    if n:
                        found.append((-n, d, k))
        return found

    size = len(item)
    while size >= match > 0:
        queue = scan(size)
        longest = -min(queue)[0] if queue else 0
        if longest > 2 * size:
            size = longest
            continue
        heapify(queue)
        while queue:
            n, d, k = heappop(queue)
            free = [(x - d, y - d) for x, y in d_marks.free(d, d - n)]
            free = [(x - k, y - k) for a, b in free for x, y in i_marks.free(k + a, k + b)]
            if free == [(0, -n)]:
                d_marks.mark(d, d - n)
                i_marks.mark(k, k - n)
                tiles.append((d, k, -n))
                continue
            for a, b in free:
                if b - a >= size:
                    heappush(queue, (a - b, d + a, k + a))
        if size == match:
            break
        size = max(match, size // 2)
    return tiles


def covered(places: list[int], match: int, length: int) -> int:
    """Words of an item of ``length`` words that lie in the seeds at these places (in ascending order)."""
    total, stop = 0, 0
    for p in places:
        end = min(p + match, length)
        total += end - max(p, stop)
        stop = end
    return total


def _bench(benchmark: DataFrame, match: int) -> DataFrame:
    """item_id, words, seeds of every benchmark row with words."""

    def make():
        def f(ids, texts):
            split = [words(t) for t in texts]
            signed = lambda x: x - (1 << 64) if x >> 63 else x
            return [ids, split, [[signed(h) for h in seed_hashes(w, match)] for w in split]]

        return f

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return common.arrow_map(benchmark.select("item_id", "text"), make, f"item_id {kind}, words array<string>, seeds array<bigint>").where("size(words) > 0")


def _stretches(docs: DataFrame, bits: np.ndarray, vocabulary_bits: np.ndarray, match: int, short: list[int]) -> DataFrame:
    """row, doc_id, part (words of each stretch around possible seeds, stretches parted by an empty word), seeds."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((bits, vocabulary_bits))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        seeds, known_bits = shared.value
        known: dict[str, bool] = {}
        sizes = sorted({match, *short})

        def f(ids, texts):
            if len(known) > 300_000:
                known.clear()
            rows = [[], [], []]
            for i, text in zip(ids, texts):
                ws = words(text)
                new = list({w for w in ws if w not in known})
                if new:
                    h = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in new], np.uint64)
                    known.update(zip(new, common.in_bitmap(known_bits, h).tolist()))
                flags = np.fromiter(map(known.__getitem__, ws), bool, len(ws))
                keep = np.zeros(len(ws) + 1, bool)
                found = set()
                for size in sizes:
                    if len(ws) < size:
                        continue
                    ends = np.cumsum(np.concatenate([[0], flags]))
                    starts = np.flatnonzero(ends[size:] - ends[:-size] == size)
                    if not len(starts):
                        continue
                    hashes = np.array([_hash(ws[a : a + size]) for a in starts.tolist()], np.uint64)
                    hit = common.in_bitmap(seeds, hashes)
                    found.update(hashes[hit].view(np.int64).tolist())
                    for a in starts[hit].tolist():
                        keep[a : a + size] = True
                if found:
                    part, last = [], -2
                    for k in np.flatnonzero(keep).tolist():
                        if k != last + 1 and part:
                            part.append("")
                        part.append(ws[k])
                        last = k
                    rows[0].append(i)
                    rows[1].append(part)
                    rows[2].append(sorted(found))
            return rows

        return f

    return common.arrow_map(docs.select("doc_id", "text"), make, f"doc_id {kind}, part array<string>, seeds array<bigint>")


def clean(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that no item contaminates. Rows are judged, not ids: null and repeated ids are kept apart."""
    kept = common.materialize(common.numbered(docs), "decontamination-rows")
    found = contaminated(kept.select(F.col("row").alias("doc_id"), "given.text"), benchmark, match, coverage)
    found = common.materialize(found.select(F.col("doc_id").alias("row")).distinct(), "contaminated")
    near = F.broadcast if found.count() <= BROADCAST_ROWS else (lambda d: d)
    return kept.join(near(found), "row", "left_anti").select("given.*")


def contaminated(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, coverage, tiles, matched_words, item_words of each document and item that contaminates it."""
    bench = common.materialize(_bench(benchmark, match).withColumn("item", F.monotonically_increasing_id()), "benchmark")
    seeds = bench.select(F.explode("seeds").alias("seed"))
    sizes = [r["n"] for r in bench.where(f"size(words) < {int(match)}").select(F.size("words").alias("n")).distinct().collect()]  # fewer than MATCH numbers
    vocabulary = _word_hashes(bench)
    bits, known = common.hash_bitmap(seeds, "seed"), common.hash_bitmap(vocabulary, "h")
    hit = common.materialize(_stretches(docs, bits, known, match, sizes).withColumn("row", F.monotonically_increasing_id()), "stretches")
    total = bench.agg(F.sum(F.expr("aggregate(words, 0L, (a, w) -> a + length(w) + 9)")).alias("n")).first()["n"] or 0
    near = F.broadcast if total <= BROADCAST_BYTES else (lambda d: d)
    held = hit.select("row", F.explode("seeds").alias("seed"))
    index = _rare_seeds(bench, held.groupBy("seed").agg(F.count("*").alias("docs")), match, coverage)
    pairs = held.join(near(index), "seed").select("row", "item").distinct()
    both = pairs.join(near(bench.select("item", "item_id", "words", F.col("seeds").alias("item_seeds"))), "item").join(hit.select("row", "doc_id", "part", "seeds"), "row")

    def run(batches):
        names = ["doc_id", "item_id", "coverage", "tiles", "matched_words", "item_words"]
        for batch in batches:
            for piece in common.slices(batch):
                out = []
                for r in piece.to_pylist():
                    shared, n = set(r["seeds"]), len(r["words"])
                    if covered([p for p, seed in enumerate(r["item_seeds"]) if seed in shared], match, n) < coverage * n:
                        continue
                    tiles = tile(r["part"], r["words"], match)
                    words_in = sum(size for _, _, size in tiles)
                    if words_in >= coverage * n:
                        out.append((r["doc_id"], r["item_id"], words_in / n, len(tiles), words_in, n))
                columns = list(zip(*out)) if out else [[]] * 6
                types = [piece.schema.field("doc_id").type, piece.schema.field("item_id").type, pa.float64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    kinds = [d.schema[c].dataType.simpleString() for d, c in ((docs, "doc_id"), (benchmark, "item_id"))]
    return both.select("doc_id", "item_id", "words", "item_seeds", "part", "seeds").mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, coverage double, tiles int, matched_words int, item_words int")


def _rare_seeds(bench: DataFrame, frequency: DataFrame, match: int, coverage: float) -> DataFrame:
    """seed, item: of each item the seeds left when the most frequent ones that together cover less than
    ``coverage`` of it are taken away; seeds that no document has are left out."""
    placed = bench.select("item", F.size("words").alias("n"), F.posexplode("seeds").alias("pos", "seed")).join(frequency, "seed")
    listed = placed.groupBy("item", "n").agg(F.collect_list(F.struct("docs", "seed", "pos")).alias("held"))

    def make():
        def f(items, sizes, helds):
            out = []
            for n, held in zip(sizes, helds):
                places, taken, gone = defaultdict(list), [False] * n, 0
                for x in held:
                    places[-x["docs"], x["seed"]].append(x["pos"])
                order, left = sorted(places), 0
                while left < len(order):
                    new = {p for at in places[order[left]] for p in range(at, min(at + match, n)) if not taken[p]}
                    gone += len(new)
                    if gone >= coverage * n:
                        break
                    for p in new:
                        taken[p] = True
                    left += 1
                out.append([seed for _, seed in order[left:]])
            return [items, out]

        return f

    return common.arrow_map(listed.select("item", "n", "held"), make, "item long, seeds array<bigint>").select(F.explode("seeds").alias("seed"), "item")


def _word_hashes(bench: DataFrame) -> DataFrame:
    def make():
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        return lambda ws: [[signed(xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))) for w in ws]]

    return common.arrow_map(bench.select(F.explode("words").alias("w")).distinct(), make, "h long")
