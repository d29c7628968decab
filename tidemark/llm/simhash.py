"""SimHash fingerprints and their links by deletion-variant signatures.

Two fingerprints that differ in at most 3 bits, cut into 2 segments, differ in at most 1 bit in one of them. So
each distinct fingerprint is indexed by each segment as it is and by each segment with one bit left out, and
fingerprints that share an index key are verified on all bits. Only keys that can link something count: an exact
key with two fingerprints, or a one-wildcard key with both values of the left-out bit.

A key with many fingerprints (a large group of near copies) isn't compared within itself: its members are
indexed anew by the segments of the part of the fingerprint that the key doesn't fix, down to keys that leave
11 bits free, of which there are 2048 fingerprints at most. What is compared in one task is thus bounded
whatever the data, and no link is lost, as the argument above holds for every part.

Within a key, members are visited from the frontier of what is already connected, and each found member is
linked to the first of its component: at most one link a member, never all pairs.

:func:`similar` finds all texts that have SIMILAR or more of their five-word shingles in common. Fingerprints of such
shingles are too far apart for that (one changed word changes five), so first links come from a fingerprint of the
texts' single words, each weighted by the root of its count. Candidates are judged inside their key by a sketch: the
least hash of the shingles in each of 256 ranges, by which the common share is estimated. Texts of equal fingerprints
are compared with the least of them first. These links only join most copies cheaply; each is verified by the shingles
themselves, and what this step leaves out is found by the next.

That is exact: all texts' shingles are put into one order, rare ones first, by the number of texts that hold each. Of two
texts alike by SIMILAR, the first ``size // 5 + 1`` shingles of each have one in common, so texts that share none need no
look. Texts next to each other in size that share one are verified along with the first links. Of texts that aren't joined
then, all pairs are made from each shared one, in tiles of a bounded number of texts where very many share it, left out
only if the places of the shared one rule them out, and verified. As what a changed copy doesn't share with others comes
first in it, hardly any texts meet that are neither alike nor joined, however many copies a text has.

Defined cases: null and empty texts have fingerprint zero, linked like any other; rows may repeat and doc_id may
be null (a null is never the least of a component unless all are); other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.components import components

BITS, DISTANCE, SHINGLE, SEED = 64, 3, 3, 42
#: Least common share of shingles of this many words, word fingerprints of a text, ranges of its sketch.
SIMILAR, SIMILAR_SHINGLE, VIEWS, RANGES = 0.8, 5, 1, 256
#: Estimates from which on texts are tried as a link, and make a star, in the first step.
POSSIBLE, SURE = 0.72, 0.88
#: Fingerprints of a key that are compared in one task; a key with more is indexed anew.
MOST_COMPARED = 2048
#: Ranges of a sketch that members of a crowded key must have in common in some place to be compared.
BAND = 8
#: Texts by which frequent shingles are known, about; the least share of all texts that is read for it, one in; how many
#: of these texts such a shingle is in; how many are told apart at most. These aren't counted one by one. All this only
#: sets an order.
ORDER_TEXTS, ORDER_SHARE, ORDER_LEAST, ORDER_MOST = 10_000, 64, 4, 100_000
#: Bits of a shingle that order goes by: two shingles taken for one only make a place smaller, which rules out less.
ORDER_BITS = 40


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half the shingles' XXH64 values."""
    words = common.utf8(text).lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(line, SEED)
    stops = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], stops[:-1] + 1])
    n = len(words) - shingle + 1
    ends = stops[shingle - 1 :].tolist()
    counts = np.zeros(BITS, np.int64)
    starts = starts[:n].tolist()
    for at in range(0, n, 1 << 16):
        values = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])], "<u8")
        counts += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist()))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (LONG, the fingerprint's bits) of every document."""

    def make():
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        return lambda ids, texts: [ids, [signed(fingerprint(t, shingle)) for t in texts]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.arrow_map(docs.select("doc_id", "text"), make, f"doc_id {kind}, fp long")


def _index(rows: DataFrame, width: int) -> DataFrame:
    """key, side, fp, member, off: the variants of the ``width`` bits from bit ``off`` on, under the rows' ``key``.

    ``side`` tells on which side of a wildcard the fingerprint is; exact keys have side null. ``off`` is then where
    the half that the new key doesn't fix begins.
    """
    half = width // 2
    mask = (1 << half) - 1

    def wildcard(k, value):
        rest = F.col("off") + (1 - k) * half
        bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p)
        return lambda p: F.struct(
            F.xxhash64("key", F.lit(width), F.lit(k), p, value.bitwiseAND(F.bitwise_not(bit(p)))).alias("key"),
            F.call_function("shiftright", value, p).bitwiseAND(F.lit(1)).cast("int").alias("side"),
            rest.alias("off"),
        )

    free = []
    for k in (0, 1):
        at = F.col("off") + k * half
        value = F.call_function("shiftrightunsigned", F.col("fp"), at).bitwiseAND(F.lit(mask))
        free.append(F.array(F.struct(F.xxhash64("key", F.lit(width), F.lit(k), F.lit(-1), value).alias("key"), F.lit(None).cast("int").alias("side"), (F.col("off") + (1 - k) * half).alias("off"))))
        free.append(F.transform(F.sequence(F.lit(0), F.lit(half - 1)), wildcard(k, value)))
    # A row becomes width + 2 rows: spread them first, or few tasks of a small table make them all.
    spread = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "member")
    return spread.select("fp", "member", F.explode(F.concat(*free)).alias("v")).select("v.key", "v.side", "fp", "member", "v.off")


def _live(index: DataFrame) -> DataFrame:
    """Keys that can link fingerprints, with their number of rows."""
    return index.groupBy("key").agg(F.count("*").alias("n"), F.min("side").alias("lo"), F.max("side").alias("hi")).where("n > 1 and (lo is null or lo <> hi)").select("key", "n")


def _link_bucket(values: np.ndarray, sketches: np.ndarray | None = None) -> tuple[list, list, list]:
    """Links among uint64 fingerprints, and sketches: (place, place, sure) for each member found.

    A member found by a sure link is linked to what the one it was found from goes back to by sure links, so that these
    make stars; by another link to the one it was found from.
    """
    left, root, a, b, sure = np.arange(len(values)), np.arange(len(values)), [], [], []
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(values[left] ^ values[at]) <= DISTANCE
            share = np.ones(len(left))
            if sketches is not None and near.any():
                spots = np.flatnonzero(near)
                share[spots] = common_share(sketches[left[spots]], sketches[at])
                near[spots] = share[spots] >= POSSIBLE
            if near.any():
                found, marked = left[near], share[near] >= SURE
                root[found[marked]] = root[at]
                a.extend(np.where(marked, root[at], at).tolist())
                b.extend(found.tolist())
                sure.extend(marked.tolist())
                left = left[~near]
                frontier.extend(found)
    return a, b, sure


def _compare(rows: DataFrame) -> DataFrame:
    """(a, b, sure) links among the members of each key; a key's rows come together in one sorted partition.

    Columns key, fp, member and, where candidates need verifying, sketch.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_())])
    verified = "sketch" in rows.columns

    def run(batches):
        held = None

        def links(keys, fps, members, sketches):
            a, b, sure = [], [], []
            cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            for x, y in zip(cuts[:-1], cuts[1:]):
                _, once = np.unique(members[x:y], return_index=True)
                marks = None if sketches is None else np.array([np.frombuffer(sketches[x + k], np.uint8) for k in once.tolist()])
                first, found, marked = _link_bucket(fps[x:y][once].view(np.uint64), marks)
                a += members[x:y][once][first].tolist()
                b += members[x:y][once][found].tolist()
                sure += marked
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sure, pa.bool_())], schema=schema)

        for batch in batches:
            now = [batch.column(k).to_numpy() for k in range(3)] + [batch.column(3).to_pylist() if verified else None]
            if held is not None:
                now = [np.concatenate(pair) for pair in zip(held[:3], now[:3])] + [held[3] + now[3] if verified else None]
            last = np.searchsorted(now[0], now[0][-1]) if len(now[0]) else 0
            if last:
                yield links(*[c[:last] for c in now[:3]], now[3][:last] if verified else None)
            held = [c[last:] for c in now[:3]] + [now[3][last:] if verified else None]
        if held is not None and len(held[0]):
            yield links(*held)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["key", "fp", "member", *(["sketch"] if verified else [])]
    return rows.select(*columns).repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, sure boolean")


def _banded(found: DataFrame) -> DataFrame:
    """Rows under a key for each band of their sketch (given as ``sketch``), for keys that many members of few
    fingerprints share, such as texts of the same words in other orders. Texts alike by SIMILAR agree in one of the
    bands all but surely (0.997), unlike ones hardly ever."""
    part = lambda b: F.substring(F.hex("sketch"), b * 2 * BAND + 1, F.lit(2 * BAND))
    filled = F.filter(F.sequence(F.lit(0), F.lit(RANGES // BAND - 1)), lambda b: part(b) != "00" * BAND)
    return found.select("fp", "member", "sketch", F.explode(F.transform(filled, lambda b: F.xxhash64("key", b, part(b)))).alias("key"))


def _search(rows: DataFrame, compare, most: int, crowded=None) -> DataFrame | None:
    """What ``compare`` makes of the rows (fp, member), by key of those that may lie within DISTANCE; None if no two do.

    Members of one fingerprint can't be parted by the index; a key with over ``most`` members that leaves no more to
    part goes to ``crowded``.
    """
    rows = rows.select("fp", "member", F.lit(0).cast("long").alias("key"), F.lit(0).alias("off"))
    out, width = None, BITS
    while True:
        index = _index(rows, width)
        live = common.materialize(_live(index), "simhash-keys")
        stats = live.agg(F.count("*").alias("keys"), F.max("n").alias("most")).first()
        if not stats["keys"]:
            break
        # A few keys go to every executor; from 100,000 (1.6 MB) on both sides are shuffled.
        small = F.broadcast(live) if stats["keys"] <= 100_000 else live
        found = index.join(small, "key")
        bounded = width // 2 + BITS.bit_length() <= 16  # 8 free bits and 3 wildcards: 2048 fingerprints at most
        full = stats["most"] > most
        split = full and not bounded
        parts = [compare(found.where(F.col("n") <= most) if split or full and crowded else found)]
        if full and bounded and crowded:
            parts.append(crowded(found.where(F.col("n") > most)))
        for part in parts:
            out = part if out is None else out.unionByName(part)
        if not split:
            break
        rows = common.materialize(found.where(F.col("n") > most).select("fp", "member", "key", "off").distinct(), "simhash-hot")
        width //= 2
    return out


def links(distinct: DataFrame, most: int = MOST_COMPARED) -> DataFrame:
    """(a, b): enough of the pairs of distinct ``fp`` within DISTANCE to connect all that are connected."""
    out = _search(distinct.select("fp", F.col("fp").alias("member")), _compare, most)
    return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0) if out is None else out.select("a", "b")


def common_share(sketches: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Estimated common share of shingles of each row of ``sketches`` with ``other``; 1 between texts without words."""
    either = ((sketches != 0) | (other != 0)).sum(-1)
    both = ((sketches == other) & (sketches != 0)).sum(-1)
    return np.where(either == 0, 1.0, both / np.maximum(either, 1))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of words with these hashes; of the whole where there are fewer words."""
    n = max(1, len(hashes) - SIMILAR_SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(SIMILAR_SHINGLE, len(hashes))):
        out = out * _MIX + hashes[j : j + n]
    return _mixed(out)


class Views:
    """Word fingerprints and the sketch of a text, with a bounded cache of word hashes."""

    def __init__(self, most: int = 300_000):
        self.known, self.most = {}, most
        self.salts = np.arange(VIEWS, dtype=np.uint64) * _MIX

    def _hashes(self, words: list[bytes]) -> list[int]:
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w, SEED)
        return [known[w] for w in words]

    def shingles(self, text: str | None) -> np.ndarray:
        """Distinct shingles, as signed numbers."""
        words = common.utf8(text).lower().split()
        return np.unique(_shingles(np.array(self._hashes(words), np.uint64)).view(np.int64)) if words else np.zeros(0, np.int64)

    def keys(self, text: str | None) -> tuple[np.ndarray, int]:
        """The first ORDER_BITS of the distinct shingles, each once; how many shingles there are."""
        held = self.shingles(text)
        return np.unique(held.view(np.uint64) >> np.uint64(64 - ORDER_BITS)).view(np.int64), len(held)

    def __call__(self, text: str | None) -> tuple[list[int], bytes]:
        return self.sized(text)[:2]

    def sized(self, text: str | None) -> tuple[list[int], bytes, int]:
        """The number of distinct shingles besides."""
        words = common.utf8(text).lower().split()
        if not words:
            return [0] * VIEWS, bytes(RANGES), 0
        hashes = np.array(self._hashes(words), np.uint64)
        each, counts = np.unique(hashes, return_counts=True)
        weights = np.sqrt(counts).astype(np.float32)
        sums = np.zeros((VIEWS, BITS), np.float64)
        for at in range(0, len(each), 1 << 13):
            bits = np.unpackbits(_mixed(each[at : at + (1 << 13)] + self.salts[:, None]).astype("<u8").view(np.uint8).reshape(VIEWS, -1, 8), axis=2, bitorder="little")
            part = weights[at : at + (1 << 13)]
            sums += 2 * (part @ bits.astype(np.float32)) - part.sum()
        fps = np.packbits(sums > 0, axis=1, bitorder="little").view("<i8")[:, 0]
        shingles = np.sort(_shingles(hashes))
        n = len(shingles)
        first = np.searchsorted(shingles, np.arange(RANGES, dtype=np.uint64) << np.uint64(56))
        least = shingles[np.minimum(first, n - 1)]
        filled = (first < n) & (least >> np.uint64(56) == np.arange(RANGES, dtype=np.uint64))
        size = 1 + int((shingles[1:] != shingles[:-1]).sum())
        return fps.tolist(), np.where(filled, 1 + (least & np.uint64(0xFFFFFF)) % np.uint64(255), 0).astype(np.uint8).tobytes(), size


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys that very many texts hold, by a sample of the texts, ascending, and how many of the sample hold them."""
    part = max(1, min(ORDER_SHARE, docs.count() // ORDER_TEXTS))
    chosen = docs.where(F.pmod(F.xxhash64("text"), F.lit(part)) == 0).select("text")

    def make():
        view = Views()
        return lambda texts: [[view.keys(t)[0] for t in texts]]

    held = common.arrow_map(chosen, make, "held array<bigint>").select(F.explode("held").alias("key"))
    most = held.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= ORDER_LEAST).orderBy(F.desc("n"), "key").limit(ORDER_MOST).toArrow()
    keys, n = most["key"].to_numpy(), most["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def _parted(keys: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys that aren't frequent, and the others in their order."""
    if not len(frequent) or not len(keys):
        return keys, keys[:0]
    place = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
    known = frequent[place] == keys
    late, weight = keys[known], counts[place[known]]
    return keys[~known], late[np.lexsort((late, weight))]


def _digest(text: str | None) -> bytes:
    """Texts without words have the empty one's."""
    data = common.utf8(text)
    return hashlib.md5(data if data.split() else b"").digest()


def _views(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), fps, sketch, size (number of distinct shingles)."""

    def make():
        view = Views()

        def f(ids, texts):
            seen = [view.sized(t) for t in texts]
            return [ids, [_digest(t) for t in texts], [fps for fps, _, _ in seen], [sketch for _, sketch, _ in seen], [size for _, _, size in seen]]

        return f

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.arrow_map(docs.select("doc_id", "text"), make, f"doc_id {kind}, digest binary, fps array<bigint>, sketch binary, size long")


def _mark(digest) -> F.Column:
    return F.xxhash64(digest)


def _same_fingerprint(rows: DataFrame, sketches: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Links of members to the least member of their fingerprint, if they may be like it, and the members that surely are.

    A fingerprint's sketch goes to its members with it, in several tasks where very many of ``total`` have it.
    """
    mark = lambda name: sketches.select(F.col("member").alias(name), F.col("sketch").alias(f"{name}_sketch"))
    first = rows.groupBy("fp").agg(F.min("member").alias("first"), F.count("*").alias("n")).where("n > 1")
    given = first.join(mark("first"), "first")
    pairs = common.salted_join(rows, given, ["fp"], common.any_hot(first, total), F.xxhash64("member"), known=common.is_hot(total))
    both = pairs.where("member <> first").join(mark("member"), "member")

    def make():
        def f(a, b, x, y):
            if not a:
                return [[], [], []]
            share = common_share(np.array([np.frombuffer(v, np.uint8) for v in x]), np.array([np.frombuffer(v, np.uint8) for v in y])).tolist()
            rows = [(i, j, v >= SURE) for i, j, v in zip(a, b, share) if v >= POSSIBLE]
            return list(map(list, zip(*rows))) if rows else [[], [], []]

        return f

    found = common.materialize(common.arrow_map(both.select("first", "member", "first_sketch", "member_sketch"), make, "a long, b long, sure boolean"), "simhash-same")
    return found, found.where("sure").select(F.col("b").alias("member"))


def _sets(members: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """member, held: all distinct shingles of each of ``members``. Only their texts are read again."""
    wanted = common.materialize(texts.join(members.distinct(), "member").select("member", "digest"), "simhash-wanted")
    near = F.broadcast(wanted) if wanted.count() <= 100_000 else wanted  # 3 MB
    digest = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    named = docs.select(digest.alias("digest"), "text").join(near, "digest").select("member", "text")

    def make():
        view = Views()
        return lambda members, found: [members, [view.shingles(t) for t in found]]

    return common.materialize(common.arrow_map(named, make, "member long, held array<bigint>").groupBy("member").agg(F.first("held").alias("held")), "simhash-shingles")


def _verified(pairs: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): the pairs whose texts share SIMILAR of their shingles, written to the shared folder. Shingles are kept of
    the texts of these pairs only, not of all that may be in one: there they take more than the texts themselves."""
    with common.scope(docs.sparkSession) as keep:
        pairs = common.materialize(pairs.select("a", "b"), "simhash-pairs")
        sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("member")), texts, docs)
        total = pairs.count()
        side = lambda name: sets.select(F.col("member").alias(name), F.col("held").alias(f"{name}_held"))
        counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
        given = counts.join(side("a"), "a")
        both = common.salted_join(pairs.join(side("b"), "b"), given, ["a"], common.any_hot(counts, total), F.xxhash64("b"), known=common.is_hot(total))
        shared = F.size(F.array_intersect("a_held", "b_held"))
        # 4/5 of those of either: the sum of sizes counts the shared ones twice.
        return keep(both.where(9 * shared >= 4 * (F.size("a_held") + F.size("b_held"))).select("a", "b"), "simhash-alike")


def _shared_first(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """key, member, size, place: the first shingles of each text, in the order of all, that other texts have too, and how
    many the text has before. ``texts`` are told apart by 64 bits of their digest here.

    Each row of ``docs`` is a text's, copies too, which count once."""
    frequent, counts = _frequent(docs)

    def make():
        view = Views()

        def f(found):
            digests, plain, late = [], [], []
            for t in found:
                keys, size = view.keys(t)
                some, rest = _parted(keys, frequent, counts)
                digests.append(_digest(t))
                plain.append(some)
                late.append(rest[: max(0, size // 5 + 1 - len(some))])
            return [digests, plain, late]

        return f

    held = common.arrow_map(docs.select("text"), make, "digest binary, plain array<bigint>, late array<bigint>")
    # ``at`` is the place of a frequent key, and tells the number of the others under 0.
    plain = F.transform("plain", lambda k: F.struct(k.alias("key"), (-F.size("plain")).alias("at")))
    late = F.transform("late", lambda k, i: F.struct(k.alias("key"), (F.size("plain") + i).alias("at")))
    each = held.select(_mark("digest").alias("mark"), F.explode(F.concat(plain, late)).alias("e")).select("e.key", "e.at", "mark")
    whole = Window.partitionBy("key")
    before = F.lag("mark").over(whole.orderBy("mark"))
    each = each.withColumn("new", (before.isNull() | (before != F.col("mark"))).cast("int"))
    shared = each.withColumn("n", F.sum("new").over(whole)).where("new = 1 and n > 1")
    text = Window.partitionBy("mark")
    own = shared.select("key", "at", "mark", "n").join(texts.select(_mark("digest").alias("mark"), "member", "size"), "mark")
    others = F.sum(F.when(F.col("at") < 0, 1).otherwise(0)).over(text)
    rank = F.row_number().over(text.orderBy(F.col("at") >= 0, "n", "key", "member")) - 1
    placed = own.withColumns({"others": others, "rank": rank}).withColumn("place", F.when(F.col("at") < 0, F.col("rank") - F.col("at") - F.col("others")).otherwise(F.col("at")))
    return placed.where("5 * place <= size").select("key", "member", "size", F.col("place").cast("long").alias("place"))


def _may_be_alike(a: str, b: str) -> str:
    """Whether texts of columns size_a, place_a and so on may be alike by SIMILAR if this is the first they share: 4/9 of both
    sizes must be shared, none of it before."""
    return f"9 * (size_{a} - place_{a}) >= 4 * (size_{a} + size_{b}) and 9 * (size_{b} - place_{b}) >= 4 * (size_{a} + size_{b})"


def _neighbours(shared: DataFrame) -> DataFrame:
    """(a, b): texts next to each other in size among those that share one of their first shingles, if they may be alike."""
    row = F.struct("member", "size", "place")
    pairs = shared.select(row.alias("a"), F.lead(row).over(Window.partitionBy("key").orderBy("size", "member")).alias("b")).where("b is not null")
    flat = pairs.select(*[F.col(f"{x}.{c}").alias(f"{c}_{x}") for x in "ab" for c in ("member", "size", "place")])
    return flat.where(_may_be_alike("a", "b")).select(F.col("member_a").alias("a"), F.col("member_b").alias("b"))


def _unjoined(shared: DataFrame, joined: DataFrame, most: int) -> DataFrame:
    """(a, b): all pairs of texts in different components of ``joined`` (node, component) that share first shingles, but
    for those that can't be alike by SIMILAR, given their sizes and the places of these.

    The texts of a key are dealt to tiles of about ``most`` by ``most``.
    """
    named = shared.join(joined.withColumnRenamed("node", "member"), "member", "left").withColumn("component", F.coalesce("component", "member"))
    whole = Window.partitionBy("key")
    open_ = named.withColumns({"low": F.min("component").over(whole), "high": F.max("component").over(whole), "n": F.count("*").over(whole)}).where("low <> high").select("key", "member", "size", "place", "component", "n")
    open_ = common.materialize(open_, "simhash-open")
    tiles = F.ceil(F.col("n") / F.lit(most)).cast("int")
    own, every = F.pmod(F.xxhash64("member"), tiles).cast("int"), F.explode(F.sequence(F.lit(0), tiles - 1))
    side = lambda x, i, j: open_.select("key", own.alias(i), every.alias(j), F.col("member").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("size", "place", "component")])
    met = side("a", "i", "j").join(side("b", "j", "i"), ["key", "i", "j"]).where(f"a < b and component_a <> component_b and {_may_be_alike('a', 'b')}")
    return met.select("a", "b").distinct()


def similar(docs: DataFrame, most: int = MOST_COMPARED) -> DataFrame:
    """doc_id, component_id (least doc_id reachable over links) of every row of ``docs``: links join equal texts, texts
    without words, and all texts that share SIMILAR of their five-word shingles."""
    spark = docs.sparkSession
    # Views and sketches are as large as half the texts: they go once the tables that follow from them are there.
    with common.scope(spark) as keep:
        with common.scope(spark) as hold:
            seen = common.materialize(_views(docs), "simhash-views")
            each = keep(seen.select("doc_id", "digest"), "simhash-rows")
            marked = seen.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("fps", "sketch", "size")])
            marked = hold(marked.withColumn("member", F.monotonically_increasing_id()), "simhash-marked")
        texts = keep(marked.select("member", "digest", "least", "n", "size"), "simhash-texts")
        sketches, total = marked.select("member", "sketch"), texts.count()
        rows = marked.select(F.col("fps")[0].alias("fp"), "member")
        edges, represented = _same_fingerprint(rows, sketches, total)
        near = _search(rows.join(represented, "member", "left_anti"), lambda found: _compare(found.join(sketches, "member")), most, lambda found: _compare(_banded(found.join(sketches, "member"))))
        edges = keep((edges if near is None else edges.unionByName(near)).select("a", "b").distinct(), "simhash-links")
    shared = common.materialize(_shared_first(texts, docs), "simhash-first")
    found = _verified(edges.unionByName(_neighbours(shared)).distinct(), texts, docs)
    joined = common.materialize(components(found), "simhash-joined")
    member = components(found.unionByName(_verified(_unjoined(shared, joined, most), texts, docs)))
    named = texts.join(member, texts["member"] == member["node"], "left").select("digest", "least", F.coalesce("component", "member").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    copied = common.any_hot(texts, each.count())
    # Rows are numbered as they are read, so copies with one id, or none, are spread too.
    each = common.salted_join(each, named.join(least, "component").select("digest", "component_id"), ["digest"], copied, F.monotonically_increasing_id())
    return each.select("doc_id", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST_COMPARED) -> DataFrame:
    """doc_id, fp, component_id (least doc_id reachable over links) of every row of ``docs``."""
    fps = common.materialize(fingerprints(docs, shingle), "simhash")
    classes = common.materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-classes")
    member = components(links(classes.select("fp"), most))
    named = classes.join(member, classes["fp"] == member["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    each = common.salted_join(fps, named.join(least, "component").select("fp", "component_id"), ["fp"], common.any_hot(classes, fps.count()), F.monotonically_increasing_id())
    return each.select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: DuckDB has no XXH64; the query is tested against brute force.
