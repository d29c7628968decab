"""Filter interaction audit: what each of five text filters removes in every order of applying them.

Failure conditions of a text (null counts as empty; words are maximal runs without ASCII white space, case-sensitive):

* A: under 200 words
* B: distinct words are less than half of the words
* C: more than 3 % of the code points are capitals A-Z
* D: holds one of ``#$%&*|``
* E: equals the text of a smaller doc_id, anywhere in the table

An index of packed bitmaps answers all orders at once. The rows of a task go through it in blocks of BLOCK: each filter
and label is a bitmap over the block, sorted so that a part (a ``lang`` value) is a run of it. What a filter removes
depends only on the *set* of filters before it, so for each of the 32 sets the rows that pass are one AND-NOT from a
smaller set, and counts are pops of those words. Tasks emit 80 counts a part, Spark sums them, and the 120 orders are
looked up in the sums.

Equal texts are found by their SHA-256, of which the least doc_id is found in two steps, so that a text with any
share of the rows is spread over SALTS keys.

Edge cases: a null ``lang`` is the part ''; a null doc_id is smaller than none and has no smaller one, so E never fails
on it, nor between rows of one doc_id; a document has a label if any row of ``labels`` with its id has it; an empty
text fails A alone (and E); an empty table has no part, so no row. Of a long text only its distinct words are held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 200, 50, 3, b"#$%&*|"
#: Rows in one set of bitmaps; keys that the copies of one text are spread over.
BLOCK, SALTS = 1 << 16, 64
_EVERY = (1 << len(FILTERS)) - 1
_NOT_CAPITAL = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_FOLLOWING = bytes(range(0x80, 0xC0))


def failures(text: str | None) -> tuple[bytes, int]:
    """SHA-256 of a text and the filters A to D that it fails, as bits."""
    data = common.utf8(text)
    n, distinct = 0, set()
    for words in common.words_of(data):
        n += len(words)
        distinct.update(words)
    capitals = len(data.translate(None, _NOT_CAPITAL))
    characters = len(data.translate(None, _NOT_FOLLOWING))
    fails = (
        n < LEAST_WORDS,
        100 * len(distinct) < DISTINCT_PERCENT * n,
        100 * capitals > CAPITAL_PERCENT * characters,
        len(data.translate(None, SYMBOLS)) < len(data),
    )
    return hashlib.sha256(data).digest(), sum(x << i for i, x in enumerate(fails))


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic) of each document; ``fails`` has a bit for each failed filter."""

    def make():
        return lambda ids, parts, texts: [ids, parts, *zip(*map(failures, texts))]

    given = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")), "text")
    facts = common.arrow_map(given, make, "doc_id long, part string, digest binary, fails int")
    facts = common.materialize(facts.withColumn("salt", F.monotonically_increasing_id() % SALTS), "audit-facts")
    spread = facts.groupBy("digest", "salt").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    repeated = spread.groupBy("digest").agg(F.min("least").alias("least"), F.sum("n").alias("n")).where("n > 1")
    least = spread.select("digest", "salt").join(repeated.select("digest", "least"), "digest")
    facts = facts.join(least, ["digest", "salt"], "left")
    copied = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    facts = facts.select("doc_id", "part", (F.col("fails") + F.when(copied, 16).otherwise(0)).alias("fails"), F.when(F.col("doc_id").isNull(), F.col("salt")).otherwise(0).alias("spread"))
    marked = labels.groupBy("doc_id").agg(F.max(F.expr("coalesce(quality = 1, false)")).alias("good"), F.max(F.expr("coalesce(toxic = 1, false)")).alias("toxic"))
    marked = marked.withColumn("spread", F.lit(0).cast("long"))  # null ids have no label; they are spread over keys
    found = facts.join(marked, ["doc_id", "spread"], "left")
    return found.select("part", "fails", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def _packed(marks: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words, bit 0 first."""
    padded = np.zeros((len(marks), -(-marks.shape[1] // 64) * 64), bool)
    padded[:, : marks.shape[1]] = marks
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def _run(start: int, stop: int) -> tuple[slice, np.ndarray]:
    """The words that the rows from start to stop lie in, and their bitmap within these."""
    first, last = start >> 6, (stop + 63) >> 6
    words = np.full(last - first, ~np.uint64(0))
    words[0] &= ~np.uint64(0) << np.uint64(start & 63)
    if stop & 63:
        words[-1] &= ~np.uint64(0) >> np.uint64(64 - (stop & 63))
    return slice(first, last), words


def block_counts(parts: np.ndarray, fails: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each part code of a block: an array [set of filters before, filter] of (kept, removed, good and toxic removed).

    Entries whose set holds the filter are zero.
    """
    order = np.argsort(parts, kind="stable")
    parts, fails = parts[order], fails[order]
    marks = _packed(np.stack([*((fails >> i) & 1 == 1 for i in range(len(FILTERS))), good[order], toxic[order]]))
    codes, starts = np.unique(parts, return_index=True)
    for code, start, stop in zip(codes.tolist(), starts.tolist(), [*starts[1:].tolist(), len(parts)]):
        where, part = _run(start, stop)
        failing, labels = marks[: len(FILTERS), where], marks[len(FILTERS) :, where]
        left = np.empty((_EVERY + 1, len(part)), np.uint64)  # rows that no filter of the set removes
        left[0] = part
        for s in range(1, _EVERY + 1):
            low = (s & -s).bit_length() - 1
            left[s] = left[s & (s - 1)] & ~failing[low]
        kept = np.bitwise_count(left).sum(1, dtype=np.int64)
        out = np.zeros((_EVERY + 1, len(FILTERS), 4), np.int64)
        for f in range(len(FILTERS)):
            sets = np.array([s for s in range(_EVERY + 1) if not s >> f & 1])
            removed = left[sets] & failing[f]
            out[sets, f, 0] = kept[sets | 1 << f]
            out[sets, f, 1] = np.bitwise_count(removed).sum(1, dtype=np.int64)
            for k in (0, 1):
                out[sets, f, 2 + k] = np.bitwise_count(removed & labels[k]).sum(1, dtype=np.int64)
        yield code, out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "before", "filter", "kept", "removed", "good_lost", "toxic_lost"]
    steps = [(s, f) for s in range(_EVERY + 1) for f in range(len(FILTERS)) if not s >> f & 1]
    sets, filters = np.array(steps, np.int32).T
    total: dict[str, np.ndarray] = {}
    waiting, rows = [], 0

    def count():
        nonlocal waiting, rows
        block = pa.Table.from_batches(waiting).combine_chunks()
        waiting, rows = [], 0
        for at in range(0, block.num_rows, BLOCK):
            piece = block.slice(at, BLOCK)
            coded = piece["part"].combine_chunks().dictionary_encode()
            columns = [piece[c].to_numpy() for c in ("fails", "good", "toxic")]
            for code, counts in block_counts(coded.indices.to_numpy(), *columns):
                name = coded.dictionary[code].as_py()
                total[name] = total[name] + counts if name in total else counts

    def emit():
        for part, counts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(steps)), pa.array(sets), pa.array(filters), *[pa.array(counts[sets, filters, k]) for k in range(4)]], names)
        total.clear()

    for batch in batches:
        waiting.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK:
            count()
            if len(total) > 1000:
                yield from emit()
    if rows:
        count()
    yield from emit()


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark = docs.sparkSession
    schema = "part string, before int, filter int, kept long, removed long, good_lost long, toxic_lost long"
    counts = flagged(docs, labels).mapInArrow(_sums, schema)
    counts = counts.groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in ("kept", "removed", "good_lost", "toxic_lost")])
    counts = common.materialize(counts, "audit-counts")
    size = F.bit_count("before")  # how many orders have this set before this filter
    weight = F.element_at(F.array(*[F.lit(factorial(k) * factorial(len(FILTERS) - 1 - k)) for k in range(len(FILTERS))]), size + 1)
    alone = F.expr(f"before = {_EVERY} - shiftleft(1, filter)")  # all other filters come first
    of_filter = counts.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("failing"),
        F.sum(F.when(alone, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * weight).cast("long").alias("shapley"),
    )
    steps = []
    for order in permutations(range(len(FILTERS))):
        for k, f in enumerate(order):
            steps.append(("".join(FILTERS[i] for i in order), k + 1, sum(1 << i for i in order[:k]), f))
    orders = spark.createDataFrame(steps, "filter_order string, step int, before int, filter int")
    found = counts.join(F.broadcast(orders), ["before", "filter"]).join(of_filter, ["part", "filter"])
    return found.select("part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


AUDIT_SQL = r"""
with texts as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents
), marks as (
  select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels group by doc_id
), failed as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
         (case when len(words) < 200 then 1 else 0 end)
         + (case when 100 * len(list_distinct(words)) < 50 * len(words) then 2 else 0 end)
         + (case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) then 4 else 0 end)
         + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end)
         + (case when d.doc_id > min(d.doc_id) over (partition by t) then 16 else 0 end) as fails
  from texts d left join marks m on d.doc_id = m.doc_id
), classes as (
  select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from failed group by all
), letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as l),
orders as (
  select a.l || b.l || c.l || d.l || e.l as filter_order from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), letters_of as (
  select filter_order, step::int as step, (1 << (ascii(filter_order[step]) - 65))::int as own from orders, range(1, 6) r(step)
), steps as (
  select *, coalesce(sum(own) over (partition by filter_order order by step rows between unbounded preceding and 1 preceding), 0)::int as before
  from letters_of
), counted as (
  select part, filter_order, step, own,
         coalesce(sum(n) filter ((fails & (before | own)) = 0), 0)::bigint as kept,
         coalesce(sum(n) filter ((fails & before) = 0 and (fails & own) <> 0), 0)::bigint as removed,
         coalesce(sum(n) filter ((fails & before) <> 0 and (fails & own) <> 0), 0)::bigint as redundant,
         coalesce(sum(n) filter (fails = own), 0)::bigint as unique_fails,
         coalesce(sum(good) filter ((fails & before) = 0 and (fails & own) <> 0), 0)::bigint as good_lost,
         coalesce(sum(toxic) filter ((fails & before) = 0 and (fails & own) <> 0), 0)::bigint as toxic_lost
  from classes, steps group by part, filter_order, step, own
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) over (partition by part, own))::bigint as shapley
from counted
"""
