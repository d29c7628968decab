"""Ranked lexical search by the threshold algorithm over shards of the documents.

A document's score for an item is the sum over the item's terms (repeats included) of an impact, weight of the term
times a saturated frequency, all in integers. A first pass splits every text and writes the forward index: for each
document the number of its terms and the frequencies of those that some item holds. Document frequencies come from it.
In the second pass each task takes its documents in blocks; a block has a list of (impact, document) for each
term, sorted by impact. For each item the lists are read in turn, to the same depth; each new document is
looked up in the forward index for its whole score; reading stops once the threshold, the score of a document that
had the last impact read from each list, is strictly below the k-th best score that the task knows. Documents still
unseen then are strictly worse than k others, so ties are ranked whole. Each task sends k rows an item, which are
merged in two steps of bounded width.

Items are searched in blocks of about ITEM_BYTES of text, so the vocabulary that is broadcast has a bound.

Edge cases: a null text and one without a term match nothing and aren't counted; an item without a term that occurs
has no row; repeated rows of the benchmark count once, different texts of one item_id are items of their own with that
id; repeated documents are ranked each; equal scores go by doc_id, a null one last; long texts are split in windows;
with an empty table there is no row.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common

#: Entries of one block's lists, and documents in it; bytes of item texts searched at once; keys that the results of
#: one item are merged by first.
BLOCK_ENTRIES, BLOCK_DOCS, ITEM_BYTES, LOTS = 1 << 20, 1 << 15, 4 << 20, 64
#: Entries read from each list before the threshold is looked at again, at first and at most.
FIRST_READ, MOST_READ = 8, 512
#: Letters A-Z become small; other ASCII that is no letter or digit becomes a space.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> Counter:
    found = Counter()
    for words in common.words_of(common.utf8(text).translate(_TERMS)):
        found.update(words)
    return found


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Items:
    """The items of one block: term numbers and multiplicities of item i are [starts[i], starts[i + 1])."""

    def __init__(self, texts: list[str | None]):
        self.vocabulary: dict[bytes, int] = {}
        terms, times, self.starts = [], [], [0]
        for text in texts:
            for term, n in terms_of(text).items():
                terms.append(self.vocabulary.setdefault(term, len(self.vocabulary)))
                times.append(n)
            self.starts.append(len(terms))
        self.terms, self.times = np.array(terms, np.int64), np.array(times, np.int64)


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (its terms with repeats), and term numbers in ascending order with their frequencies."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        known = sent.value

        def one(text):
            found = terms_of(text)
            n = found.total()
            own = sorted((known[t], k) for t, k in found.items() if t in known)
            return n, [t for t, _ in own], [k for _, k in own]

        def run(ids, texts):
            made = [(i, *one(t)) for i, t in zip(ids, texts)]
            return [*zip(*(x for x in made if x[1]))] or [[], [], [], []]

        return run

    return common.arrow_map(docs.select("doc_id", "text"), make, "doc_id long, n long, terms array<int>, times array<long>")


class Best:
    """The k best (score, document) of one item: higher scores first, then lower ids, null ids last."""

    __slots__ = ("k", "score", "unknown", "ident")

    def __init__(self, k: int):
        self.k, self.score = k, np.zeros(0, np.int64)
        self.unknown, self.ident = np.zeros(0, bool), np.zeros(0, np.int64)

    def least(self) -> int:
        """What a score must reach to be of use."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, unknown: np.ndarray, ident: np.ndarray) -> None:
        use = score >= self.least()
        if not use.any():
            return
        score, unknown, ident = (np.concatenate([a, b[use]]) for a, b in ((self.score, score), (self.unknown, unknown), (self.ident, ident)))
        top = np.lexsort((ident, unknown, -score))[: self.k]
        self.score, self.unknown, self.ident = score[top], unknown[top], ident[top]


class Block:
    """Sorted lists and forward index of some documents."""

    def __init__(self, ids: pa.Array, saturated: np.ndarray, terms: np.ndarray, stops: np.ndarray, weights: np.ndarray):
        """``terms`` and ``saturated`` (frequencies) of document d are [stops[d], stops[d + 1])."""
        self.unknown = ids.is_null().to_numpy(zero_copy_only=False)
        self.ident = ids.fill_null(0).to_numpy()
        self.stops, self.terms, self.impact = stops, terms, weights[terms] * saturated
        doc = np.repeat(np.arange(len(ids)), np.diff(stops))
        order = np.lexsort((-self.impact, terms))
        self.list_doc, self.list_impact = doc[order], self.impact[order]
        self.list_start = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        self.seen = np.zeros(len(ids), bool)
        self.times = np.zeros(len(weights), np.int64)

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Whole scores of documents by the forward index, for the item whose multiplicities are in ``times``."""
        size = self.stops[docs + 1] - self.stops[docs]
        begin = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(self.stops[docs] - begin, size)
        return np.add.reduceat(self.impact[at] * self.times[self.terms[at]], begin)

    def search(self, terms: np.ndarray, times: np.ndarray, best: Best) -> int:
        """Put the block's documents into ``best``; returns the depth to which the lists were read."""
        begin, end = self.list_start[terms], self.list_start[terms + 1]
        there = end > begin
        terms, times, begin, end = terms[there], times[there], begin[there], end[there]
        if not len(terms) or int((self.list_impact[begin] * times).sum()) < best.least():
            return 0
        self.times[terms] = times
        depth, step, met = 0, FIRST_READ, []
        while True:
            at = (begin[:, None] + np.arange(depth, depth + step))[np.arange(depth, depth + step) < (end - begin)[:, None]]
            docs = self.list_doc[at]
            docs = np.unique(docs[~self.seen[docs]])
            if len(docs):
                self.seen[docs] = True
                met.append(docs)
                best.add(self.scores(docs), self.unknown[docs], self.ident[docs])
            depth += step
            last = begin + depth - 1
            open_ = last < end
            threshold = int((self.list_impact[last[open_]] * times[open_]).sum())
            if threshold < best.least():
                break
            step = min(2 * step, MOST_READ)
        for docs in met:
            self.seen[docs] = False
        self.times[terms] = 0
        return depth


def _blocks(batches: Iterator[pa.RecordBatch], n_docs: int, n_terms: int, weights: np.ndarray) -> Iterator[Block]:
    """Blocks of the forward index's rows; n_terms is the number of terms of all documents."""
    waiting, entries, rows = [], 0, 0

    def made():
        ids, n, terms, times = (pa.chunked_array([b.column(i) for b in waiting]).combine_chunks() for i in range(4))
        size = pc.list_value_length(terms).to_numpy().astype(np.int64)
        m = 25 + (75 * n.to_numpy() * n_docs) // n_terms
        tf = times.flatten().to_numpy()
        saturated = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, size))
        return Block(ids, saturated, terms.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(size)]), weights)

    for batch in batches:
        for part in common.slices(batch):
            waiting.append(part)
            entries += len(part.column(2).flatten())
            rows += part.num_rows
            if entries >= BLOCK_ENTRIES or rows >= BLOCK_DOCS:
                yield made()
                waiting, entries, rows = [], 0, 0
    if rows:
        yield made()


def _search_block(docs: DataFrame, items: Items, k: int) -> DataFrame:
    """(item number, doc_id, score, rank) for one block of items."""
    spark = docs.sparkSession
    index = common.materialize(forward_index(docs, items.vocabulary), "forward-index")
    total = index.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = total["docs"], total["terms"]
    counted = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()
    df = np.zeros(len(items.vocabulary), np.int64)
    df[counted["term"].to_numpy()] = counted["df"].to_numpy()
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    sent = spark.sparkContext.broadcast((weights, items.terms, items.times, items.starts))

    def run(batches):
        weights, terms, times, starts = sent.value
        best = [Best(k) for _ in range(len(starts) - 1)]
        for block in _blocks(batches, n_docs, n_terms, weights):
            for i, (a, b) in enumerate(zip(starts, starts[1:])):
                block.search(terms[a:b], times[a:b], best[i])
        for i, found in enumerate(best):
            if len(found.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found.score), i, np.int32)), pa.array(found.ident, mask=found.unknown), pa.array(found.score)], ["item", "doc_id", "score"])

    found = index.mapInArrow(run, "item int, doc_id long, score long").withColumn("lot", F.spark_partition_id() % LOTS)
    for keys in (["item", "lot"], ["item"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
        found = found.withColumn("rank", place).where(F.col("rank") <= k)
    return found.select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the k best documents of each item, those with a score above 0."""
    spark = docs.sparkSession
    items = items.select("item_id", "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks, found = 1 + size // ITEM_BYTES, None
    for b in range(n_blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).collect()
        numbers = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(own)], T.StructType([T.StructField("item", T.IntegerType()), items.schema["item_id"]]))
        part = _search_block(docs, Items([r["text"] for r in own]), k).join(F.broadcast(numbers), "item").select("item_id", "rank", "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    return found


SEARCH_SQL = r"""
with terms as (
  select d, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select row_number() over () as d, doc_id, text from documents)
), tf as (select d, doc_id, term, count(*) as tf from terms group by all),
lengths as (select d, count(*) as n from terms group by d),
total as (select count(*) as docs, sum(n)::bigint as l from lengths),
df as (select term, count(*) as df from tf group by term),
weights as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w from df, total),
asked as (
  select i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select row_number() over () as i, item_id, text from (select distinct item_id, text from benchmark))
), scores as (
  select i, item_id, d, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // l))))::bigint as score
  from asked join tf using (term) join weights using (term) join lengths using (d), total
  group by all
), ranked as (
  select item_id, row_number() over (partition by i order by score desc, doc_id nulls last) as rank, doc_id, score from scores where score > 0
)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
"""
