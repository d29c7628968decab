"""Language identification by error-correcting output codes.

Languages get codewords; for each bit a binary logistic classifier on hashed byte n-grams tells the languages
with a 1 from those with a 0. A text goes to the codeword of least total loss, where a bit's loss
log(1 + exp(-margin)) is weighted by how well that bit did for that language on the training rows. A text is
flagged ambiguous if the runner-up is about as likely as the winner.

Training: about SAMPLE documents of each language (fewer where TOTAL allows no more for each), chosen by a hash of
doc_id and text among rows with a language that ``may_train`` admits; the number of documents of a language sets
the hash threshold. Repeated rows count once, and no language gives over twice its share, so that what comes to
the driver is bounded: 2 x TOTAL rows of 2^FEATURES_LOG2 2-byte numbers. Predictions use the text alone, whole.

Defined cases: a text that is null or has no letter is ``und`` with score 0; with no labelled rows every text is
``und``, with one language every text with a letter is that language; rows may repeat; null ids are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common

#: Documents of a language to learn from, about; n-gram lengths; log2 of the number of features.
SAMPLE, GRAMS, FEATURES_LOG2 = 600, (1, 2, 3, 4), 13
#: Documents of all languages to learn from, about.
TOTAL = 8000
#: Languages at most: more distinct labels than this are an error, as labels come to the driver.
MOST_LANGUAGES = 1000
#: Ambiguous if the winner's share of (winner + runner-up) is below this.
CLEAR_SHARE = 0.6
BLOCK = 1 << 20
UNKNOWN = "und"

_has_letter = regex.compile(r"\p{L}").search
_is_letter = np.zeros(256, bool)
_is_letter[128:] = True
_is_letter[97:123] = True


def features(text: str) -> np.ndarray:
    """Unit-length root counts of hashed byte n-grams of the lower-cased text, other ASCII as single spaces."""
    size = 1 << FEATURES_LOG2
    counts = np.zeros(size)
    for at in range(0, len(text), BLOCK):
        raw = np.frombuffer(common.utf8(text[max(0, at - 8) : at + BLOCK].lower()), np.uint8)
        raw = np.where(_is_letter[raw], raw, 32).astype(np.uint32)
        keep = np.ones(len(raw), bool)
        keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
        raw = raw[keep]
        code = np.zeros(len(raw), np.uint32)
        for n in range(1, max(GRAMS) + 1):
            if len(raw) < n:
                break
            code = code[: len(raw) - n + 1] * np.uint32(257) + raw[n - 1 :]
            if n in GRAMS:
                counts += np.bincount(((code + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - FEATURES_LOG2), minlength=size)
    root = np.sqrt(counts)
    length = np.sqrt(counts.sum())
    return (root / length if length else root).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """n rows of distinct ±1 words: exhaustive codes up to 7 languages, else the best of seeded random codes."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 7:
        bits = np.array([[(v >> i) & 1 for v in range(1 << (n - 1), (1 << n) - 1)] for i in range(n)])
        return (1 - 2 * bits).astype(np.int8)
    rng, best, most = np.random.default_rng(0), None, -1
    width = int(10 * np.ceil(np.log2(n)))
    for _ in range(50):
        words = rng.choice(np.array([-1, 1], np.int8), (n, width))
        if (abs(words.sum(0)) == n).any():
            continue
        distance = (width - words.astype(int) @ words.T.astype(int)) // 2
        least = distance[~np.eye(n, dtype=bool)].min()
        if least > most:
            best, most = words, least
    return best


class Model:
    """Weights (bits x features), biases, codewords and loss weights."""

    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 2.0, decay: float = 1e-5):
        self.languages = languages
        self.words = codewords(len(languages)).astype(np.float32)
        bits = self.words.shape[1]
        self.w, self.b = np.zeros((bits, 1 << FEATURES_LOG2), np.float32), np.zeros(bits, np.float32)
        if not bits:
            return
        target = self.words[y]
        weight = (1.0 / np.maximum(np.bincount(y, minlength=len(languages)), 1))[y].astype(np.float32)
        weight /= weight.sum()
        moment = np.zeros_like(self.w)
        for step in range(steps):
            margin = target * (x @ self.w.T + self.b)
            pull = target * weight[:, None] / (1 + np.exp(np.clip(margin, -30, 30)))
            moment = 0.9 * moment + pull.T @ x
            self.w += rate * 10 * moment - decay * self.w
            self.b += rate * pull.sum(0)
        margin = target * (x @ self.w.T + self.b)
        right = np.stack([(margin[y == k] > 0).mean(0) if (y == k).any() else np.ones(bits) for k in range(len(languages))])
        right = np.maximum(right, 1e-3)
        self.loss_weight = (right / right.sum(1, keepdims=True)).astype(np.float32)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (0 to 1), ambiguous."""
        if text is None or not self.languages or not _has_letter(text):
            return UNKNOWN, 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        margin = self.w @ features(text) + self.b
        loss = (self.loss_weight * np.logaddexp(0, -np.clip(self.words * margin, -30, 30))).sum(1)
        odds = np.exp((loss.min() - loss) * self.words.shape[1])
        order = np.argsort(-odds, kind="stable")
        first, second = odds[order[0]], odds[order[1]]
        return self.languages[order[0]], float(first / odds.sum()), bool(first / (first + second) < CLEAR_SHARE)


def train(docs: DataFrame, may_train: Column, sample: int = SAMPLE) -> Model:
    rows = docs.where(may_train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect())
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    languages = [k for k, _ in counts]
    number = {k: i for i, k in enumerate(languages)}
    share = min(sample, max(1, TOTAL // max(1, len(languages))))
    rows = rows.withColumn("rank", F.xxhash64("doc_id", "text"))
    limit = F.lit(0)
    for k, n in counts:
        limit = F.when(F.col("lang") == k, F.lit(int(min(1.0, share / n) * (1 << 30)))).otherwise(limit)

    def make():
        return lambda ranks, texts, langs: [ranks, [number[k] for k in langs], [features(t).astype("<f2").tobytes() for t in texts]]

    chosen = rows.where(F.pmod("rank", F.lit(1 << 30)) < limit).select("rank", "text", "lang")
    once = common.arrow_map(chosen, make, "rank long, y int, x binary").groupBy("y", "rank").agg(F.min("x").alias("x"))
    place = F.row_number().over(Window.partitionBy("y").orderBy("rank"))
    got = once.withColumn("place", place).where(F.col("place") <= 2 * share).orderBy("y", "rank").select("y", "x").toArrow()
    x, y = np.empty((got.num_rows, 1 << FEATURES_LOG2), np.float32), got["y"].to_numpy().astype(np.int64)
    for i, v in enumerate(got["x"]):
        x[i] = np.frombuffer(v.as_buffer(), "<f2")
    del got
    return Model(languages, x, y)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` that identify and hold texts, with lang_pred, score and ambiguous: doc_id, lang_pred, score, ambiguous."""

    def make():
        return lambda ids, texts: [ids, *map(list, zip(*[model.predict(t) for t in texts]))]

    return common.arrow_map(docs.select("doc_id", "text"), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")


def recognised(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text has a language that isn't ambiguous."""

    def make():
        def f(batch):
            seen = [model.predict(t) for t in batch.column("text").to_pylist()]
            return batch.filter(pa.array([k != UNKNOWN and not ambiguous for k, _, ambiguous in seen]))

        return f

    return common.batch_map(docs, make)
