"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of about PASSAGE bytes. Each passage is encoded by a layer h = tanh(W f) over
byte, byte-class and word statistics f of the passage; gated attention weights a_k (softmax over the passages of
v . (tanh(V h_k) * sigmoid(U h_k))) make the document's representation z = sum of a_k h_k, and a logistic layer
scores z. All of it is learned from document labels alone, with hand-written gradients in numpy.

Training: about SAMPLE documents of each label, chosen by a hash of doc_id among labelled rows that ``may_train``
admits; of rows that share an id one is taken, and of a document of over MOST_BAG passages that many, evenly spread
over it. So at most about 2 x SAMPLE x MOST_BAG passages come to the driver. Classes are weighted by their share of all labelled rows, so that scores are calibrated to it. Scoring
takes whole texts; the passages of a very long one go through in blocks with a running softmax.

Defined cases: null and empty texts are one passage without bytes and get a score as any; rows may repeat; a
label that is null is no label; with no labels, or one class only, every score is that class's share (0.5 with
none).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: Bytes of a passage; passages handled at once; documents of a label to learn from, about; hidden sizes.
PASSAGE, BLOCK, SAMPLE, HIDDEN, ATTENTION = 1200, 2048, 1500, 24, 12
THRESHOLD = 0.7
EPOCHS, RATE, DECAY, BATCH = 12, 3e-3, 1e-4, 32
#: Passages of a training document.
MOST_BAG = 64

_CLASS = np.full(256, 7, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 space, 4 newline, 5 stop and comma, 6 other punctuation, 7 non-ASCII and control
_CLASS[33:127] = 6
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[32] = _CLASS[9] = 3
_CLASS[10] = _CLASS[13] = 4
_CLASS[[44, 46]] = 5
CLASSES = 8
SIZE = 256 + CLASSES * CLASSES + 5


def passages(raw: bytes) -> list[bytes]:
    """Pieces of about PASSAGE bytes, cut at white space where there is some."""
    out, at = [], 0
    while len(raw) - at > PASSAGE + PASSAGE // 2:
        stop = raw.rfind(b" ", at + PASSAGE // 2, at + PASSAGE)
        stop = at + PASSAGE if stop < 0 else stop + 1
        out.append(raw[at:stop])
        at = stop
    out.append(raw[at:])
    return out


def features(pieces: list[bytes]) -> np.ndarray:
    """One row for each passage."""
    n = len(pieces)
    lengths = np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    owner = np.repeat(np.arange(n), lengths)
    total = np.maximum(lengths, 1)[:, None]
    hist = np.bincount(owner * 256 + raw, minlength=n * 256).reshape(n, 256)
    kinds = _CLASS[raw].astype(np.int64)
    inside = owner[1:] == owner[:-1]
    steps = np.bincount((owner[1:] * CLASSES + kinds[:-1])[inside] * CLASSES + kinds[1:][inside], minlength=n * CLASSES * CLASSES).reshape(n, CLASSES * CLASSES)
    extra = np.zeros((n, 5))
    for k, p in enumerate(pieces):
        words = p.split()
        if words:
            extra[k] = len(set(words)) / len(words), np.log1p(len(words)) / 6, len(p) / len(words) / 20, max(map(len, words)) / 40, len(set(words[: len(words) // 2]) & set(words[len(words) // 2 :])) / len(words)
    return np.concatenate([np.sqrt(hist / total), np.sqrt(steps / total), extra], 1).astype(np.float32)


class Model:
    NAMES = ("w", "b", "v", "vb", "u", "ub", "a", "c", "c0")

    def __init__(self, share: float):
        self.share, self.trained = share, False
        rng = np.random.default_rng(7)
        normal = lambda *s: (rng.normal(size=s) / np.sqrt(s[-1])).astype(np.float32)
        self.w, self.b = normal(HIDDEN, SIZE), np.zeros(HIDDEN, np.float32)
        self.v, self.vb, self.u, self.ub = normal(ATTENTION, HIDDEN), np.zeros(ATTENTION, np.float32), normal(ATTENTION, HIDDEN), np.zeros(ATTENTION, np.float32)
        self.a, self.c, self.c0 = normal(1, ATTENTION)[0], normal(1, HIDDEN)[0], np.zeros(1, np.float32)
        self.mean, self.scale = np.zeros(SIZE, np.float32), np.ones(SIZE, np.float32)

    def _encode(self, f: np.ndarray):
        h = np.tanh(((f - self.mean) / self.scale) @ self.w.T + self.b)
        gate = 1 / (1 + np.exp(-(h @ self.u.T + self.ub)))
        bent = np.tanh(h @ self.v.T + self.vb)
        return h, bent, gate, (bent * gate) @ self.a

    def gradients(self, bags: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean weighted logistic loss of some documents, by parameter."""
        sizes = np.array([len(bag) for bag in bags])
        starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(bags)), sizes)
        f = (np.concatenate(bags) - self.mean) / self.scale
        h = np.tanh(f @ self.w.T + self.b)
        gate = 1 / (1 + np.exp(-(h @ self.u.T + self.ub)))
        bent = np.tanh(h @ self.v.T + self.vb)
        e = (bent * gate) @ self.a
        e = np.exp(e - np.maximum.reduceat(e, starts)[owner])
        att = e / np.add.reduceat(e, starts)[owner]
        z = np.add.reduceat(att[:, None] * h, starts)
        p = 1 / (1 + np.exp(-(z @ self.c + self.c0)))
        d = (weights * (p - labels)).astype(h.dtype) / len(bags)
        dz = d[:, None] * self.c
        dh = att[:, None] * dz[owner]
        datt = (dz[owner] * h).sum(1)
        de = att * (datt - np.add.reduceat(att * datt, starts)[owner])
        dbent, dgate = de[:, None] * self.a * gate * (1 - bent**2), de[:, None] * self.a * bent * gate * (1 - gate)
        dh += dbent @ self.v + dgate @ self.u
        dh *= 1 - h**2
        return {"w": dh.T @ f, "b": dh.sum(0), "v": dbent.T @ h, "vb": dbent.sum(0), "u": dgate.T @ h, "ub": dgate.sum(0), "a": (de[:, None] * bent * gate).sum(0), "c": d @ z, "c0": d.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> None:
        """Adam over shuffled batches of documents."""
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), np.maximum(every.std(0), 1e-2)
        rng, first, second, step = np.random.default_rng(1), {k: 0.0 for k in self.NAMES}, {k: 0.0 for k in self.NAMES}, 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), BATCH):
                chosen = order[at : at + BATCH]
                grads = self.gradients([bags[i] for i in chosen], labels[chosen], weights[chosen])
                step += 1
                for k, g in grads.items():
                    g = g + DECAY * getattr(self, k)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    setattr(self, k, (getattr(self, k) - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32))
        self.trained = True

    def score(self, text: str | None) -> float:
        if not self.trained:
            return self.share
        pieces = passages(common.utf8(text))
        top, mass, z = -np.inf, 0.0, np.zeros(HIDDEN)
        for at in range(0, len(pieces), BLOCK):
            h, _, _, e = self._encode(features(pieces[at : at + BLOCK]))
            now = max(top, float(e.max()))
            part, kept = np.exp(e - now), np.exp(top - now)
            mass, z, top = mass * kept + part.sum(), z * kept + part @ h, now
        return float(1 / (1 + np.exp(-np.clip(z / mass @ self.c + self.c0[0], -30, 30))))


def train(docs: DataFrame, labels: DataFrame, may_train: Column, sample: int = SAMPLE) -> Model:
    marks = labels.where(F.col("quality").isin(0, 1) & may_train).groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("quality").alias("least")).where("quality = least").select("doc_id", "quality")
    counts = {r["quality"]: r["n"] for r in marks.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    model = Model(counts.get(1, 0) / total if total else 0.5)
    if len(counts) < 2:
        return model
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    limit = F.when(F.col("quality") == 1, F.lit(int(min(1, sample / counts[1]) * (1 << 30)))).otherwise(F.lit(int(min(1, sample / counts[0]) * (1 << 30))))
    # 2 x SAMPLE ids, about, go to every executor; the texts aren't shuffled.
    chosen = F.broadcast(marks.where(rank < limit))

    def make():
        def bag(text):
            pieces = passages(common.utf8(text))
            if len(pieces) > MOST_BAG:
                pieces = [pieces[k * len(pieces) // MOST_BAG] for k in range(MOST_BAG)]
            return features(pieces).astype("<f2").tobytes()

        return lambda ids, texts, q: [ids, q, [bag(t) for t in texts]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    picked = docs.select("doc_id", "text").join(chosen, "doc_id")
    got = common.arrow_map(picked, make, f"doc_id {kind}, quality int, f binary").groupBy("doc_id", "quality").agg(F.min("f").alias("f")).orderBy("doc_id").toArrow()
    bags = [np.frombuffer(f, "<f2").reshape(-1, SIZE).astype(np.float32) for f in got["f"].to_pylist()]
    ys = got["quality"].to_pylist()
    y = np.array(ys, np.float32)
    if 0 < y.sum() < len(y):
        share = counts[1] / total
        weights = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
        model.fit(bags, y, weights)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every document."""

    def make():
        def f(ids, texts):
            scores = [model.score(t) for t in texts]
            return [ids, scores, [int(s >= THRESHOLD) for s in scores]]

        return f

    return common.arrow_map(docs.select("doc_id", "text"), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
