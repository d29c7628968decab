"""Training: gradients against differences, decoding against a plain loop, and bounded samples."""

import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import language_id, quality


def test_gradients_equal_differences():
    rng = np.random.default_rng(5)
    model = quality.Model(0.5)
    for k in model.NAMES:
        setattr(model, k, getattr(model, k).astype(np.float64) + 0.1 * rng.normal(size=getattr(model, k).shape))
    bags = [rng.random((n, quality.SIZE)) for n in (1, 3, 7, 2)]
    labels, weights = np.array([0.0, 1.0, 1.0, 0.0]), np.array([1.0, 0.5, 2.0, 1.5])

    def loss():
        out = 0.0
        for bag, y, w in zip(bags, labels, weights):
            h, _, _, e = model._encode(bag)
            a = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
            p = 1 / (1 + math.exp(-((a @ h) @ model.c + model.c0[0])))
            out -= w * (y * math.log(p) + (1 - y) * math.log(1 - p))
        return out / len(bags)

    grads = model.gradients(bags, labels, weights)
    for k in model.NAMES:
        value = getattr(model, k)
        for _ in range(4):
            at = tuple(rng.integers(n) for n in value.shape)
            kept, step = value[at], 1e-5
            value[at] = kept + step
            up = loss()
            value[at] = kept - step
            down = loss()
            value[at] = kept
            assert abs((up - down) / (2 * step) - grads[k][at]) < 1e-7


def test_decoding_takes_the_nearest_codeword():
    rng = np.random.default_rng(6)
    languages = [f"l{i}" for i in range(5)]
    texts = [" ".join(rng.choice(list("abcdefgh"[i : i + 4]), 6).tolist()) + " " + "abcdefgh"[i] * 4 for i in range(5) for _ in range(30)]
    x, y = np.array([language_id.features(t) for t in texts]), np.repeat(np.arange(5), 30)
    model = language_id.Model(languages, x, y, steps=60)
    for t in texts[::7] + ["h a", "zzz"]:
        f, totals = language_id.features(t), []
        for k in range(5):
            total = 0.0
            for bit in range(model.words.shape[1]):
                margin = float(model.w[bit] @ f + model.b[bit]) * model.words[k, bit]
                total += float(model.loss_weight[k, bit]) * math.log1p(math.exp(-max(-30, min(30, margin))))
            totals.append(total)
        order = sorted(range(5), key=totals.__getitem__)
        odds = [math.exp((totals[order[0]] - v) * model.words.shape[1]) for v in totals]
        name, score, ambiguous = model.predict(t)
        assert name == languages[order[0]] and abs(score - 1 / sum(odds)) < 1e-4
        share = 1 / (1 + odds[order[1]])
        assert ambiguous == (share < language_id.CLEAR_SHARE) or abs(share - language_id.CLEAR_SHARE) < 1e-3


def test_language_sample_is_bounded(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(language_id, "Model", lambda languages, x, y: sizes.append(np.bincount(y).tolist()))
    nulls = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.when(F.col("id") % 3 == 0, "en").otherwise("de").alias("lang"))
    same = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same").alias("text"), F.lit("fr").alias("lang"))
    language_id.train(nulls.unionByName(same), F.lit(True), sample=50)
    de, en, fr = sizes[0] if len(sizes[0]) == 3 else [*sizes[0], 0]
    assert 20 <= de <= 100 and 20 <= en <= 100 and fr <= 1
    monkeypatch.setattr(language_id, "TOTAL", 30)
    language_id.train(nulls, F.lit(True), sample=50)
    assert max(sizes[1]) <= 30


def test_quality_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality.Model, "fit", lambda self, bags, y, w: seen.append((len(bags), max(map(len, bags)))))
    docs = spark.range(400).select((F.col("id") % 40).alias("doc_id"), F.concat(F.repeat(F.lit("some words "), 20_000), "id").alias("text"))
    labels = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    quality.train(docs, labels, F.lit(True))
    assert seen == [(40, quality.MOST_BAG)]
