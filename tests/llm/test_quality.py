import math

import numpy as np
from helpers import documents, empty, prose
from pyspark.sql import functions as F

from lexdrift.llm import quality


def labelled(spark, n=200):
    rows = []
    for k in range(n):
        t = prose(k, 30 + k % 90)
        bad = k % 4 == 0
        if bad:  # clean at first, then shouted
            t = t + "\n" + prose(k + 1000, 60).upper().replace(" ", "!! ")
        rows.append((k, t, int(not bad), k % 5))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, part int")


def test_held_out(spark):
    df = labelled(spark)
    model = quality.fit(df.select("doc_id", "text"), df.where("part <> 0").select("doc_id", "quality"))
    got = quality.score(df, model, ("doc_id", "quality", "part")).where("part = 0").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    kept = quality.accepted(df, model)
    assert kept.columns == df.columns and kept.agg(F.avg("quality")).first()[0] > 0.9


def test_gradients():
    rng = np.random.default_rng(0)
    x = rng.random((9, quality.WIDTH)).astype(np.float64)
    first, y = np.array([0, 4, 5, 9]), np.array([1.0, 0.0, 1.0])
    model = quality.train(x.astype(np.float32), first, np.array([1, 1, 1], np.float32))
    model.w = {k: (v + 0.3 * rng.standard_normal(v.shape)).astype(np.float64) for k, v in model.w.items()}
    grads = model.gradients(x, first, y)

    def loss():
        p = model.forward(x, first)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, g in grads.items():
        at = tuple(rng.integers(0, s) for s in g.shape)
        old = model.w[name][at]
        model.w[name][at] = old + 1e-5
        up = loss()
        model.w[name][at] = old - 1e-5
        down = loss()
        model.w[name][at] = old
        assert abs((up - down) / 2e-5 - g[at]) < 1e-5, name


def test_odd(spark):
    docs = documents(spark)
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0).alias("quality")).unionByName(spark.createDataFrame([(None, 1), (4, None)], "doc_id long, quality int"))
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by_text = {}
    for r, s in zip(quality.score(docs, model, ("text",)).collect(), range(10**6), strict=False):
        by_text.setdefault(r.text or "", set()).add(r.score)
    assert all(max(v) - min(v) < 1e-6 for v in by_text.values())
    none = quality.fit(docs, labels.limit(0))
    assert quality.score(empty(spark), none).count() == 0
    assert len({r.score for r in quality.score(docs, none).collect()}) == 1


def plain(text: bytes, model) -> float:
    """The score of one text by the definition, a passage and a byte at a time."""
    encoded = []
    for a in range(0, max(len(text), 1), quality.PASSAGE):
        own = text[a : a + quality.PASSAGE]
        x = [0.0] * quality.WIDTH
        for b, c in zip(own, own[1:], strict=False):
            x[int(quality._CLASS[b]) * 16 + int(quality._CLASS[c])] += 1
        low = own.lower()
        for k in range(len(low) - 2):
            h = (low[k] << 16 | low[k + 1] << 8 | low[k + 2]) * 2654435761 % (1 << 32) >> 26
            x[256 + h] += 1
        x = [math.sqrt(v / max(len(own), 1)) for v in x]
        grams = {(own[k] << 24 | own[k + 1] << 16 | own[k + 2] << 8 | own[k + 3]) * 2654435761 % (1 << 32) >> 22 for k in range(len(own) - 3)}
        x[-2] = len(grams) / max(len(own) - 3, 1)
        x[-1] = max(0.5 - x[-2], 0)
        x = (np.array(x) - model.mean) / model.scale
        encoded.append(np.tanh(x @ model.w["W"] + model.w["b"]))
    gates = [float(model.w["a"] @ (np.tanh(h @ model.w["V"]) / (1 + np.exp(-(h @ model.w["U"]))))) for h in encoded]
    e = [math.exp(g - max(gates)) for g in gates]
    z = sum(w * h for w, h in zip(e, encoded, strict=True)) / sum(e)
    return 1 / (1 + math.exp(-float(z @ model.w["c"] + model.w["d"][0])))


def test_scores_by_definition(spark):
    df = labelled(spark, 80)
    model = quality.fit(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    docs = documents(spark)
    texts = {(r.doc_id, r.at): (r.text or "").encode() for r in docs.collect()}
    for r in quality.score(docs, model, ("doc_id", "at")).collect():
        assert abs(r.score - plain(texts[r.doc_id, r.at], model)) < 1e-4


def test_every_passage_is_learned_from(spark, monkeypatch):
    """A long document has all its passages in its bag, and the bounds of the sample are whole documents."""
    bags = []
    monkeypatch.setattr(quality, "train", lambda x, first, y: bags.append(np.diff(first).tolist()))
    texts = ["x" * 384 * 40, "y" * 384 * 3, "z" * 10]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    quality.fit(docs, labels)
    quality.fit(docs, labels, sample=2)
    quality.fit(docs, labels, sample_bytes=384 * 5)
    assert sorted(bags[0]) == [1, 3, 40] and len(bags[1]) == 2 and 1 <= len(bags[2]) <= 2
