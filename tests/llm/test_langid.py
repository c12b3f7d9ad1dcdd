import math
import re
from collections import Counter

import numpy as np
from helpers import documents, empty, prose
from pyspark.sql import functions as F

from lexdrift.llm import langid


def test_held_out_accuracy(spark):
    docs = documents(spark, 240, odd=False)
    got = langid.identify(docs, langid.fit(docs.where("at % 4 <> 2"))).join(docs.select("doc_id", "lang", "at"), "doc_id").where("at % 4 = 2").collect()
    assert len(got) > 50 and np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_texts(spark):
    docs = documents(spark)
    got = langid.identify(docs, langid.fit(docs)).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        t = texts[r.doc_id]
        assert (r.lang_pred == "und") == (t is None or not any(c.isalpha() for c in t))
        assert r.lang_pred in ("en", "de", "fr", "und")
    nothing = langid.fit(empty(spark))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(empty(spark), nothing).count() == 0


def test_far_texts_are_rejected(spark):
    docs = documents(spark, 120, odd=False)
    model = langid.fit(docs)
    far = spark.createDataFrame([(1, "zzqx kvjw " * 60), (2, prose(999, 300))], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(far, model).collect()}
    assert got[1].rejected and got[1].score < got[2].score and not got[2].rejected


def test_vectors_by_definition(spark):
    model = langid.fit(documents(spark, 45, odd=False).where(F.col("text").isNotNull()))
    text = "The Thing, the."
    data = np.frombuffer(text.encode(), np.uint8)
    got = model.vectors(model.counts(data, np.array([0, len(data)])))[0]
    clean = b" the thing the "
    assert abs(np.linalg.norm(got) - 1) < 1e-5 or not got.any()
    row, bucket = langid.ngrams(data, np.array([0, len(data)]))
    assert len(bucket) == 2 * len(clean) - 3
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-4)


def test_predictions_by_definition(spark):
    """Language and score by the formula, an n-gram at a time."""
    docs = documents(spark)
    model = langid.fit(docs, features=900)
    for r in langid.identify(docs, model).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        text = (r.text or "").encode()
        if r.lang_pred == "und":
            continue
        clean = re.sub(rb" +", b" ", b" " + bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text) + b" ")
        tf = Counter()
        for k in range(len(clean) - 1):
            two = (clean[k] << 8 | clean[k + 1]) * 2654435761 % (1 << 32)
            tf[two >> 16] += 1
            if k + 2 < len(clean):
                tf[((two ^ clean[k + 2] * 0x9E3779B1 % (1 << 32)) * 2246822519 % (1 << 32)) >> 16] += 1
        v = np.zeros(len(model.idf))
        for bucket, n in tf.items():
            if model.index[bucket] < len(v):
                v[model.index[bucket]] = (1 + math.log(n)) * model.idf[model.index[bucket]]
        cos = model.centroids @ (v / max(np.linalg.norm(v), 1e-12))
        assert abs(r.score - min(max(cos.max(), 0), 1)) < 1e-4
        assert r.lang_pred == model.languages[model.of[cos.argmax()]] or np.sort(cos)[-1] - np.sort(cos)[-2] < 1e-5
