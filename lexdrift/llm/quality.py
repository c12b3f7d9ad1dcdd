"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes. Each passage is encoded from its byte-class bigrams and hashed letter n-grams by a
small network; gated attention weighs the passages of a document, and a logistic unit scores their weighted mean. Only document labels
are learned from; the weights of the passages follow from them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, flat, fold, map_arrow, map_batches, materialise, parts, table

PASSAGE = 384
HIDDEN, GATES = 24, 16
#: Labelled documents that are learned from at most, and the bytes of their texts. Of each one every passage counts.
SAMPLE, SAMPLE_BYTES = 5000, 24 << 20
EPOCHS, BATCH, RATE, DECAY = 30, 64, 3e-3, 1e-4
ACCEPT = 0.3

_CLASS = np.full(256, 13, np.uint8)
for _k, _chars in enumerate((None, b"\n", b" ", b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"AEIOU", b"BCDFGHJKLMNPQRSTVWXYZ", b"0123456789", b".", b",;:", b"|", b"!?", b"#$%&*@^~")):
    if _chars:
        _CLASS[list(_chars)] = _k
_CLASS[:32] = np.where(_CLASS[:32] == 13, 0, _CLASS[:32])
_CLASS[0x80:0xC0] = 15
_CLASS[0xC0:] = 14
KINDS = 16
HASHED = 64
#: Buckets that tell how many different 4-grams a passage has.
DISTINCT = 1024
WIDTH = KINDS * KINDS + HASHED + 2


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, first passage of each document and the number of all); an empty text is one empty passage."""
    n = np.diff(offsets)
    per = np.maximum(1, -(-n // PASSAGE))
    first = np.concatenate([[0], np.cumsum(per)])
    p = np.repeat(first[:-1], n) + (np.arange(len(data)) - np.repeat(offsets[:-1], n)) // PASSAGE
    kind = _CLASS[data].astype(np.int64)
    x = np.zeros((first[-1], WIDTH), np.float32)
    if len(data) > 1:
        same = p[1:] == p[:-1]
        x[:, : KINDS * KINDS] = np.bincount((p[:-1] * (KINDS * KINDS) + kind[:-1] * KINDS + kind[1:])[same], minlength=first[-1] * KINDS * KINDS).reshape(-1, KINDS * KINDS)
    if len(data) > 2:
        low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
        h = ((low[:-2] << 16 | low[1:-1] << 8 | low[2:]) * np.uint32(2654435761)) >> np.uint32(26)
        same = p[2:] == p[:-2]
        x[:, KINDS * KINDS : WIDTH - 2] = np.bincount((p[:-2] * HASHED + h)[same], minlength=first[-1] * HASHED).reshape(-1, HASHED)
    size = np.bincount(p, minlength=first[-1])[:, None]
    x = np.sqrt(x / np.maximum(size, 1)).astype(np.float32)
    x[:, -1] = 0.5
    if len(data) > 3:
        # words that repeat within a passage: the share of its 4-grams that are new, and how far that is below the usual
        h = ((data[:-3].astype(np.uint32) << 24 | data[1:-2].astype(np.uint32) << 16 | data[2:-1].astype(np.uint32) << 8 | data[3:]) * np.uint32(2654435761)) >> np.uint32(22)
        same = p[3:] == p[:-3]
        seen = np.zeros(first[-1] * DISTINCT, bool)
        seen[(p[:-3] * DISTINCT + h)[same]] = True
        new = seen.reshape(-1, DISTINCT).sum(1) / np.maximum(size[:, 0] - 3, 1)
        x[:, -2], x[:, -1] = new, np.maximum(0.5 - new, 0)
    return x, first


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray, keep: bool = False):
        w = self.w
        starts, n = first[:-1], np.diff(first)
        xs = (x - self.mean) / self.scale
        h = np.tanh(xs @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * g) @ w["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), n))
        alpha = e / np.repeat(np.add.reduceat(e, starts), n)
        z = np.add.reduceat(alpha[:, None] * h, starts)
        p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"][0], -40, 40)))
        return (p, xs, h, t, g, alpha, z) if keep else p

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, n = self.w, np.diff(first)
        p, xs, h, t, g, alpha, z = self.forward(x, first, keep=True)
        dz0 = (p - y) / len(y)
        dz = np.repeat(dz0[:, None] * w["c"], n, axis=0)
        zr = np.repeat(z, n, axis=0)
        de = alpha * ((h - zr) * dz).sum(1)
        dt, dg = de[:, None] * w["a"] * g * (1 - t * t), de[:, None] * w["a"] * t * g * (1 - g)
        dh = (alpha[:, None] * dz + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
        return {"c": z.T @ dz0, "d": np.array([dz0.sum()]), "a": (t * g).T @ de, "V": h.T @ dt, "U": h.T @ dg, "W": xs.T @ dh, "b": dh.sum(0)}


def train(x: np.ndarray, first: np.ndarray, y: np.ndarray, seed: int = 3) -> Model:
    """Adam on the logistic loss of the documents' labels (0..1)."""
    rng = np.random.default_rng(seed)
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    w = {"W": draw(WIDTH, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATES), "U": draw(HIDDEN, GATES), "a": draw(GATES), "c": draw(HIDDEN), "d": np.zeros(1, np.float32)}
    model = Model(x.mean(0) if len(x) else np.zeros(WIDTH, np.float32), np.maximum(x.std(0), 0.02) if len(x) else np.ones(WIDTH, np.float32), w)
    if not len(y) or y.min() == y.max():
        model.w["c"][:] = 0
        model.w["d"][:] = 0 if not len(y) else np.log((y.mean() * len(y) + 0.5) / ((1 - y.mean()) * len(y) + 0.5))
        return model
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    step, n = 0, np.diff(first)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        rate = RATE * (1 - epoch / EPOCHS) + 1e-4
        for k in range(0, len(y), BATCH):
            own = order[k : k + BATCH]
            at = np.concatenate([np.arange(first[i], first[i + 1]) for i in own])
            grads = model.gradients(x[at], np.concatenate([[0], np.cumsum(n[own])]), y[own])
            step += 1
            for name, grad in grads.items():
                grad = grad + DECAY * w[name]
                m[name] = 0.9 * m[name] + 0.1 * grad
                v[name] = 0.999 * v[name] + 0.001 * grad * grad
                w[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learn from documents (doc_id, text) that have labels (doc_id, quality); null labels don't count, several are averaged.

    The sample is the first documents by a hash of their id, of equal ids by one of the text: at most `sample` of them, and no more when their
    texts pass `sample_bytes`; one always counts. Equal rows are one. What the driver gets is bounded by both.
    """
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(sample))  # at most `sample` rows
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", F.xxhash64("text").alias("mark")).agg(F.first("text").alias("text"), F.max("y").alias("y"))
    rows = materialise(rows)
    first = rows.select("doc_id", "mark", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "mark").limit(sample).toArrow()
    n = max(1, int((np.cumsum(first["size"].to_numpy()) <= sample_bytes).sum()))
    wanted = docs.sparkSession.sparkContext.broadcast(set(zip(first["doc_id"].to_pylist()[:n], first["mark"].to_pylist()[:n], strict=True)))

    def encode(batch):
        own = [x in wanted.value for x in zip(batch["doc_id"].to_pylist(), batch["mark"].to_pylist(), strict=True)]
        for part in parts(batch.filter(pa.array(own)), limit=1 << 18):
            x, first = passages(*flat(part["text"]))
            x = x.astype(np.float16)
            yield {"doc_id": part["doc_id"], "mark": part["mark"], "y": part["y"], "n": np.diff(first), "x": [x[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]}

    got = map_arrow(rows.select("doc_id", "mark", "text", "y"), encode, "doc_id long, mark long, y double, n int, x binary").orderBy("doc_id", "mark").toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float16).reshape(-1, WIDTH).astype(np.float32)
    return train(x, np.concatenate([[0], np.cumsum(got["n"].to_numpy())]).astype(np.int64), got["y"].to_numpy().astype(np.float32))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), accept: float = ACCEPT) -> DataFrame:
    """The columns in `keep` and score, predicted (1 if score >= accept, else 0) for rows with a text.

    Every passage of a text counts. A null or empty text is one empty passage and has its score too. Each row stands alone: repeated
    rows and equal texts get equal scores, no rows give none; columns that aren't named in `keep` are ignored. Without labels, or with
    one kind of label only, all documents get one score.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep)
    columns = ["text", *[c for c in keep if c != "text"]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def run(batch):
        for part in parts(batch):
            data, offsets = flat(part["text"])
            p = np.zeros(len(offsets) - 1)
            for a, b in chunks(offsets, 1 << 18):
                p[a:b] = sent.value.forward(*passages(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
            yield {c: part[c] for c in keep} | {"score": p, "predicted": (p >= accept).astype(np.int32)}

    return map_arrow(docs.select(*columns), run, f"{schema}, score double, predicted int")


def accepted(docs: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """The rows of docs, with their columns, whose text scores `accept` or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in parts(batch):
                data, offsets = flat(part["text"])
                keep = np.zeros(len(offsets) - 1, bool)
                for a, b in chunks(offsets, 1 << 18):
                    keep[a:b] = sent.value.forward(*passages(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) >= accept
                yield part.filter(pa.array(keep))

    return map_batches(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(fold("doc_id", 5) != 0))
    return score(docs, model).withColumn("held_out", fold("doc_id", 5) == 0).select("doc_id", "held_out", "score", "predicted")
