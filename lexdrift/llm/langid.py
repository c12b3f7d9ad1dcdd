"""Language identification by nearest centroid.

A text is the vector of its byte n-grams (lower-case, other than letters collapsed to a space), weighted by 1 + ln(tf) and idf and
normalised. Each language has several centroids, found by spherical k-means in a bounded sample of its labelled texts; n-grams and idf
come from all labelled texts. A text gets the language of the centroid with the highest cosine; one whose cosine is below what
nearly all of that centroid's own texts reach is marked as rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, flat, fold, map_arrow, map_batches, parts, table

UNKNOWN = "und"
#: Buckets of hashed n-grams, those kept (the ones in most labelled texts), centroids of a language, k-means rounds.
BUCKETS, KEPT, CENTROIDS, ROUNDS = 1 << 16, 4096, 4, 12
#: Labelled texts that the centroids are fitted on, over all languages, and of one language.
SAMPLE, PER_LANGUAGE = 4000, 600
#: Share of a centroid's own texts that lie beyond its rejection distance.
REJECTED = 0.005
CHUNK = 1 << 18

_KIND = np.zeros(256, np.uint8)  # what a byte counts as: lower-case letter, byte of a longer character, else space
_KIND[:] = 32
_KIND[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_KIND[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_KIND[128:] = np.arange(128, 256)


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each 2- and 3-gram of bytes in rows of UTF-8; a space stands before and after each row."""
    n = np.diff(offsets)
    rows = len(n)
    text = np.full(len(data) + 2 * rows, 32, np.uint8)
    row = np.repeat(np.arange(rows, dtype=np.int32), n + 2)
    text[np.arange(len(data)) + np.repeat(2 * np.arange(rows) + 1, n)] = _KIND[data]
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != 32) | (text[:-1] != 32) | (row[1:] != row[:-1])
    text, row = text[keep].astype(np.uint32), row[keep]
    two = (text[:-1] << 8 | text[1:]) * np.uint32(2654435761)
    three = (two[:-1] ^ text[2:] * np.uint32(0x9E3779B1)) * np.uint32(2246822519)
    same2, same3 = row[:-1] == row[1:], row[:-2] == row[2:]
    shift = np.uint32(32 - 16)
    return np.concatenate([row[:-1][same2], row[:-2][same3]]), np.concatenate([two[same2] >> shift, three[same3] >> shift])


def document_frequencies(batch_text: pa.Array) -> np.ndarray:
    out = np.zeros(BUCKETS, np.int64)
    data, offsets = flat(batch_text)

    for a, b in chunks(offsets, CHUNK):
        for c in range(a, b, 128):
            d = min(b, c + 128)
            row, bucket = ngrams(data[offsets[c] : offsets[d]], offsets[c : d + 1] - offsets[c])
            seen = np.zeros((d - c, BUCKETS), bool)
            seen[row, bucket] = True
            out += seen.sum(0)
    return out


@dataclass
class Model:
    languages: list[str]
    index: np.ndarray  # bucket -> kept feature, KEPT where none
    idf: np.ndarray
    centroids: np.ndarray  # (languages * CENTROIDS, KEPT), normalised; zero rows where a language has fewer
    of: np.ndarray  # language of each centroid
    floor: np.ndarray  # cosine below which a centroid rejects

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, bucket = ngrams(data, offsets)
        width = len(self.idf)
        return np.bincount(row * np.int64(width + 1) + self.index[bucket], minlength=(len(offsets) - 1) * (width + 1)).reshape(-1, width + 1)[:, :width]

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.zeros(counts.shape, np.float32)
        some = counts > 0
        v[some] = 1 + np.log(counts[some])
        v *= self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def predict(self, text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine of the nearest centroid, and whether it rejects, of each text."""

        data, offsets = flat(text)
        n = len(offsets) - 1
        best, score = np.zeros(n, np.int64), np.zeros(n)
        if len(self.centroids):
            for a, b in chunks(offsets, CHUNK):
                for c in range(a, b, 256):
                    d = min(b, c + 256)
                    cos = self.vectors(self.counts(data[offsets[c] : offsets[d]], offsets[c : d + 1] - offsets[c])) @ self.centroids.T
                    best[c:d] = cos.argmax(1)
                    score[c:d] = cos[np.arange(d - c), best[c:d]]
        lang = []
        ascii_letter = _has_letter(data, offsets)
        for k in range(n):
            letter = ascii_letter[k] or any(ch.isalpha() for ch in data[offsets[k] : offsets[k + 1]].tobytes().decode())
            lang.append(self.languages[self.of[best[k]]] if letter and len(self.centroids) else UNKNOWN)
        none = np.array([x == UNKNOWN for x in lang], bool)
        score = np.where(none, 0.0, np.clip(score, 0, 1))
        rejected = none | (score < self.floor[best]) if len(self.centroids) else np.ones(n, bool)
        return lang, score, rejected


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    letter = np.concatenate([[0], np.cumsum((_KIND[data] != 32) & (data < 128))])
    return letter[offsets[1:]] > letter[offsets[:-1]]


def kmeans(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Spherical k-means: normalised means of the rows nearest by cosine; starts are spread out."""
    rng = np.random.default_rng(seed)
    c = x[[int(rng.integers(len(x)))]]
    while len(c) < min(k, len(x)):
        c = np.vstack([c, x[(x @ c.T).max(1).argmin()]])
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].mean(0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def fit(labelled: DataFrame, sample: int = SAMPLE, per_language: int = PER_LANGUAGE, features: int = KEPT) -> Model:
    """Learn from rows (doc_id, text, lang); null texts or languages don't count. Centroids are fitted on at most `sample` texts.

    Of the hashed n-grams, the `features` that most labelled texts hold count. The driver holds the centroids, so a few rows for each language.
    """
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = dict(sorted((r[0], r[1]) for r in rows.groupBy("lang").count().collect()))
    languages = list(counts)
    if not languages:
        return Model([], np.zeros(BUCKETS, np.int64), np.zeros(0, np.float32), np.zeros((0, 0), np.float32), np.zeros(0, int), np.zeros(0))

    def seen(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in parts(batch):
                total += document_frequencies(part["text"])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    df = map_batches(rows.select("text"), seen, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(BUCKETS, np.int64)
    n[df["bucket"].to_numpy()] = df["n"].to_numpy()
    kept = np.sort(np.lexsort((np.arange(BUCKETS), -n))[:features])
    index = np.full(BUCKETS, len(kept), np.int64)
    index[kept] = np.arange(len(kept))
    idf = (np.log((1 + sum(counts.values())) / (1 + n[kept])) + 0.05).astype(np.float32)
    model = Model(languages, index, idf, np.zeros((0, len(kept)), np.float32), np.zeros(0, int), np.zeros(0))
    most = max(CENTROIDS, min(per_language, sample // len(languages)))
    u = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(1)), 11).cast("double") / float(1 << 53)
    shares = F.create_map(*[F.lit(x) for lang, m in counts.items() for x in (lang, min(1.0, most / m))])
    # thinned by hash to about `most` texts a language; texts become counts, of bounded size, where they are read. The limit makes the bound
    # exact, and equal ids are told apart by their texts
    keys = (F.xxhash64("doc_id", F.lit(2)).alias("draw"), "doc_id", F.xxhash64("text").alias("digest"))
    thinned = rows.where(u < F.element_at(shares, F.col("lang"))).select(*keys, "lang", "text")

    def vectors(batch):
        for part in parts(batch, limit=CHUNK):
            c = model.counts(*flat(part["text"]))
            at = [np.flatnonzero(x) for x in c]
            yield {**{k: part[k] for k in ("draw", "doc_id", "digest", "lang")}, "at": [x.astype(np.int32).tobytes() for x in at], "counts": [x[k].tobytes() for x, k in zip(c, at, strict=True)]}

    drawn = map_arrow(thinned, vectors, f"draw long, doc_id {dict(rows.dtypes)['doc_id']}, digest long, lang string, at binary, counts binary")
    got = drawn.orderBy("draw", "doc_id", "digest").limit(max(sample, most * len(languages))).select("lang", "at", "counts").toArrow()
    x = np.zeros((len(got), len(kept)), np.float32)
    for k, (at, c) in enumerate(zip(got["at"].to_pylist(), got["counts"].to_pylist(), strict=True)):
        row = np.zeros((1, len(kept)), np.int64)
        row[0, np.frombuffer(at, np.int32)] = np.frombuffer(c, np.int64)
        x[k] = model.vectors(row)[0]
    lang = np.array(got["lang"].to_pylist())
    centroids, of, floor = [], [], []
    for i, name in enumerate(languages):
        own = x[lang == name]
        own = own[np.linalg.norm(own, axis=1) > 0]
        if not len(own):
            continue
        c = kmeans(own, CENTROIDS)
        cos = own @ c.T
        near = cos.argmax(1)
        for j in range(len(c)):
            centroids.append(c[j])
            of.append(i)
            floor.append(float(np.quantile(cos[near == j, j], REJECTED)) if (near == j).any() else 0.0)
    model.centroids = np.array(centroids, np.float32).reshape(-1, len(kept))
    model.of, model.floor = np.array(of, int), np.array(floor)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected for rows (doc_id, text).

    lang_pred is the nearest learned language, `und` with score 0 where the text is null or has no letter, or nothing was learned. score
    is the cosine of the nearest centroid; `rejected` marks texts too far from it. Each row stands alone: repeated rows give repeated
    results, no rows none; other columns are ignored. Of equal cosines the first language by code point wins. Whole texts count.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        for part in parts(batch):
            lang, score, rejected = sent.value.predict(part["text"])
            yield {"doc_id": part["doc_id"], "lang_pred": lang, "score": score, "rejected": rejected}

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, rejected boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold("doc_id", 4) != 2))
    return identify(docs, model).withColumn("held_out", fold("doc_id", 4) == 2).select("doc_id", "held_out", "lang_pred", "score", "rejected")
