"""Document fingerprints by content-defined chunking.

A gear hash runs over the UTF-8 bytes; a chunk ends where its bits under a mask are zero. Up to the normal length the mask is harder to
meet, beyond it easier (normalised chunking), so lengths stay near the normal one, and an edit moves only the boundaries around it. A
fingerprint is the set of chunk digests with their lengths; the containment of one text in another is the share of its length whose
digests the other has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import chunks, map_batches, parts, table

#: Bytes of a chunk: least, normal, most.
LEAST, NORMAL, MOST = 24, 64, 256
#: Bits that must be zero before and after the normal length; the second are among the first.
HARD, EASY = 7, 5
WINDOW = 32

_rng = np.random.default_rng(5)
GEAR = _rng.integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash h = 2 h + GEAR[byte] at each byte, of the WINDOW bytes that still count in 32 bits, by doubling."""
    h = GEAR[data]
    for k in range(5):
        step = 1 << k
        if len(h) > step:
            new = h.copy()
            new[step:] += h[:-step] << np.uint32(step)
            h = new
    return h


def boundaries(texts: list[bytes]) -> Iterator[list[int]]:
    """The ends of each text's chunks. A text's hash starts anew: what stands before it doesn't count."""
    data = np.frombuffer((b"\x00" * WINDOW).join([b"", *texts]), np.uint8)
    starts = np.cumsum([WINDOW] + [len(t) + WINDOW for t in texts])
    h = gear(data)
    top = h >> np.uint32(32 - HARD)
    # the window of the first bytes reaches into the zeros between texts, which are the same before each text
    easy = np.flatnonzero(top & np.uint32((1 << EASY) - 1) == 0)
    hard = (top[easy] == 0).tolist()
    lo = np.searchsorted(easy, starts)
    easy = easy.tolist()
    for k, text in enumerate(texts):
        s, n = int(starts[k]), len(text)
        i, stop = int(lo[k]), int(lo[k + 1])
        out, at = [], 0
        while n - at > LEAST:
            base = s + at
            a, b, c = base + LEAST - 1, base + NORMAL - 1, min(base + MOST, s + n) - 1
            while i < stop and easy[i] < a:
                i += 1
            while i < stop and easy[i] < b and not hard[i]:
                i += 1
            cut = easy[i] if i < stop and easy[i] <= c else c
            at = cut + 1 - s
            out.append(at)
        if at < n:
            out.append(n)
        yield out


Print = dict[int, int]


def fingerprints(texts: list[bytes]) -> list[Print]:
    """digest -> length, of each text's distinct chunks."""
    digest = xxhash.xxh3_64_intdigest
    out = []
    for text, ends in zip(texts, boundaries(texts), strict=True):
        a, own = 0, {}
        for b in ends:
            own[digest(text[a:b])] = b - a
            a = b
        out.append(own)
    return out


def as_text(own: Print) -> str:
    """`digest:length` in hex, by digest."""
    return ",".join(["%016x:%x" % x for x in sorted(own.items())])


def from_text(s: str) -> Print:
    return {int(a, 16): int(b, 16) for a, _, b in (x.partition(":") for x in s.split(",") if x)}


def containment(a: Print, b: Print) -> float:
    """The share of a's length that b has too. An empty text is contained in an empty one only."""
    if not a:
        return 0.0 if b else 1.0
    return sum([n for d, n in a.items() if d in b]) / sum(a.values())


def edited(text: str, following: str) -> str:
    """The last half of the text, rounded down, replaced by the first as many characters of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(docs: DataFrame) -> DataFrame:
    """Rows (bucket, ghost, doc_id, text), each bucket a range of ids and, as a ghost, the first document of the range below it.

    The documents after each other in descending order thus meet in one task, with one shuffle of the texts. The bounds of the ranges
    are quantiles of the ids, as many as shuffle partitions; the driver gets one id of each range.
    """
    spark = docs.sparkSession
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    low = -(1 << 63)
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(low)).alias("key"))
    ids = docs.select(F.coalesce("doc_id", F.lit(low)).alias("key"))
    cuts = sorted(set(map(int, ids.approxQuantile("key", [k / n for k in range(1, n)], 0.2 / n))))
    bits = max(1, len(cuts).bit_length())
    padded = cuts + [(1 << 63) - 1] * ((1 << bits) - 1 - len(cuts))
    # binary search: how many bounds are at or below the key
    bounds = F.array(*[F.lit(c).cast("long") for c in padded])

    def bucket(key):
        return F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(bits))]), F.lit(0), lambda at, step: at + F.when(F.element_at(bounds, at + step) <= key, step).otherwise(0))

    tops = sorted((r[0], r[1]) for r in ids.select("key", bucket(F.col("key")).alias("bucket")).groupBy("bucket").agg(F.max("key")).collect())
    # the document after the least of a range is the greatest of the next range below; after the least of all comes the greatest of all
    donors = [(tops[k - 1][1], tops[k][0]) for k in range(len(tops))]
    if not donors:
        return keyed.select(F.lit(0).alias("bucket"), F.lit(False).alias("ghost"), "doc_id", "text", "key")
    extra = F.broadcast(spark.createDataFrame(donors, "donor long, to int"))
    rows = keyed.join(extra, F.col("key") == F.col("donor"), "left").withColumn("own", bucket(F.col("key")))
    rows = rows.withColumn("x", F.explode(F.when(F.col("to").isNull(), F.array(F.struct(F.col("own").alias("bucket"), F.lit(False).alias("ghost")))).otherwise(F.array(F.struct(F.col("own").alias("bucket"), F.lit(False).alias("ghost")), F.struct(F.col("to").alias("bucket"), F.lit(True).alias("ghost"))))))
    # each range is a partition of its own, where a hash of their numbers would leave some partitions empty and give others several
    return rows.select("x.bucket", "x.ghost", "doc_id", "text", "key").repartitionById(len(tops) and max(r[0] for r in tops) + 1, "bucket")


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text (doc_id, text) and of its edited text, and their likeness.

    The next document is the one with the next smaller doc_id (null last; equal ids by text, null first); after the last comes the first,
    so a single document follows itself. A null text is empty, and empty texts have the empty fingerprint. Repeated rows are documents of
    their own. Other columns are ignored. Likeness is containment(): 1 for equal texts.
    """
    shape = to_arrow_schema(StructType.fromDDL(COLUMNS))

    def rows(batches):
        for batch in batches:
            for part in parts(batch):
                yield from zip(part["bucket"].to_pylist(), part["ghost"].to_pylist(), part["doc_id"].to_pylist(), [t or "" for t in part["text"].to_pylist()], strict=True)

    def run(batches):
        waiting: list[tuple] = []  # (doc_id, text, next text)
        size, before = 0, None
        for bucket, ghost, i, text in rows(batches):
            if before is not None and before[0] == bucket and not before[1]:
                waiting.append((before[2], before[3], text))
                size += len(before[3])
                if size > 1 << 19:
                    yield result(waiting)
                    waiting, size = [], 0
            before = (bucket, ghost, i, text)
        if waiting:
            yield result(waiting)

    def result(pairs: list[tuple]) -> pa.RecordBatch:
        changed = [edited(t, u).encode() for _, t, u in pairs]
        # a text is mostly the next of the one before it
        texts: dict[str, int] = {}
        for _, t, u in pairs:
            texts.setdefault(t, len(texts))
            texts.setdefault(u, len(texts))
        raw = [t.encode() for t in texts]
        prints = _prints(raw)
        new = _prints(changed)
        a, b = [prints[texts[t]] for _, t, _ in pairs], [prints[texts[u]] for _, _, u in pairs]
        columns = [
            [i for i, _, _ in pairs],
            [len(t) for _, t, _ in pairs],
            [hashlib.sha256(c).hexdigest() for c in changed],
            list(map(as_text, a)),
            list(map(as_text, new)),
            list(map(containment, a, new)),
            list(map(containment, a, b)),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

    ordered = _pairs(docs).sortWithinPartitions("bucket", "ghost", F.col("key").desc(), F.col("text").asc_nulls_first())
    return map_batches(ordered.select("bucket", "ghost", "doc_id", "text"), run, COLUMNS)


def _prints(texts: list[bytes]) -> list[Print]:
    out: list[Print] = []
    for a, b in chunks(np.cumsum([0] + [len(t) for t in texts]), 1 << 18):
        out += fingerprints(texts[a:b])
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(table(spark, sf_dir, "documents"))
