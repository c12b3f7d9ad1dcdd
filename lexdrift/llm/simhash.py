"""SimHash near-duplicates: fingerprints of word shingles, compared exactly, tile by tile.

A fingerprint has 64 bits; bit k is 1 where it is set in over half of the hashes of the text's shingles, repeats included. Two documents link
where their fingerprints differ in few bits. Each distinct fingerprint is compared once, whatever the number of its documents.

Fingerprints are packed into tiles by the population counts of their BLOCKS parts. Parts that differ in d bits have counts that differ by d at
most, so of tiles whose counts differ beyond the radius, all parts together, no two fingerprints link, and the pair of tiles is skipped; all other
pairs are compared by exclusive-or and bit counts in numpy. What a task finds is reduced to a spanning forest before it is sent, so that a
group in which all are alike doesn't send its pairs.

Nulls: a null text is an empty one; without words the fingerprint is zero and links like any other. A null doc_id is never the smallest of its
component, and a component of null ids only has a null component_id. Repeated rows come back as often as they are there. No rows give no rows.
Long texts are gone through in windows of WINDOW bytes, cut at white space. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, materialise, table
from .components import components

#: Fixed by the contract: words of a shingle, seed of its hash, bits that linked fingerprints may differ in.
WORDS, SEED, RADIUS = 4, 42, 4
#: Parts of a fingerprint whose population counts make the tiles: about a tenth of all pairs are left with 4. With 8 it is a hundredth, at eleven
#: times the copies of each tile, which pays off from some 10^8 different fingerprints on. Any power of two gives the same links.
BLOCKS = 4
#: Fingerprints of a tile at most, on average of its salts, and pairs that are compared at once.
TILE, AT_ONCE = 2048, 1 << 20
WINDOW = 1 << 20
_SPACE = re.compile(rb"[\x09-\x0D\x20]")
#: Base of the digits of a cell: counts and their differences are below it, so that no sum of two cells carries.
_DIGIT = 128


def _word_runs(text: bytes):
    """Lists of the lower-case words of a text, a window at a time."""
    at = 0
    while at < len(text):
        end = at + WINDOW
        cut = _SPACE.search(text, end) if end < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end].lower().split()
        at = end


def _shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of `size` words, joined by spaces."""
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(length + 1) - 1
    starts, ends = (ends - length)[: len(words) - size + 1], ends[size - 1 :]
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """In how many of the hashes each bit is set, the lowest first."""
    out = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 14):
        bits = np.unpackbits(h[a : a + (1 << 14)].view(np.uint8), bitorder="little").reshape(-1, 64)
        out += bits.sum(0, dtype=np.int32)
    return out


def fingerprint(text: bytes, size: int = WORDS) -> int:
    """The fingerprint of a text; with fewer words than a shingle has, of their whole sequence; 0 without words."""
    counts, n, tail = np.zeros(64, np.int64), 0, []
    for words in _word_runs(text):
        words = tail + words
        if len(words) >= size:
            h = _shingle_hashes(words, size)
            counts, n = counts + _bit_counts(h), n + len(h)
            words = words[-(size - 1) :] if size > 1 else []
        tail = words
    if not n and tail:
        counts, n = _bit_counts(_shingle_hashes(tail, len(tail))), 1
    return sum(1 << k for k in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of rows (doc_id, text); fp holds the 64 bits as a signed number."""

    def run(batch):
        fps = [fingerprint(t or b"") for t in (x.as_py() for x in batch["text"].cast(pa.large_binary()))]
        yield {"doc_id": batch["doc_id"], "fp": np.array(fps, np.uint64).view(np.int64)}

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, fp long")


def _cell(fp: Column, blocks: int) -> Column:
    """The population counts of the parts of a fingerprint as digits of a number."""
    width = 64 // blocks
    counts = [F.bit_count(F.shiftrightunsigned(fp, k * width).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))) for k in range(blocks)]
    out = counts[0].cast("long")
    for k, c in enumerate(counts[1:], 1):
        out = out + c.cast("long") * _DIGIT**k
    return out


def _steps(blocks: int, radius: int) -> list[int]:
    """To what other cells links may lead: differences of population counts that sum up to the radius at most, of opposite ones only the greater."""
    found = [(0, radius)]
    for k in range(blocks):
        found = [(at + d * _DIGIT**k, left - abs(d)) for at, left in found for d in range(-left, left + 1)]
    return sorted(at for at, _ in found if at >= 0)


def tiles(fps: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(cell, salt, fps): the fingerprints (fp), packed; a cell with many is several tiles, by hash."""
    rows = fps.select("fp", _cell(F.col("fp"), blocks).alias("cell"))
    n = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("salts"))
    rows = rows.join(n, "cell").select("cell", F.pmod(F.xxhash64("fp"), F.col("salts")).alias("salt"), "fp")
    return rows.groupBy("cell", "salt").agg(F.collect_list("fp").alias("fps"))


class _Forest:
    """Components of what a task has linked so far."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.above.get(x, x)) != x:
            self.above[x] = x = self.above.get(up, up)
        return x

    def joins(self, a: int, b: int) -> bool:
        """Whether a and b weren't connected before; they are from now on."""
        a, b = self.root(a), self.root(b)
        if a != b:
            self.above[max(a, b)] = min(a, b)
        return a != b


def compared(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> list[tuple[int, int]]:
    """Links (positions in a, then b) between two tiles, or within one, enough to connect all that are connected: fewer than both have."""
    label = np.arange(len(a)) if same else np.arange(len(a) + len(b))
    shift = 0 if same else len(a)
    out: list[tuple[int, int]] = []
    step = max(1, AT_ONCE // max(1, len(b)))
    for i in range(0, len(a), step):
        near = np.bitwise_count(a[i : i + step, None] ^ b[None]) <= radius
        x, y = np.nonzero(near)
        x, y = x + i, y + shift
        some = label[x] != label[y]
        x, y = x[some], y[some]
        for r in np.unique(x).tolist():
            others = np.unique(label[y[x == r]])
            others = others[others != label[r]]
            for o in others.tolist():
                out.append((r, o))
                label[label == o] = label[r]
    return out


def near(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp), enough to connect all that are connected."""
    packed = materialise(tiles(fps, blocks))
    steps = F.array(*[F.lit(s) for s in _steps(blocks, radius)])
    left = packed.select("fps", "salt", F.explode(F.transform(steps, lambda s: F.struct(s.alias("step"), (F.col("cell") + s).alias("to")))).alias("x"))
    left = left.select(F.col("fps").alias("a"), F.col("salt").alias("salt_a"), "x.step", F.col("x.to").alias("cell"))
    pairs = left.join(packed.withColumnRenamed("fps", "b"), "cell").where((F.col("step") > 0) | (F.col("salt_a") <= F.col("salt")))
    pairs = pairs.select("a", "b", ((F.col("step") == 0) & (F.col("salt_a") == F.col("salt"))).alias("same"))

    def run(batches):
        forest = _Forest()
        for batch in batches:
            found: list[tuple[int, int]] = []
            sides = []
            for name in ("a", "b"):
                col = batch[name]
                sides.append((col.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False))])))
            (av, ao), (bv, bo) = sides
            for k, same in enumerate(batch["same"].to_pylist()):
                x, y = av[ao[k] : ao[k + 1]], bv[bo[k] : bo[k + 1]]
                both = x if same else np.concatenate([x, y])
                for i, j in compared(x.view(np.uint64), y.view(np.uint64), radius, same):
                    p, q = int(both[i]), int(both[j])
                    if forest.joins(p, q):
                        found.append((p, q))
            yield pa.RecordBatch.from_arrays([pa.array([e[s] for e in found], pa.int64()) for s in (0, 1)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def join(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for rows (doc_id, text): the smallest doc_id that links lead to."""
    rows = materialise(fingerprints(docs))
    own = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near(own, radius, blocks)).withColumnsRenamed({"node": "fp", "root": "root"})
    grouped = own.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = grouped.join(least, "root").select("fp", "component_id")
    return rows.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))
