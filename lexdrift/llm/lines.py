"""Fuzzy line deduplication by MinHash.

Lines (without regard to ASCII case) are sets of character shingles. MinHash signatures are banded for high recall; lines that share a
band are candidates, which the exact Jaccard similarity of their sets confirms; a distributed union-find makes components of them, and of
each component the first line stays, by doc_id and position.

Lines with an equal band are a group, and every pair of a group is linked, connected by others, or excluded by exact comparison. Groups of
the same lines, from several bands, are one. A group of up to BLOCK lines is compared at once. A larger one is first compared with PIVOTS of
its lines, which settles groups of near copies; the lines that this leaves apart are compared with all others of the group in blocks of
BLOCK lines, each pair of blocks on its own. The cost of a group that no pivot settles, as where many lines share a template and are just
too different to link, is quadratic in its lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, bitmap_slots, distinct, map_arrow, materialise, mix64, packed, parts, quoted, table, unpacked
from .components import components, union
from .shingles import links_within

#: Characters of a shingle; lines link when 100 * intersection >= PERCENT * union of their shingle sets.
SHINGLE, PERCENT = 8, 75
#: A pair at the threshold shares a band with probability 1 - (1 - 0.75 ** ROWS) ** BANDS = 0.998.
BANDS, ROWS = 16, 4
BUCKET_BYTES = 24 << 20
#: Keys of lines that a task remembers to have banded.
SEEN = 200_000
#: Lines of a group that are compared with all others at once; pivots of a larger group.
BLOCK, PIVOTS = 256, 1

_rng = np.random.default_rng(9)
_FACTORS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_SALTS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_CHARS = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def line_key(line: bytes) -> int:
    """64-bit key of a line that is in lower case, as a signed number."""
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def split(text: bytes) -> list[bytes]:
    """The lines, ASCII letters in lower case."""
    return text.lower().split(b"\n")


def shingles(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each line's character shingles, one after the other, and the first of each; a shorter line is one shingle."""
    texts = [x.decode() for x in lines]
    sizes = np.array([len(x) for x in texts])
    short = sizes < SHINGLE
    if short.any():
        texts = [x.ljust(SHINGLE, "\x00") if s else x for x, s in zip(texts, short.tolist(), strict=True)]
    n = np.maximum(sizes, SHINGLE)
    data = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.zeros(len(data) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        word += data[k : len(data) - SHINGLE + 1 + k] * _CHARS[k]
    starts = np.concatenate([[0], np.cumsum(n)])
    per = n - SHINGLE + 1
    first = np.concatenate([[0], np.cumsum(per)])
    at = np.arange(first[-1]) + np.repeat(starts[:-1] - first[:-1], per)
    return mix64(word[at]), first


def signatures(lines: list[bytes]) -> np.ndarray:
    """(lines, BANDS) hashes of the bands of each line's MinHash signature."""
    h, first = shingles(lines)
    h = (h >> np.uint64(32)).astype(np.uint32)
    x = np.empty_like(h)
    out = np.zeros((len(lines), BANDS), np.uint64)
    for b in range(BANDS):
        for r in range(ROWS):
            k = b * ROWS + r
            # h is mixed already, so that a multiplication makes another order of it
            np.multiply(np.bitwise_xor(h, _SALTS[k], out=x), _FACTORS[k], out=x)
            out[:, b] = mix64(out[:, b] + np.minimum.reduceat(x, first[:-1]).astype(np.uint64) + np.uint64(k))
    return out


def occurrences(docs: DataFrame) -> DataFrame:
    """(key, doc_id, at) of every line that isn't blank."""

    def run(batch):
        for part in parts(batch):
            keys, ids, at = [], [], []
            for i, text in zip(part["doc_id"].to_pylist(), part["text"].cast(pa.binary()).to_pylist(), strict=True):
                for k, line in enumerate(split(text or b"")):
                    if line and not line.isspace():
                        keys.append(line_key(line))
                        ids.append(i)
                        at.append(k)
            yield {"key": keys, "doc_id": ids, "at": at}

    return map_arrow(docs.select("doc_id", "text"), run, "key long, doc_id long, at int")


def bands(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, payload) with the band hash (32 bits within a bucket) and key of each line, once for each task that has it, or a few times."""

    seen: set[int] = set()  # of a task, as each has its own copy

    def run(batch):
        for part in parts(batch, limit=1 << 18):
            if len(seen) > SEEN:
                seen.clear()
            lines, keys = [], []
            for text in part["text"].cast(pa.binary()).to_pylist():
                for line in split(text or b""):
                    if line and not line.isspace() and (k := line_key(line)) not in seen:
                        seen.add(k)
                        keys.append(k)
                        lines.append(line)
            if not lines:
                continue
            sig = signatures(lines)
            band = mix64(sig + np.arange(BANDS, dtype=np.uint64)).ravel()
            own = np.repeat(np.array(keys, np.int64), BANDS)
            b = ((band >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            b, h, own = b[order], band.astype(np.uint32)[order], own[order]
            ids, at = np.unique(b, return_index=True)
            at = np.append(at, len(b))
            yield {"bucket": ids, "payload": [h[i:j].tobytes() + own[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]}

    return map_arrow(docs.select("text"), run, "bucket long, payload binary")


def groups(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(met, key, pivot, large) of the lines that share a band with others: met is a key of the group's lines, by which equal groups are one.

    A line of a large group is given once with each of the group's pivots; other lines have pivot 0.
    """
    h, key = [], []
    for p in payloads:
        n = len(p) // 12
        h.append(np.frombuffer(p, np.uint32, n))
        key.append(np.frombuffer(p, np.int64, n, 4 * n))
    h, key = np.concatenate(h), np.concatenate(key)
    order = np.lexsort((key, h))
    h, key = h[order], key[order]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (key[1:] != key[:-1])])
    h, key = h[fresh], key[fresh]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    starts, own = np.flatnonzero(new), np.cumsum(new) - 1
    sizes = np.diff(np.append(starts, len(key)))
    met = mix64(np.add.reduceat(mix64(key.view(np.uint64)), starts) + sizes.astype(np.uint64)).view(np.int64)
    at = np.flatnonzero((sizes[own] > 1) & (sizes[own] <= BLOCK))
    out = [(met[own[at]], key[at], np.zeros(len(at), np.int64), np.zeros(len(at), bool))]
    at = np.flatnonzero(sizes[own] > BLOCK)
    for k in range(PIVOTS):
        pivot = key[starts[own[at]] + sizes[own[at]] * k // PIVOTS]
        out.append((met[own[at]], key[at], pivot, np.ones(len(at), bool)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def alike(a: list[bytes], b: list[bytes], percent: int = PERCENT) -> np.ndarray:
    """Whether each pair's sets of shingles are similar enough, exactly (64-bit hashes stand for shingles)."""
    n = len(a)
    out = np.zeros(n, bool)
    x, fx = shingles(a)
    y, fy = shingles(b)
    for k in range(n):
        p, q = distinct(x[fx[k] : fx[k + 1]]), distinct(y[fy[k] : fy[k + 1]])
        if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
            continue
        inter = len(np.intersect1d(p, q, assume_unique=True))
        out[k] = 100 * inter >= percent * (len(p) + len(q) - inter)
    return out


def _texts(docs: DataFrame, bits) -> DataFrame:
    """(key, doc_id, at, line) of lines whose key may be wanted."""

    def run(batch):
        for part in parts(batch):
            keys, ids, at, lines = [], [], [], []
            for i, text in zip(part["doc_id"].to_pylist(), part["text"].cast(pa.binary()).to_pylist(), strict=True):
                for k, line in enumerate(split(text or b"")):
                    if line and not line.isspace():
                        keys.append(line_key(line))
                        ids.append(i)
                        at.append(k)
                        lines.append(line)
            own = np.array(keys, np.int64)
            slot = bitmap_slots(own)
            hit = np.flatnonzero((bits.value[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)).tolist()
            yield {"key": own[hit], "doc_id": [ids[k] for k in hit], "at": [at[k] for k in hit], "line": [lines[k] for k in hit]}

    return map_arrow(docs.select("doc_id", "text"), run, "key long, doc_id long, at int, line binary")


def confirmed(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of keys those whose lines are alike."""
    both = pairs.join(lines.select(F.col("key").alias("a"), F.col("line").alias("x")), "a").join(lines.select(F.col("key").alias("b"), F.col("line").alias("y")), "b")

    def verify(batch):
        for part in parts(batch, "x", limit=1 << 19):
            ok = alike(part["x"].to_pylist(), part["y"].to_pylist(), percent)
            yield {"a": part["a"].filter(pa.array(ok)), "b": part["b"].filter(pa.array(ok))}

    return map_arrow(both.select("a", "b", "x", "y"), verify, "a long, b long")


def blocks(met: np.ndarray, key: np.ndarray, pivot: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, side, key): of each large group the lines that its pivots leave apart from most others (side 1) against all (side 2), by blocks.

    Rows are a group's lines with each of its pivots, and whether they link.
    """
    out = [(np.zeros(0, np.int64),) * 3]
    order = np.lexsort((key, met))
    met, key, pivot, hit = met[order], key[order], pivot[order], hit[order]
    cuts = np.flatnonzero(np.concatenate([[True], met[1:] != met[:-1], [True]]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        names, own = np.unique(key[a:b], return_inverse=True)
        at = hit[a:b]
        root = union(len(names), own[at].tolist(), np.searchsorted(names, pivot[a:b][at]).tolist())
        apart = names[root != np.bincount(root).argmax()]
        for i in range(0, len(apart), BLOCK):
            for j in range(0, len(names), BLOCK):
                cell = xxhash.xxh3_64_intdigest(b"%d %d %d" % (met[a], i, j)) - (1 << 63)
                for side, some in ((1, apart[i : i + BLOCK]), (2, names[j : j + BLOCK])):
                    out.append((np.full(len(some), cell), np.full(len(some), side), some))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def compared(cells: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """Links (a, b), enough to connect all that are connected, within the cells of rows (cell, side, key): all pairs, or side 1 against 2."""
    spark = lines.sparkSession
    rows = cells.join(lines, "key")
    total = rows.agg(F.sum(F.octet_length("line"))).first()[0] or 0
    bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (BUCKET_BYTES // 3) + 1)

    def meet(t: pa.Table) -> pa.Table:
        t = t.sort_by([("cell", "ascending"), ("key", "ascending")])
        cell, side, key = (t[c].to_numpy() for c in ("cell", "side", "key"))
        line = t["line"].to_pylist()
        cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
        cuts = cuts[:-1][np.diff(cuts) > 1].tolist(), cuts[1:][np.diff(cuts) > 1].tolist()
        a, b = [], []
        held: list[np.ndarray] = []  # sets of the lines from `begin` on
        begin = 0
        for i, j in zip(*cuts, strict=True):
            if j > begin + len(held):
                begin, size, k = i, 0, i
                while k < j or (k < len(line) and size < 1 << 18):
                    size += len(line[k])
                    k += 1
                h, first = shingles(line[i:k])
                held = [distinct(h[x:y]) for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            x, y = links_within(held[i - begin : j - begin], percent, side[i:j])
            a.append(key[i:j][x])
            b.append(key[i:j][y])
        return pa.table({"a": np.concatenate([*a, np.zeros(0, np.int64)]), "b": np.concatenate([*b, np.zeros(0, np.int64)])})

    rows = rows.withColumn("bin", F.pmod(F.xxhash64("cell"), F.lit(bins))).select("bin", "cell", "side", "key", "line")
    return rows.groupBy("bin").applyInArrow(meet, "a long, b long")


def clusters(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(key, doc_id, at, kept_doc, kept_at) of the lines that aren't the first of their component."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    seen = materialise(occurrences(docs))
    reps = seen.groupBy("key").agg(F.min(F.struct("doc_id", "at")).alias("first"))
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(shuffles, seen.count() * BANDS * 12 // BUCKET_BYTES + 1)

    def meet(t: pa.Table) -> pa.Table:
        met, key, pivot, large = groups(t["payload"].to_pylist())
        return pa.table({"met": met, "key": key, "pivot": pivot, "large": large})

    met = materialise(bands(docs, buckets).groupBy("bucket").applyInArrow(meet, "met long, key long, pivot long, large boolean").distinct())
    nodes = met.select("key").distinct()
    bits = spark.sparkContext.broadcast(bitmap(nodes, "key"))
    wanted = nodes.join(reps, "key").select(F.col("key").alias("k"), "first")
    found = _texts(docs, bits)
    lines = found.join(wanted, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("at") == F.col("first.at")))
    lines = materialise(lines.groupBy("key").agg(F.first("line").alias("line")))
    cells = met.where(~F.col("large")).select(F.col("met").alias("cell"), F.lit(0).alias("side"), "key")
    star = met.where("large")
    links = None
    if not star.isEmpty():
        pairs = star.select(F.col("pivot").alias("a"), F.col("key").alias("b")).where("a <> b").distinct()
        links = materialise(confirmed(pairs, lines, percent))
        hits = links.select(F.col("a").alias("pivot"), F.col("b").alias("key"), F.lit(True).alias("hit"))
        marked = star.join(hits, ["pivot", "key"], "left").select(F.pmod(F.xxhash64("met"), F.lit(buckets)).alias("bin"), "met", "key", "pivot", F.coalesce("hit", F.lit(False)).alias("hit"))

        def deal(t: pa.Table) -> pa.Table:
            cell, side, key = blocks(*(t[c].to_numpy(zero_copy_only=False) if c == "hit" else t[c].to_numpy() for c in ("met", "key", "pivot", "hit")))
            return pa.table({"cell": cell, "side": side.astype(np.int32), "key": key})

        cells = cells.unionByName(marked.groupBy("bin").applyInArrow(deal, "cell long, side int, key long"))
    tried = materialise(compared(materialise(cells), lines, percent))
    roots = components(tried if links is None else tried.unionByName(links))
    rooted = seen.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("cluster", F.coalesce("root", "key"))
    rooted = materialise(rooted.select("key", "doc_id", "at", "cluster"))
    firsts = rooted.groupBy("cluster").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1").select("cluster", "first")
    firsts = materialise(firsts)  # a table of its own, so that a hot cluster's rows can be split among tasks in the join
    other = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("at") == F.col("first.at")))
    return rooted.join(firsts, "cluster").where(other).select("key", "doc_id", "at", F.col("first.doc_id").alias("kept_doc"), F.col("first.at").alias("kept_at"))


ADDED = ("n_lines", "n_kept", "kept_in")


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs with text replaced, and n_lines, n_kept, kept_in added.

    Of each component of alike lines the first stays, by doc_id (null first) and position; the others go from their texts, whose other
    lines keep their order. Blank lines stay. kept_in lists the documents that hold the lines for which others went here. Rows with equal
    doc_id count as one document, so repeated rows keep the same lines. A null text stays null with 0 lines, an empty one is one blank
    line; no rows give none. Columns of docs with the added names are replaced; other columns may have any name.
    """
    gone = clusters(docs, percent).groupBy("doc_id").agg(F.sort_array(F.collect_set("at")).alias("gone"), F.sort_array(F.collect_set("kept_doc")).alias("kept_in"))
    names = [c for c in docs.columns if c not in ADDED]
    out = packed(docs.select(*quoted(names)), "doc_id", "text").join(gone.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id")), "left")

    def since(g: Column, k: Column) -> Column:
        """How many lines stay between a line that goes, the k-th of them, and the one that went before."""
        return g - F.when(k > 0, F.get("gone", k - 1)).otherwise(-1) - 1

    # whether each line goes, from the places of those that go, in linear time
    marks = F.flatten(F.transform("gone", lambda g, k: F.concat(F.array_repeat(F.lit(False), since(g, k)), F.array(F.lit(True)))))
    left = F.array_join(F.zip_with(F.split("text", "\n"), marks, lambda line, goes: F.when(~F.coalesce(goes, F.lit(False)), line)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)
    n = F.coalesce(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    out = out.select("rest", "doc_id", text.alias("text"), n.alias("n_lines"), (n - F.coalesce(F.size("gone"), F.lit(0))).alias("n_kept"), F.coalesce("kept_in", F.array().cast("array<bigint>")).alias("kept_in"))
    return unpacked(out, names, "doc_id", "text").select(*quoted([*names, *ADDED]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_kept", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text"), 256).alias("kept_sha256"), "kept_in")
