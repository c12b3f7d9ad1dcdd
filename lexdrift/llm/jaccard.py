"""Exact Jaccard join of documents by their word shingles, in a metric space.

Jaccard distance is a metric, in which nearly all documents are at distance 1 from each other: there the triangle inequality excludes nothing,
and Voronoi regions of document pivots would each hold all documents. So the space is first cut where it is empty, by the prefix bound of
Jaccard similarity: a document meets others in the lists of so many of its shingles, rarest first, as leave no linked document out.
Documents that meet are one region, and single documents go. Regions that are large are cut once more by what is rare among their own documents,
as among very many documents the sketch of frequencies doesn't tell a shingle of a few documents from one of a single document, and documents that
share no more than such a shingle meet.

Regions are joined by document pivots, recursively and exactly. With e the link distance, a document belongs to its nearest pivot (its Voronoi
region); within e it is linked to it, and pivots that link with the same document are one component. A document y outside p's component can
link with an x of p's region only if d(y, p) <= 2 e, and only if d(x, p) >= d(y, p) - e: the documents of that ring are replicated into the
component's cell, opposite the boundary of its regions. What links with no pivot is a region of its own, smaller by the pivots and all they link
with, and goes on to the next round. If more than half of a region goes on, pivots don't divide it, and its rows are compared by blocks, as are
the two sides of a cell. Regions of up to REGION_ROWS documents are joined by the same steps within a task.

A round deals each region over many tasks, so that a large group of near copies is no task's alone. Pairs that pivots neither link, connect nor
exclude are compared, at a cost that is quadratic in their number, but without rows for pairs: BLOCK_ROWS documents meet as many at a time.

Documents with equal sets are one class. 64-bit hashes stand for shingles and for classes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, bitmap_slots, chunks, flat, map_arrow, map_batches, materialise, mix64, packed, parts, quoted, small_batches, table, unpacked
from .components import components, union
from .shingles import WORDS, links_within, shared, shingle_sets

#: Two documents link when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Cells of the sketch of shingle frequencies that orders shingles (any order is right; rarest first is fast): 16 MB, whatever the input.
CELLS, BLOCK = 1 << 22, 1 << 12
#: Bytes of replicated shingles in a bucket.
BUCKET_BYTES = 24 << 20
#: Documents and shingles of a region that is joined within a task, and of a block of a larger one; documents that a task compares with pivots.
REGION_ROWS, REGION_ITEMS, BLOCK_ROWS, BLOCK_ITEMS, DEALT = 256, 1 << 18, 512, 1 << 19, 512
PIVOTS = 16
#: Rows of a region that is cut again before it is joined; up to that many, blocks make a few copies of a row at most.
DIVIDED = 4 * BLOCK_ROWS


def _sets(batch: pa.RecordBatch, words: int, limit: int = 1 << 20):
    for part in parts(batch, limit=limit):
        yield part, shingle_sets(*flat(part["text"]), words)


def class_key(own: np.ndarray) -> int:
    """64-bit key of a set, as a signed number."""
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def members(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, class, n) of every row; n 0 for no words."""

    def run(batch):
        for part, sets in _sets(batch, words):
            yield {"doc_id": part["doc_id"], "class": [class_key(s) for s in sets], "n": [len(s) for s in sets]}

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, class long, n long")


def _of_texts(words: int):
    """Reader of batches (text): sets, and their classes."""

    def read(batch: pa.RecordBatch, limit: int = 1 << 20):
        for _, sets in _sets(batch, words, limit):
            yield sets, [class_key(s) for s in sets]

    return read


def _of_regions(turn: int):
    """Reader of batches (region, class, own): sets whose items differ from region to region and from turn to turn, and their classes."""

    def read(batch: pa.RecordBatch, limit: int = 1 << 20):
        for part in parts(batch, "own", limit):
            salt = mix64(part["region"].to_numpy().view(np.uint64) + np.uint64(turn))
            yield [np.sort(mix64(np.frombuffer(x, np.uint64) ^ y)) for x, y in zip(part["own"].to_pylist(), salt, strict=True)], part["class"].to_pylist()

    return read


def _cell(s: np.ndarray, cells: int) -> np.ndarray:
    return (s >> np.uint64(65 - cells.bit_length())).astype(np.int64)


def frequencies(docs: DataFrame, read, cells: int = CELLS) -> np.ndarray:
    """How many (document, shingle) pairs fall into each cell, up to 2^32 - 1; cells: a power of two, BLOCK at least.

    Where cells hold many shingles each, a frequent one still stands out, by far more than the others of its cell vary.
    """

    def sent(x: np.ndarray) -> bytes:
        return x.astype(np.uint16 if x.max() < 1 << 16 else np.uint32).tobytes()

    def got(x: bytes) -> np.ndarray:
        return np.frombuffer(x, np.uint16 if len(x) == 2 * BLOCK else np.uint32)


    def run(batches):
        total, held, size = np.zeros(cells, np.int64), [], 0

        def settle():
            nonlocal held, size
            if held:
                total[:] += np.bincount(_cell(np.concatenate(held), cells), minlength=cells)
            held, size = [], 0

        for batch in batches:
            for sets, _ in read(batch):
                held += sets
                size += sum(map(len, sets))
                if size > 1 << 21:
                    settle()
        settle()
        out = np.minimum(total, (1 << 32) - 1).reshape(-1, BLOCK)
        task = TaskContext.get().partitionId() % 32
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array([task] * len(out), pa.int32()), pa.array([sent(x) for x in out], pa.binary())], names=["block", "salt", "cells"])

    def add(t: pa.Table) -> pa.Table:
        x = np.zeros(BLOCK, np.int64)
        for c in t["cells"].to_pylist():
            x += got(c)
        return pa.table({"block": t["block"].slice(0, 1), "salt": t["salt"].slice(0, 1), "cells": pa.array([sent(np.minimum(x, (1 << 32) - 1))], pa.binary())})

    schema = "block int, salt int, cells binary"
    some = map_batches(docs, run, schema).groupBy("block", "salt").applyInArrow(add, schema)
    blocks = some.groupBy("block").applyInArrow(add, schema).toArrow()
    out = np.zeros((cells // BLOCK, BLOCK), np.uint32)
    for b, c in zip(blocks["block"].to_pylist(), blocks["cells"].to_pylist(), strict=True):
        out[b] = got(c)
    return out.ravel()


def windows(n: int, percent: int = PERCENT) -> tuple[int, int]:
    """Of a set of n shingles in the common order, how many must be tried against sets of its size or more, and against smaller ones.

    A set of m >= n shingles shares at least a = percent (n + m) / (100 + percent) with it, so at least 2 percent n / (100 + percent): one of
    the first n - a + 1 is shared. A smaller set of m >= percent n / 100 shares at least percent n / 100.
    """
    return n - -(-2 * percent * n // (100 + percent)) + 1, n - -(-percent * n // 100) + 1


def replicas(docs: DataFrame, sent, buckets: int, read, percent: int) -> DataFrame:
    """(bucket, payload): for each shingle in a document's window its hash, the class, and the size, negative where only smaller sets count. sent: the broadcast cells."""

    def run(batch):
        cell = sent.value
        for sets, keys in read(batch, 4 << 20):
            sh, cl, size = [], [], []
            seen = set()
            for s, key in zip(sets, keys, strict=True):
                n = len(s)
                if not n or key in seen:
                    continue
                seen.add(key)
                small, large = windows(n, percent)
                order = np.argsort(cell[_cell(s, len(cell))], kind="stable")[:large]
                sh.append(s[order])
                cl.append(np.full(len(order), key, np.int64))
                size.append(np.where(np.arange(len(order)) < small, n, -n))
            if not sh:
                continue
            sh, cl, size = combine(np.concatenate(sh), np.concatenate(cl), np.concatenate(size))
            b = (sh % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            b, sh, cl, size = b[order], sh[order], cl[order], size[order].astype(np.int32)
            ids, at = np.unique(b, return_index=True)
            at = np.append(at, len(b))
            yield {"bucket": ids, "payload": [sh[i:j].tobytes() + cl[i:j].tobytes() + size[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]}

    return map_arrow(docs, run, "bucket long, payload binary")


def combine(sh: np.ndarray, cl: np.ndarray, size: np.ndarray, most: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Before the shuffle, a shingle with more than `most` documents here keeps, of each narrow band of sizes, a chain's two ends.

    The documents between are tied to an end by a replica of a key that only they share, so the regions stay united.
    """
    order = np.lexsort((np.abs(size), sh))
    sh, cl, size = sh[order], cl[order], size[order]
    starts = np.flatnonzero(np.concatenate([[True], sh[1:] != sh[:-1]]))
    ends = np.append(starts[1:], len(sh))
    hot = np.flatnonzero(ends - starts > most)
    if not len(hot):
        return sh, cl, size
    keep = np.ones(len(sh), bool)
    more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in hot:
        a, b = int(starts[i]), int(ends[i])
        band = (np.log(np.abs(size[a:b])) / math.log(1.05)).astype(np.int64)
        cuts = np.append(np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]])), b - a)
        for c, d in zip((cuts[:-1] + a).tolist(), (cuts[1:] + a).tolist(), strict=True):
            if d - c > 2:
                keep[c + 1 : d - 1] = False
                if (size[c:d] > 0).any():
                    size[c], size[d - 1] = abs(size[c]), abs(size[d - 1])
                tie = np.uint64(xxhash.xxh3_64_intdigest(sh[c : c + 1].tobytes() + np.sort(cl[c:d]).tobytes()))
                more.append((np.full(d - c, tie), cl[c:d], np.full(d - c, abs(int(size[c])), np.int64)))
    return tuple(np.concatenate([x[keep], *[m[k] for m in more]]) for k, x in enumerate((sh, cl, size)))


def unite(payloads: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the least class of each region of a bucket to its other classes."""
    sh, cl, size = [], [], []
    for p in payloads:
        n = len(p) // 20
        sh.append(np.frombuffer(p, np.uint64, n))
        cl.append(np.frombuffer(p, np.int64, n, 8 * n))
        size.append(np.frombuffer(p, np.int32, n, 16 * n))
    sh, cl, size = np.concatenate(sh), np.concatenate(cl), np.concatenate(size).astype(np.int64)
    n = np.abs(size)
    order = np.lexsort((n, sh))
    sh, cl, size, n = sh[order], cl[order], size[order], n[order]
    # sizes in a region are a chain: neighbours within the size window meet, unless both only look for smaller sets
    meet = (sh[1:] == sh[:-1]) & (100 * n[:-1] >= percent * n[1:]) & (cl[1:] != cl[:-1])
    # a chain link may be needed by two others around it, so it goes only where no document of its run of sizes has the wider window
    run = np.concatenate([[0], np.cumsum(~((sh[1:] == sh[:-1]) & (100 * n[:-1] >= percent * n[1:])))])
    wide = np.bincount(run, size > 0) > 0
    meet &= wide[run[1:]]
    pairs = np.unique(np.stack([cl[:-1][meet], cl[1:][meet]], 1), axis=0)
    if not len(pairs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    nodes, flat_ = np.unique(pairs, return_inverse=True)
    flat_ = flat_.reshape(-1, 2)
    root = union(len(nodes), flat_[:, 0].tolist(), flat_[:, 1].tolist())
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[other]], nodes[other]


def _meeting(docs: DataFrame, read, total: int, percent: int, cells: int = CELLS) -> DataFrame:
    """(node, root) of the classes that meet others in the lists of their windows: root names the region. total: shingles of all sets."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(frequencies(docs, read, cells))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * (1 - percent / 100) * 20 // BUCKET_BYTES) + 1)

    def edges(t: pa.Table) -> pa.Table:
        a, b = unite(t["payload"].to_pylist(), percent)
        return pa.table({"a": a, "b": b})

    met = components(replicas(docs, sent, buckets, read, percent).groupBy("bucket").applyInArrow(edges, "a long, b long"))
    sent.destroy()  # what met reads is written
    return met


def _repeating(rows: DataFrame, items: int, percent: int, turn: int) -> DataFrame:
    """(class) of the rows (region, class, n, own) of whose items at least `percent` in a hundred are in others of their region too, by exact counts: no other can link."""
    read, buckets = _of_regions(turn), max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), items * 16 // BUCKET_BYTES + 1)

    def run(batch):
        for sets, keys in read(batch, 4 << 20):
            sh, cl = np.concatenate(sets), np.repeat(np.array(keys, np.int64), [len(s) for s in sets])
            b = (sh % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            ids, at = np.unique(b[order], return_index=True)
            sh, cl, at = sh[order], cl[order], np.append(at, len(b))
            yield {"bucket": ids, "payload": [sh[i:j].tobytes() + cl[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]}

    def count(t: pa.Table) -> pa.Table:
        both = [np.frombuffer(p, np.uint64).reshape(2, -1) for p in t["payload"].to_pylist()]
        sh, cl = np.concatenate([x[0] for x in both]), np.concatenate([x[1] for x in both]).view(np.int64)
        order = np.argsort(sh)
        same = np.concatenate([[False], sh[order][1:] == sh[order][:-1], [False]])
        names, n = np.unique(cl[order][same[1:] | same[:-1]], return_counts=True)
        return pa.table({"class": names, "shared": n})

    met = map_arrow(rows.select("region", "class", "own"), run, "bucket long, payload binary").groupBy("bucket").applyInArrow(count, "class long, shared long")
    return met.groupBy("class").agg(F.sum("shared").alias("shared")).join(rows.select("class", "n").distinct(), "class").where(F.col("shared") * 100 >= F.col("n") * percent).select("class")


def _divided(regions: DataFrame, percent: int, most: int = DIVIDED) -> DataFrame:
    """Rows (region, class, n, own), those of regions with more than `most` rows cut by windows over what is rare among them alone; what then meets nothing goes.

    From the second turn on, rows most of whose items are theirs alone go before. As long as a turn takes a quarter of the rows out of large regions, there is another.
    """
    done: list[DataFrame] = []
    before, turn = 0, 0
    while True:
        size = regions.groupBy("region").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("items")).where(F.col("rows") > most)
        rows, items = size.agg(F.sum("rows"), F.sum("items")).first()
        if not rows or turn > 1 and 4 * rows > 3 * before:
            break
        before, turn = rows, turn + 1
        names = F.broadcast(materialise(size.select("region")))  # one of `most` rows at most
        done.append(regions.join(names, "region", "left_anti"))
        large = regions.join(names, "region", "left_semi").select("region", "class", "n", "own")
        if turn > 1:
            large = materialise(large.join(_repeating(large, items, percent, turn), "class", "left_semi"))
        met = _meeting(large.select("region", "class", "own"), _of_regions(turn), items, percent)
        regions = materialise(large.join(met, large["class"] == met["node"]).select(F.col("root").alias("region"), "class", "n", "own"))
    for x in done:
        regions = regions.unionByName(x)
    return regions


def held(pivot: np.ndarray, items: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many shingles of a pivot each of several sets (not empty) holds; items are their shingles."""
    at = np.searchsorted(pivot, items)
    at[at == len(pivot)] = 0
    return np.add.reduceat((pivot[at] == items).astype(np.int64), offsets[:-1])


def join_region(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between the sets of a region (positions), enough to connect all that are connected."""
    e = 1 - percent / 100
    n_all = np.array([len(s) for s in sets])
    links: list[tuple[int, int]] = []
    # larger sets first: pivots then have their whole size window ahead
    rest = np.argsort(-n_all, kind="stable")

    def measure(p: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Jaccard distance of p to others, and whether they link."""
        own = [sets[i] for i in others]
        inter = held(sets[p], np.concatenate(own), np.concatenate([[0], np.cumsum(n_all[others])]))
        either = n_all[p] + n_all[others] - inter
        return 1 - inter / either, 100 * inter >= percent * either

    while len(rest) > 1:
        p, others = int(rest[0]), rest[1:]
        # 2 e is as far as a ring reaches: sets smaller than (1 - 2 e) of the pivot's lie beyond
        near = others[n_all[others] >= (1 - 2 * e) * n_all[p] - 1e-9]
        if not len(near):
            rest = others
            continue
        d, linked = measure(p, near)
        core, ring = near[linked], near[~linked & (d <= 2 * e + 1e-9)]
        links += [(p, int(x)) for x in core]
        if len(ring) and len(core):
            d_core, d_ring = d[linked], d[~linked & (d <= 2 * e + 1e-9)]
            for y, dy in zip(ring.tolist(), d_ring.tolist(), strict=True):
                edge = core[d_core >= dy - e - 1e-9]
                if len(edge):
                    _, hit = measure(y, edge)
                    links += [(y, int(x)) for x in edge[hit][:1]]
        gone = np.zeros(len(sets), bool)
        gone[core] = True
        rest = others[~gone[others]]
    return links


def _nearest(rows: pa.Table, pivots: pa.Table, percent: int) -> pa.Table:
    """Each row with the nearest pivot, its distance, the pivots that it links with, and those in whose ring it lies."""
    e = 1 - percent / 100
    shape = [("home", pa.int64()), ("d", pa.float64()), ("linked", pa.list_(pa.int64())), ("ring", pa.list_(pa.struct([("pivot", pa.int64()), ("d", pa.float64())])))]
    rows = rows.select(["region", "class", "n", "own"])
    pivots = pivots.sort_by("pivot")
    names = pivots["pivot"].to_numpy()
    if not len(rows):  # a salt that no document has; none is without pivots, as a region has at least one
        return pa.table([*rows.columns, *[pa.array([], kind) for _, kind in shape]], names=[*rows.column_names, *[name for name, _ in shape]])
    sets = [np.frombuffer(x, np.uint64) for x in rows["own"].to_pylist() + pivots["own"].to_pylist()]
    n = np.array([len(x) for x in sets])
    k = len(rows)
    inter = np.concatenate([shared(sets[a:b] + sets[k:], np.arange(b - a), np.arange(b - a, b - a + len(names))) for a, b in chunks(np.concatenate([[0], np.cumsum(n[:k])]), BLOCK_ITEMS)])
    either = n[:k, None] + n[k:] - inter
    d = 1 - inter / either
    linked = 100 * inter >= percent * either
    ring = ~linked & (d <= 2 * e + 1e-9)
    home = d.argmin(1)
    found = (names[home], d[np.arange(k), home], [names[x].tolist() for x in linked], [[{"pivot": names[j], "d": d[i, j]} for j in np.flatnonzero(x)] for i, x in enumerate(ring)])
    for (name, kind), x in zip(shape, found, strict=True):
        rows = rows.append_column(name, pa.array(x, kind))
    return rows


def _pivoted(regions: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A round over regions of rows (region, class, n, own, rows): links (a, b), two-sided cells (cell, side, class, n, own), and what goes on."""
    e = 1 - percent / 100
    hashed = F.xxhash64("class", F.lit(77))
    salts = F.ceil(F.col("rows") / DEALT).cast("int")
    dealt = regions.withColumn("salt", F.pmod(F.xxhash64("class", F.lit(78)), salts).cast("int"))
    pivots = regions.groupBy("region", F.pmod(hashed, F.lit(PIVOTS)).alias("slot")).agg(F.min(F.struct(hashed.alias("h"), "class", "own")).alias("p"), F.max(salts).alias("salts"))
    pivots = pivots.select("region", F.col("p.class").alias("pivot"), F.col("p.own").alias("own"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    schema = "region long, class long, n long, own binary, home long, d double, linked array<bigint>, ring array<struct<pivot: bigint, d: double>>"
    met = dealt.groupBy("region", "salt").cogroup(pivots.groupBy("region", "salt"))
    marked = materialise(met.applyInArrow(lambda rows, near: _nearest(rows, near, percent), schema))

    links = marked.select(F.explode("linked").alias("a"), F.col("class").alias("b")).where("a <> b")
    # pivots of a region that a document links with are one component; at most PIVOTS ** 2 pairs a region
    both = marked.where(F.size("linked") > 1).select("region", F.col("linked")[0].alias("a"), F.explode("linked").alias("b")).distinct()
    alone = marked.where(F.size("linked") > 0).select("region", F.explode("linked").alias("a")).distinct().select("region", "a", F.col("a").alias("b"))

    def name(t: pa.Table) -> pa.Table:
        a, b = t["a"].to_numpy(), t["b"].to_numpy()
        names = np.unique(a)
        root = union(len(names), np.searchsorted(names, a).tolist(), np.searchsorted(names, b).tolist())
        return pa.table({"region": pa.array([t["region"][0].as_py()] * len(names), pa.int64()), "pivot": names, "part": names[root]})

    parts_ = materialise(both.unionByName(alone).groupBy("region").applyInArrow(name, "region long, pivot long, part long"))
    own = parts_.select("region", F.col("pivot").alias("own_pivot"), F.col("part").alias("own_part"))
    named = marked.join(own, (marked["region"] == own["region"]) & (F.get("linked", F.lit(0)) == F.col("own_pivot")), "left").drop(own["region"])
    around = named.select("region", "class", "own_part", F.explode("ring").alias("x")).select("region", "class", "own_part", "x.pivot", "x.d")
    around = around.join(parts_, ["region", "pivot"]).where(~F.col("own_part").eqNullSafe(F.col("part")))
    around = materialise(around.select("region", "pivot", "part", "class", "d"))
    least = around.groupBy("region", "pivot").agg(F.min("d").alias("least"))
    # a pivot itself has been compared with all
    inner = named.where((F.size("linked") > 0) & (F.col("class") != F.col("home"))).join(least.withColumnRenamed("pivot", "home"), ["region", "home"])
    inner = inner.where(F.col("d") >= F.col("least") - e - 1e-9)
    inner = materialise(inner.select(F.xxhash64("region", "own_part").alias("cell"), F.lit(2).alias("side"), "class", "n", "own"))
    outer = around.select("region", F.xxhash64("region", "part").alias("cell"), "class").distinct().join(inner.select("cell").distinct(), "cell", "left_semi")
    outer = outer.join(marked.select("region", "class", "n", "own"), ["region", "class"]).select("cell", F.lit(1).alias("side"), "class", "n", "own")
    further = marked.where(F.size("linked") == 0).select("region", "class", "n", "own")
    return links, inner.unionByName(outer), further


def _blocks(rows: DataFrame, cell: str) -> DataFrame:
    """Rows (cell, side, class, n, own) dealt into blocks, so that each pair of blocks meets once: of sides 1 and 2 across, of side 0 all."""
    rows = rows.withColumnRenamed(cell, "wide")
    many = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_ITEMS)).cast("int")
    sizes = rows.groupBy("wide").pivot("side", [0, 1, 2]).agg(many).na.fill(0)
    block = F.pmod(F.xxhash64("class", F.lit(79)), F.element_at(F.array("0", "1", "2"), F.col("side") + 1))
    rows = rows.join(sizes, "wide").withColumn("i", block)
    within = F.transform(F.sequence(F.lit(0), F.col("0") - 1), lambda j: F.struct(F.least("i", j).alias("x"), F.greatest("i", j).alias("y"), F.when(F.col("i") == j, 0).when(F.col("i") < j, 1).otherwise(2).alias("side")))
    first = F.transform(F.sequence(F.lit(0), F.col("2") - 1), lambda j: F.struct(F.col("i").alias("x"), j.alias("y"), F.lit(1).alias("side")))
    second = F.transform(F.sequence(F.lit(0), F.col("1") - 1), lambda j: F.struct(j.alias("x"), F.col("i").alias("y"), F.lit(2).alias("side")))
    meets = F.when(F.col("side") == 0, within).when((F.col("1") == 0) | (F.col("2") == 0), F.slice(within, 1, 0)).when(F.col("side") == 1, first).otherwise(second)
    rows = rows.select("wide", "class", "n", "own", F.explode(meets).alias("m"))
    return rows.select(F.xxhash64("wide", "m.x", "m.y").alias("cell"), F.col("m.side").alias("side"), "class", "n", "own")


def _within_tasks(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) in each cell of rows (cell, side, class, n, own): side 0 as a region, 1 against 2 by comparison."""
    total = rows.agg(F.sum("n")).first()[0] or 0
    bins = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // REGION_ITEMS))

    def join(t: pa.Table) -> pa.Table:
        t = t.sort_by([("cell", "ascending"), ("class", "ascending")])
        cell, side, cl = t["cell"].to_numpy(), t["side"].to_numpy(), t["class"].to_numpy()
        own = t["own"].to_pylist()
        cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            sets = [np.frombuffer(x, np.uint64) for x in own[i:j]]
            if side[i] or j - i > REGION_ROWS:
                x, y = links_within(sets, percent, side[i:j])
            else:
                x, y = np.array(join_region(sets, percent), np.int64).reshape(-1, 2).T
            a.append(cl[i:j][x])
            b.append(cl[i:j][y])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    dealt = rows.withColumn("bin", F.pmod(F.xxhash64("cell"), F.lit(bins))).select("bin", "cell", "side", "class", "own")
    return materialise(dealt.groupBy("bin").applyInArrow(join, "a long, b long"))


def link_regions(regions: DataFrame, percent: int, rows: int = REGION_ROWS, items: int = REGION_ITEMS) -> DataFrame:
    """Links (a, b) between classes, enough to connect all that are connected, from rows (region, class, n, own); a round halves what goes on."""
    links: list[DataFrame] = []
    regions = _divided(regions, percent)
    before = None  # rows of the region that a region is what remained of
    while True:
        size = regions.groupBy("region").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("items")).where("rows > 1")
        tagged = regions.join(size, "region")
        if before is None:
            tagged = tagged.withColumn("was", F.lit(None).cast("long"))
        else:
            tagged = tagged.join(before, "region")
        tagged = materialise(tagged)
        if tagged.isEmpty():
            break
        small = (F.col("rows") <= rows) & (F.col("items") <= items)
        links.append(_within_tasks(tagged.where(small).select(F.col("region").alias("cell"), F.lit(0).alias("side"), "class", "n", "own"), percent))
        large = tagged.where(~small)
        stuck = F.coalesce(F.col("rows") * 2 > F.col("was"), F.lit(False))
        undivided = large.where(stuck).select(F.col("region").alias("cell"), F.lit(0).alias("side"), "class", "n", "own")
        large = large.where(~stuck)
        if not large.isEmpty():
            more, cells, regions = _pivoted(large, percent)
            undivided = undivided.unionByName(cells)
            links.append(more)
            before = large.select("region", F.col("rows").alias("was")).distinct()
        met = materialise(_blocks(undivided, "cell"))
        if not met.isEmpty():
            links.append(_within_tasks(met, percent))
        if large.isEmpty():
            break
    if not links:
        return regions.select(F.col("class").alias("a"), F.col("class").alias("b")).limit(0)
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return out


def _linked(docs: DataFrame, words: int, percent: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, class, n) of every row, and of each class with words (class, doc, root): its least doc_id and the least class of its component."""
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    every = materialise(members(docs, words))
    classes = materialise(every.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("doc"), F.max("n").alias("n")))
    total = classes.agg(F.sum("n")).first()[0] or 0
    regions = _meeting(docs.select("text"), _of_texts(words), total, percent)
    bits = spark.sparkContext.broadcast(bitmap(regions, "node")) if not regions.isEmpty() else None
    if bits is None:
        found = regions
    else:
        wanted = regions.join(classes.withColumnRenamed("class", "node"), "node").select(F.col("node").alias("class"), F.col("root").alias("region"), "doc")
        keyed = _candidates(docs, words, bits)
        here = keyed.join(wanted, keyed["class"] == wanted["class"]).where(F.col("doc").eqNullSafe(F.col("doc_id")))
        here = materialise(here.select("region", wanted["class"], "n", "own"))
        found = components(link_regions(here, percent, rows))
        bits.destroy()
    top = classes.join(found.withColumnRenamed("node", "class"), "class", "left").select("class", "doc", F.coalesce("root", "class").alias("root"))
    return every, top


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, rows: int = REGION_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id for rows (doc_id, text).

    component_id is the least doc_id reachable over links, the own one included. A document's set is its distinct shingles; a text with
    fewer words than a shingle is one shingle. Null texts and texts without words have none, link with nothing and are their own component.
    Repeated rows are documents with equal sets and link. A null doc_id is greater than all others. No rows give none; other columns are
    ignored. Groups of equal sets are one class throughout, and groups of near copies are settled against a pivot, without all their pairs.
    """
    every, top = _linked(docs, words, percent, rows)
    least = top.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = top.join(least, "root").select("class", "component_id")
    out = every.join(named, "class", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _candidates(docs: DataFrame, words: int, bits) -> DataFrame:
    """(doc_id, class, n, own) of the rows whose class may be wanted; own: the sorted shingles as bytes."""

    def run(batch):
        for part, sets in _sets(batch, words):
            keys = np.array([class_key(s) for s in sets], np.int64)
            slot = bitmap_slots(keys)
            hit = (bits.value[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)
            at = [k for k in np.flatnonzero(hit).tolist() if len(sets[k])]
            yield {"doc_id": part["doc_id"].take(pa.array(at, pa.int64())), "class": keys[at], "n": [len(sets[k]) for k in at], "own": [sets[k].tobytes() for k in at]}

    return map_arrow(docs, run, "doc_id long, class long, n long, own binary")


def deduplicate(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, rows: int = REGION_ROWS) -> DataFrame:
    """The documents with their columns, one of each component: one with the least id, a null id being greater than all others.

    Components are those of texts, whatever their ids: unlinked texts all stay, with a null or the same id too. Texts without words link with
    nothing; those that share an id, which isn't null, are one. Of rows with one id and equal sets, one with the greatest text stays.
    """
    top = materialise(_linked(docs, words, percent, rows)[1])
    chosen = top.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "class")).alias("c"))
    chosen = chosen.select(F.col("c.class").alias("class"), F.col("c.doc").alias("doc"))

    @F.arrow_udf("long")
    def key(text: pa.Array) -> pa.Array:
        return pa.array([class_key(s) for _, sets in _sets(pa.RecordBatch.from_arrays([text], names=["text"]), words) for s in sets], pa.int64())

    small_batches(docs.sparkSession)
    kept = packed(docs, "doc_id", "text").withColumn("key", key("text"))
    bare = F.col("key") == class_key(np.zeros(0, np.uint64))
    kept = kept.join(chosen, (F.col("key") == F.col("class")) & F.col("doc_id").eqNullSafe(F.col("doc")), "left")
    kept = kept.where(F.col("class").isNotNull() | bare)
    # rows without words and id are told apart by a number of their own; equal rows are thinned before the shuffle, so that many of them don't meet in one task
    kept = kept.withColumn("row", F.when(bare & F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    whole, order = F.struct("doc_id", "text", "rest"), F.struct(F.col("text").isNotNull().alias("some"), F.col("text"))
    kept = kept.groupBy("key", F.col("doc_id").alias("id"), "row").agg(F.max_by(whole, order).alias("x")).select("x.*")
    return unpacked(kept, docs.columns, "doc_id", "text").select(*quoted(docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.b)::BIGINT AS component_id FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
