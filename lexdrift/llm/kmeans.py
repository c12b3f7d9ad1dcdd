"""Centroid clustering of integer vectors, exactly, with Elkan's bounds.

Vectors are packed into blocks of rows, each with what is known of them: the centroid they are at, an upper bound of the distance to it and k lower bounds of
the distances to all centroids. A round goes over the blocks where they lie, without a shuffle, and writes them again with new bounds; the sums that the
next centroids are made of are columns of the blocks, and only those are read for them. Earlier rounds' tables go.

Assignments are exact. Squared distances are whole numbers. Bounds are floating-point distances that are rounded outwards at every step, and a calculation is
skipped only where a bound shows that the other centroid is strictly farther, so that equally near ones are always compared and the smaller number wins.

Nulls: vectors that are null, have another number of components, or any that is null or not finite, are left out. Null vec_ids are kept and come last where
the first centroids are chosen. Repeated rows are vectors of their own; of rows with one vec_id, those with smaller components are chosen first. With fewer
vectors than centroids there are fewer centroids; no vectors give no rows. A component beyond 2^27 (an x of 131,072), whose squared
distances a long can't hold, is an error, as an overflow is in Spark. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_tables, map_arrow, materialise, table, written_tables

#: Fixed by the contract.
COMPONENTS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, 3
LARGEST = 1 << 27
#: vec_ids, vectors and their bounds, of a block; sums and counts by centroid, moved and computed: vectors that changed their centroid, distances computed.
BLOCK = "ids array<bigint>, width int, vectors binary, at binary, upper binary, lower binary, sums array<bigint>, counts array<bigint>, inertia array<bigint>, moved bigint, computed bigint"


def kept(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, v) of the rows (vec_id, embedding) whose embedding has so many components, all finite."""
    v = F.col("embedding").cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where((F.size("v") == components) & ~F.coalesce(odd.alias("o"), F.lit(True)))


def scaled(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as whole numbers."""
    out = np.floor(v * scale)
    if len(out) and np.abs(out).max() > LARGEST:
        raise ArithmeticError(f"a component is beyond {LARGEST} after scaling: squared distances may not fit a long")
    return out.astype(np.int64)


def first_centroids(vectors: DataFrame, k: int, seed: int, scale: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of seed:vec_id, in that order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(name.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return scaled(np.array([r["v"] for r in rows], np.float64).reshape(len(rows), -1 if rows else 0), scale)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of vectors to a centroid, exactly."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def _up(d2: np.ndarray) -> np.ndarray:
    """A distance that isn't less than the root of a whole number."""
    return np.nextafter(np.nextafter(np.sqrt(np.nextafter(d2.astype(np.float64), np.inf)), np.inf), np.inf)


def _down(d2: np.ndarray) -> np.ndarray:
    """A distance that isn't more than the root of a whole number."""
    return np.maximum(np.nextafter(np.nextafter(np.sqrt(np.maximum(np.nextafter(d2.astype(np.float64), -np.inf), 0)), -np.inf), -np.inf), 0)


def assign_first(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(centroid, upper bound, lower bounds, distances computed) of vectors of which nothing is known."""
    d2 = np.stack([squared(x, k) for k in c], 1)
    at = d2.argmin(1)
    return at, _up(d2.min(1)), _down(d2), d2.size


def assign(x: np.ndarray, c: np.ndarray, before: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same for vectors with the bounds that held for the centroids before."""
    drift = np.array([squared(a[None], b)[0] for a, b in zip(c, before, strict=True)])
    at = at.copy()
    upper = np.nextafter(upper + _up(drift)[at], np.inf)
    lower = np.maximum(np.nextafter(lower - _up(drift), -np.inf), 0)
    apart = np.stack([_down(squared(c, k)) for k in c]) / 2  # a division by 2 is exact
    np.fill_diagonal(apart, np.inf)
    computed = 0
    # strictly nearer than half the way to the next centroid: nothing else is as near
    open_ = np.flatnonzero(upper >= apart.min(1)[at])
    if len(open_):
        open_ = open_[((upper[open_, None] >= lower[open_]) & (upper[open_, None] >= apart[at[open_]])).any(1)]
    best = squared(x[open_], c[at[open_]])
    computed += len(open_)
    upper[open_] = _up(best)
    lower[open_, at[open_]] = _down(best)
    for k in range(len(c)):
        own = at[open_]
        todo = np.flatnonzero((own != k) & (upper[open_] >= lower[open_, k]) & (upper[open_] >= apart[own, k]))
        rows = open_[todo]
        d2 = squared(x[rows], c[k])
        computed += len(rows)
        lower[rows, k] = _down(d2)
        nearer = (d2 < best[todo]) | ((d2 == best[todo]) & (k < at[rows]))
        at[rows[nearer]] = k
        upper[rows[nearer]] = _up(d2[nearer])
        best[todo[nearer]] = d2[nearer]
    return at, upper, lower, computed


def _packed(ids, x: np.ndarray, at, upper, lower, c: np.ndarray, moved: int, computed: int, inertia: bool = False) -> dict:
    """A block's row. Vectors take as few bytes as they need; upper bounds are rounded up and lower ones down where they are shortened."""
    width = next((w for w in (1, 2, 4) if not x.size or (x.min() >= -(1 << (8 * w - 1)) and x.max() < 1 << (8 * w - 1))), 8)
    up, low = upper.astype(np.float32), lower.astype(np.float32)
    up = np.where(up < upper, np.nextafter(up, np.float32(np.inf)), up)
    low = np.maximum(np.where(low > lower, np.nextafter(low, np.float32(-np.inf)), low), np.float32(0))
    k = len(c)
    sums = np.zeros((k, x.shape[1]), np.int64)
    for j in range(k):
        sums[j] = x[at == j].sum(0)
    far = np.zeros(k, np.int64)
    if inertia:
        np.add.at(far, at, squared(x, c[at]))
    return {
        "ids": [ids], "width": [width], "vectors": [x.astype(f"<i{width}").tobytes()], "at": [at.astype("<u4").tobytes()], "upper": [up.astype("<f4").tobytes()], "lower": [low.astype("<f4").tobytes()],
        "sums": [sums.ravel().tolist()], "counts": [np.bincount(at, minlength=k).tolist()], "inertia": [far.tolist()], "moved": [moved], "computed": [computed],
    }


def _vectors(row, n: int) -> np.ndarray:
    return np.frombuffer(row["vectors"], f"<i{row['width']}").astype(np.int64).reshape(n, -1)


def _begun(vectors: DataFrame, c: np.ndarray, scale: int) -> DataFrame:
    def run(batch):
        if len(batch):
            x = scaled(batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1), scale)
            yield _packed(batch["vec_id"].to_pylist(), x, *assign_first(x, c)[:3], c, len(batch), len(batch) * len(c))

    return map_arrow(vectors, run, BLOCK)


def _again(blocks: DataFrame, c: np.ndarray, before: np.ndarray, last: bool) -> DataFrame:
    def run(batch):
        for row in batch.to_pylist():
            x = _vectors(row, len(row["ids"]))
            was = np.frombuffer(row["at"], "<u4").astype(np.int64)
            upper, lower = (np.frombuffer(row[b], "<f4").astype(np.float64) for b in ("upper", "lower"))
            at, upper, lower, computed = assign(x, c, before, was, upper, lower.reshape(len(x), -1))
            yield _packed(row["ids"], x, at, upper, lower, c, int((at != was).sum()), computed, last)

    return map_arrow(blocks.select("ids", "width", "vectors", "at", "upper", "lower"), run, BLOCK)


def _totals(blocks: DataFrame, column: str) -> list[int]:
    """Sums of an array column over all blocks, place by place: one row for each place comes to the driver."""
    x = blocks.select(F.posexplode(column).alias("k", "x")).groupBy("k").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("x"))
    return [int(r["x"]) for r in sorted(x.collect(), key=lambda r: r["k"])]


def cluster(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """The blocks after the last assignment, and the centroids. The driver holds k centroids and their sums."""
    vectors = kept(embeddings, components)
    c = first_centroids(vectors, k, seed, scale)
    if not len(c):
        return embeddings.sparkSession.createDataFrame([], BLOCK), c
    tables = written_tables()
    blocks = materialise(_begun(vectors, c, scale))
    for r in range(rounds):
        sums, counts = (_totals(blocks, x) for x in ("sums", "counts"))
        new = [[s // n for s in sums[j * components : (j + 1) * components]] if (n := counts[j]) else c[j].tolist() for j in range(len(c))]
        before, c = c, np.array(new, np.int64)
        blocks = materialise(_again(blocks, c, before, r + 1 == rounds))
        drop_tables(embeddings.sparkSession, tables)
    return blocks, c


def assigned(embeddings: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of rows (vec_id, embedding)."""
    blocks, c = cluster(embeddings, **options)
    inertia = _totals(blocks, "inertia") if len(c) else []
    names = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c.tolist()]
    total = sum(inertia)

    def run(batch):
        for row in batch.to_pylist():
            n, at = len(row["ids"]), np.frombuffer(row["at"], "<u4").astype(np.int64)
            yield {
                "vec_id": row["ids"], "cluster": at.astype(np.int32), "distance": squared(_vectors(row, n), c[at]), "cluster_inertia": [inertia[j] for j in at.tolist()], "inertia": [total] * n,
                "centroid_sha256": [names[j] for j in at.tolist()],
            }

    return map_arrow(blocks.select("ids", "width", "vectors", "at"), run, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _oracle() -> str:
    """All rounds one after the other, each vector against each centroid, in whole numbers."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {COMPONENTS})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT v, sha256('{SEED}:' || vec_id) AS h FROM v ORDER BY h, v LIMIT {CENTROIDS}))",
    ]
    for r in range(ROUNDS + 1):
        # equal vectors needn't be told apart here: argmin takes the smaller of equal distances by k
        parts.append(
            f"a{r} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, k := k)) AS m FROM (SELECT r, k, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{r}) GROUP BY r)"
        )
        if r < ROUNDS:
            parts.append(
                f"s{r} AS MATERIALIZED (SELECT k, j, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT m.k AS k, unnest(range({COMPONENTS})) AS j, unnest(v) AS x FROM a{r} JOIN v USING (r)) GROUP BY k, j)"
            )
            parts.append(
                f"c{r + 1} AS MATERIALIZED (SELECT c{r}.k AS k, coalesce(x.c, c{r}.c) AS c FROM c{r} LEFT JOIN (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM s{r} GROUP BY k) x ON c{r}.k = x.k)"
            )
    return f"""WITH {", ".join(parts)}
    SELECT vec_id, m.k::INTEGER AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.k))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
        sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM a{ROUNDS} JOIN v USING (r) JOIN c{ROUNDS} ON c{ROUNDS}.k = m.k"""


ORACLE_SQL = _oracle()
