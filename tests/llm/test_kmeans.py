import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from lexdrift.llm import kmeans


def by_definition(rows, k=8, rounds=10, n=64):
    """Lloyd's rounds in whole numbers, every distance computed. Of centroids, the smaller number wins ties."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == n and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, d, _ in last)
    return sorted(((i, j, d, sum(e for _, e, a in last if a == j), total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in last), key=str)


def ordered(df):
    return sorted(map(tuple, df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def vectors(n, seed=0, groups=5, spread=0.05):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(groups, 64))
    return [(k * 3, (at[k % groups] + spread * rng.normal(size=64)).astype(np.float32).tolist()) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_odd_vectors_by_definition(spark):
    rows = vectors(150)
    rows += [(1000, None), (1001, []), (1002, [1.0] * 63), (1003, [1.0] * 65), (1004, [None] + [1.0] * 63), (1005, [float("nan")] * 64), (1006, [float("inf")] + [0.0] * 63), (None, [0.5] * 64), (None, [-0.25] * 64)]
    rows += [rows[4], rows[4], (12, rows[7][1]), (2000, [-0.0] * 64), (2001, [-1e-9] * 64), (2002, [100.0] * 64)]
    assert ordered(kmeans.assigned(frame(spark, rows))) == by_definition(rows)


def test_ties(spark):
    """Vectors on a small grid, many as near to one centroid as to another, and many equal ones."""
    rng = random.Random(1)
    rows = [(k, [rng.choice([0.0, 1 / 1024, 2 / 1024])] * 2 + [0.0] * 62) for k in range(300)]
    assert ordered(kmeans.assigned(frame(spark, rows))) == by_definition(rows)


@pytest.mark.parametrize("n", [0, 1, 5, 9])
def test_few_vectors(spark, n):
    assert ordered(kmeans.assigned(frame(spark, vectors(n)))) == by_definition(vectors(n))


def test_equal_vectors(spark):
    rows = [(k, [0.25] * 64) for k in range(50)]
    assert ordered(kmeans.assigned(frame(spark, rows))) == by_definition(rows)


def test_bounds_hold_and_spare_distances():
    """After each round, bounds lie on their sides of the distances, assignments are those of all distances, and most distances weren't computed."""
    rng = np.random.default_rng(2)
    x = np.floor(1024 * (rng.normal(size=(8, 64))[rng.integers(0, 8, 800)] + 0.1 * rng.normal(size=(800, 64)))).astype(np.int64)
    c = x[[np.flatnonzero((x != x[j]).any(1))[j] for j in range(8)]]
    at, upper, lower, computed = kmeans.assign_first(x, c)
    done = 0
    for _ in range(10):
        before, c = c, np.array([x[at == j].sum(0) // max(1, (at == j).sum()) if (at == j).any() else c[j] for j in range(8)])
        at, upper, lower, computed = kmeans.assign(x, c, before, at, upper, lower)
        done += computed
        d2 = np.stack([kmeans.squared(x, k) for k in c], 1)
        assert (at == d2.argmin(1)).all()
        exact = np.sqrt(d2.astype(np.longdouble))
        assert (upper >= exact[np.arange(800), at]).all() and (lower <= exact).all()
    assert done < 0.5 * 10 * d2.size


def test_widths(spark):
    """Components that need one, two, four bytes, and one too large."""
    for scale in (0.01, 1.0, 1000.0):
        rows = [(k, [scale * x for x in v]) for k, v in vectors(40)]
        rows = [(k, np.array(v, np.float32).tolist()) for k, v in rows]
        assert ordered(kmeans.assigned(frame(spark, rows))) == by_definition(rows)
    with pytest.raises(Exception, match="beyond"):
        kmeans.assigned(frame(spark, [(k, [1e30] * 64) for k in range(9)])).collect()


def test_other_columns(spark):
    rows = [(k, v, k, "x") for k, v in vectors(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int, `a.b` string")
    assert ordered(kmeans.assigned(df)) == by_definition([r[:2] for r in rows])


def test_query_and_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    want = con.execute(f"SELECT vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 FROM ({kmeans.ORACLE_SQL})").fetchall()
    assert ordered(kmeans.query(spark, small)) == sorted(want, key=str)
