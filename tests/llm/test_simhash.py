import random
import re

import numpy as np
import pytest
import xxhash
from helpers import documents, empty

from lexdrift.llm import simhash


def by_definition(text, size=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    grams = [b" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def classes(rows, radius=4):
    """Smallest doc_id of each row's component, all pairs compared."""
    fps = [by_definition(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(k)] = min(least.get(find(k), doc_id), doc_id)
    return [(d, f"{fps[k]:016x}", least.get(find(k))) for k, (d, _) in enumerate(rows)]


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def test_all_rows_by_all_pairs(spark):
    docs = documents(spark, 60)
    out = simhash.join(docs)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    assert ordered(out.collect()) == ordered(classes([(r["doc_id"], r["text"]) for r in docs.collect()]))


def test_near_copies_by_all_pairs(spark):
    """Long texts with a word or two changed: links of 1 to 4 bits, and components longer than the radius."""
    rng = random.Random(3)
    base = [[f"w{rng.randrange(5000)}" for _ in range(700)] for _ in range(6)]
    rows = []
    for k in range(240):
        words = list(base[k % 6])
        for _ in range(k // 6 % 4):
            words[rng.randrange(700)] = "changed"
        rows.append((k * 7 % 1000 if k % 9 else None, " ".join(words)))
    want = classes(rows)
    assert len({w[2] for w in want}) < 200 and any(w[1] != v[1] and w[2] == v[2] for w in want for v in want)
    for blocks in (1, 2, 4, 8):
        assert ordered(simhash.join(spark.createDataFrame(rows, "doc_id long, text string"), blocks=blocks).collect()) == ordered(want)


@pytest.mark.parametrize("blocks,radius", [(1, 4), (2, 4), (4, 4), (8, 4), (4, 0), (4, 7)])
def test_links_of_fingerprints(spark, monkeypatch, blocks, radius):
    """Random and nearly equal fingerprints, in several tiles a cell: components as those of all pairs."""
    monkeypatch.setattr(simhash, "TILE", 8)
    rng = random.Random(blocks)
    fps = [0, (1 << 64) - 1, 1, 1 << 63]
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(6):
            fps.append(x)
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    edges = [(int(r["a"]), int(r["b"])) for r in simhash.near(spark.createDataFrame([(x,) for x in signed], "fp long"), radius, blocks).collect()]
    for a, b in edges:
        root[find(a)] = find(b)
    near = {(a, b) for i, a in enumerate(signed) for b in signed[:i] if (fps[i] ^ fps[signed.index(b)]).bit_count() <= radius}
    # one forest a task finds links through members that were connected already, so links between representatives count by component
    want = {x: x for x in signed}

    def up(x):
        while want[x] != x:
            x = want[x]
        return x

    for a, b in near:
        want[up(a)] = up(b)
    assert all((find(a) == find(b)) == (up(a) == up(b)) for a in signed for b in signed)


def test_a_group_of_near_copies_sends_no_pairs(spark):
    """2,000 fingerprints within two bits of one: fewer links than one for each in each task and pair of cells, far from all pairs."""
    x = 0x0F0F0F0F0F0F0F0F
    fps = {x} | {x ^ 1 << a ^ 1 << b for a in range(64) for b in range(a)}
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    n = simhash.near(df).count()
    assert len(fps) - 1 <= n <= 4 * len(fps)


def test_compared_is_a_forest():
    x = np.array([0, 1, 3, 7, 15, 31, 255 << 40], np.uint64)
    assert len(simhash.compared(x, x, 1, True)) == 5
    assert len(simhash.compared(x[:3], x[3:], 1, False)) == 1


def test_windows(monkeypatch):
    text = "Some Words of\ta text\n that go on for a while " * 40 + "x" * 500 + " and\x0bend"
    whole = simhash.fingerprint(text.encode())
    assert whole == by_definition(text)
    for size in (1, 7, 64, 100):
        monkeypatch.setattr(simhash, "WINDOW", size)
        assert simhash.fingerprint(text.encode()) == whole
        for short in ("", " \n", "One", "one Two", "one two three", "é ß " * 3, "one two three four"):
            assert simhash.fingerprint(short.encode()) == by_definition(short)


def test_no_rows_and_other_columns(spark):
    assert simhash.join(empty(spark)).collect() == []
    rows = [(1, "a b c d e", "x", 1), (2, "A b c d e", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, `a.b` long")
    assert [r["component_id"] for r in simhash.join(docs).collect()] == [1, 1]


def test_query_on_all_documents(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert ordered(simhash.query(spark, small).collect()) == ordered(classes([tuple(r) for r in rows]))
