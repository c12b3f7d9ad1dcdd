import re

import numpy as np
import pytest
from helpers import changed, documents, empty, prose
from pyspark.sql import functions as F

from lexdrift.llm import jaccard
from lexdrift.llm.common import flat
from lexdrift.llm.components import components, union
from lexdrift.llm.shingles import shingle_sets

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """(n, component) of each (id, text) by all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [(i, len(s), least.get(root(k))) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


def family(spark, n=120):
    """Chains of copies that drift, so that components have links between documents far from any one pivot."""
    rows, k = [], 0
    for f in range(6):
        text = prose(f, 60 + 25 * f)
        for _ in range(n // 6):
            rows.append((k * 7 % (7 * n + 1), text))
            k += 1
            text = changed(text, k, 0.02)
    rows += [(10_000 + j, prose(500 + j, 40)) for j in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def same(got, rows):
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)


def test_odd_documents(spark):
    docs = documents(spark)
    same(jaccard.join(docs), [(r.doc_id, r.text) for r in docs.collect()])
    assert jaccard.join(empty(spark)).count() == 0
    blank = docs.where("text is null or trim(text) = ''")
    assert {(r.doc_id, r.n_shingles) for r in jaccard.join(blank).collect()} == {(r.doc_id, 0) for r in blank.collect()}


@pytest.mark.parametrize("rows", [jaccard.REGION_ROWS, 5])
def test_chains(spark, rows):
    docs = family(spark)
    same(jaccard.join(docs, rows=rows), [tuple(r) for r in docs.collect()])


def test_regions_join_exactly():
    rng = np.random.default_rng(1)
    for seed in range(30):
        base = rng.integers(0, 1 << 60, (4, 60)).astype(np.uint64)
        sets = []
        for _ in range(40):
            own = base[rng.integers(4)].copy()
            at = rng.choice(60, rng.integers(0, 16), replace=False)
            own[at] = rng.integers(0, 1 << 60, len(at)).astype(np.uint64)
            sets.append(np.unique(own[: rng.integers(45, 61)]))
        links = jaccard.join_region(sets)
        true = [(i, j) for i in range(40) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))]
        assert all((max(x), min(x)) in set(true) for x in links), seed
        a, b = (union(40, [x for x, _ in e], [y for _, y in e]) for e in (links, true))
        assert (a == b).all()


def test_windows():
    for n in range(1, 60):
        small, large = jaccard.windows(n)
        for m in range(1, 80):
            least = -(-75 * (n + m) // 175)  # shared shingles that a link needs
            if least > min(n, m):
                continue
            assert n - least + 1 <= (small if m >= n else large)


def test_hot_shingles_before_the_shuffle():
    sh = np.full(40, 5, np.uint64)
    cl, size = np.arange(40), np.concatenate([np.full(20, 100), np.full(20, -300)])
    a, b, c = jaccard.combine(sh, cl, size)
    n, counts = np.unique(a, return_counts=True)
    assert (a == 5).sum() < 10
    root = jaccard.unite([a.tobytes() + b.astype(np.int64).tobytes() + c.astype(np.int32).tobytes()], 75)
    assert set(root[0].tolist()) == {0, 20} and len(root[1]) == 38


def test_shingle_sets():
    texts = ["A b c d e f", "a B c d e f", "a b", "a  b\n", "", "a b c d e", "e d c b a", "one\x1ftwo three"]
    import pyarrow as pa

    got = shingle_sets(*flat(pa.array(texts)))
    assert [len(x) for x in got] == [2, 2, 1, 1, 0, 1, 1, 1]
    assert (got[0] == got[1]).all() and (got[2] == got[3]).all() and got[5][0] != got[6][0]


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(k, k + 1) for k in range(1000, 1200)] + [(2000, k) for k in range(2001, 2100)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def test_one_of_each_group_stays(spark):
    docs = documents(spark)
    got = jaccard.deduplicate(docs)
    kept = [r.doc_id for r in got.collect()]
    assert got.columns == docs.columns
    assert sorted(kept, key=str) == sorted({c for i, _, c in brute([(r.doc_id, r.text) for r in docs.collect()]) if i is not None} | {None}, key=str)
    assert got.where(F.col("doc_id") == 1).first().text == docs.where("doc_id = 1").first().text


def test_unlinked_texts_stay_whatever_their_ids(spark):
    """Of each component of rows one stays, also where ids are null or shared by different texts."""
    rows = [(None if k % 3 == 0 else k % 7, prose(k // 2 if k % 4 < 2 else 100 + k, 40)) for k in range(48)]
    rows += [(None, changed(prose(900, 60), k, 0.01)) for k in range(5)] + [(3, changed(prose(900, 60), 9, 0.01))]
    got = [tuple(r) for r in jaccard.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    groups = [{t for j, (_, t) in enumerate(rows) if root[j] == c} for root in [linked(rows)] for c in set(root)]
    assert len(got) == len(groups)
    for group in groups:
        ids = [i for i, t in rows if t in group and i is not None]
        assert [i for i, t in got if t in group] == [min(ids) if ids else None]


def linked(rows):
    """The component of each row, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    true = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    return union(len(rows), [i for i, _ in true], [j for _, j in true]).tolist()


def template(n, seed=0, length=200, most=39):
    """n sets around one template, 2 to `most` of their items replaced."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 60, length).astype(np.uint64)
    out = []
    for _ in range(n):
        own = base.copy()
        at = rng.choice(length, rng.integers(2, most + 1), replace=False)
        own[at] = rng.integers(0, 1 << 60, len(at)).astype(np.uint64)
        out.append(np.unique(own))
    return out


def as_regions(spark, sets):
    return spark.createDataFrame([(1, k, len(s), bytearray(s.tobytes())) for k, s in enumerate(sets)], "region long, class long, n long, own binary")


def test_rounds_divide_a_template(spark):
    """A round's rows stay a small multiple of the region's, and what goes on is at most half of it."""
    sets = template(300)
    rows = as_regions(spark, sets).withColumn("rows", F.lit(300).cast("long"))
    links, cells, rest = jaccard._pivoted(rows, 75)
    on, made = rest.count(), cells.count()
    assert on <= 150 and made <= 3 * 300
    met = jaccard._blocks(cells, "cell")
    assert met.count() <= made  # below a block, none is replicated, and a cell of one side goes
    found = jaccard.link_regions(as_regions(spark, sets), 75, rows=20).collect()
    true = [(i, j) for i in range(300) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))]
    x, y = (union(300, [a for a, _ in e], [b for _, b in e]) for e in (found, true))
    assert (x == y).all()


def test_unrelated_sets_of_a_region_are_cut_apart(spark, monkeypatch):
    """Sets that met by chance, each sharing a few items with others, aren't compared all with all; those that link stay together."""
    made = []
    real = jaccard._blocks
    monkeypatch.setattr(jaccard, "_blocks", lambda rows, cell: (lambda df: made.append(df.count()) or df)(real(rows, cell)))
    rng = np.random.default_rng(3)
    sets = [np.concatenate([rng.integers(0, 1 << 60, 84), rng.integers(0, 16_000, 16)]).astype(np.uint64) for _ in range(4000)]
    for k in range(200):
        sets[20 * k + 1] = np.concatenate([sets[20 * k][:95], rng.integers(0, 1 << 60, 5).astype(np.uint64)])
    sets = [np.unique(s) for s in sets]
    found = jaccard.link_regions(as_regions(spark, sets), 75).collect()
    assert {tuple(sorted(x)) for x in found} == {(20 * k, 20 * k + 1) for k in range(200)}
    assert sum(made) < 4000, made


def test_noisy_frequencies_lose_no_link(spark):
    """With a sketch of few cells, regions grow together, and nothing else changes."""
    docs = family(spark).select("text", "doc_id")
    read, total = jaccard._of_texts(5), 10_000
    whole, coarse = (jaccard._meeting(docs.select("text"), read, total, 75, cells) for cells in (jaccard.CELLS, jaccard.BLOCK))
    ids = {r.doc_id: r["class"] for r in jaccard.members(docs, 5).collect()}
    for met in (whole, coarse):
        root = {r.node: r.root for r in met.collect()}
        for i, _, c in brute([(r.doc_id, r.text) for r in docs.collect()]):
            assert ids[i] == ids[c] or root[ids[i]] == root[ids[c]]


def test_many_near_copies_in_bounded_rows(spark, monkeypatch):
    made = []
    real = jaccard._blocks
    monkeypatch.setattr(jaccard, "_blocks", lambda rows, cell: (lambda df: made.append(df.count()) or df)(real(rows, cell)))
    sets = template(10_000)
    found = jaccard.link_regions(as_regions(spark, sets), 75).collect()
    assert sum(made) < 16 * 10_000, made
    root = union(len(sets), [a for a, _ in found], [b for _, b in found])
    # by each set's nearest: those with few changes are one component, and the others are in it if any of it is alike
    core = np.flatnonzero(root == np.bincount(root).argmax())
    apart = np.setdiff1d(np.arange(len(sets)), core)[:60]
    for i in apart.tolist():
        inter = jaccard.held(sets[i], np.concatenate([sets[j] for j in core]), np.concatenate([[0], np.cumsum([len(sets[j]) for j in core])]))
        either = len(sets[i]) + np.array([len(sets[j]) for j in core]) - inter
        assert not (100 * inter >= 75 * either).any()


def test_other_columns_keep_their_names(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", "a", 5), (2, "one two three four five six", "b", 6)], "doc_id long, text string, _id string, key int")
    docs = docs.withColumn("class", F.lit("c")).withColumn("rest", F.lit(1)).withColumn("k", F.lit(0))
    assert [tuple(r) for r in jaccard.deduplicate(docs).collect()] == [(1, "one two three four five six", "a", 5, "c", 1, 0)]
