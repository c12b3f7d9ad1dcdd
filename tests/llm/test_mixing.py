import re

import pytest
from helpers import documents, empty
from pyspark.sql import functions as F

from lexdrift.llm import mixing


def water(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Targets by giving away the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    total = sum(sizes.values())
    target = {s: share * total * w[s] / sum(w.values()) for s in order}
    full = set()
    while True:
        over = {s for s in order if s not in full and target[s] > cap * sizes[s] + 1e-9}
        if not over:
            return target
        excess = sum(target[s] - cap * sizes[s] for s in over)
        full |= over
        for s in over:
            target[s] = cap * sizes[s]
        rest = sum(w[s] for s in order if s not in full)
        for s in order:
            if s not in full:
                target[s] += excess * w[s] / rest


def test_mix(spark):
    docs = documents(spark, 400)
    got = mixing.mix(docs).collect()
    sizes, taken = {}, {}
    texts = {}
    for r in docs.collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        texts.setdefault(r.doc_id, set()).add(n)
        sizes[r.source] = sizes.get(r.source, 0) + n
    exp = water(sizes)
    assert len(got) == docs.count()
    for r in got:
        assert r.size in texts[r.doc_id] and r.source_size == sizes[r.source] and r.target == pytest.approx(exp[r.source])
        assert r.taken % max(1, r.size) == 0 and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in exp.items():
        assert abs(taken[s] - t) <= 0.05 * sizes[s] + 5
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)


def test_groups_fold_up_a_tree(spark):
    units = spark.range(5000).select(F.lit("a").alias("source"), F.col("id").alias("doc_id"), (F.col("id") % 50 + 1).alias("size"), F.lit(0.3).alias("p"), F.lit(5000).alias("n"))
    got = mixing.rounded(units, 5000, group=8).collect()
    assert sorted(r.doc_id for r in got) == list(range(5000))
    assert abs(sum(r.size * r.chosen for r in got) - 0.3 * sum(r.size for r in got)) <= 50


def test_means_are_kept(spark):
    units = spark.range(12).select(F.lit("a").alias("source"), F.col("id").alias("doc_id"), (F.col("id") * 3 + 1).alias("size"), F.lit(0.25).alias("p"), F.lit(12).alias("n"))
    n = [0] * 12
    for seed in range(40):
        for r in mixing.rounded(units, 12, seed=seed * 7919, group=4).collect():
            n[r.doc_id] += r.chosen
    assert 0.15 < sum(n) / 480 < 0.35


def test_apply(spark):
    docs = documents(spark, 90)
    got = mixing.apply(docs)
    assert got.columns == docs.columns
    expected = {}
    for r in mixing.mix(docs).collect():
        expected[r.doc_id] = expected.get(r.doc_id, 0) + r.taken
    found = {}
    for r in got.collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert found == {k: v for k, v in expected.items() if v}
    assert mixing.mix(empty(spark)).count() == 0 and mixing.apply(empty(spark)).count() == 0


def test_repeated_rows_are_units_of_their_own(spark):
    """Many equal rows are dealt over groups, and the mix takes some of them."""
    rows = spark.range(30_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("a").alias("source"))
    docs = rows.unionByName(spark.createDataFrame([(k, f"word {k}", "b") for k in range(300)], "doc_id long, text string, source string"))
    got = mixing.mix(docs).groupBy("source", "target").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("n")).collect()
    assert {r.source: r.n for r in got} == {"a": 30_000, "b": 300}
    assert all(abs(r.taken - r.target) <= 6 for r in got)
    assert mixing.apply(docs).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).orderBy("source").collect() == sorted((r.source, r.taken) for r in got)


def test_targets_of_many_sources(spark):
    sizes = {f"s{k:04}": k % 97 + 1 for k in range(700)} | {None: 40}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    exp = water(sizes)
    assert len(got) == 701 and all(r.target == pytest.approx(exp[r.source]) for r in got)


def test_other_columns_keep_their_names(spark):
    docs = documents(spark, 45).select("doc_id", "text", "source", *[F.lit("mine").alias(c) for c in ("_id", "_size", "_k", "_copy", "size", "copies", "m", "rest", "own_source", "n")])
    got = mixing.apply(docs)
    assert got.columns == docs.columns and got.count() > 0 and got.select("_id", "_size", "_k", "_copy", "size", "copies", "m", "rest", "own_source", "n").distinct().count() == 1
