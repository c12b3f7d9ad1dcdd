import pytest
from helpers import documents
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

import __spark_entry__ as driver  # noqa: E402
from lexdrift.llm import jaccard, lines, mixing, pieces, registry  # noqa: E402
from lexdrift.llm.common import materialise  # noqa: E402


def test_names():
    names = [n for n in registry.MODULES if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert set(driver.oracle_sql()) <= set(driver.queries()) and "pipeline" in driver.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram jaccard join", "mixing sources", "sentencepiece round trip"]


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, docs
    outs = []
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, small))
        outs.append(docs)
    good, cut, single, mixed, encoded = outs
    assert all(x.columns == columns for x in outs[:-1])
    assert good.exceptAll(before).count() == 0 and 0.7 * before.count() < good.count() < before.count()
    assert cut.count() == good.count() and cut.where("n_chars <> length(text)").count() == 0
    assert lines.clusters(cut).count() == 0
    components = jaccard.join(cut).select("component_id").distinct()
    assert single.count() == components.count()
    taken = mixing.mix(single).agg(F.sum("taken")).first()[0]
    assert mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == taken
    assert encoded.count() == mixed.count()
    assert encoded.select("n_tokens").exceptAll(pieces.round_trip(mixed).select("n_tokens")).count() == 0


def test_odd_documents(spark, small):
    names = ("n_lines", "kept_in", "size", "copies", "component_id", "predicted", "class", "n")
    docs = documents(spark).select("*", *[F.lit("mine").alias(c) for c in names])
    for data in (docs, docs.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = materialise(stage(spark, data, small))
            assert (out.count() > 0) == (data.count() > 0)
            if k < 4:
                assert out.columns == docs.columns
                for c in names:
                    assert out.where(F.col(c) != "mine").count() == 0
            data = out


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
