"""Columns of any name go through the stages that keep them."""

import pytest
from helpers import documents
from pyspark.sql import functions as F

from lexdrift.llm import jaccard, lines, mixing


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, 45, odd=False).withColumn("a.b", F.col("at") * 2).withColumn("c`d e", F.lit("x")).withColumn("rest", F.lit(1))


def kept(df):
    return {(r["doc_id"], r["at"], r["a.b"], r["c`d e"]) for r in df.collect()}


@pytest.mark.parametrize("stage", [lines.deduplicate, jaccard.deduplicate, mixing.apply], ids=["lines", "jaccard", "mixing"])
def test_names_with_dots_and_backticks(odd, stage):
    out = stage(odd)
    assert set(odd.columns) <= set(out.columns)
    assert kept(out) <= kept(odd) and out.count() > 0
    assert all(r["a.b"] == r["at"] * 2 for r in out.collect())
