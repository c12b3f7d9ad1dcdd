"""From documents to token ids: quality, line dedup, near-duplicate documents, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexdrift.llm import jaccard, lines, mixing, pieces, quality
from lexdrift.llm.common import drop_tables, fold, materialise, packed, table, unpacked, written_tables


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from the labels of the folds that aren't held out."""
    labels = table(spark, sf_dir, "labels")
    return quality.accepted(docs, quality.fit(docs, labels.where(fold("doc_id", 5) != 0)))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of alike lines, one stays in one document. Documents stay, with n_chars of the text that is left."""
    out = unpacked(lines.deduplicate(packed(docs, "doc_id", "text")), docs.columns, "doc_id", "text")  # whatever the other columns are called
    length = F.length("text").cast(dict(docs.dtypes).get("n_chars", "long"))
    return out.select(*[length.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays."""
    return jaccard.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.apply(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each taken document, and digests of them and of the text they decode to."""
    return pieces.round_trip(docs, with_ids=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("n-gram jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("sentencepiece round trip", encode_pieces),
]

#: Learned scores, MinHash and seeded draws have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; a stage's own tables go when its result is written."""
    before = written_tables()
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs)
            drop_tables(spark, before)
    return docs
