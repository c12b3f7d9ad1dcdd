"""The incidence matrix of papers and words: a dictionary with dense ids, one row of ids for each paper, and blocks of rows in compressed form.

Ids follow the order of the words, rows that of the papers. Both are ranked by ranges: each range counts its own, and what has to be added up in order is one
number for each range. A block holds BLOCK papers, so that its arrays fit a task, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.corpus import materialised

#: Papers of a block.
BLOCK = 4096


def dense_ranks(keys: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): distinct keys with their places from 0 in the order of the key, nulls first."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialised(keys.select(key).distinct().repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return dealt.join(F.broadcast(before), "_part").select(key, (F.col("_before") + place).cast("long").alias(name))


def dictionary(rows: DataFrame) -> DataFrame:
    """(word, word_id) of the words of postings, by alphabet."""
    return dense_ranks(rows, "word", "word_id")


def incidence(papers: DataFrame, words: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, row, ids): of each paper (key, words) its row and the sorted ids of its words, by a dictionary (word, word_id); empty without any."""
    coded = papers.select(key, F.explode("words").alias("word")).join(words, "word").groupBy(key).agg(F.sort_array(F.collect_list("word_id")).alias("ids"))
    found = dense_ranks(papers, key, "row").join(coded, key, "left")
    return found.select(key, "row", F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"))


def blocks(matrix: DataFrame, key: str = "doc_id", size: int = BLOCK) -> DataFrame:
    """(block, keys, starts, ids): `size` rows each; the ids of the k-th row of a block are those from starts[k] up to starts[k + 1]."""
    rows = matrix.groupBy(F.floor(F.col("row") / size).alias("block")).agg(F.sort_array(F.collect_list(F.struct("row", F.col(key).alias("key"), "ids"))).alias("_rows"))
    counts = F.transform("_rows", lambda r: F.size(r["ids"]))
    starts = F.aggregate(counts, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    return rows.select("block", F.transform("_rows", lambda r: r["key"]).alias("keys"), starts.alias("starts"), F.flatten(F.transform("_rows", lambda r: r["ids"])).alias("ids"))


def column_sums(packed: DataFrame) -> DataFrame:
    """(word_id, n): the papers of each word, summed up block by block before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["ids"].flatten().to_numpy(zero_copy_only=False)
            found, n = np.unique(ids, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], names=["word_id", "n"])

    return packed.select("ids").mapInArrow(run, "word_id long, n long").groupBy("word_id").agg(F.sum("n").alias("n"))


def write_matrix(papers: DataFrame, path: str, key: str = "doc_id", size: int = BLOCK) -> None:
    """Dictionary, blocks below a path. Papers (key, words) have distinct keys."""
    words = dictionary(papers.select(F.explode("words").alias("word")))
    words.write.mode("overwrite").parquet(f"{path}/words")
    blocks(incidence(papers, papers.sparkSession.read.parquet(f"{path}/words"), key), key, size).write.mode("overwrite").parquet(f"{path}/blocks")


def read_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The dictionary and the blocks that write_matrix() wrote."""
    return spark.read.parquet(f"{path}/words"), spark.read.parquet(f"{path}/blocks")
