"""Counts kept up to date from a stream of papers, as files land. The batch operators do the work of each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.frequency import papers_per, postings, word_counts


def start_counts(papers: DataFrame, folder: str, checkpoint: str, time: str | None = None, delay: str = "7 days") -> StreamingQuery:
    """Append each micro-batch's counts, under its number, to Parquet tables below a folder; read_counts() sums them.

    A batch that is repeated after a failure overwrites its own files, so papers count once. Papers with an id that was seen are left out: with
    the name of a timestamp column, within its watermark and so with bounded state, else for good.
    """
    single = papers.withWatermark(time, delay).dropDuplicatesWithinWatermark(["doc_id"]) if time else papers.dropDuplicates(["doc_id"])

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        word_counts(postings(batch), "year", "month").write.mode("overwrite").parquet(f"{folder}/words/batch={number}")
        papers_per(batch, "year", "month").write.mode("overwrite").parquet(f"{folder}/papers/batch={number}")
        batch.unpersist()

    return single.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_counts(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    """(word, year, month, n) and (year, month, n_papers) over all batches so far."""
    words = spark.read.parquet(f"{folder}/words").groupBy("word", "year", "month").agg(F.sum("n").alias("n"))
    return words, spark.read.parquet(f"{folder}/papers").groupBy("year", "month").agg(F.sum("n_papers").alias("n_papers"))
