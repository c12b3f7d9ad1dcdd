"""Tables that are kept up to date: files are parsed once, and rows are merged by key. What hasn't changed isn't read or written again."""

from __future__ import annotations

import os
import uuid
from collections import Counter
from collections.abc import Callable
from functools import reduce
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .corpus import materialised, shared_folder

#: The directory of rows without a segment, as Spark's writers call it.
NONE = "__HIVE_DEFAULT_PARTITION__"
MANIFEST = "path string, length long, modified timestamp, segment string"


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


#: Tasks for each core that files are dealt to, and bytes of files that a task has at most if those don't suffice. Spark's own tasks have 32 small files each.
DEALT, TASK_BYTES = 4, 64 << 20


def dealt(files: DataFrame, size: int = 0) -> DataFrame:
    """Rows of many small files in so few tasks that files, not tasks, take the time."""
    return files.coalesce(max(DEALT * files.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))


def listing(spark: SparkSession, folder: str, glob: str = "PMC*.xml", pattern: str = r"PMC\d{6,8}.xml", content: bool = False) -> DataFrame:
    """(path, length, modified, segment) of the files below a folder; the segment is the directory that a file is in. No file is opened, unless content is asked for and used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    found = files.where(name.rlike(f"^(?:{pattern})")).select("path", "length", F.col("modificationTime").alias("modified"), *["content"] * content)
    return found.withColumn("segment", _segment())


def land(rows: DataFrame, folder: str) -> None:
    """A file named part-*.txt for each row (content, segment), in the directory of its segment below a folder; files that are there stay.

    In a local folder, Hadoop starts two processes for each file it writes, to set permissions of the file and of its checksum. There the tasks write the files
    themselves; to other stores, Spark's writer does.
    """
    own, at = uuid.uuid4().hex, urlparse(folder)
    if at.scheme not in ("", "file"):
        # the tasks move their files into place; else the driver would, one by one
        out = rows.select(F.col("content").cast("string"), "segment").write.mode("append").partitionBy("segment").option("maxRecordsPerFile", 1)
        out.option("mapreduce.fileoutputcommitter.algorithm.version", "2").option("lineSep", "\n").text(folder)
        return
    top = unquote(at.path) if at.scheme else folder

    def run(batches):
        task, n = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for content, segment in zip(batch["content"], batch["segment"].to_pylist(), strict=True):
                to = f"{top}/segment={NONE if segment is None else segment}"
                if not n[segment]:
                    os.makedirs(to, exist_ok=True)
                name = f"part-{own}-{task:05d}-{n[segment]:07d}.txt"
                n[segment] += 1
                with open(f"{to}/.{name}", "wb") as file:
                    file.write(content.as_buffer() or b"")
                os.replace(f"{to}/.{name}", f"{to}/{name}")
        yield pa.RecordBatch.from_pydict({"n": [n.total()]}, schema=pa.schema([("n", pa.int64())]))

    # in order, so that a file has the same content whichever attempt of its task writes it
    rows.select("content", "segment").sortWithinPartitions("segment", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def _replace_partitions(spark: SparkSession, rows: DataFrame, path: str, *keys: str) -> None:
    """Write rows over the partitions that they have rows of, and no others. They go to a folder beside the table first, as they may come from it."""
    staged = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    rows.write.parquet(staged)
    kept = spark.read.schema(rows.schema).parquet(staged)
    # rows are dealt by partition, and a large one is split over several tasks
    kept.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    fs, at = _fs(spark, staged)
    fs.delete(at, True)


def _drop_partitions(spark: SparkSession, path: str, key: str, values: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    fs, _ = _fs(spark, path)
    for v in values:
        name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(v)
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{key}={name}"), True)


def _segment() -> Column:
    """The directory that a file is in, without the key of a partitioned layout (key=value)."""
    return F.element_at(F.split(F.element_at(F.split("path", "/"), -2), "="), -1)


def ingest(spark: SparkSession, folder: str, table: str, parse: Callable[[DataFrame], DataFrame], replace: bool = False, glob: str = "PMC*.xml", pattern: str = r"PMC\d{6,8}.xml") -> dict[str, int]:
    """Bring a table, partitioned by segment, up to date with the files of a folder: {"segments", "files", "gone"} that were read, and segments that went.

    A manifest beside the table has path, length and time of the files that made it. Segments whose files are all as they were are skipped, or
    read again as well if replace says so; of others, all files are parsed, and only their partitions of table and manifest are rewritten. parse
    gets rows (path, content, segment) and returns rows with segment. The manifest is written last: after a failure, a segment is read again.
    """
    manifest = f"{table}.manifest"
    found = listing(spark, folder, glob, pattern, True)
    now = materialised(dealt(found.drop("content")))  # files are looked at once
    old = spark.read.schema(MANIFEST).parquet(manifest) if exists(spark, manifest) else spark.createDataFrame([], MANIFEST)
    same = ["path", "length", "modified", "segment"]
    if replace:
        touched = now.select("segment").distinct()
    else:
        touched = now.join(old, same, "left_anti").unionByName(old.join(now, same, "left_anti")).select("segment").distinct()
    # the directories of a listing, not its files: as many as the packages of a release
    changed, there = {r[0] for r in touched.collect()}, {r[0] for r in now.select("segment").distinct().collect()}
    gone = {r[0] for r in old.select("segment").distinct().collect()} - there
    due = sorted(changed & there)
    files = 0
    if due:
        read = now.where(F.col("segment").isin(due))
        files, size = read.agg(F.count(F.lit(1)), F.sum("length")).first()
        content = found  # its list of files is in the driver's memory
        if there - changed:
            paths = [p.rsplit("/", 1)[0] for _, p in read.groupBy("segment").agg(F.min("path")).collect()]
            content = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(paths)
            content = content.where(F.element_at(F.split("path", "/"), -1).rlike(f"^(?:{pattern})")).withColumn("segment", _segment())
        content = content.select("path", "content", "segment")
        _replace_partitions(spark, parse(dealt(content, size)), table, "segment")
        _replace_partitions(spark, read, manifest, "segment")
    if gone:
        for path in (table, manifest):
            _drop_partitions(spark, path, "segment", sorted(gone))
    return {"segments": len(due), "files": files, "gone": len(gone)}


def bucket(key: Column, buckets: int) -> Column:
    """The bucket of a key; null keys have bucket 0."""
    return F.coalesce(F.pmod(F.xxhash64(key), buckets), F.lit(0)).cast("int")


def upsert(spark: SparkSession, table: str, rows: DataFrame, key: str, period: str, *order: Column, buckets: int = 8, newest: bool = False) -> int:
    """Merge rows into a table by key, in the parts of the table (period, bucket of the key) that they have rows of; the number of those parts.

    Of equal keys in a period, the row that is there stays, or the new one if newest says so; of several new ones the first in the given order. Rows with a null
    key are all kept. Parts without new rows aren't read, and their files stay as they are. The table is in buckets of the key, so that a part is as large as a task can take.
    """
    new = rows.withColumn("bucket", bucket(F.col(key), buckets))
    parts = sorted(tuple(r) for r in new.select(period, "bucket").distinct().collect())  # periods times buckets at most
    if not parts:
        return 0
    age = F.lit(1 if newest else 2)
    merged = new.withColumn("_age", age)
    if exists(spark, table):
        here = reduce(Column.__or__, [(F.col(period) == p) & (F.col("bucket") == b) for p, b in parts])
        old = spark.read.parquet(table).where(here).withColumn("_age", F.lit(2 if newest else 1))
        merged = old.unionByName(merged, allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy(period, "bucket", key).orderBy("_age", *order))
    told = merged.where(F.col(key).isNotNull()).withColumn("_k", first).where("_k = 1").drop("_k")
    _replace_partitions(spark, told.unionByName(merged.where(F.col(key).isNull())).drop("_age"), table, period, "bucket")
    return len(parts)


def merged(spark: SparkSession, table: str) -> DataFrame:
    """The rows of a table that upsert() keeps."""
    return spark.read.parquet(table).drop("bucket")
