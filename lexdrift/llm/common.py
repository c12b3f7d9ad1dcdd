"""What the operators of this subpackage share: tables, Arrow buffers, written intermediate tables, bitmaps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: \x20 and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col: str | Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string")) % m, F.lit(-1))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Set here only where a local session, as of tests, names none; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


#: Intermediate tables that this driver has written and not dropped yet.
_written: list[str] = []


def written_tables() -> int:
    return len(_written)


def drop_tables(spark: SparkSession, since: int, keep: int = 1) -> None:
    """Delete the intermediate tables written from the since-th on, but for the last `keep`."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    gone = _written[since : max(since, len(_written) - keep)]
    for path in gone:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(jsc.hadoopConfiguration()).delete(at, True)
    _written[since : since + len(gone)] = []


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: its lineage ends there, and lost executors lose nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(jsc.hadoopConfiguration()).deleteOnExit(at)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(names: Iterable[str]) -> list[Column]:
    """Columns by their whole names, dots and backticks in them included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def packed(docs: DataFrame, *own: str) -> DataFrame:
    """The columns in `own`, and all others as one struct, `rest`, so that their names can't clash with those that an operator adds."""
    others = quoted(c for c in docs.columns if c not in own)
    return docs.select(*own, (F.struct(*others) if others else F.lit(None)).alias("rest"))


def unpacked(df: DataFrame, names: list[str], *own: str) -> DataFrame:
    """The columns `names` of packed() rows, those in `own` as they are now, and the other columns that df has by now."""
    more = [F.col(c) for c in df.columns if c not in (*own, "rest") and c not in names]
    return df.select(*[F.col(c) if c in own else F.col("rest")[c].alias(c) for c in names], *more)


def flat(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column (null: empty) and their offsets, without a copy where there are no nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `limit` bytes; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


def parts(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes in a column."""
    sizes = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(sizes), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for a, b in chunks(np.concatenate([[0], np.cumsum(sizes)]), limit):
        yield batch.slice(a, b - a)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values of a small array, sorted (np.unique takes several times as long)."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


#: Bits of a membership bitmap: 2 MB, whatever the input's size. A full one only filters less.
BITMAP_BITS = 1 << 24


def bitmap_slots(keys: np.ndarray) -> np.ndarray:
    """Bit of each 64-bit key."""
    return (mix64(keys.view(np.uint64)) >> np.uint64(40)).astype(np.int64)


def bitmap(df: DataFrame, key: str) -> np.ndarray:
    """A bitmap of the values of a bigint column, of fixed size: a pre-filter, to be followed by an exact join."""

    def run(batch):
        slot = np.unique(bitmap_slots(batch[key].to_numpy()))
        yield {"w": (slot >> 6).astype(np.int32), "bits": (np.uint64(1) << (slot & 63).astype(np.uint64)).view(np.int64)}

    words = map_arrow(df.select(key), run, "w int, bits long").groupBy("w").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITMAP_BITS // 64, np.uint64)
    if len(words):
        out[words["w"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


#: Rows that go to Python at a time. Spark's usual 10,000 texts fill buffers in the JVM and in Python.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches have BATCH_ROWS rows in this session, unless it has a setting of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with small batches; run gets all batches of a task."""
    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with a generator over batches; fn gets each batch and yields batches or dicts of columns."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for out in fn(batch):
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in ((out[f.name], f) for f in shape)], schema=shape)

    return map_batches(df, run, schema)
