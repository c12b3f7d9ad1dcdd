"""Exact quantiles without a group's values in one buffer: ranges of values are counted, and only the range that holds a rank is looked into."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.corpus import materialised

#: Ranges that an interval is divided into in each pass. Whole numbers up to 10^9 take three passes.
RANGES = 1024
#: Wanted ranks (groups times shares times two) up to which they are broadcast; beyond, values and ranks meet by group.
FEW = 100_000


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float], ranges: int = RANGES) -> DataFrame:
    """(keys, share, quantile): the quantiles of whole numbers for each of the keys, interpolated between the two nearest ranks. Null values don't count.

    Each pass counts the values of the intervals that hold a wanted rank by range, `ranges` rows for each interval at most, and narrows the
    intervals to one range, until they are one value wide. Keys are taken as they are, null among them.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(value).cast("long").alias("v"))
    ks = [f"k{i}" for i in range(len(keys))]
    bounds = rows.groupBy(*ks).agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count(F.lit(1)).alias("n"))
    share = F.explode(F.array(*[F.lit(float(s)) for s in shares]))
    asked = bounds.withColumn("share", share).withColumn("at", (F.col("n") - 1) * F.col("share"))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor("at").alias("rank")), F.struct(F.lit(1).alias("side"), F.least(F.floor("at") + 1, F.col("n") - 1).alias("rank"))))
    asked = materialised(asked.withColumn("x", sides).select(*ks, "share", (F.col("at") - F.floor("at")).alias("part"), "x.side", "x.rank", "a", "b"))
    while True:
        widest, n = asked.agg(F.max(F.col("b") - F.col("a")), F.count(F.lit(1))).first()
        if not widest:
            break
        small = F.broadcast if n <= FEW else lambda df: df  # by a broadcast the values stay where they are
        width = F.ceil((F.col("b") - F.col("a") + 1) / ranges)
        open_ = asked.where("b > a").select(*ks, "a", "b").distinct().select(*[F.col(k).alias(f"_{k}") for k in ks], "a", "b")
        same = F.lit(True)
        for k in ks:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        inside = rows.join(small(open_), same & F.col("v").between(F.col("a"), F.col("b")))
        counts = inside.groupBy(*ks, "a", "b", F.floor((F.col("v") - F.col("a")) / width).alias("r")).agg(F.count(F.lit(1)).alias("c"))
        upto = Window.partitionBy(*ks, "a", "b").orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = counts.withColumn("to", F.sum("c").over(upto)).select(*[F.col(k).alias(f"_{k}") for k in ks], F.col("a").alias("_a"), F.col("b").alias("_b"), "r", "c", "to")
        hit = same & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")) & (F.col("rank") < F.col("to")) & (F.col("rank") >= F.col("to") - F.col("c"))
        done = asked.where("b = a")
        low = F.col("a") + F.col("r") * width
        moved = asked.where("b > a").join(counts, hit).select(*ks, "share", "part", "side", (F.col("rank") - (F.col("to") - F.col("c"))).alias("rank"), low.alias("a"), F.least(low + width - 1, "b").alias("b"))
        asked = materialised(done.unionByName(moved))
    ends = asked.groupBy(*ks, "share", "part").agg(F.max(F.when(F.col("side") == 0, F.col("a"))).alias("low"), F.max(F.when(F.col("side") == 1, F.col("a"))).alias("high"))
    value_ = F.col("low") + F.col("part") * (F.col("high") - F.col("low"))
    return ends.select(*[F.col(k).alias(name) for k, name in zip(ks, keys, strict=True)], "share", value_.cast("double").alias("quantile"))
