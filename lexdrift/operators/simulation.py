"""Simulated texts with a known share of help, which the estimate should find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.estimate import smoothed, standard_error, usage


def draw(seed: int, *keys) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed)), 11).cast("double") / float(1 << 53)


def vocabulary(spark: SparkSession, words: int, seed: int = 1) -> DataFrame:
    """(word, p, helped): p ~ Gamma(2, 0.02) as the sum of two exponentials, and p (1 + d) with d uniform in [0.5, 5] as far as that stays at most 1."""
    w = F.col("id")
    p = F.least(-0.02 * (F.log(1 - draw(seed, w, F.lit(1))) + F.log(1 - draw(seed, w, F.lit(2)))), F.lit(0.6))
    top = F.least(F.lit(5.0), F.try_divide(F.lit(1.0), F.col("p")) - 1)
    d = 0.5 + draw(seed, F.col("word"), F.lit(3)) * (top - 0.5)
    return spark.range(words).select(w.alias("word"), p.alias("p")).withColumn("helped", F.col("p") * (1 + d))


def simulate(spark: SparkSession, words: int, texts: int, shares: list[float], cutoffs: list[float], seed: int = 1) -> DataFrame:
    """(share, cutoff, q, p, usage, gap, se): frequencies of the texts with any word rarer than the cutoff, before and after help.

    A text needs only its rarest word, so words x texts is aggregated by text as it is made; nothing of that size is kept.
    """
    v = F.broadcast(vocabulary(spark, words, seed))
    sides = F.broadcast(spark.createDataFrame([(float(s),) for s in shares], "share double"))
    t = spark.range(texts).select(F.col("id").alias("text"))
    before = t.crossJoin(v).where(draw(seed, F.col("text"), F.col("word"), F.lit(11)) < F.col("p"))
    before = before.groupBy("text").agg(F.min("p").alias("rarest"))
    after = t.crossJoin(sides).withColumn("with_help", draw(seed, F.col("text"), F.col("share"), F.lit(12)) < F.col("share"))
    after = after.crossJoin(v).where(draw(seed, F.col("text"), F.col("word"), F.col("share"), F.lit(13)) < F.when(F.col("with_help"), F.col("helped")).otherwise(F.col("p")))
    after = after.groupBy("share", "text").agg(F.min("p").alias("rarest"))
    c = F.broadcast(spark.createDataFrame([(float(x),) for x in cutoffs], "cutoff double"))
    n_before = before.join(c, F.col("rarest") < F.col("cutoff")).groupBy("cutoff").agg(F.count(F.lit(1)).alias("a"))
    n_after = after.join(c, F.col("rarest") < F.col("cutoff")).groupBy("share", "cutoff").agg(F.count(F.lit(1)).alias("b"))
    both = c.crossJoin(sides).join(n_before, "cutoff", "left").join(n_after, ["share", "cutoff"], "left")
    n = F.lit(texts).cast("long")
    both = both.select("share", "cutoff", smoothed(F.coalesce("b", F.lit(0)), n).alias("q"), smoothed(F.coalesce("a", F.lit(0)), n).alias("p"))
    both = both.withColumn("usage", usage(F.col("q"), F.col("p"))).withColumn("gap", F.col("q") - F.col("p"))
    return both.withColumn("se", standard_error(F.col("p"), F.col("q"), n, "binomial"))


def recovered(simulated: DataFrame, most_p: float = 0.999, most_se: float = 0.025) -> DataFrame:
    """Per share the greatest usage among the cutoffs with p and its error small enough."""
    good = simulated.where((F.col("p") < most_p) & (F.col("se") < most_se))
    return good.groupBy("share").agg(F.max("usage").alias("usage"), F.max_by("gap", "usage").alias("gap"), F.max_by("cutoff", "usage").alias("cutoff"))
