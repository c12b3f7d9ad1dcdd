"""Sweeps over frequency cutoffs of marker words, and the choice of the best one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.estimate import binomial_variance, smoothed, standard_error, usage
from .frequency import regression


def cutoff_table(spark, cutoffs: list[float]) -> DataFrame:
    """A few dozen rows (cutoff, step)."""
    return F.broadcast(spark.createDataFrame([(float(c), k) for k, c in enumerate(sorted(cutoffs))], "cutoff double, step int"))


def cutoff_lists(frequencies: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """(cutoff, step, word) of the words (word, freq) rarer than each cutoff: a range join with the small table of cutoffs."""
    return frequencies.join(cutoffs, F.col("freq") < F.col("cutoff")).select("cutoff", "step", *[c for c in frequencies.columns if c not in ("freq", "cutoff", "step")])


def sweep(rows: DataFrame, frequencies: DataFrame, cutoffs: DataFrame, periods: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Smoothed frequency, per cutoff and year (and section or the like, `by`), of papers with a word rarer than the cutoff.

    The lists are nested, so a paper counts for each cutoff above its rarest marker word: one aggregation by paper serves all cutoffs.
    frequencies has the marker words (word, freq) of each `by`; periods the papers of each year and `by`.
    """
    rarest = rows.join(F.broadcast(frequencies), ["word", *by]).groupBy("doc_id", "year", *by).agg(F.min("freq").alias("rarest"))
    return sweep_rarest(rarest, cutoffs, periods, by)


def sweep_rarest(rarest: DataFrame, cutoffs: DataFrame, periods: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """sweep() of papers (year, by) whose rarest marker word is known (rarest, its frequency; null: none). Nothing but counts is shuffled."""
    counted = rarest.where("rarest is not null").groupBy("rarest", "year", *by).agg(F.count(F.lit(1)).alias("_c"))
    # each count goes to the first cutoff above its rarest word; the sums over lower cutoffs are of a few hundred rows
    steps = cutoffs.withColumn("low", F.coalesce(F.lag("cutoff").over(Window.orderBy("step")), F.lit(float("-inf"))))
    first = counted.join(F.broadcast(steps), (F.col("rarest") < F.col("cutoff")) & (F.col("rarest") >= F.col("low")))
    n = first.groupBy("step", "year", *by).agg(F.sum("_c").alias("_n"))
    dense = F.broadcast(cutoffs).crossJoin(F.broadcast(periods)).join(n, ["step", "year", *by], "left")
    upto = Window.partitionBy("year", *by).orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dense = dense.withColumn("n", F.sum(F.coalesce("_n", F.lit(0).cast("long"))).over(upto)).drop("_n")
    return dense.withColumn("freq", smoothed(F.col("n"), F.col("n_papers")))


def estimated(swept: DataFrame, key: list[str], end: int, length: int) -> DataFrame:
    """The sweep with projection, sdev, gap, usage and its errors."""
    out = regression(swept, key, "year", "freq", end, length)
    out = out.withColumn("usage", usage(F.col("freq"), F.col("projection")))
    out = out.withColumn("binomial_var", binomial_variance(F.col("freq"), F.col("n_papers")))
    return out.withColumn("se", standard_error(F.col("projection"), F.col("freq"), F.col("n_papers"), "regression", F.col("sdev")))


def without_saturated(rows: DataFrame, key: str = "step", most: float = 0.999, by: tuple[str, ...] = ()) -> DataFrame:
    """Only cutoffs whose projection stays below `most` in every year."""
    return rows.withColumn("_top", F.max("projection").over(Window.partitionBy(key, *by))).where(F.col("_top") < most).drop("_top")


def prefix(rows: DataFrame, most_se: float | Column = 0.025, by: tuple[str, ...] = ()) -> DataFrame:
    """Per year the cutoffs before the first whose error exceeds most_se."""
    first_bad = F.min(F.when(F.col("se") > most_se, F.col("step"))).over(Window.partitionBy("year", *by))
    return rows.withColumn("_bad", first_bad).where(F.col("_bad").isNull() | (F.col("step") < F.col("_bad"))).drop("_bad")


def optimum(rows: DataFrame, most_se: float | Column = 0.025, by: tuple[str, ...] = ()) -> DataFrame:
    """Per year the cutoff with the greatest usage, the lowest of those equal to nine decimals, among those before the first whose error exceeds most_se."""
    rank = F.row_number().over(Window.partitionBy("year", *by).orderBy(F.round("usage", 9).desc(), F.asc("step")))
    return prefix(rows, most_se, by).withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def neighbours(cutoffs: DataFrame) -> DataFrame:
    """Each cutoff with the one and the two steps lower; null where there is none."""
    w = Window.orderBy("step")  # the table of cutoffs, a few dozen rows
    return cutoffs.select("cutoff", "step", F.lag("cutoff", 1).over(w).alias("lower"), F.lag("cutoff", 2).over(w).alias("second_lower"))


def chosen_lists(winner: DataFrame, lists: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, kind, cutoff, word): the words of the winning cutoff (opt) and of those one and two steps lower (subopt, subsubopt), where there are any."""
    kinds = F.array(*[F.struct(F.lit(name).alias("kind"), F.lit(k).alias("down")) for k, name in enumerate(("opt", "subopt", "subsubopt"))])
    wanted = winner.select(*by, "step").distinct().withColumn("x", F.explode(kinds)).select(*by, F.col("x.kind").alias("kind"), (F.col("step") - F.col("x.down")).alias("step"))
    return lists.join(F.broadcast(wanted), ["step", *by]).select(*by, "kind", "cutoff", "word")
