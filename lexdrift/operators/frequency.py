"""Postings, counts and smoothed frequencies per word, group and period."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.estimate import ratio, smoothed
from ..functions.text import tokens


#: A fit that leaves no more than this share of the variance is exact.
EXACT = 1e-9


def postings(papers: DataFrame, keep: tuple[str, ...] = ("doc_id", "year", "month"), words: list[str] | None = None) -> DataFrame:
    """A row for each paper and distinct word in its `words`, or in its abstract where it has none. A list of words is applied before the arrays are exploded."""
    found = F.col("words") if "words" in papers.columns else tokens(F.col("abstract"))
    if words is not None:
        found = F.array_intersect(found, F.array(*[F.lit(w) for w in words]))
    return papers.select(*keep, F.explode(found).alias("word"))


def document_frequency(rows: DataFrame, papers: DataFrame | None = None, least_share: float = 0.0) -> DataFrame:
    """(word, doc_freq), of words in at least a share of the papers."""
    df = rows.groupBy("word").agg(F.count(F.lit(1)).alias("doc_freq"))
    if papers is None or not least_share:
        return df
    return df.crossJoin(F.broadcast(papers.agg(F.count(F.lit(1)).alias("_n")))).where(F.col("doc_freq") >= least_share * F.col("_n")).drop("_n")


#: Buckets of the sketch that sorts out rare words, whatever the size of the corpus.
BUCKETS = 1 << 20


def frequent(rows: DataFrame, papers: DataFrame, least_share: float = 1e-6, buckets: int = BUCKETS) -> DataFrame:
    """(word, doc_freq) of the words in at least a share of the papers, as document_frequency() gives them, without a shuffle of the rare ones.

    Tasks count postings by a hash of the word first, in a fixed number of buckets whose sums are merged. No word is in more papers than its bucket has postings, so
    words of buckets below the floor are out before they are counted one by one, and no word above it is lost. The full buckets, a bounded number, are broadcast.
    """
    at = F.pmod(F.xxhash64("word"), F.lit(buckets)).alias("_at")
    n = F.broadcast(papers.agg((F.count(F.lit(1)) * least_share).alias("_least")))
    sketch = rows.groupBy(at).agg(F.count(F.lit(1)).alias("_c")).crossJoin(n).where(F.col("_c") >= F.col("_least")).select("_at")
    left = rows.select("word", at).join(F.broadcast(sketch), "_at", "left_semi")
    return left.groupBy("word").agg(F.count(F.lit(1)).alias("doc_freq")).crossJoin(n).where(F.col("doc_freq") >= F.col("_least")).drop("_least")


def papers_per(papers: DataFrame, *period: str) -> DataFrame:
    return papers.groupBy(*period).agg(F.count(F.lit(1)).alias("n_papers"))


def word_counts(rows: DataFrame, *period: str) -> DataFrame:
    return rows.groupBy("word", *period).agg(F.count(F.lit(1)).alias("n"))


def calendar(papers: DataFrame, first: int, last: int, monthly: bool = False) -> DataFrame:
    """Every period of the years, with its number of papers (0 where there are none). At most 12 rows a year."""
    spark = papers.sparkSession
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    keys = ["year", "month"] if monthly else ["year"]
    if monthly:
        years = years.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return years.join(papers_per(papers, *keys), keys, "left").withColumn("n_papers", F.coalesce("n_papers", F.lit(0).cast("long")))


def calendar_of(papers: DataFrame, first: int, last: int, key: str) -> DataFrame:
    """calendar() of each value of a key, such as the sections: every year of each."""
    years = papers.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    n = papers.groupBy(key, "year").agg(F.count(F.lit(1)).alias("n_papers"))
    return n.select(key).distinct().crossJoin(F.broadcast(years)).join(n, [key, "year"], "left").withColumn("n_papers", F.coalesce("n_papers", F.lit(0).cast("long")))


def grid(counts: DataFrame, keys: list[str], periods: DataFrame, period: tuple[str, ...] = ("year",), known: DataFrame | None = None) -> DataFrame:
    """All keys (those known, or that have counts) in all periods, with n = 0 where there is no count, and the smoothed frequency."""
    dense = (counts.select(*keys).distinct() if known is None else known.select(*keys)).crossJoin(F.broadcast(periods))
    out = dense.join(counts, [*keys, *period], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out.withColumn("freq", smoothed(F.col("n"), F.col("n_papers")))


def yearly(rows: DataFrame, first: int, last: int, keys: tuple[str, ...] = ("word",)) -> DataFrame:
    """(keys, doc_freq, year, n) for all years of each key, with zeros: one aggregation by key that counts the years side by side."""
    each = [F.count_if(F.col("year") == y) for y in range(first, last + 1)]
    wide = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("doc_freq"), F.array(*each).alias("_n"))
    return wide.select(*keys, "doc_freq", F.posexplode("_n").alias("_at", "n")).select(*keys, "doc_freq", (F.col("_at") + first).cast("int").alias("year"), "n")


def monthly(rows: DataFrame, first: int, last: int, keys: tuple[str, ...] = ("word",)) -> DataFrame:
    """(keys, i, n) for all months from first to last (period_index()) of each key, with zeros, counted side by side as yearly() does."""
    at = period_index(F.col("year"), F.col("month"))
    counts = rows.where(at.between(first, last)).groupBy(*keys, (at - first).cast("int").alias("_i")).agg(F.count(F.lit(1)).alias("_n"))
    found = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_i", "_n"))).alias("_m"))  # a month each at most
    dense = F.transform(F.sequence(F.lit(0), F.lit(last - first)), lambda i: F.coalesce(F.element_at("_m", i), F.lit(0).cast("long")))
    return found.select(*keys, F.posexplode(dense).alias("_at", "n")).select(*keys, (F.col("_at") + first).cast("long").alias("i"), "n")


def with_frequency(counts: DataFrame, periods: DataFrame, *period: str) -> DataFrame:
    """Counts (n) with the papers of their period and the smoothed frequency."""
    return counts.join(F.broadcast(periods), list(period)).withColumn("freq", smoothed(F.col("n"), F.col("n_papers")))


def group_hits(papers: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """papers (words) with a column for each group: whether the paper has a word of its list, by the paper's own array."""
    return papers.select("*", *[F.arrays_overlap("words", F.array(*[F.lit(w) for w in sorted(words)]).cast("array<string>")).alias(name) for name, words in groups.items()])


def marked(papers: DataFrame, markers: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """papers without their words, with `rarest`, the frequency of their rarest marker word (null: none), and a column for each group: whether they have a word of it.

    markers has (word, freq, grp). It is a list, published or bounded as one, so it is broadcast: postings meet it where they are, and are added up by paper once.
    """
    own = [c for c in papers.columns if c != "words"]
    rows = papers.withColumn("_row", F.monotonically_increasing_id()).select("_row", *own, F.explode_outer("words").alias("word"))
    found = rows.join(F.broadcast(markers.select("word", "freq", "grp")), "word", "left")
    flags = [F.coalesce(F.bool_or(F.col("grp") == g), F.lit(False)).alias(g) for g in groups]
    return found.groupBy("_row", *own).agg(F.min("freq").alias("rarest"), *flags).drop("_row")


def flag_frequency(papers: DataFrame, flags: list[str], periods: DataFrame, *period: str) -> DataFrame:
    """(grp, period, n, n_papers, freq): papers for which each flag column holds, in all periods. Nothing but the counts is shuffled."""
    n = papers.groupBy(*period).agg(*[F.count_if(F.col(g)).alias(g) for g in flags])
    wide = periods.join(n, list(period), "left").na.fill(0, flags)
    return wide.unpivot([*period, "n_papers"], flags, "grp", "n").withColumn("freq", smoothed(F.col("n"), F.col("n_papers")))


def group_frequency(papers: DataFrame, groups: dict[str, list[str]], periods: DataFrame, *period: str) -> DataFrame:
    """(grp, period, n, n_papers, freq): papers (words) with at least one word of each group's list, in all periods."""
    return flag_frequency(group_hits(papers.select(*period, "words"), groups), list(groups), periods, *period)


def yearly_mean(monthly: DataFrame, *keys: str) -> DataFrame:
    """Mean of the monthly frequencies of each year, which isn't the frequency of the year."""
    return monthly.groupBy(*keys, "year").agg(F.avg("freq").alias("mean_freq"))


def mean_series(rows: DataFrame, months: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """(key, means): for all keys of postings (key, year, month), or words of papers (words, year, month), the means of the monthly frequencies of each year from first to last as one array, without a grid of months.

    A month adds (n + 1) / (n_papers + 1): what the year's months add without any count is a constant, and each posting adds 1 / (n_papers + 1).
    """
    share = months.select("year", "month", (1 / (F.col("n_papers") + 1)).alias("_share"))
    base = share.where(F.col("year").between(first, last)).groupBy("year").agg(F.avg("_share").alias("base"), F.count(F.lit(1)).alias("months"))
    base = base.agg(F.sort_array(F.collect_list(F.struct("year", "base", "months"))).alias("_years"))  # one row, of a year each
    each = [F.sum(F.when(F.col("year") == y, F.col("_share")).otherwise(0.0)) for y in range(first, last + 1)]
    rows = rows.join(F.broadcast(share), ["year", "month"])
    if "words" in rows.columns:  # papers: their months are looked up once, not for each word
        rows = rows.select("year", "_share", F.explode("words").alias(key))
    wide = rows.groupBy(key).agg(F.array(*each).alias("_sums")).crossJoin(F.broadcast(base))
    return wide.select(key, F.zip_with("_sums", "_years", lambda s, y: y["base"] + s / y["months"]).alias("means"))


def mean_of_months(rows: DataFrame, months: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """yearly_mean() of all keys of postings (key, year, month) in all years: mean_series() as rows."""
    found = mean_series(rows, months, key, first, last)
    return found.select(key, F.posexplode("means").alias("_at", "mean_freq")).select(key, (F.col("_at") + first).cast("int").alias("year"), "mean_freq")


def lagged_series(series: DataFrame, key: str, first: int, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """lag_projection() of series (key, means) that begin in a year, from the fourth on: by places in the array, without a window.

    keep gets a struct (year, mean_freq, projection, ratio, gap) and tells which years become rows at all.
    """

    def year(at: Column) -> Column:
        own, two, three = (F.get("means", at - k) for k in (0, 2, 3))
        expected = two + F.greatest(2 * (two - three), F.lit(0.0))
        return F.struct((at + first).cast("int").alias("year"), own.alias("mean_freq"), expected.alias("projection"), ratio(own, expected).alias("ratio"), (own - expected).alias("gap"))

    years = F.transform(F.sequence(F.lit(3), F.size("means") - 1), year)
    return series.select(key, F.explode(F.filter(years, keep) if keep else years).alias("_x")).select(key, "_x.*")


def floor_mean(monthly: DataFrame, value: str, *keys: str, time: str = "time") -> DataFrame:
    """Mean per key and whole year of rows on a continuous month axis."""
    return monthly.groupBy(*keys, F.floor(time).cast("int").alias("year")).agg(F.avg(value).alias(value))


def aligned(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Two count tables side by side, all keys of either, with zeros where one has none."""
    a, b = left.select(*keys, F.col(value).alias("left_n")), right.select(*keys, F.col(value).alias("right_n"))
    return a.join(b, keys, "full").na.fill(0, ["left_n", "right_n"])


def lag_projection(yearly: DataFrame, key: str, freq: str = "mean_freq", least: int | None = None) -> DataFrame:
    """What the trend of the years two and three before lets expect: f(y-2) + max(2 (f(y-2) - f(y-3)), 0); with ratio and gap."""
    w = Window.partitionBy(key).orderBy("year")
    two, three = F.lag(freq, 2).over(w), F.lag(freq, 3).over(w)
    out = yearly.withColumn("projection", two + F.when(three.isNotNull(), F.greatest(2 * (two - three), F.lit(0.0)))).where(F.col("projection").isNotNull())
    out = out.withColumn("ratio", ratio(F.col(freq), F.col("projection"))).withColumn("gap", F.col(freq) - F.col("projection"))
    return out.where(F.col("year") >= least) if least else out


def period_index(year: Column, month: Column | None = None) -> Column:
    return year.cast("long") if month is None else year.cast("long") * 12 + month - 1


def regression(series: DataFrame, keys: list[str], index: str, value: str, end: int, length: int) -> DataFrame:
    """Least squares over the `length` periods before `end`, carried on to the last period, in closed form.

    Adds t (0 at the first training period), projection, sdev (standard error of a prediction), ratio and gap; rows before the training are dropped.
    """
    t = (F.col(index) - (end - length)).cast("double")
    rows = series.withColumn("t", t).where("t >= 0")
    each = Window.partitionBy(*keys)
    x, y = (F.when(F.col("t") < length, F.col(c).cast("double")) for c in ("t", value))

    def over(f) -> Column:
        return f(y, x).over(each)

    fit = {"_b": F.regr_slope, "_a": F.regr_intercept, "_syy": F.regr_syy, "_sxy": F.regr_sxy, "_sxx": F.regr_sxx, "_mean": F.regr_avgx, "_k": F.regr_count}
    rows = rows.select("*", *[over(f).alias(name) for name, f in fit.items()])
    left = F.col("_syy") - F.try_divide(F.col("_sxy") * F.col("_sxy"), F.col("_sxx"))
    # below this share of the variance, what is left is what rounding leaves of 0
    sse = F.when(left > EXACT * F.col("_syy"), left).when(left.isNotNull(), 0.0)
    sigma2 = F.try_divide(sse, F.col("_k") - 2)
    lever = 1 + F.try_divide(F.lit(1.0), F.col("_k")) + F.try_divide((F.col("t") - F.col("_mean")) * (F.col("t") - F.col("_mean")), F.col("_sxx"))
    out = rows.withColumn("projection", F.col("_a") + F.col("_b") * F.col("t")).withColumn("sdev", F.sqrt(sigma2 * lever))
    out = out.withColumn("ratio", ratio(F.col(value), F.col("projection"))).withColumn("gap", F.col(value) - F.col("projection"))
    return out.drop(*fit)


def without_partial(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Rows (year, month) of the months from first to last (year * 12 + month - 1, both included): partly collected months at the ends go."""
    return rows.where(period_index(F.col("year"), F.col("month")).between(first, last))
