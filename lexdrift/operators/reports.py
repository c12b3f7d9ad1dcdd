"""Reports by country, discipline and journal."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.estimate import smoothed
from ..functions.lists import COMMON_COUNTRIES, ENGLISH_SPEAKING
from ..functions.text import last_label


def memberships(country: Column, common: list[str] = COMMON_COUNTRIES, english: list[str] = ENGLISH_SPEAKING) -> Column:
    """The groups of a paper's country: itself if common, and english or non-english; none for null."""
    own = F.when(country.isin(common), F.array(country)).otherwise(F.array().cast("array<string>"))
    side = F.when(country.isin(english), F.array(F.lit("english"))).when(country.isNotNull(), F.array(F.lit("non-english"))).otherwise(F.array().cast("array<string>"))
    return F.concat(own, side)


def overlapping_frequency(papers: DataFrame, hit: Column, groups: Column, *period: str) -> DataFrame:
    """(grp, period, n_papers, n, freq) of papers for which hit holds, in groups that may overlap, against the group's own papers."""
    marked = papers.select(*period, hit.alias("_hit"), F.explode(groups).alias("grp"))
    out = marked.groupBy("grp", *period).agg(F.count(F.lit(1)).alias("n_papers"), F.count_if("_hit").alias("n"))
    return out.withColumn("freq", smoothed(F.col("n"), F.col("n_papers")))


def journal_labels(papers: DataFrame, journal: str = "journal") -> DataFrame:
    """(journal, label): labels are found once for each distinct journal."""
    return papers.select(journal).distinct().withColumn("label", last_label(F.col(journal)))


def large_groups(labelled: DataFrame, label: str, more_than: int) -> DataFrame:
    return labelled.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n_papers")).where(F.col("n_papers") > more_than)


def with_other(counts: DataFrame, key: str, n: str, small: Column) -> DataFrame:
    """Counts with the small keys summed up as Other."""
    return counts.withColumn(key, F.when(small, F.lit("Other")).otherwise(F.col(key))).groupBy(key).agg(F.sum(n).alias(n))


def turnover(present: DataFrame, step: int, more_than: int = 0) -> DataFrame:
    """(year, key) rows whose key isn't there `step` years on (negative: before), where that year has any keys. Keys with up to `more_than` papers (n) don't count as theirs."""
    other = present
    if more_than:
        present = present.where(F.col("n") > more_than).select("year", "key")
    other = other.select((F.col("year") - step).alias("year"), "key")
    years = other.select("year").distinct()
    return present.join(F.broadcast(years), "year", "left_semi").join(other, ["year", "key"], "left_anti")


def null_shares(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, null_share), in one pass."""
    wide = rows.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return wide.unpivot([], columns, "column", "null_share")


def remapped(value: Column, names: Mapping[str, str]) -> Column:
    """The value by another name where a table has one, else as it is: spellings of journals, display names of countries."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), value), value)


def section_order(section: Column, order: list[str]) -> Column:
    """The place of a section in the order of a paper, after all others if it is none of them."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in order]), section), F.lit(0)), F.lit(len(order) + 1)).cast("int")


def pivoted(rows: DataFrame, key: str, column: str, values: list, value: str) -> DataFrame:
    return rows.groupBy(key).pivot(column, values).agg(F.first(value))


def transposed(rows: DataFrame, columns: list[str], key: str | None = None, values: list | None = None) -> DataFrame:
    """Columns become rows: (measure, value) of a single row, or (measure, one column per value of a key)."""
    if key is None:
        return rows.unpivot([], columns, "measure", "value")
    return rows.unpivot([key], columns, "measure", "value").groupBy("measure").pivot(key, values).agg(F.first("value"))


def overlay(report: DataFrame, published: DataFrame, months: int = 6) -> DataFrame:
    """Published estimates (date, section, estimate, mode, method) beside the report's rows (date, section, usage) of the same section, within
    some months of each other.

    An interval join: each of the report's rows, which are a bounded number of months and sections, goes to the months that estimates near it may be of, so that rows
    meet by section and month, and the distance is tested after that. The report is broadcast, whatever the number of estimates, which stay where they are.
    """
    index = lambda d: F.year(d) * 12 + F.month(d)
    near = report.withColumn("_i", F.explode(F.sequence(index(F.col("date")) - months - 1, index(F.col("date")) + months + 1)))
    p = published.withColumnRenamed("date", "published_on").withColumn("_i", index(F.col("published_on")))
    out = p.join(F.broadcast(near), ["section", "_i"]).where(F.abs(F.months_between("date", "published_on")) <= months)
    return out.select(*report.columns, *[c for c in p.columns if c not in ("section", "_i")])


def listed_share(papers: DataFrame, listed: list[str], *by: str, column: str = "journal") -> DataFrame:
    """(by, n_papers, n, share) of papers whose value is in a list, such as the preprint servers among the journals."""
    out = papers.groupBy(*by).agg(F.count(F.lit(1)).alias("n_papers"), F.count_if(F.coalesce(F.col(column).isin(listed), F.lit(False))).alias("n"))
    return out.withColumn("share", F.col("n") / F.col("n_papers"))
