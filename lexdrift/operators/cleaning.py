"""The cleaning funnel, language inference, and deduplication of papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lists import ARTICLE_TYPES
from ..functions.text import full_text, has_sections, standard_sections

LEAST_CHARS = 250

# Frequent words that tell the languages apart.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "that", "is", "with", "for", "was"],
    "de": ["der", "die", "und", "das", "ist", "von", "für", "mit", "ein", "nicht"],
    "fr": ["le", "la", "les", "de", "et", "des", "que", "qui", "pour", "dans"],
    "es": ["el", "los", "las", "del", "que", "por", "una", "con", "para", "se"],
}


def detect_language(text: Column) -> Column:
    """The language with the most stop words in a text, the first of equals; null if none occurs."""
    words = F.split(F.lower(text), r"[^\p{L}]+")

    def known(lang: str) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(STOP_WORDS[lang])))

    scores = [F.struct(known(lang).alias("n"), F.lit(-k).alias("k"), F.lit(lang).alias("lang")) for k, lang in enumerate(STOP_WORDS)]
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] > 0, best["lang"])


def infer_language(papers: DataFrame, declared: str = "language", short: str = "abstract", long: str | None = None) -> DataFrame:
    """The declared language, else that of the short text, else that of the long one, row by row."""
    return papers.withColumn(declared, F.coalesce(F.col(declared), detect_language(F.col(short)), *([detect_language(F.col(long))] if long else [])))


def stages(language: str = "en", first: int = 2000, last: int = 2025) -> list[tuple[str, Column]]:
    """The funnel's predicates in order, each of which has to hold besides those before it. Titles that are null count as an empty list."""
    none = F.array().cast("array<string>")
    return [
        ("article_type", F.col("article_type").isin(ARTICLE_TYPES)),
        ("sections", F.size(standard_sections(F.coalesce("section_titles", none), F.coalesce("sections", none))) > 0),
        ("abstract", F.length("abstract") >= LEAST_CHARS),
        ("language", F.col("language") == language),
        ("date", F.col("date").isNotNull() & F.year("date").between(first, last)),
    ]


def funnel(papers: DataFrame, by: str | None = None, steps: list[tuple[str, Column]] | None = None) -> DataFrame:
    """Papers left after each stage, of all or of each group, in one pass. Where languages were inferred (language_by), it counts those that couldn't be told
    among the papers that came to that stage."""
    counts, left = [F.count(F.lit(1)).alias("before_prep")], F.lit(True)
    for name, keep in steps or stages():
        if name == "language" and "language_by" in papers.columns:
            counts.append(F.count_if(left & (F.col("language_by") == "failed")).alias("language_failures"))
        left = left & F.coalesce(keep, F.lit(False))
        counts.append(F.count_if(left).alias(f"after_{name}"))
    return papers.groupBy(by).agg(*counts) if by else papers.agg(*counts)


def of_type(papers: DataFrame, kind: str = "all") -> DataFrame:
    """Papers of one article type; `all` takes every one, those without a type too."""
    return papers if kind == "all" else papers.where(F.col("article_type") == kind)


def since(papers: DataFrame, day: str) -> DataFrame:
    """Papers of a day (yyyy-mm-dd) and later; those without a date go."""
    return papers.where(F.col("date") >= F.lit(day).cast("date"))


def clean(papers: DataFrame, steps: list[tuple[str, Column]] | None = None) -> DataFrame:
    for _, keep in steps or stages():
        papers = papers.where(keep)
    return papers


def with_sections(papers: DataFrame, required: list[str], sections: str = "sections", allow_other: bool = False, least: int = LEAST_CHARS) -> DataFrame:
    """Papers whose section map has the required keys, each section long enough, as columns, with `full` as all of them joined."""
    out = papers.where(has_sections(F.col(sections), required, allow_other))
    for r in required:
        out = out.withColumn(r, F.element_at(F.col(sections), r)).where(F.length(r) >= least)
    return out.withColumn("full", full_text(F.col(sections), required))


def keep_first(papers: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """One row of each key: the first in the given order."""
    return papers.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")
