"""Renaming of words to American spellings and lemmas, on vocabularies and not on texts.

A dictionary isn't at hand, so the corpus is its own: an ending is taken off only where what is left is a word of the vocabulary. Words
meet their base forms in a join on the vocabulary, of any size.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lists import DETACHED, IRREGULAR, LEMMAS, SPELLINGS
from .frequency import BUCKETS


def _fixed(word: Column, names: Mapping[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), word) if names else F.lit(None).cast("string")


def _cut(word: Column, rules: list[tuple[str, str]]) -> Column:
    """What is left of a word by each of the rules (ending, what stands for it) that apply."""
    each = F.array(*[F.struct(F.lit(old).alias("old"), F.lit(new).alias("new")) for old, new in rules])
    fits = F.filter(each, lambda r: word.endswith(r["old"]) & (F.length(word) > F.length(r["old"])))
    return F.transform(fits, lambda r: F.concat(F.substring(word, F.lit(1), F.length(word) - F.length(r["old"])), r["new"]))


def _each(words: Column, rules: list[tuple[str, str]]) -> Column:
    return F.flatten(F.transform(words, lambda w: _cut(w, rules)))


def _numbered(words: Column, at: int) -> Column:
    return F.transform(words, lambda w: F.struct(F.lit(at).alias("at"), w.alias("base")))


def detached(words: DataFrame, known: DataFrame, passes: list[list[tuple[str, str]]], rounds: int = 2) -> DataFrame:
    """(word, new) of the words (word) that become a known word (word) when one of the endings in a pass's rules is taken off.

    The first pass that leads anywhere counts. Where no ending leads to a known word, endings are taken off what is left, in so many rounds. Of several
    known words the shortest is taken, and the first by alphabet of equally short ones. All candidates meet the vocabulary in one join.
    """
    tried = []
    for k, rules in enumerate(passes):
        left = F.array("word")
        for n in range(rounds):
            left = _each(left, rules)
            tried.append(_numbered(left, k * rounds + n))
    rows = words.select("word", F.explode(F.flatten(F.array(*tried))).alias("x")).select("word", "x.at", "x.base")
    found = rows.join(known.select(F.col("word").alias("base")), "base", "left_semi")
    return found.groupBy("word").agg(F.min(F.struct("at", F.length("base").alias("n"), "base"))["base"].alias("new"))


def lemma_table(words: DataFrame, known: DataFrame, exceptions: DataFrame | None = None, first: Mapping[str, str] = LEMMAS, irregular: Mapping[str, str] = IRREGULAR) -> DataFrame:
    """(word, new) of the words that aren't their own lemma.

    A lemma is that of a fixed list, else of a given table of exceptions (word, lemma), else of the irregular forms, else the base form of the
    word as a verb, else as a noun. known: the words (word) that may be base forms. Exceptions that name a word itself keep it as it is.
    """
    w = words.select("word").distinct()
    own = w.withColumn("given", _fixed(F.col("word"), first))
    if exceptions is not None:
        told = exceptions.groupBy("word").agg(F.min("lemma").alias("_e"))
        own = own.join(told, "word", "left").select("word", F.coalesce("given", "_e").alias("given"))
    own = own.withColumn("given", F.coalesce("given", _fixed(F.col("word"), irregular)))
    found = detached(own.where(F.col("given").isNull()), known, [DETACHED["verb"], DETACHED["noun"]])
    return own.where(F.col("given").isNotNull()).select("word", F.col("given").alias("new")).unionByName(found).where("new <> word")


def spelling_table(words: DataFrame, known: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(word, new) of the words with a British spelling: by a given table (word, new), else by the first of the rules that leads to a known word."""
    rows = words.select("word").distinct()
    fixed = None
    if given is not None:
        fixed = given.join(rows, "word", "left_semi").groupBy("word").agg(F.min("new").alias("new"))
        rows = rows.join(fixed.select("word"), "word", "left_anti")
    each = [F.when(F.col("word").rlike(old), F.struct(F.lit(k).alias("k"), F.regexp_replace("word", old, new.replace("\\", "$")).alias("base"))) for k, (old, new) in enumerate(SPELLINGS)]
    found = rows.select("word", F.explode(F.array_compact(F.array(*each))).alias("x")).select("word", "x.k", "x.base")
    found = found.join(known.select(F.col("word").alias("base")), "base", "left_semi").groupBy("word").agg(F.min(F.struct("k", "base"))["base"].alias("new"))
    return (found if fixed is None else fixed.unionByName(found)).where("new <> word")


def rename(counts: DataFrame, spellings: DataFrame, lemmas: DataFrame) -> DataFrame:
    """word -> american spelling -> lemma, where the tables (word, new) have them. Lemmas are those of the words as they were written."""
    out = counts.join(spellings.withColumnRenamed("new", "_a"), "word", "left").withColumn("_w", F.coalesce("_a", "word"))
    return out.join(lemmas.select(F.col("word").alias("_w"), F.col("new").alias("_l")), "_w", "left").withColumn("lemma", F.coalesce("_l", "_w")).drop("_a", "_w", "_l")


def changed_words(spellings: DataFrame, lemmas: DataFrame) -> DataFrame:
    """(word, new) of the words that rename() changes: both steps as one table."""
    words = spellings.select("word").unionByName(lemmas.select("word")).distinct()
    return rename(words, spellings, lemmas).select("word", F.col("lemma").alias("new")).where("new <> word")


def lemmatised(papers: DataFrame, changed: DataFrame, *keep: str, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, keep, words) with the distinct lemmas of the papers' `words`. A doc_id that has several rows gets one, with the lemmas of them all.

    Only words that change meet the table of changes (word, new): a sketch of bounded size, broadcast, sorts out most others where they are read. They come back to
    their papers as arrays, so that a paper is shuffled once and as one row, and so are the few words that change.
    """
    at = F.pmod(F.xxhash64("word"), F.lit(buckets)).alias("_at")
    none = F.lit(None).cast("string")
    found = papers.select("doc_id", *keep, F.explode("words").alias("word")).select("*", at)
    found = found.join(F.broadcast(changed.select(at).distinct()), "_at", "left_semi").join(changed, "word")
    rows = papers.select("doc_id", *keep, "words", none.alias("old"), none.alias("new"))
    rows = rows.unionByName(found.select("doc_id", *keep, F.lit(None).cast("array<string>").alias("words"), F.col("word").alias("old"), "new"))
    met = rows.groupBy("doc_id", *keep).agg(F.flatten(F.collect_list("words")).alias("words"), F.collect_list("old").alias("old"), F.collect_list("new").alias("new"))
    return met.select("doc_id", *keep, F.array_union(F.array_except("words", "old"), "new").alias("words"))


def count_sum(renamed: DataFrame, *period: str, least: int = 4) -> DataFrame:
    """Sum of the variants' counts: a paper with two variants counts twice, so that frequencies may exceed 1."""
    return renamed.groupBy("lemma", *period).agg(F.sum("n").alias("n")).where(F.length("lemma") >= least)


def count_union(renamed_postings: DataFrame, *period: str, least: int = 4) -> DataFrame:
    """Papers with any of the variants."""
    return renamed_postings.select("lemma", "doc_id", *period).distinct().groupBy("lemma", *period).agg(F.count(F.lit(1)).alias("n")).where(F.length("lemma") >= least)


def count_lemmatised(papers: DataFrame, *period: str, least: int = 4) -> DataFrame:
    """count_union() of papers that lemmatised() made: each has a lemma once, so nothing but counts is shuffled. Papers without a doc_id aren't counted."""
    rows = papers.select("doc_id", *period, F.explode("words").alias("lemma")).where(F.length("lemma") >= least)
    return rows.groupBy("lemma", *period).agg(F.count("doc_id").alias("n"))


def surface_words(kept: DataFrame, lemmas: DataFrame) -> DataFrame:
    """The kept lemmas and all words that have one of them as lemma."""
    return kept.select("word").unionByName(lemmas.join(kept.select(F.col("word").alias("new")), "new").select("word")).distinct()
