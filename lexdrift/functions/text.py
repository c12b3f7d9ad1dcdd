"""Column functions over text: tokens, crops, titles, labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lists import DISCIPLINES, SECTION_TITLES


def tokens(text: Column, least: int = 4) -> Column:
    """Distinct lower-case words of ASCII letters only, `least` or longer. A word is a maximal run of letters, digits and underscores."""
    word = rf"(?<![\p{{L}}\p{{N}}_])[a-z]{{{least},}}+(?![\p{{L}}\p{{N}}_])"
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(word), F.lit(0)))


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def _drawn(seed: int, *keys: Column) -> Column:
    """A hash of keys, the same in every engine, as hexadecimal digits; null keys count as empty."""
    return F.md5(F.concat_ws(":", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys], F.lit(str(seed))).cast("binary"))


def crop(text: Column, most: int, *keys: Column, seed: int = 0) -> Column:
    """`most` words in a row from a place drawn by a hash of the keys; a text that isn't longer stays as it is."""
    w = words(text)
    place = F.conv(F.substring(_drawn(seed, *keys), 1, 15), 16, 10).cast("long")
    start = (place % F.greatest(F.size(w) - most + 1, F.lit(1))).cast("int") + 1
    return F.when(F.size(w) <= most, text).otherwise(F.array_join(F.slice(w, start, F.lit(most)), " "))


def sample(text: Column, most: int, *keys: Column, seed: int = 0) -> Column:
    """`most` words without replacement, those at the positions with the least hashes; a text that isn't longer stays as it is."""
    w = words(text)
    drawn = F.transform(w, lambda x, at: F.struct(_drawn(seed, *keys, at).alias("h"), x.alias("w")))
    chosen = F.transform(F.slice(F.array_sort(drawn), 1, most), lambda s: s["w"])
    return F.when(F.size(w) <= most, text).otherwise(F.array_join(chosen, " "))


def clean_title(title: Column) -> Column:
    """Line breaks and hard spaces to spaces, no byte order marks, no numbers with their dots, `and` for &, no colons or spaces around."""
    for pattern, new in ((r"\n", " "), ("﻿", ""), (r" *\d+\.* *", ""), (" ", " "), ("&", "and")):
        title = F.regexp_replace(title, pattern, new)
    return F.trim(F.regexp_replace(title, "^:+|:+$", ""))


def canonical_title(title: Column, titles: dict[str, list[str]] = SECTION_TITLES) -> Column:
    """The section that a title names; empty for null and unknown titles. Of sections that share a title the last one wins."""
    known = {t: key for key, synonyms in titles.items() for t in synonyms}
    pairs = [F.lit(x) for t, key in known.items() for x in (t, key)]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(clean_title(title))), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def standard_sections(titles: Column, sections: Column) -> Column:
    """Map of canonical title to text, texts of the same title joined by a space in their order; empty if the arrays differ in length.

    Each different title is looked up once.
    """

    def joined(pairs: Column) -> Column:
        keys = F.array_distinct(F.transform(pairs, lambda x: x["k"]))
        return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.array_join(F.transform(F.filter(pairs, lambda x: x["k"] == k), lambda x: x["s"]), " ").alias("value"))))

    def named(known: Column) -> Column:
        pairs = F.transform(F.arrays_zip(titles.alias("t"), sections.alias("s")), lambda x: F.struct(F.coalesce(F.element_at(known, x["t"]), F.lit("")).alias("k"), x["s"].alias("s")))
        return let(F.filter(pairs, lambda x: x["k"] != ""), joined)

    different = F.filter(F.array_distinct(titles), lambda t: t.isNotNull())
    made = let(F.map_from_entries(F.transform(different, lambda t: F.struct(t.alias("key"), canonical_title(t).alias("value")))), named)
    return F.when(F.size(titles) == F.size(sections), made).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def has_sections(sections: Column, required: list[str], allow_other: bool = False) -> Column:
    """Whether a section map has exactly the required keys, or at least them."""
    keys = F.map_keys(sections)
    if allow_other:
        return F.size(F.array_except(F.array(*[F.lit(r) for r in required]), keys)) == 0
    return F.array_sort(keys) == F.array(*[F.lit(r) for r in sorted(required)])


def full_text(sections: Column, required: list[str]) -> Column:
    """The required sections one after the other, without anything between."""
    return F.concat(*[F.element_at(sections, r) for r in required])


def last_label(text: Column, labels: list[str] = DISCIPLINES) -> Column:
    """The label that begins furthest right, as a whole word, or else as part of a word; ties go to the earlier label; null if there is none."""
    low = F.lower(text)
    whole = F.filter(F.split(low, r"[^\p{L}\p{N}_]+"), lambda w: w.isin(labels))

    def start(name: Column) -> Column:
        """Where a label begins last, from 1; 0 if it isn't there."""
        return F.when(F.contains(low, name), F.length(low) - F.length(name) - F.instr(F.reverse(low), F.reverse(name)) + 2).otherwise(0)

    found = F.array_max(F.transform(F.array(*[F.lit(x) for x in labels]), lambda name, k: F.struct(start(name).alias("at"), (-k).alias("order"), name.alias("label"))))
    return F.coalesce(F.try_element_at(whole, F.lit(-1)), F.when(found["at"] > 0, found["label"]))
