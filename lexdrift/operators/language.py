"""Languages of texts by ranked profiles of character n-grams, learned from the rows that declare theirs.

A language's profile is the list of its most frequent n-grams, a text's own profile the same for the text. What tells them apart is how far each of the
text's n-grams is out of its place in the language's list, with the length of the list for one that isn't there. Counts, ranks and
distances are whole numbers, so that the result doesn't depend on the order of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of an n-gram, n-grams of a profile, and n-grams that a text has at least if its language is to be told.
GRAM, PROFILE, LEAST = 3, 300, 10


def _words(text: Column, n: int = GRAM) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) >= max(1, n - 2))


def _grams_of(w: Column, n: int = GRAM) -> Column:
    """The n-grams of a word with a space on both sides."""
    return F.transform(F.sequence(F.lit(1), F.length(w) + (3 - n)), lambda i: F.substring(F.concat(F.lit(" "), w, F.lit(" ")), i, F.lit(n)))


def grams(text: Column, n: int = GRAM) -> Column:
    """The n-grams (two and more letters) of the words of a text in lower case, each with a space on both sides; repeats stay. Null for null."""
    return F.flatten(F.transform(_words(text, n), lambda w: _grams_of(w, n)))


def _ranked(counts: DataFrame, most: int, *keys: str) -> DataFrame:
    """The `most` n-grams (gram, n) with the greatest counts for each of the keys, with their places; equal counts by alphabet."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "gram"))
    return counts.withColumn("place", place.cast("int")).where(F.col("place") <= most).select(*keys, "gram", "place")


def profiles(rows: DataFrame, declared: str = "language", text: str = "abstract", n: int = GRAM, most: int = PROFILE) -> DataFrame:
    """(language, gram, place) of the rows that declare a language. Words are counted first, by tasks and then by language, and only the different ones are taken apart:
    their n-grams count as often as they occur. What is ranked are a language's different n-grams."""
    words = rows.where(F.col(declared).isNotNull()).select(F.col(declared).alias("language"), F.explode(_words(F.col(text), n)).alias("word"))
    counted = words.groupBy("language", "word").agg(F.count(F.lit(1)).alias("n"))
    told = counted.select("language", "n", F.explode(_grams_of(F.col("word"), n)).alias("gram"))
    return _ranked(told.groupBy("language", "gram").agg(F.sum("n").alias("n")), most, "language")


def told(text: Column, n: int = GRAM, least: int = LEAST) -> Column:
    """Whether a text has enough n-grams for its language to be told."""
    return F.coalesce(F.size(grams(text, n)) >= least, F.lit(False))


def _nearest(grams: pa.ListArray, names: list[str], index: pa.Array, places: np.ndarray, most: int) -> tuple[list[str | None], list[int | None]]:
    """The nearest language and its distance for each list of n-grams; null where no language has any of them.

    names: the languages in order; index: the n-grams that any has, and places: theirs in each language, 0 where it hasn't got it."""
    rows = len(grams)
    lengths = pc.fill_null(pc.list_value_length(grams), 0).to_numpy(zero_copy_only=False)
    coded = grams.flatten().dictionary_encode()
    if not len(coded) or not len(names):
        return [None] * rows, [None] * rows
    # codes by alphabet, as equally frequent n-grams are ranked by it
    order = pc.sort_indices(coded.dictionary.cast(pa.binary())).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    pairs, n = np.unique(np.repeat(np.arange(rows), lengths) * len(order) + rank[coded.indices.to_numpy()], return_counts=True)
    row, gram = pairs // len(order), pairs % len(order)
    by = np.lexsort((gram, -n, row))
    row, gram = row[by], gram[by]
    place = np.arange(len(row)) - np.searchsorted(row, row) + 1
    row, gram, place = row[place <= most], gram[place <= most], place[place <= most]
    at = pc.fill_null(pc.index_in(coded.dictionary.take(pa.array(order)), value_set=index), len(index)).to_numpy()[gram]
    theirs = places[at]
    # what a language hasn't got costs `most`; summed over what it has got, an n-gram is worth what its place saves
    saved = np.where(theirs > 0, most - np.abs(place[:, None] - theirs), 0)
    worth = np.stack([np.bincount(row, x, rows) for x in saved.T], 1).astype(np.int64)
    met = np.stack([np.bincount(row, x, rows) > 0 for x in (theirs > 0).T], 1)
    best = np.where(met, worth, np.iinfo(np.int64).min).argmax(1)
    distance = most * np.bincount(row, minlength=rows) - worth[np.arange(rows), best]
    some = met.any(1).tolist()
    return [names[k] if x else None for k, x in zip(best.tolist(), some, strict=True)], [d if x else None for d, x in zip(distance.tolist(), some, strict=True)]


def detect(rows: DataFrame, known: DataFrame, key: str = "doc_id", short: str = "abstract", long: str | None = None, n: int = GRAM, most: int = PROFILE, least: int = LEAST) -> DataFrame:
    """(key, language, told_by, distance) of all rows: the language whose profile (known) is nearest to that of the short text, or of the long one where the short
    one has too few n-grams. Of equally near languages the first by alphabet. told_by: the column that was read, null where both fail.

    A text is ranked beside its row, a batch at a time: nothing is shuffled. The profiles, a bounded list for each language, go to all tasks.
    """
    names = [short] + ([long] if long else [])
    by = F.coalesce(*[F.when(told(F.col(c), n, least), F.lit(c)) for c in names])
    read = F.coalesce(*[F.when(F.col("told_by") == c, F.col(c)) for c in names])
    chosen = rows.select(key, *names, by.alias("told_by")).select(F.col(key), "told_by", grams(read, n).alias("_grams"))
    found = [(r["language"], r["gram"], r["place"]) for r in known.select("language", "gram", "place").collect()]
    languages = sorted({x for x, _, _ in found}, key=str.encode)
    index = {g: k for k, g in enumerate(sorted({g for _, g, _ in found}))}
    places = np.zeros((len(index) + 1, len(languages)), np.int64)
    for x, g, k in found:
        places[index[g], languages.index(x)] = k
    sent = rows.sparkSession.sparkContext.broadcast((languages, list(index), places))

    def run(batches):
        names, listed, places = sent.value
        index = pa.array(listed, pa.string())
        for batch in batches:
            language, distance = _nearest(batch["_grams"], names, index, places, most)
            language, distance = pa.array(language, pa.string()), pa.array(distance, pa.int64())
            told_by = pc.if_else(pc.is_valid(language), batch["told_by"], pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([batch[key], language, told_by, distance], names=[key, "language", "told_by", "distance"])

    shape = T.StructType([T.StructField(key, rows.schema[key].dataType), *[T.StructField(c, t) for c, t in (("language", T.StringType()), ("told_by", T.StringType()), ("distance", T.LongType()))]])
    return chosen.mapInArrow(run, shape)


def inferred(papers: DataFrame, known: DataFrame | None = None, key: str = "doc_id", declared: str = "language", short: str = "abstract", long: str | None = None) -> DataFrame:
    """papers with the declared language, or the detected one where none is declared, and `language_by`: declared, the text that told it, or failed."""
    known = profiles(papers, declared, short) if known is None else known
    found = detect(papers.where(F.col(declared).isNull()), known, key, short, long).select(F.col(key).alias("_k"), F.col("language").alias("_l"), "told_by")
    out = papers.join(found, F.col(key) == F.col("_k"), "left")
    by = F.when(F.col(declared).isNotNull(), "declared").otherwise(F.coalesce("told_by", F.lit("failed")))
    return out.withColumn("language_by", by).withColumn(declared, F.coalesce(declared, "_l")).drop("_k", "_l", "told_by")
