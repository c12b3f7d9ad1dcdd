"""Filter interaction audit: what each of several filters removes in every order in which they can be applied.

Which filters a document fails is a set, one of 32. With some filters already applied (a subset of the others), the next one keeps, removes or
finds already removed: an edge of the lattice of subsets, of which there are 80. Documents are counted by part and set, each set adds to the 80
edges, and each of the 120 orders is a path of five edges, so its 600 steps are a join with the edges. Nothing is computed for each order.

Whether a text is a copy of one with a smaller doc_id is told by 128-bit digests. Copies are summed up by digest before they are looked at, so that
a text that a third of the documents share is a few rows.

Nulls: a null text is an empty one, a null lang the part ''. A row without doc_id is nobody's copy and has no labels. Rows with one doc_id and
text aren't copies of each other. Labels that are there several times count once. Empty texts fail A; B and C ask for more than none, so they don't fail those.
No rows give no rows. Texts are gone through in windows of WINDOW bytes; what is held are a text's different words. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from itertools import combinations, permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

#: The filters, in order of their bits.
FILTERS = "ABCDE"
#: Fixed by the contract: the least words, percent of distinct words at least, percent of capitals at most, and characters that a text must not have.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, BARRED = 100, 80, 10, b"#$%&*|"
WINDOW = 1 << 20
_SPACE = re.compile(rb"[\x09-\x0D\x20]")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_NOT_CAPITALS = bytes(set(range(256)) - set(_CAPITALS))
_CONTINUED = bytes(range(0x80, 0xC0))


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text (UTF-8) fails."""
    words, different, at = 0, set(), 0
    while at < len(text):
        end = at + WINDOW
        cut = _SPACE.search(text, end) if end < len(text) else None
        end = cut.start() if cut else len(text)
        own = text[at:end].split()
        words += len(own)
        different.update(own)
        at = end
    capitals, points = len(text.translate(None, _NOT_CAPITALS)), len(text.translate(None, _CONTINUED))
    barred = any(c in text for c in BARRED)
    return (words < LEAST_WORDS) | (100 * len(different) < LEAST_DISTINCT * words) << 1 | (100 * capitals > MOST_CAPITALS * points) << 2 | barred << 3


def facts(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, fails) of rows (doc_id, text, lang): the digest of the text and the filters A to D that it fails."""

    def run(batch):
        texts = [x.as_py() or b"" for x in batch["text"].cast(pa.large_binary())]
        yield {"doc_id": batch["doc_id"], "part": batch["part"], "digest": [hashlib.blake2b(t, digest_size=16).digest() for t in texts], "fails": [failures(t) for t in texts]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, part string, digest binary, fails int")


def failure_sets(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, n, good, toxic): documents by part and set of filters that they fail, copies included, and those that labels mark."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("key"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"), F.lit(False).alias("none"))
    # rows without an id get keys of their own: as nulls they would meet in one task
    rows = rows.withColumn("none", F.col("doc_id").isNull()).withColumn("key", F.coalesce("doc_id", F.monotonically_increasing_id()))
    marked = rows.join(marks, ["key", "none"], "left").na.fill(0, ["good", "toxic"])
    each = marked.groupBy("key", "none", "doc_id", "part", "digest", "fails", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    alike = each.groupBy("digest", "part", "fails", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("none"), F.col("n")).otherwise(0)).alias("bare"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first")
    )
    least = alike.groupBy("digest").agg(F.min("first").alias("least"))
    alike = alike.join(least.where("least is not null").withColumnRenamed("digest", "d"), F.col("digest") == F.col("d"), "left")
    copies = F.col("n") - F.col("bare") - F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0)
    two = F.array(F.struct(F.col("fails").alias("fails"), (F.col("n") - copies).alias("n")), F.struct((F.col("fails") + (1 << 4)).alias("fails"), copies.alias("n")))
    split = alike.select("part", "good", "toxic", F.explode(two).alias("x")).select("part", "good", "toxic", "x.fails", "x.n")
    return split.groupBy("part", "fails").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def lattice_edges(k: int = len(FILTERS)) -> list[tuple[int, int]]:
    """(already applied subset, next filter's bit) for each subset of the other filters."""
    return [(sum(1 << i for i in subset), f) for f in range(k) for size in range(k) for subset in combinations([i for i in range(k) if i != f], size)]


def edges(sets: DataFrame, k: int = len(FILTERS)) -> DataFrame:
    """(part, applied, bit, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): the sums of each part over its at most 2^k sets.

    shapley: the documents that the filter removes, summed over all orders of the filters.
    """
    each = F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("bit")) for s, f in lattice_edges(k)])
    x = sets.withColumn("e", F.explode(each)).select("part", "fails", "n", "good", "toxic", "e.applied", "e.bit")
    gone = F.col("fails").bitwiseAND(F.col("applied")) != 0
    own = F.col("fails").bitwiseAND(F.expr("shiftleft(1, bit)")) != 0

    def total(when, value="n"):
        return F.sum(F.when(when, F.col(value)).otherwise(0)).cast("long")

    out = x.groupBy("part", "applied", "bit").agg(
        total(~gone & ~own).alias("kept"), total(~gone & own).alias("removed"), total(gone & own).alias("redundant"), total(F.col("fails") == F.expr("shiftleft(1, bit)")).alias("unique_fails"),
        total(~gone & own, "good").alias("good_lost"), total(~gone & own, "toxic").alias("toxic_lost"),
    )
    orders = F.element_at(F.array(*[F.lit(math.factorial(s) * math.factorial(k - 1 - s)) for s in range(k)]), (F.bit_count("applied") + 1).cast("int"))
    over = out.groupBy(F.col("part").alias("_p"), F.col("bit").alias("_b")).agg(F.sum(F.col("removed") * orders).cast("long").alias("shapley"))
    return out.join(over, (F.col("part") == F.col("_p")) & (F.col("bit") == F.col("_b"))).drop("_p", "_b")


def paths(spark: SparkSession, names: str = FILTERS) -> DataFrame:
    """(filter_order, step, applied, bit): the edges that each order of the filters goes along. Fixed: k * k! rows."""
    rows = []
    for order in permutations(range(len(names))):
        name = "".join(names[i] for i in order)
        rows += [(name, k + 1, sum(1 << i for i in order[:k]), f) for k, f in enumerate(order)]
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, bit int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, zeros included, from rows (doc_id, text, lang) and labels (doc_id, quality, toxic)."""
    found = edges(failure_sets(facts(docs), labels))
    out = found.join(F.broadcast(paths(docs.sparkSession)), ["applied", "bit"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


#: Order by order, step by step, over the documents themselves.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
firsts AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws), 100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 10 * length(w.t),
     regexp_matches(w.t, '[#$%&*|]'), coalesce(w.doc_id > least, false)] AS fails
  FROM w JOIN firsts ON w.t = firsts.t LEFT JOIN marks ON w.doc_id = marks.doc_id),
sets AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
l AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
orders AS (SELECT [a.i, b.i, c.i, e.i, g.i] AS o FROM l a, l b, l c, l e, l g
  WHERE len(list_distinct([a.i, b.i, c.i, e.i, g.i])) = 5),
steps AS (SELECT o, s.i AS step, o[s.i] AS filter, o[1:s.i - 1] AS before FROM orders, l s),
sums AS (SELECT part, o, step, filter,
    sum(CASE WHEN NOT gone AND NOT fails[filter] THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails[filter] THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND fails[filter] THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails[filter] AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND fails[filter] THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fails[filter] THEN toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT *, len(list_filter(before, lambda k: fails[k])) > 0 AS gone FROM sets, steps) GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda k: substr('ABCDE', k::INT, 1)), '') AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
  redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM sums"""
