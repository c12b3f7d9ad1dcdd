"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Each document of a source is to be taken f = target / source_size times: floor(f) times for certain, and once more with
probability f - floor(f). Pairs of documents trade that probability, weighted by size, so that the words to take stay the same and
one of the two becomes 0 or 1; who gives is drawn so that each probability keeps its mean. Small groups of documents fold into one
residual each, the residuals of GROUP groups fold into one again, and so on up a tree. Trading leaves the largest document open, so
the few documents above 1/BIG of a source are settled first and the words they miss or exceed are spread over the probabilities of the
rest, whose means that keeps: a source ends off its target by less than 1/BIG of its size, where its small documents can hold that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from .common import WORD, materialise, packed, quoted, table, unpacked

#: Fixed by the contract.
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
#: At most so many documents of a source are larger than 1/BIG of it.
BIG = 64
#: Mean number of units that fold into one residual.
GROUP = 32
SEED = 20_011


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranged(rows: DataFrame, *order: Column) -> tuple[DataFrame, WindowSpec]:
    """The rows dealt into ranges of an order, with the number of the range (part), and a window over each range in that order."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
    return materialise(dealt), Window.partitionBy("part").orderBy(*order)


def _with_before(rows: DataFrame, **sums: Column) -> DataFrame:
    """Ranged rows with, for each name, the sum over all ranges before the row's: what has to be ordered is one row for each range."""
    parts = rows.groupBy("part").agg(*[F.sum(x).alias(name) for name, x in sums.items()])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(name) for name in sums])
    return rows.join(F.broadcast(parts), "part")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size, n, target from rows (source, size). Sources by code point, null last, get the weights in turn.

    Targets are min(cap * size, level * weight) with the level at which they sum to the share of all words; that is where giving the
    excess over the caps to the others by weight ends. Sources are ranked by ranges, however many there are.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    s, own = _ranged(s, F.col("source").asc_nulls_last())
    s = _with_before(s, first=F.lit(1))
    rank = F.col("first") + F.row_number().over(own) - 1
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(cap)).drop("part", "first")
    s, own = _ranged(s.withColumn("ratio", F.col("cap") / F.col("w")), F.col("ratio"), F.col("source").asc_nulls_last())
    s = _with_before(s, caps=F.col("cap"), ws=F.col("w"))
    ahead = own.rowsBetween(Window.unboundedPreceding, -1)
    all_ = s.agg(F.sum("source_size").alias("words"), F.sum("w").alias("weight"))
    s = s.crossJoin(F.broadcast(all_))
    before = F.col("caps") + F.coalesce(F.sum("cap").over(ahead), F.lit(0.0))
    left = F.col("weight") - F.col("ws") - F.coalesce(F.sum("w").over(ahead), F.lit(0.0))
    s = s.withColumn("level", (F.col("words") * share - before) / left)
    water = s.agg(F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).alias("water"))
    s = s.crossJoin(F.broadcast(water))
    return s.select("source", "source_size", "n", F.least("cap", F.coalesce(F.col("water") * F.col("w"), F.col("cap"))).alias("target"))


def _uniform(*keys: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") / float(1 << 53)


def _fold(units: Column) -> Column:
    """Sequential pivotal rounding over an array of units (h, doc_id, size, k, p, r): each comes back, all but the last integral."""

    def step(acc: Column, x: Column) -> Column:
        cur = acc["cur"]

        def unit(of: Column, p: Column) -> Column:
            return F.struct(*[of[k].alias(k) for k in ("h", "doc_id", "size", "k")], p.cast("double").alias("p"), of["r"].alias("r"))

        up = F.least(cur["size"] * (1 - cur["p"]), x["size"] * x["p"])  # words that may go from x to cur
        down = F.least(cur["size"] * cur["p"], x["size"] * (1 - x["p"]))
        rise = x["r"] * (up + down) < down
        # which side becomes integral
        cur_full = cur["size"] * (1 - cur["p"]) <= x["size"] * x["p"]
        cur_empty = cur["size"] * cur["p"] <= x["size"] * (1 - x["p"])
        p_cur = F.when(rise, F.when(cur_full, 1.0).otherwise(cur["p"] + up / cur["size"])).otherwise(F.when(cur_empty, 0.0).otherwise(cur["p"] - down / cur["size"]))
        p_x = F.when(rise, F.when(cur_full, x["p"] - up / x["size"]).otherwise(0.0)).otherwise(F.when(cur_empty, x["p"] + down / x["size"]).otherwise(1.0))
        cur_done = F.when(rise, cur_full).otherwise(cur_empty)
        new_cur, new_x = unit(cur, F.least(F.greatest(p_cur, F.lit(0.0)), F.lit(1.0))), unit(x, F.least(F.greatest(p_x, F.lit(0.0)), F.lit(1.0)))
        fixed = (cur["p"] <= 0) | (cur["p"] >= 1)
        return F.struct(
            F.when(fixed, unit(x, x["p"])).when(cur_done, new_x).otherwise(new_cur).alias("cur"),
            F.concat(acc["out"], F.array(F.when(fixed, unit(cur, cur["p"])).when(cur_done, new_cur).otherwise(new_x))).alias("out"),
        )

    first = F.element_at(units, 1)
    start = F.struct(first.alias("cur"), F.slice(units, 1, 0).alias("out"))
    return F.aggregate(F.slice(units, F.lit(2), F.size(units)), start, step, lambda acc: F.concat(acc["out"], F.array(acc["cur"])))


#: Equal rows that are numbered at a time.
EQUAL = 10_000


def _numbered(units: DataFrame) -> DataFrame:
    """The rows with a number k that tells equal ones apart, so that many of them don't share a group; they are counted before that."""
    rows = units.groupBy("source", "doc_id", "size", "p", "n").agg(F.count(F.lit(1)).alias("m"))
    rows = rows.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(EQUAL).cast("long"))))
    return rows.withColumn("k", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + EQUAL, "m") - 1))).drop("m", "from")


def rounded(units: DataFrame, largest: int, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """source, doc_id, size, chosen from rows (source, doc_id, size > 0, p in (0, 1), n); largest: the largest n of a source."""
    done = []
    level, groups = 0, -(-largest // group)
    at = F.pmod(F.xxhash64("doc_id", "size", "k", F.lit(seed)), F.ceil(F.col("n") / group))
    rows = _numbered(units).select("source", "doc_id", "size", "k", "p", at.cast("long").alias("g"))
    while True:
        drawn = _uniform(F.col("doc_id"), F.col("size"), F.col("k"), F.lit(seed + 101 + level))
        unit = F.struct(F.xxhash64("doc_id", "size", "k", F.lit(seed + 1 + level)).alias("h"), "doc_id", "size", "k", "p", drawn.alias("r"))
        folded = rows.groupBy("source", "g").agg(F.sort_array(F.collect_list(unit)).alias("u")).select("source", "g", F.explode(_fold(F.col("u"))).alias("x"))
        folded = materialise(folded.select("source", "g", "x.doc_id", "x.size", "x.k", "x.p"))
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(folded.where(~open_).select("source", "doc_id", "size", (F.col("p") >= 1).alias("chosen")))
        rows = folded.where(open_).withColumn("g", F.floor(F.col("g") / group))
        if groups <= 1:
            break
        level, groups = level + 1, -(-groups // group)
    done.append(rows.select("source", "doc_id", "size", (_uniform(F.col("doc_id"), F.col("k"), F.lit(seed + 999)) < F.col("p")).alias("chosen")))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for rows (doc_id, text, source).

    Null or empty texts have size 0 and are taken 0 times. A source whose documents are all empty has target 0. Repeated rows are units
    of their own; equal ones may differ in copies. No rows give no rows. Other columns are ignored. The draw depends on doc_id, size and
    seed alone, so reruns agree.
    """
    sizes = materialise(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")))
    per_source = materialise(targets(sizes.select("source", "size"), weights, share, cap))
    largest = per_source.agg(F.max("n")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = per_source.select(F.col("source").alias("s"), "source_size", "target", "n", F.floor(rate).alias("base"), (rate - F.floor(rate)).alias("p"))
    rows = sizes.join(t, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    free = (F.col("size") > 0) & (F.col("p") > 0)
    big = F.col("size") * BIG > F.col("source_size")
    fixed = rows.where(~free).select("source", "doc_id", "size", F.lit(False).alias("chosen"))
    first = rounded(rows.where(free & big).withColumn("n", F.lit(1)), 1, seed + 7)
    first = materialise(first.join(t.select("s", F.col("p")), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    over = first.groupBy("source").agg(F.sum(F.col("size") * (F.col("chosen").cast("double") - F.col("p"))).alias("over"), F.sum("size").alias("settled"))
    small = rows.where(free & ~big).join(over.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    rest = F.col("source_size") - F.coalesce("settled", F.lit(0))
    small = small.withColumn("p", F.least(F.greatest(F.col("p") - F.coalesce(F.col("over") / rest, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    drawn = rounded(small, largest, seed).unionByName(first.drop("p"))
    out = fixed.unionByName(drawn).join(t, F.col("source").eqNullSafe(F.col("s")), "left")
    copies = F.when(F.col("size") > 0, F.col("base") + F.col("chosen").cast("long")).otherwise(F.lit(0)).cast("long")
    return out.select("doc_id", "source", "size", "source_size", F.col("target").cast("double"), copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def apply(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as many times as the mix takes it, with their columns, which may have any names.

    Rows with equal id, source and size are alike to the mix: of c copies that m such rows have, each gets c / m, and the first by a hash of the
    text one more where that isn't whole.
    """

    def keyed(rows: DataFrame, source: Column) -> DataFrame:
        """The rows with a key without nulls, by which the join and the places below share one shuffle."""
        parts = {"key_id": F.coalesce("doc_id", F.lit(0).cast("long")), "key_none": F.col("doc_id").isNull(), "key_source": F.coalesce(source, F.lit("")), "key_bare": source.isNull()}
        return rows.withColumns(parts)

    key = ["key_id", "key_none", "key_source", "key_bare", "size"]
    plan = keyed(mix(docs, **options), F.col("source")).groupBy(*key).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("m")).where("copies > 0")
    rows = keyed(packed(docs, "doc_id", "text").withColumn("size", word_count(F.col("text"))), F.col("rest")["source"].cast("string")).join(plan, key)
    # only equal rows have to be told apart; one by itself, as nearly all are, gets its copies without a place
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("text"))) - 1
    own = F.when(F.col("m") == 1, F.col("copies")).otherwise(F.floor(F.col("copies") / F.col("m")) + F.when(place < F.col("copies") % F.col("m"), 1).otherwise(0))
    rows = rows.withColumn("own", own.cast("int")).where("own > 0")
    rows = rows.select("doc_id", "text", "rest", F.explode(F.sequence(F.lit(1), F.col("own"))).alias("copy"))
    return unpacked(rows, docs.columns, "doc_id", "text").select(*quoted(docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")
