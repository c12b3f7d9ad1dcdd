"""The queries, each an operator applied to the papers that the driver's documents stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import estimate
from ..functions.dates import month_axis, parse_date
from ..functions.lists import COMMON_MARKERS, CUTOFFS, IGNORED_WORDS, PREPRINTS
from ..functions.text import canonical_title, clean_title, crop, sample, standard_sections, word_count
from ..operators import cleaning, cutoffs, frequency, language, lemmas, matrix, quantiles, reports, simulation
from ..sources import ingest
from ..sources.corpus import FIRST_YEAR, TITLES, YEARS, head_tokens, kept, lemma_tokens, materialised, papers, read_word_table, renames, scratch, section_parts, section_tokens, table, tokenised
from ..sources.xml import country_table, html_title, parse_articles

FIRST, LAST = FIRST_YEAR, FIRST_YEAR + YEARS - 1
#: The yearly means of months begin here.
MEANS = 2010
#: Training ends before this year and takes so many years.
END, LENGTH = 2023, 5
#: Share of papers (percent) that a marker word is in, at least and at most; from COMMON on it is a common one.
MARKER_LEAST, MARKER_MOST, COMMON = 2, 10, 5
#: Cutoff of the low-frequency group; on a corpus of millions of papers 0.0038 is usual.
LOW_CUTOFF = 0.04
RAW_TITLES = ["1. Introduction", "METHODS:", "Results & analysis", "3 Discussion", "Related Work", "Funding", "Summary and\nOutlook", "2.1 Materials and Methods"]
RAW_JOURNALS = ["Journal of Neurology", "Neurological Journal", "Journal of Cancer Biochemistry", "The Biochemistry of Cancer", "Biomaterials", "Annals of Things"]


def r(c: Column | str) -> Column:
    """Rounded for comparison. A value on the edge of the sixth digit would go up or down by its last bit: it is rounded to nine digits first, and moved off the edge.
    + 0.0 turns a negative zero into zero."""
    return F.round(F.round(F.col(c) if isinstance(c, str) else c, 9) + F.lit(1e-10), 6) + F.lit(0.0)


def _band(df: DataFrame, p: DataFrame) -> DataFrame:
    """Rows with a doc_freq in a band, and their grp. The words are at most the mean number of words of a paper / 2 %."""
    df = df.crossJoin(F.broadcast(p.agg(F.count(F.lit(1)).alias("_n"))))
    df = df.where((F.col("doc_freq") * 100 >= MARKER_LEAST * F.col("_n")) & (F.col("doc_freq") * 100 <= MARKER_MOST * F.col("_n")))
    return df.withColumn("grp", F.when(F.col("doc_freq") * 100 >= COMMON * F.col("_n"), "common").otherwise("rare")).drop("_n")


def _markers(rows: DataFrame, p: DataFrame) -> DataFrame:
    return _band(frequency.document_frequency(rows), p)


def _base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = tokenised(spark, sf_dir)
    return p, frequency.postings(p)


def corpus_funnel(spark, sf_dir):
    return cleaning.funnel(papers(spark, sf_dir))


def funnel_discarded(spark, sf_dir):
    f = cleaning.funnel(papers(spark, sf_dir), "journal").withColumn("discarded", 1 - F.col("after_date") / F.col("before_prep"))
    return f.agg(F.sum("before_prep").alias("before_prep"), F.sum("after_date").alias("after_prep"), r(F.avg("discarded")).alias("mean_discarded"), r(F.percentile("discarded", 0.5)).alias("median_discarded"))


def dedupe_latest(spark, sf_dir):
    p = papers(spark, sf_dir).select("doc_id", "date", "journal", F.lit(1).alias("load"))
    again = p.where("doc_id % 3 = 0").withColumn("load", F.lit(2)).withColumn("journal", F.concat("journal", F.lit("x")))
    return cleaning.keep_first(p.unionByName(again), "doc_id", "load").select("doc_id", F.year("date").alias("year"), "journal", "load")


def upsert_by_key(spark, sf_dir):
    """Papers merged by doc_id in two loads: of those that are in both, the first stays. The second load has some years only."""
    p = papers(spark, sf_dir).select("doc_id", "year", "journal")
    path = scratch(spark)
    ingest.upsert(spark, path, p.where("doc_id % 3 <> 0").withColumn("load", F.lit(1)), "doc_id", "year")
    ingest.upsert(spark, path, p.where("year >= 2020").withColumn("load", F.lit(2)).withColumn("journal", F.concat("journal", F.lit("x"))), "doc_id", "year")
    return ingest.merged(spark, path).select("doc_id", F.col("year").cast("int").alias("year"), "journal", "load")


def language_inferred(spark, sf_dir):
    p = papers(spark, sf_dir).withColumn("language", F.when(F.col("doc_id") % 2 == 0, F.col("language")))
    return cleaning.infer_language(p).groupBy("language").agg(F.count(F.lit(1)).alias("n"))


def _undeclared(spark, sf_dir):
    """The papers, of which every other one declares no language, and the first line of each as a short text."""
    p = papers(spark, sf_dir).withColumn("declared", F.col("language")).withColumn("language", F.when(F.col("doc_id") % 2 == 0, F.col("language")))
    return p.withColumn("head", F.get("sections", F.lit(0)))


def language_profiles(spark, sf_dir):
    """The most frequent letter n-grams of each declared language, in order."""
    return language.profiles(_undeclared(spark, sf_dir))


def language_detected(spark, sf_dir):
    """The language of every paper that declares none, by its first line, or by the whole text where the line is too short."""
    p = _undeclared(spark, sf_dir)
    return language.detect(p.where("language is null"), language.profiles(p), short="head", long="abstract")


def funnel_language(spark, sf_dir):
    """The cleaning funnel with languages inferred where none is declared, only of the papers that come to that stage, and the failures."""
    p, steps = _undeclared(spark, sf_dir), cleaning.stages()
    came = language.inferred(cleaning.clean(p, steps[:3]), language.profiles(p), short="head", long="abstract")
    first, rest = cleaning.funnel(p, steps=steps[:3]), cleaning.funnel(came, steps=steps[3:])
    return first.crossJoin(F.broadcast(rest.drop("before_prep")))  # two single rows


def _titled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    titles = F.transform(lines, lambda _, i: F.element_at(F.array(*[F.lit(t) for t in RAW_TITLES]), (i % len(RAW_TITLES) + 1).cast("int")))
    return docs.select("doc_id", titles.alias("titles"), lines.alias("lines"))


def section_standardize(spark, sf_dir):
    made = _titled(spark, sf_dir).select("doc_id", F.explode(standard_sections(F.col("titles"), F.col("lines"))).alias("section", "text"))
    return made.select("doc_id", "section", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def section_set_filter(spark, sf_dir):
    p = papers(spark, sf_dir).withColumn("sections", standard_sections(F.col("section_titles"), F.col("sections")))
    return cleaning.with_sections(p, TITLES).select("doc_id", F.length("full").cast("long").alias("full_chars"), F.length("methods").cast("long").alias("methods_chars"))


def _sections_long(spark, sf_dir):
    p = papers(spark, sf_dir)
    return p.select("doc_id", "year", F.explode(standard_sections(F.col("section_titles"), F.col("sections"))).alias("section", "text"))


def section_length_quantiles(spark, sf_dir):
    s = _sections_long(spark, sf_dir).withColumn("n", word_count(F.col("text")))
    q = lambda x: F.floor(F.percentile("n", x) + 1e-9).cast("long")
    return s.groupBy("section").agg(q(0.05).alias("p05"), q(0.5).alias("median"), q(0.95).alias("p95"), F.min("n").alias("least"), r(F.avg("n")).alias("mean"))


def melt_lengths(spark, sf_dir):
    p = papers(spark, sf_dir).withColumn("m", standard_sections(F.col("section_titles"), F.col("sections")))
    wide = p.select("doc_id", *[F.coalesce(word_count(F.element_at("m", t)), F.lit(0).cast("long")).alias(t) for t in TITLES])
    return wide.unpivot(["doc_id"], TITLES, "section", "n_words")


def date_normalize(spark, sf_dir):
    k, y = F.col("doc_id"), (F.lit(2000) + F.col("doc_id") % 26).cast("string")
    m = (1 + F.col("doc_id") % 12).cast("int")
    short = F.element_at(F.array(*[F.lit(x) for x in ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")]), m)
    season = F.element_at(F.array(*[F.lit(x) for x in ("Spring", "Summer", "Fall", "Winter")]), (k % 4 + 1).cast("int"))
    day = (1 + k % 28).cast("string")
    raw = (
        F.when(k % 6 == 0, F.concat_ws("-", day, m.cast("string"), y))
        .when(k % 6 == 1, F.concat(short, F.lit("-Dec-"), y))
        .when(k % 6 == 2, F.concat_ws("-", season, y))
        .when(k % 6 == 3, F.concat(day, F.lit("-"), m.cast("string"), F.lit("-"), y, F.lit("-November-17")))
        .when(k % 6 == 4, F.concat(F.lit("Someday-"), y))
    )
    return table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"), F.date_format(parse_date(raw), "yyyy-MM-dd").alias("date"))


def token_docfreq(spark, sf_dir):
    _, rows = _base(spark, sf_dir)
    return frequency.document_frequency(rows)


def docfreq_floor(spark, sf_dir):
    p, rows = _base(spark, sf_dir)
    return frequency.document_frequency(rows, p, 0.05)


def papers_per_month(spark, sf_dir):
    return frequency.calendar(papers(spark, sf_dir), FIRST, LAST, monthly=True)


def mean_papers_per_month(spark, sf_dir):
    return frequency.papers_per(papers(spark, sf_dir), "year", "month").agg(r(F.avg("n_papers")).alias("mean_papers"), F.max("n_papers").alias("most"))


def _yearly(p: DataFrame, rows: DataFrame) -> DataFrame:
    counts = _band(frequency.yearly(rows, FIRST, LAST), p)
    return frequency.with_frequency(counts, frequency.calendar(p, FIRST, LAST), "year").select("word", "year", "n", "n_papers", "freq")


GROUPS = ("common", "rare")


def marker_table(spark, sf_dir):
    """(word, doc_freq, grp, freq) of the marker words, with their frequency of 2024; kept for all queries of a session. The band bounds their number, whatever the
    size of the corpus, as a published list is."""

    def make() -> DataFrame:
        p, rows = _base(spark, sf_dir)
        counts = rows.groupBy("word").agg(F.count(F.lit(1)).alias("doc_freq"), F.count_if(F.col("year") == 2024).alias("n"))
        return frequency.with_frequency(_band(counts, p).withColumn("year", F.lit(2024)), frequency.calendar(p, 2024, 2024), "year").select("word", "doc_freq", "grp", "freq")

    return kept(spark, sf_dir, "markers", make)


def marked_papers(spark, sf_dir):
    """The papers with the frequency of their rarest marker word, and whether they have any of each group; kept for all queries of a session."""
    return kept(spark, sf_dir, "marked", lambda: frequency.marked(tokenised(spark, sf_dir).drop("short"), marker_table(spark, sf_dir), GROUPS))


def word_year_freq(spark, sf_dir):
    """Smoothed yearly frequency of the marker words."""
    p, rows = _base(spark, sf_dir)
    return _yearly(p, rows).select("word", "year", "n", "n_papers", r("freq").alias("freq"))


def _monthly(p, rows):
    """The marker words in all months."""
    months = frequency.calendar(p, FIRST, LAST, monthly=True)
    words = _markers(rows, p).select("word")
    counts = frequency.word_counts(rows.join(F.broadcast(words), "word", "left_semi"), "year", "month")
    return frequency.grid(counts, ["word"], months, ("year", "month"), words)


def word_month_grid(spark, sf_dir):
    g = _monthly(*_base(spark, sf_dir))
    return g.where("year >= 2018").select("word", "year", "month", "n", r("freq").alias("freq"), r(month_axis(F.col("year"), F.col("month"))).alias("time"))


def _series(spark, sf_dir):
    """Yearly means of the months' frequencies of every word, the years as one array."""
    p = tokenised(spark, sf_dir)
    return frequency.mean_series(p, frequency.calendar(p, FIRST, LAST, monthly=True), "word", MEANS, LAST)


def _mean(spark, sf_dir):
    """The same as rows."""
    p = tokenised(spark, sf_dir)
    return frequency.mean_of_months(p, frequency.calendar(p, FIRST, LAST, monthly=True), "word", MEANS, LAST)


def yearly_mean_freq(spark, sf_dir):
    return _mean(spark, sf_dir).select("word", "year", r("mean_freq").alias("mean_freq"))


def _lagged(spark, sf_dir, keep=None):
    return frequency.lagged_series(_series(spark, sf_dir), "word", MEANS, keep)


def lag_projection(spark, sf_dir):
    return _lagged(spark, sf_dir).select("word", "year", r("projection").alias("projection"), r("ratio").alias("ratio"), r("gap").alias("gap"))


def _excess(spark, sf_dir):
    # rounded, as a word that is just as frequent as the rule asks is in or out by the last bit
    rule = lambda x: F.coalesce(estimate.is_excess(F.round(x["ratio"], 9), F.round(x["gap"], 9), F.round(x["mean_freq"], 9)), F.lit(False))
    return _lagged(spark, sf_dir, rule).where(~F.col("word").isin(IGNORED_WORDS))


def excess_words(spark, sf_dir):
    return _excess(spark, sf_dir).select("word", "year", r("ratio").alias("ratio"), r("gap").alias("gap"))


def excess_count_per_year(spark, sf_dir):
    return _excess(spark, sf_dir).groupBy("year").agg(F.count(F.lit(1)).alias("n_words"))


def excess_distinct(spark, sf_dir):
    return _excess(spark, sf_dir).select("word").distinct()


def ratio_filter(spark, sf_dir):
    m = _mean(spark, sf_dir).where("year in (2022, 2024)")
    two = m.groupBy("word").agg(F.max(F.when(F.col("year") == 2022, F.col("mean_freq"))).alias("a"), F.max(F.when(F.col("year") == 2024, F.col("mean_freq"))).alias("b"))
    return two.where(F.round(estimate.ratio(F.col("b"), F.col("a")), 9) > 1.1).select("word", r(estimate.ratio(F.col("b"), F.col("a"))).alias("ratio"))


def _groups(spark, sf_dir, monthly=False):
    p = marked_papers(spark, sf_dir)
    return frequency.flag_frequency(p, list(GROUPS), frequency.calendar(p, FIRST, LAST, monthly), *(("year", "month") if monthly else ("year",)))


def two_groups_year(spark, sf_dir):
    return _groups(spark, sf_dir).select("grp", "year", "n", "n_papers", r("freq").alias("freq"))


def two_groups_month(spark, sf_dir):
    return _groups(spark, sf_dir, True).select("grp", "year", "month", "n", r("freq").alias("freq"))


def common_markers_freq(spark, sf_dir):
    """The published group of common marker words."""
    p = tokenised(spark, sf_dir)
    f = frequency.group_frequency(p, {"common": COMMON_MARKERS}, frequency.calendar(p, FIRST, LAST), "year")
    return f.select("year", "n", "n_papers", r("freq").alias("freq"))


def _projected(spark, sf_dir):
    return frequency.regression(_groups(spark, sf_dir), ["grp"], "year", "freq", END, LENGTH)


def ols_projection(spark, sf_dir):
    return _projected(spark, sf_dir).select("grp", "year", r("freq").alias("freq"), r("projection").alias("projection"), r("sdev").alias("sdev"))


def gap_ratio_usage(spark, sf_dir):
    x = _projected(spark, sf_dir)
    return x.select("grp", "year", r("gap").alias("gap"), r("ratio").alias("ratio"), r(estimate.usage(F.col("freq"), F.col("projection"))).alias("usage"))


def word_projection(spark, sf_dir):
    """Tidy report per marker word: frequency, projection, gap, ratio, error, usage of the years from 2020."""
    p, rows = _base(spark, sf_dir)
    x = frequency.regression(_yearly(p, rows), ["word"], "year", "freq", END, LENGTH).where("year >= 2020")
    return x.select("word", "year", *[r(c).alias(c) for c in ("freq", "projection", "gap", "sdev")], r("ratio").alias("ratio"), r(estimate.usage(F.col("freq"), F.col("projection"))).alias("usage"))


def month_projection(spark, sf_dir):
    """Monthly groups, trained on the 24 months before November 2022, from 2022 on."""
    g = _groups(spark, sf_dir, True).withColumn("i", frequency.period_index(F.col("year"), F.col("month")))
    x = frequency.regression(g, ["grp"], "i", "freq", 2022 * 12 + 10, 24).where("year >= 2022")
    return x.select("grp", "year", "month", r("projection").alias("projection"), r("sdev").alias("sdev"), r(estimate.usage(F.col("freq"), F.col("projection"))).alias("usage"))


def last_usage(spark, sf_dir):
    g = _groups(spark, sf_dir, True).withColumn("i", frequency.period_index(F.col("year"), F.col("month")))
    x = frequency.regression(g, ["grp"], "i", "freq", 2022 * 12 + 10, 24)
    x = x.withColumn("usage", estimate.usage(F.col("freq"), F.col("projection")))
    return x.groupBy("grp").agg(r(F.max_by("usage", "i")).alias("usage"))


def digits(c: Column) -> Column:
    """Six significant digits, for values of any size."""
    return F.when(c.isNotNull(), F.format_string("%.5e", c))


def standard_errors(spark, sf_dir):
    """All errors of both groups and of each marker word, with projections of 1 and more, which the clamps bring below 1."""
    p, rows = _base(spark, sf_dir)
    x = frequency.regression(_yearly(p, rows), ["word"], "year", "freq", END, LENGTH).select("word", "year", "freq", "n_papers", "projection", "sdev")
    x = _projected(spark, sf_dir).select(F.col("grp").alias("word"), "year", "freq", "n_papers", "projection", "sdev").unionByName(x)
    p_ = F.round("projection", 12)  # what is 1 but for rounding is 1
    cols = {f"{f}_{v}": estimate.standard_error(p_, F.col("freq"), F.col("n_papers"), v, F.col("sdev"), f) for f in ("usage", "gap") for v in ("binomial", "regression", "both")}
    return x.select("word", "year", *[digits(c).alias(name) for name, c in cols.items()])


def usage_band(spark, sf_dir):
    """Usage of the groups with its error, an interval. A projection of 1 and more counts as just below 1 in the error, which then is large: six digits are compared."""
    x = _projected(spark, sf_dir).where("year >= 2018").withColumn("usage", estimate.usage(F.col("freq"), F.col("projection")))
    low, high = estimate.band(F.col("usage"), estimate.standard_error(F.round("projection", 12), F.col("freq"), F.col("n_papers"), "regression", F.col("sdev")))
    return x.select("grp", "year", digits(F.col("usage")).alias("usage"), digits(low).alias("low"), digits(high).alias("high"))


def low_frequency_month(spark, sf_dir):
    """The group of words that are rarer than a cutoff in 2024, month by month, with a projection from 60 months, partly collected months left out."""
    p = marked_papers(spark, sf_dir).withColumn("low", F.coalesce(F.round("rarest", 9) < LOW_CUTOFF, F.lit(False)))
    g = frequency.flag_frequency(p, ["low"], frequency.calendar(p, FIRST, LAST, monthly=True), "year", "month")
    g = frequency.without_partial(g, FIRST * 12, LAST * 12 + 9).withColumn("i", frequency.period_index(F.col("year"), F.col("month")))
    x = frequency.regression(g, ["grp"], "i", "freq", 2022 * 12 + 10, 60)
    return x.select("year", "month", "n", r("freq").alias("freq"), r("projection").alias("projection"), r("sdev").alias("sdev"), r("gap").alias("gap"))


def error_band(spark, sf_dir):
    x = _projected(spark, sf_dir).where("year >= 2018")
    return x.select("grp", "year", r(F.col("projection") - F.col("sdev")).alias("low"), r(F.col("projection") + F.col("sdev")).alias("high"))


def _cutoffs(spark, sf_dir):
    p, rows = _base(spark, sf_dir)
    return p, rows, marker_table(spark, sf_dir).select("word", "freq"), cutoffs.cutoff_table(spark, CUTOFFS)


def cutoff_lists(spark, sf_dir):
    _, _, y, c = _cutoffs(spark, sf_dir)
    return cutoffs.cutoff_lists(y, c).groupBy("cutoff").agg(F.count(F.lit(1)).alias("n_words"))


def _swept(spark, sf_dir):
    _, _, y, c = _cutoffs(spark, sf_dir)
    p = marked_papers(spark, sf_dir)
    return cutoffs.sweep_rarest(p.select("year", "rarest"), c, frequency.calendar(p, FIRST, LAST)), y, c


def cutoff_sweep(spark, sf_dir):
    return _swept(spark, sf_dir)[0].where("year >= 2018").select("cutoff", "year", "n", r("freq").alias("freq"))


def _estimated(spark, sf_dir):
    s, y, c = _swept(spark, sf_dir)
    return cutoffs.without_saturated(cutoffs.estimated(s, ["cutoff", "step"], END, LENGTH)), y, c


def sweep_filtered(spark, sf_dir):
    x = _estimated(spark, sf_dir)[0]
    return x.select("cutoff", "year", *[r(k).alias(k) for k in ("projection", "gap", "usage", "binomial_var")])


#: Bounds of the standard error before which the best cutoff is sought: the published one, which some forty papers a year hardly meet, and a wide one.
MOST_SE = [0.025, 0.8]


def _best(x: DataFrame, *by: str) -> DataFrame:
    """The best cutoff of each year (and `by`) from 2023 on, for each bound of the error."""
    bounds = F.broadcast(x.sparkSession.createDataFrame([(b,) for b in MOST_SE], "most_se double"))
    return cutoffs.optimum(x.where("year >= 2023").crossJoin(bounds), F.col("most_se"), by=("most_se", *by))


def optimal_cutoff(spark, sf_dir):
    return _best(_estimated(spark, sf_dir)[0]).select("most_se", "year", "cutoff", r("usage").alias("usage"))


def fixed_cutoff(spark, sf_dir):
    """The best cutoff of 2025 in all years."""
    x = _estimated(spark, sf_dir)[0]
    best = _best(x).where("year = 2025").select("most_se", "step")
    return x.join(F.broadcast(best), "step").select("most_se", "cutoff", "year", r("usage").alias("usage"))


def chosen_words(spark, sf_dir):
    x, y, c = _estimated(spark, sf_dir)
    best = _best(x).where("year = 2025").select("most_se", "step")
    return cutoffs.cutoff_lists(y, c).join(F.broadcast(best), "step").select("most_se", "word")


def neighbour_cutoffs(spark, sf_dir):
    """Each cutoff with the two lower ones, and the marker words below it."""
    _, _, y, c = _cutoffs(spark, sf_dir)
    n = cutoffs.cutoff_lists(y, c).groupBy("step").agg(F.count(F.lit(1)).alias("n_words"))
    return cutoffs.neighbours(c).join(n, "step", "left").withColumn("n_words", F.coalesce("n_words", F.lit(0).cast("long")))


def marker_order(spark, sf_dir):
    """Every marker word with its frequency of 2024, the rarest first."""
    _, _, y, _ = _cutoffs(spark, sf_dir)
    return y.orderBy("freq", "word").select("word", r("freq").alias("freq"))


def _section_base(spark, sf_dir):
    """Sections, and their postings of the papers' marker words."""
    sections = section_tokens(spark, sf_dir)
    rows = frequency.postings(sections, ("section", "doc_id", "year", "month"))
    return sections, rows.join(F.broadcast(marker_table(spark, sf_dir).select("word")), "word", "left_semi")


def _section_years(sections):
    return frequency.calendar_of(sections, FIRST, LAST, "section")


def _section_freq(sections, rows):
    return frequency.with_frequency(frequency.yearly(rows, FIRST, LAST, ("section", "word")), _section_years(sections), "section", "year")


def section_year_freq(spark, sf_dir):
    """Smoothed yearly frequency of the marker words in each section."""
    f = _section_freq(*_section_base(spark, sf_dir))
    return f.select("section", reports.section_order(F.col("section"), [*TITLES, "full"]).alias("place"), "word", "year", "n", "n_papers", r("freq").alias("freq"))


def section_projection(spark, sf_dir):
    """Projection of each marker word in each section."""
    x = frequency.regression(_section_freq(*_section_base(spark, sf_dir)), ["section", "word"], "year", "freq", END, LENGTH).where("year >= 2023")
    return x.select("section", "word", "year", *[r(c).alias(c) for c in ("projection", "sdev", "gap", "ratio")])


def _section_swept(spark, sf_dir):
    sections, rows = _section_base(spark, sf_dir)
    y = _section_freq(sections, rows).where("year = 2024").select("section", "word", "freq")
    c = cutoffs.cutoff_table(spark, CUTOFFS)
    return cutoffs.sweep(rows, y, c, _section_years(sections), ("section",)), y, c


def section_sweep(spark, sf_dir):
    return _section_swept(spark, sf_dir)[0].where("year >= 2018").select("section", "cutoff", "year", "n", r("freq").alias("freq"))


def _section_best(spark, sf_dir):
    s, y, c = _section_swept(spark, sf_dir)
    x = cutoffs.without_saturated(cutoffs.estimated(s, ["section", "cutoff", "step"], END, LENGTH), by=("section",))
    return _best(x, "section"), y, c


def section_optimum(spark, sf_dir):
    return _section_best(spark, sf_dir)[0].select("most_se", "section", "year", "cutoff", r("usage").alias("usage"), r("se").alias("se"))


def subopt_lists(spark, sf_dir):
    """The words of the section's best cutoff of 2025, and of those one and two steps lower, by the wide bound."""
    best, y, c = _section_best(spark, sf_dir)
    return cutoffs.chosen_lists(best.where((F.col("year") == 2025) & (F.col("most_se") == MOST_SE[1])), cutoffs.cutoff_lists(y, c), ("section",))


def _hits(spark, sf_dir):
    """The papers, and whether each has a rare marker word."""
    return marked_papers(spark, sf_dir), F.col("rare")


def _countries(spark, sf_dir):
    p, hit = _hits(spark, sf_dir)
    groups = reports.memberships(F.col("country"), ["NATION_1", "NATION_2", "NATION_3", "NATION_4", "NATION_5"], ["NATION_2", "NATION_7", "NATION_12"])
    return reports.overlapping_frequency(p, hit, groups, "year")


def country_freq(spark, sf_dir):
    return _countries(spark, sf_dir).select("grp", "year", "n_papers", "n", r("freq").alias("freq"))


def country_pivot(spark, sf_dir):
    x = _countries(spark, sf_dir).where("year >= 2022").withColumn("freq", r("freq"))
    return reports.pivoted(x.withColumn("y", F.concat(F.lit("y"), F.col("year"))), "grp", "y", [f"y{k}" for k in range(2022, 2026)], "freq")


def country_compare(spark, sf_dir):
    x = _countries(spark, sf_dir)
    a, b = (x.where(F.col("year") == y).select("grp", F.col("freq").alias(n)) for y, n in ((2022, "before"), (2025, "after")))
    side = F.when(F.col("grp").isin("english", "NATION_2"), "NES").otherwise("NNES")
    return a.join(b, "grp").select("grp", side.alias("side"), r("before").alias("before"), r("after").alias("after"), r(F.col("after") - F.col("before")).alias("change"))


def region_freq(spark, sf_dir):
    p, hit = _hits(spark, sf_dir)
    return reports.overlapping_frequency(p, hit, F.array("region"), "year").select("grp", "year", "n_papers", "n", r("freq").alias("freq"))


def _labelled(p):
    return p.withColumn("journal", F.element_at(F.array(*[F.lit(x) for x in RAW_JOURNALS]), (F.col("doc_id") % 6 + 1).cast("int")))


def discipline_label(spark, sf_dir):
    return reports.journal_labels(_labelled(papers(spark, sf_dir)))


def discipline_freq(spark, sf_dir):
    p, hit = _hits(spark, sf_dir)
    p = _labelled(p)
    p = p.join(reports.journal_labels(p), "journal")
    large = reports.large_groups(p, "label", 50)
    x = reports.overlapping_frequency(p.join(F.broadcast(large.select("label")), "label", "left_semi"), hit, F.array("label"), "year")
    return x.select("grp", "year", "n_papers", "n", r("freq").alias("freq"))


def discipline_share(spark, sf_dir):
    p = _labelled(papers(spark, sf_dir))
    p = p.join(reports.journal_labels(p), "journal")
    return p.agg(r(F.avg(F.col("label").isNotNull().cast("int"))).alias("labelled"), F.countDistinct("label").alias("labels"))


def journal_counts(spark, sf_dir):
    p = papers(spark, sf_dir)
    return p.groupBy("journal").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "journal").limit(5)


def _journals_skewed(spark, sf_dir):
    # journals of different sizes: the source, or for half of the papers one of three large ones
    return papers(spark, sf_dir).withColumn("journal", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("big"), (F.col("doc_id") % 3).cast("string"))).otherwise(F.col("journal")))


def journal_other(spark, sf_dir):
    n = _journals_skewed(spark, sf_dir).groupBy("journal").agg(F.count(F.lit(1)).alias("n"))
    return reports.with_other(n, "journal", "n", F.col("n") < 100)


def journal_share(spark, sf_dir):
    p = _journals_skewed(spark, sf_dir)
    n = p.groupBy("year", "journal").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(frequency.papers_per(p, "year")), "year")
    key = F.when(F.col("n") * 20 < F.col("n_papers"), "Other").otherwise(F.col("journal"))
    return n.groupBy("year", key.alias("journal"), "n_papers").agg(F.sum("n").alias("n")).select("year", "journal", "n", r(F.col("n") / F.col("n_papers")).alias("share"))


def _present(spark, sf_dir):
    return papers(spark, sf_dir).select("year", F.concat("journal", (F.col("doc_id") % 7).cast("string")).alias("key")).distinct()


def journals_removed(spark, sf_dir):
    return reports.turnover(_present(spark, sf_dir), 1)


def journals_added(spark, sf_dir):
    return reports.turnover(_present(spark, sf_dir), -1)


def journals_removed_often(spark, sf_dir):
    """Journals with more than one paper in a year that have none in the next."""
    p = papers(spark, sf_dir).groupBy("year", F.concat("journal", (F.col("doc_id") % 3).cast("string")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return reports.turnover(p, 1, more_than=1)


def journal_names(spark, sf_dir):
    """Papers by journal, of which some have another spelling."""
    names = {f"src{k}": f"Source {k}" for k in range(0, 20, 3)}
    return papers(spark, sf_dir).groupBy(reports.remapped(F.col("journal"), names).alias("journal")).agg(F.count(F.lit(1)).alias("n"))


def journals_per_year(spark, sf_dir):
    return papers(spark, sf_dir).groupBy("year").agg(F.countDistinct("journal").alias("journals"), F.countDistinct("country").alias("countries"))


def null_share(spark, sf_dir):
    p = papers(spark, sf_dir).withColumn("country", F.when(F.col("doc_id") % 5 != 0, F.col("country"))).withColumn("language", F.when(F.col("doc_id") % 3 != 0, F.col("language")))
    return reports.null_shares(p, ["doc_id", "country", "language", "journal"]).withColumn("null_share", r("null_share"))


def dup_ids(spark, sf_dir):
    p = papers(spark, sf_dir).select((F.col("doc_id") % 400).alias("id"))
    return p.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def word_lemmas(spark, sf_dir):
    """The lemma of every word that isn't its own, and the American spelling of every word with a British one."""
    spellings, lemma = renames(spark, sf_dir)
    return lemma.withColumn("kind", F.lit("lemma")).unionByName(spellings.withColumn("kind", F.lit("spelling")))


def lemma_sum(spark, sf_dir):
    counts = frequency.word_counts(_base(spark, sf_dir)[1], "year")
    return lemmas.count_sum(lemmas.rename(counts, *renames(spark, sf_dir)), "year")


def lemma_union(spark, sf_dir):
    return lemmas.count_lemmatised(lemma_tokens(spark, sf_dir), "year")


def delemmatize(spark, sf_dir):
    p, rows = _base(spark, sf_dir)
    return lemmas.surface_words(_markers(rows, p).select("word"), renames(spark, sf_dir)[1])


def layout_topk(spark, sf_dir):
    layout = F.array_join(F.array_sort(F.array_distinct(F.transform("section_titles", lambda t: canonical_title(t)))), "|")
    p = papers(spark, sf_dir).select("article_type", layout.alias("layout"))
    return p.groupBy("article_type", "layout").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "article_type", "layout").limit(5)


def title_counts(spark, sf_dir):
    t = _titled(spark, sf_dir).select(F.explode("titles").alias("raw"))
    return t.groupBy(F.lower(clean_title(F.col("raw"))).alias("title"), canonical_title(F.col("raw")).alias("section")).agg(F.count(F.lit(1)).alias("n"))


def substring_probe(spark, sf_dir):
    p = papers(spark, sf_dir)
    return p.groupBy("year").agg(F.count_if(F.contains(F.lower("abstract"), F.lit("tion the"))).alias("n"))


def _cut(p, short: Column) -> DataFrame:
    whole = F.concat_ws(" ", F.filter(F.split("abstract", r"\s+"), lambda w: w != ""))
    contained = (word_count(F.col("abstract")) <= 50) | F.contains(whole, short)
    return p.select("doc_id", word_count(short).alias("n_words"), contained.alias("contained"), F.md5(short.cast("binary")).alias("digest"))


def crop_words(spark, sf_dir):
    """Fifty words in a row of each paper."""
    return _cut(papers(spark, sf_dir), crop(F.col("abstract"), 50, F.col("doc_id")))


def sample_words(spark, sf_dir):
    """Fifty words of each paper, drawn one by one."""
    return _cut(papers(spark, sf_dir), sample(F.col("abstract"), 50, F.col("doc_id"))).drop("contained")


def html_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html_title(F.col("html")).alias("title"))


def simulated_recovery(spark, sf_dir):
    s = simulation.simulate(spark, 100, 4000, [0.1, 0.3, 0.5, 0.7, 0.9], CUTOFFS)
    return simulation.recovered(s).select("share", r("usage").alias("usage"), r("gap").alias("gap"), "cutoff")


def floor_year_mean(spark, sf_dir):
    g = _monthly(*_base(spark, sf_dir)).withColumn("time", month_axis(F.col("year"), F.col("month"))).drop("year")
    return frequency.floor_mean(g, "freq", "word").select("word", "year", r("freq").alias("freq"))


def aligned_counts(spark, sf_dir):
    """Words of the earlier and of the later half of the years side by side."""
    _, rows = _base(spark, sf_dir)
    half = FIRST + YEARS // 2
    first, last = (frequency.word_counts(rows.where(x)) for x in (F.col("year") < half, F.col("year") >= half))
    return frequency.aligned(first, last, ["word"], "n")


def funnel_transposed(spark, sf_dir):
    f = cleaning.funnel(papers(spark, sf_dir))
    return reports.transposed(f, f.columns)


def _lemma_swept(spark, sf_dir):
    """The sweep over lemmas: words of one lemma are one."""
    p = tokenised(spark, sf_dir)
    renamed = frequency.postings(lemma_tokens(spark, sf_dir), ("doc_id", "year")).where(F.length("word") >= 4)
    y = _yearly(p, renamed).where("year = 2024").select("word", "freq")
    c = cutoffs.cutoff_table(spark, [0.02, 0.05, 0.07, 0.1, 0.15, 0.2, 0.3, 0.5, 1.0])
    return cutoffs.sweep(renamed, y, c, frequency.calendar(p, FIRST, LAST))


def lemma_sweep(spark, sf_dir):
    return _lemma_swept(spark, sf_dir).where("year >= 2018").select("cutoff", "year", "n", r("freq").alias("freq"))


def lemma_usage(spark, sf_dir):
    """Projection and usage of the sweep over lemmas, of cutoffs whose projection stays below 0.95."""
    x = cutoffs.without_saturated(cutoffs.estimated(_lemma_swept(spark, sf_dir), ["cutoff", "step"], END, LENGTH), most=0.95)
    return x.select("cutoff", "year", *[r(k).alias(k) for k in ("projection", "gap", "usage")])


#: Addresses that the made articles end with, in turn: names, other spellings, codes, several words, none.
ADDRESSES = [
    "Dept. of Things, Seoul, South Korea.", "University of Berlin, Germany", "Moscow, Russia;", "Hanoi, Vietnam", "Dublin, Ireland", "Auckland, New Zealand", "Cape Town, South Africa",
    "Vienna, Austria.", "Prague, Czech Republic", "Caracas, Venezuela", "Beijing, CHN", "London, UK", "somewhere in Boston", "Ankara, Turkey", "Nowhere, Atlantis",
]


def xml_articles(spark, sf_dir, tasks=None):
    """Article files (path, content) made of the documents: metadata by doc_id, the lines as sections, of which each fourth document's second has no title. They are made in so many tasks, if that is given."""
    k = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    docs = docs.repartition(tasks, "doc_id") if tasks else docs
    text = F.coalesce("text", F.lit(""))
    held = r"\x{9}\x{A}\x{20}-\x{D7FF}\x{E000}-\x{FFFD}"
    clean = F.when(text.rlike(rf"^[{held}]*+\z"), text).otherwise(F.regexp_replace(text, f"[^{held}]", ""))  # to replace takes far longer than to look
    lines = F.split(F.replace(F.replace(clean, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), "\n")
    title = lambda i: F.coalesce(F.get(F.array(*[F.lit(x) for x in ("Intro", "Methods", "Results")]), i), F.concat(F.lit("Part "), (i + 1).cast("string")))
    sec = F.transform(lines, lambda x, i: F.concat(F.lit("<sec>"), F.when((i == 1) & (k % 4 == 0), "").otherwise(F.concat(F.lit("<title>"), title(i), F.lit("</title>"))), F.lit("<p>"), x, F.lit("</p></sec>")))
    address = F.get(F.array(*[F.lit(x) for x in ADDRESSES]), (k % len(ADDRESSES)).cast("int"))
    body = F.concat(F.when(k % 3 == 0, "<p>Before.</p>").otherwise(""), F.array_join(sec, ""))
    date = F.concat(F.lit("<year>"), (2000 + k % 26).cast("string"), F.lit("</year>"))
    xml = F.concat(
        F.lit('<article article-type="research-article" xml:lang="en"><front><journal-meta><journal-title-group><journal-title>'), F.coalesce("source", F.lit("none")),
        F.lit('</journal-title></journal-title-group></journal-meta><article-meta><article-id pub-id-type="pmc">'), k.cast("string"), F.lit("</article-id>"),
        F.when(k % 2 == 0, F.concat(F.lit('<article-id pub-id-type="pmid">'), (k + 7).cast("string"), F.lit("</article-id>"))).otherwise(""),
        F.lit("<title-group><article-title>A <i>title</i> of "), k.cast("string"), F.lit("</article-title></title-group><contrib-group><aff>"), address, F.lit("</aff></contrib-group>"),
        F.when(k % 5 == 0, F.concat(F.lit('<pub-date pub-type="ppub">'), date, F.lit("</pub-date>"))).otherwise(F.concat(F.lit('<pub-date pub-type="epub"><day>3</day><month>4</month>'), date, F.lit("</pub-date>"))),
        F.lit('<abstract abstract-type="graphical">no</abstract><abstract>yes '), k.cast("string"), F.lit("</abstract></article-meta></front>"),
        F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("<body>"), body, F.lit("</body>"))), F.lit("</article>"),
    )
    return docs.select(F.concat(F.lit("PMC"), k.cast("string"), F.lit(".xml")).alias("path"), xml.cast("binary").alias("content"))


def xml_records(spark, sf_dir):
    """Records of the made articles: attributes, ids, title, country, date, abstract, sections."""
    x = parse_articles(xml_articles(spark, sf_dir), country_table(spark))
    chars = F.aggregate("sections", F.lit(0).cast("long"), lambda n, t: n + F.length(t))
    return x.where("_corrupt is null").select(
        F.col("pmc-id").cast("long").alias("doc_id"), F.col("article-type").alias("article_type"), "language", "journal", "pmid", "title", "country", "date", "abstract",
        F.array_join("section_titles", "|").alias("titles"), chars.alias("section_chars"),
    )


def xml_ingest(spark, sf_dir):
    """Article files in eight directories, one for each document, read in three runs: all of them, none as nothing has changed, and one directory that got more files."""
    folder, path = scratch(spark), scratch(spark)
    k = F.regexp_extract("path", r"\d+", 0).cast("long")
    articles = xml_articles(spark, sf_dir, ingest.DEALT * spark.sparkContext.defaultParallelism).select("content", F.concat(F.lit("s"), (k % 8).cast("string")).alias("segment"), k.alias("k"))

    def run() -> dict[str, int]:
        return ingest.ingest(spark, folder, path, lambda files: parse_articles(files, country_table(spark), ("segment",)), glob="part-*.txt", pattern=r"part-.*\.txt")

    ingest.land(articles, folder)
    runs = [run(), run()]
    ingest.land(articles.where("k % 24 = 1"), folder)
    runs.append(run())
    chars = F.aggregate("sections", F.lit(0).cast("long"), lambda n, t: n + F.length(t))
    found = spark.read.parquet(path).groupBy("segment").agg(F.count(F.lit(1)).alias("n_papers"), F.countDistinct("pmc-id").alias("n_ids"), F.sum(chars).alias("section_chars"))
    return found.select("*", *[F.lit(x["files"]).cast("long").alias(f"read_{k}") for k, x in enumerate(runs, 1)])


#: Years of a pooled period, periods that are trained on, and the published bound of the error.
POOL, POOLED, PUBLISHED_SE = 5, 4, 0.025
#: The cutoffs of the pooled sweep: the usual ones and some between, as errors of small corpora exceed the bound early.
POOLED_CUTOFFS = sorted([*CUTOFFS, 0.0025, 0.003, 0.004])


def _pool(rows: DataFrame) -> DataFrame:
    """Rows of the whole periods of five years, by period in place of the year."""
    return rows.where(F.col("year") < FIRST + POOL * (POOLED + 1)).withColumn("year", F.floor((F.col("year") - FIRST) / POOL).cast("int"))


def _pooled(spark, sf_dir):
    """The sweep over the common marker words of the papers' first lines in periods of five years, of the cutoffs that aren't saturated. Words are cut by their
    frequency in all periods, as few lines of a period have any one of them."""
    heads = _pool(head_tokens(spark, sf_dir))
    common = marker_table(spark, sf_dir).where("grp = 'common'").select("word")
    rows = frequency.postings(heads, ("doc_id", "year")).join(F.broadcast(common), "word", "left_semi")
    periods = frequency.calendar(heads, 0, POOLED)
    all_ = F.broadcast(periods.agg(F.sum("n_papers").alias("n_papers")))
    y = frequency.document_frequency(rows).crossJoin(all_).select("word", estimate.smoothed(F.col("doc_freq"), F.col("n_papers")).alias("freq"))
    swept = cutoffs.sweep(rows, y, cutoffs.cutoff_table(spark, POOLED_CUTOFFS), periods)
    return cutoffs.without_saturated(cutoffs.estimated(swept, ["cutoff", "step"], POOLED, POOLED))


def pooled_errors(spark, sf_dir):
    """Usage and error of each cutoff in the last period, and whether it lies before the first whose error exceeds the published bound."""
    x = _pooled(spark, sf_dir).where(F.col("year") == POOLED)
    within = cutoffs.prefix(x, PUBLISHED_SE).select(F.col("step").alias("_s"))
    x = x.join(F.broadcast(within), F.col("step") == F.col("_s"), "left")  # at most one row for each cutoff
    return x.select("cutoff", r("freq").alias("freq"), r("projection").alias("projection"), r("usage").alias("usage"), r("se").alias("se"), F.col("_s").isNotNull().alias("within"))


def pooled_optimum(spark, sf_dir):
    """The cutoff with the greatest usage among those within the published bound of the error."""
    best = cutoffs.optimum(_pooled(spark, sf_dir).where(F.col("year") == POOLED), PUBLISHED_SE)
    return best.select("cutoff", r("usage").alias("usage"), r("se").alias("se"))


def matrix_counts(spark, sf_dir):
    """Papers of each word, by the column sums of the incidence matrix that is written and read again."""
    path = scratch(spark)
    matrix.write_matrix(tokenised(spark, sf_dir), path)
    words, packed = matrix.read_matrix(spark, path)
    return matrix.column_sums(packed).join(words, "word_id").select("word", F.col("n").alias("doc_freq"))


def matrix_rows(spark, sf_dir):
    """Each paper's row of the incidence matrix: its place, its number of words, and the first, the last and the sum of their ids."""
    p = tokenised(spark, sf_dir)
    rows = matrix.incidence(p, materialised(matrix.dictionary(frequency.postings(p))))
    total = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("doc_id", "row", F.size("ids").alias("n_words"), F.get("ids", F.lit(0)).alias("first_id"), F.try_element_at("ids", F.lit(-1)).alias("last_id"), total.alias("id_sum"))


#: Share of the papers that a frequent word is in at least; the published one is for a corpus of millions.
FLOOR, PUBLISHED_FLOOR = 0.002, 1e-6


def frequent_words(spark, sf_dir):
    """Words in at least a share of the papers; a sketch sorts out the rare ones before they are counted."""
    p, rows = _base(spark, sf_dir)
    return frequency.frequent(rows, p, FLOOR)


def published_floor(spark, sf_dir):
    """The same with the published share, which no word of a small corpus falls below."""
    p, rows = _base(spark, sf_dir)
    return frequency.frequent(rows, p, PUBLISHED_FLOOR)


def section_length_ranks(spark, sf_dir):
    """Exact quantiles of the sections' lengths by ranges of values; the interpolated ones cut to whole numbers."""
    s = _sections_long(spark, sf_dir).select("section", word_count(F.col("text")).alias("n"))
    q = quantiles.quantiles(materialised(s), ["section"], "n", [0.05, 0.5, 0.95])
    of = lambda share: F.max(F.when(F.col("share") == share, F.floor(F.col("quantile") + 1e-9))).cast("long")
    return q.groupBy("section").agg(of(0.05).alias("p05"), of(0.5).alias("median"), of(0.95).alias("p95"))


def section_docfreq(spark, sf_dir):
    """Papers of each word since 2018 in the sections that are shorter than the longest one: the others' directories are left out when the query runs."""
    parts = section_parts(spark, sf_dir)
    sizes = parts.groupBy("section").agg(F.avg(F.size("words")).alias("mean"))
    chosen = sizes.crossJoin(F.broadcast(sizes.agg(F.max("mean").alias("most")))).where("mean < most").select("section")
    rows = parts.where("year >= 2018").join(F.broadcast(chosen), "section").select("section", F.explode("words").alias("word"))  # a row for each section
    return rows.groupBy("section", "word").agg(F.count(F.lit(1)).alias("n"))


def literature_overlay(spark, sf_dir):
    """Events as dated estimates, each beside the groups' monthly usage within six months: how many, and their mean, for each month and mode."""
    g = _groups(spark, sf_dir, True).withColumn("i", frequency.period_index(F.col("year"), F.col("month")))
    x = frequency.regression(g, ["grp"], "i", "freq", 2022 * 12 + 10, 24).withColumn("usage", estimate.usage(F.col("freq"), F.col("projection")))
    report = x.where("year >= 2022").select(F.make_date("year", "month", F.lit(1)).alias("date"), F.col("grp").alias("section"), "usage")
    e = table(spark, sf_dir, "events")
    # the events of one month, spread over three years
    day = F.add_months(F.to_date("ts"), (F.col("event_id") % 36 - 12).cast("int"))
    published = e.select(day.alias("date"), F.when(F.col("event_id") % 2 == 0, "common").otherwise("rare").alias("section"), F.col("value").alias("estimate"), F.col("event_type").alias("mode"))
    near = reports.overlay(report, published).groupBy("section", "date", "mode").agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.col("estimate"))).alias("mean_estimate"), r(F.max("usage")).alias("usage"))
    return near.select("section", F.date_format("date", "yyyy-MM").alias("month"), "mode", "n", "mean_estimate", "usage")


def excess_labels(spark, sf_dir):
    """What the plot of a year's excess words shows of each word that isn't ignored and frequent enough."""
    rows = _lagged(spark, sf_dir, lambda x: (x["year"] == 2024) & (F.round(x["mean_freq"], 9) >= 1e-3)).where(~F.col("word").isin(IGNORED_WORDS))
    shown = estimate.label_rule(F.round("ratio", 9), F.round("gap", 9), F.round("mean_freq", 9))
    return rows.select("word", r("mean_freq").alias("freq"), *[(r(c) if k in ("ratio", "gap") else c).alias(k) for k, c in shown.items()])


#: Bounds of the error of a country's usage: the published one, and a wide one.
MOST_COUNTRY_SE = [0.07, 0.2]


def country_precise(spark, sf_dir):
    """Usage of the country groups in the last period of five years, by the first lines' rare marker words, of those whose error is below each bound."""
    marked = frequency.marked(_pool(head_tokens(spark, sf_dir)), marker_table(spark, sf_dir), GROUPS)
    groups = reports.memberships(F.col("country"), ["NATION_1", "NATION_2", "NATION_3", "NATION_4", "NATION_5"], ["NATION_2", "NATION_7", "NATION_12"])
    x = frequency.regression(reports.overlapping_frequency(marked, F.col("rare"), groups, "year"), ["grp"], "year", "freq", POOLED, POOLED)
    se = estimate.standard_error(F.col("projection"), F.col("freq"), F.col("n_papers"), "regression", F.col("sdev"))
    x = x.where(F.col("year") == POOLED).select("grp", "n_papers", estimate.usage(F.col("freq"), F.col("projection")).alias("usage"), se.alias("se"))
    bounds = F.broadcast(spark.createDataFrame([(b,) for b in MOST_COUNTRY_SE], "most_se double"))
    precise = x.crossJoin(bounds).where(F.round("se", 9) < F.col("most_se"))
    return precise.select("most_se", "grp", "n_papers", r("usage").alias("usage"), r("se").alias("se"))


def preprint_share(spark, sf_dir):
    """Share of each year's papers from preprint servers, which some of the sources stand for."""
    names = {"src1": "bioRxiv", "src2": "medRxiv", "src4": "arXiv", "src5": "Research Square"}
    p = papers(spark, sf_dir).withColumn("journal", reports.remapped(F.col("journal"), names))
    return reports.listed_share(p, PREPRINTS, "year").withColumn("share", r("share"))


def papers_by_type(spark, sf_dir):
    """Papers by year since November 2020, of all types and of one."""
    p = cleaning.since(papers(spark, sf_dir), "2020-11-01")
    each = [cleaning.of_type(p, t).groupBy("year").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(t)) for t in ("all", "review-article")]
    return each[0].unionByName(each[1])


def section_month_projection(spark, sf_dir):
    """Monthly projection of each marker word in each section, from the 24 and from the 60 months before November 2022, for 2025."""
    sections, rows = _section_base(spark, sf_dir)
    end, last = 2022 * 12 + 10, LAST * 12 + 11
    counts = frequency.monthly(rows, end - 60, last, ("section", "word"))
    n = sections.groupBy("section", frequency.period_index(F.col("year"), F.col("month")).alias("i")).agg(F.count(F.lit(1)).alias("n_papers"))  # a row for each section and month
    x = counts.join(F.broadcast(n), ["section", "i"], "left").withColumn("n_papers", F.coalesce("n_papers", F.lit(0).cast("long"))).withColumn("freq", estimate.smoothed(F.col("n"), F.col("n_papers")))
    out = [frequency.regression(x, ["section", "word"], "i", "freq", end, k).where(F.col("i") >= LAST * 12).withColumn("months", F.lit(k)) for k in (24, 60)]
    return out[0].unionByName(out[1]).select("months", "section", "word", (F.col("i") % 12 + 1).cast("int").alias("month"), *[r(c).alias(c) for c in ("freq", "projection", "sdev", "gap")])


def listed_sweep(spark, sf_dir):
    """The sweep over a list of marker words that is read from a file: here the common ones, written out first."""
    p, rows, y, c = _cutoffs(spark, sf_dir)
    path = scratch(spark)
    marker_table(spark, sf_dir).where("grp = 'common'").select("word").write.text(path)
    listed = y.join(F.broadcast(read_word_table(spark, path)), "word", "left_semi")  # a published list
    return cutoffs.sweep(rows, listed, c, frequency.calendar(p, FIRST, LAST)).where("year >= 2018").select("cutoff", "year", "n", r("freq").alias("freq"))


NAMES = [
    "corpus_funnel", "funnel_discarded", "dedupe_latest", "language_inferred", "section_standardize", "section_set_filter", "section_length_quantiles",
    "melt_lengths", "date_normalize", "token_docfreq", "docfreq_floor", "papers_per_month", "mean_papers_per_month", "word_year_freq", "word_month_grid",
    "yearly_mean_freq", "lag_projection", "excess_words", "excess_count_per_year", "excess_distinct", "ratio_filter", "two_groups_year",
    "two_groups_month", "common_markers_freq", "ols_projection", "gap_ratio_usage", "word_projection", "month_projection", "last_usage", "standard_errors", "error_band",
    "cutoff_lists", "cutoff_sweep", "sweep_filtered", "optimal_cutoff", "fixed_cutoff", "chosen_words", "neighbour_cutoffs", "marker_order", "usage_band", "low_frequency_month", "section_year_freq", "section_projection", "section_sweep",
    "section_optimum", "subopt_lists", "lemma_usage", "journals_removed_often", "journal_names", "xml_records",
    "country_freq", "country_pivot", "country_compare", "region_freq", "discipline_label", "discipline_freq", "discipline_share", "journal_counts",
    "journal_other", "journal_share", "journals_removed", "journals_added", "journals_per_year", "null_share", "dup_ids", "lemma_sum", "lemma_union",
    "delemmatize", "layout_topk", "title_counts", "substring_probe", "crop_words", "sample_words", "html_titles", "simulated_recovery",
    "floor_year_mean", "aligned_counts", "funnel_transposed", "lemma_sweep", "word_lemmas",
    "language_profiles", "language_detected", "funnel_language", "upsert_by_key", "xml_ingest", "pooled_errors", "pooled_optimum",
    "matrix_counts", "matrix_rows", "frequent_words", "published_floor", "section_length_ranks", "section_docfreq", "literature_overlay", "excess_labels",
    "country_precise", "preprint_share", "papers_by_type", "section_month_projection", "listed_sweep",
]
QUERIES = {name: globals()[name] for name in NAMES}
