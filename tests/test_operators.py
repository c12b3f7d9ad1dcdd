import numpy as np
import pytest
from pyspark.sql import functions as F

from lexdrift.operators import cleaning, cutoffs, frequency, lemmas, reports, simulation
from lexdrift.sources import corpus
from lexdrift.sources.xml import body_sections, country_at_end, country_table, parse_articles, read_articles


def papers(spark):
    rows = [(1, 2024, 1, "delve into crucial things"), (2, 2024, 2, "crucial crucial matters"), (3, 2025, 1, "nothing here"), (4, 2025, 1, None)]
    return spark.createDataFrame(rows, "doc_id long, year int, month int, abstract string")


def test_counts_and_grid(spark):
    p = papers(spark)
    rows = frequency.postings(p, words=["delve", "crucial"])
    assert {(r.word, r.n) for r in frequency.word_counts(rows, "year").collect()} == {("delve", 1), ("crucial", 2)}
    g = frequency.grid(frequency.word_counts(rows, "year"), ["word"], frequency.calendar(p, 2023, 2025)).collect()
    freq = {(r.word, r.year): r.freq for r in g}
    assert freq["crucial", 2024] == 1.0 and freq["crucial", 2025] == 1 / 3 and freq["delve", 2023] == 1.0  # no papers: 1
    assert all(0 < x <= 1 for x in freq.values())


def test_regression_is_least_squares(spark):
    rng = np.random.default_rng(0)
    y = rng.random(12)
    s = spark.createDataFrame([("a", 2010 + k, float(v)) for k, v in enumerate(y)], "grp string, year int, freq double")
    got = frequency.regression(s, ["grp"], "year", "freq", 2018, 6).orderBy("year").collect()
    t, train = np.arange(10), y[2:8]
    x = np.column_stack([np.ones(6), np.arange(6)])
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ train
    sigma2 = ((train - x @ beta) ** 2).sum() / 4
    full = np.column_stack([np.ones(10), t])
    assert np.allclose([r.projection for r in got], full @ beta)
    assert np.allclose([r.sdev for r in got], np.sqrt(sigma2 * (1 + np.einsum("ij,jk,ik->i", full, inv, full))))


def test_sweep_equals_counting_each_list(spark):
    rng = np.random.default_rng(1)
    words = [f"word{chr(97 + k)}" for k in range(12)]
    rows = [(i, 2020 + i % 3, w) for i in range(200) for w in rng.choice(words, 3, replace=False).tolist()]
    post = spark.createDataFrame(rows, "doc_id long, year int, word string")
    freq = spark.createDataFrame([(w, 0.05 * (k + 1)) for k, w in enumerate(words)], "word string, freq double")
    cuts = cutoffs.cutoff_table(spark, [0.1, 0.3, 0.5, 1.0])
    periods = spark.createDataFrame([(y, 67) for y in (2020, 2021, 2022)], "year int, n_papers long")
    got = {(r.cutoff, r.year): r.n for r in cutoffs.sweep(post, freq, cuts, periods).collect()}
    for (c, y), n in got.items():
        own = {w for k, w in enumerate(words) if 0.05 * (k + 1) < c}
        assert n == len({i for i, yy, w in rows if yy == y and w in own})
    assert all(got[a, y] <= got[b, y] for y in (2020, 2021, 2022) for a, b in ((0.1, 0.3), (0.3, 0.5), (0.5, 1.0)))


def test_optimum_takes_the_prefix_before_a_bad_error(spark):
    rows = [(2025, 0, 0.1, 0.2, 0.01), (2025, 1, 0.2, 0.4, 0.02), (2025, 2, 0.3, 0.3, 0.5), (2025, 3, 0.4, 0.9, 0.01), (2024, 0, 0.1, 0.5, 0.9)]
    df = spark.createDataFrame(rows, "year int, step int, cutoff double, usage double, se double")
    assert [(r.year, r.cutoff) for r in cutoffs.optimum(df).collect()] == [(2025, 0.2)]


def test_lag_projection(spark):
    s = spark.createDataFrame([("a", 2010, 0.1), ("a", 2011, 0.2), ("a", 2012, 0.3), ("a", 2013, 0.35)], "word string, year int, mean_freq double")
    got = frequency.lag_projection(s, "word").collect()
    assert len(got) == 1 and abs(got[0].projection - 0.4) < 1e-12


def test_lemmas_sum_and_union(spark):
    post = spark.createDataFrame([(1, "colour"), (1, "colors"), (2, "color")], "doc_id long, word string")
    british = spark.createDataFrame([("colour", "color")], "word string, new string")
    own = spark.createDataFrame([("colors", "color")], "word string, new string")
    counts = post.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    assert [tuple(r) for r in lemmas.count_sum(lemmas.rename(counts, british, own)).collect()] == [("color", 3)]
    assert [tuple(r) for r in lemmas.count_union(lemmas.rename(post, british, own)).collect()] == [("color", 2)]


def test_groups_of_countries(spark):
    df = spark.createDataFrame([("Canada",), ("Ireland",), (None,), ("Germany",)], "c string")
    got = [r[0] for r in df.select(reports.memberships(F.col("c"), ["Germany"], ["Canada", "Ireland"])).collect()]
    assert got == [["english"], ["english"], [], ["Germany", "non-english"]]


def test_funnel_and_keep_first(spark, small):
    p = corpus.papers(spark, small)
    row = cleaning.funnel(p).first()
    assert row.before_prep == p.count() and row.after_date == cleaning.clean(p).count()
    twice = p.select("doc_id", F.lit(2).alias("load")).unionByName(p.select("doc_id", F.lit(1).alias("load")))
    kept = cleaning.keep_first(twice, "doc_id", "load")
    assert kept.count() == p.count() and kept.agg(F.max("load")).first()[0] == 1


def test_language(spark):
    df = spark.createDataFrame([(None, "the cat and the dog of it"), (None, "der Hund und die Katze"), ("xx", "the"), (None, "zzz")], "language string, abstract string")
    assert [r.language for r in cleaning.infer_language(df).collect()] == ["en", "de", "xx", None]


def test_simulation_finds_the_share(spark):
    got = {r.share: r for r in simulation.recovered(simulation.simulate(spark, 100, 4000, [0.2, 0.8], [0.005, 0.01, 0.02, 0.05, 1.0]), most_se=0.05).collect()}
    assert abs(got[0.2].usage - 0.2) < 0.1 and abs(got[0.8].usage - 0.8) < 0.12
    assert all(r.gap <= r.usage for r in got.values())


XML = """<article article-type="research-article" xml:lang="en"><front><journal-meta><journal-title-group><journal-title>J</journal-title></journal-title-group></journal-meta>
<article-meta><article-id pub-id-type="pmc">1</article-id><title-group><article-title>A <i>b</i></article-title></title-group>
<contrib-group><aff>Dept, Seoul, South Korea.</aff></contrib-group><pub-date pub-type="ppub"><year>2020</year></pub-date>
<pub-date pub-type="epub"><day>1</day><month>2</month><year>2021</year></pub-date><abstract abstract-type="graphical">no</abstract><abstract>yes</abstract></article-meta></front>
<body><p>Before.</p><sec><title>Methods</title><p>m</p></sec><sec><title>Methods</title><p>n</p></sec></body></article>"""


def test_xml(spark, tmp_path):
    (tmp_path / "PMC1234567.xml").write_text(XML)
    (tmp_path / "PMC7654321.xml").write_text("<article>")
    (tmp_path / "other.xml").write_text(XML)
    rows = parse_articles(read_articles(spark, str(tmp_path))).collect()
    good = [r for r in rows if r["_corrupt"] is None]
    assert len(rows) == 2 and len(good) == 1
    r = good[0].asDict()
    assert (r["article-type"], r["language"], r["journal"], r["pmc-id"], r["country"], r["date"], r["abstract"]) == ("research-article", "en", "J", "1", "Korea, Republic of", "1-2-2021", "yes")
    # the second of two equal titles replaces the first, which then isn't there and counts as the introduction
    assert r["section_titles"] == ["Methods", "Introduction"] and [s.split()[1] for s in r["sections"]] == ["n", "m"]


def test_countries(spark):
    table = country_table(spark)
    cases = {
        "x, UK": "United Kingdom of Great Britain and Northern Ireland", "Moscow, Russia": "Russian Federation", "Hanoi, Vietnam": "Viet Nam", "Dublin, Ireland": "Ireland",
        "Auckland, New Zealand.": "New Zealand", "Cape Town, South Africa": "South Africa", "Graz, Austria;": "Austria", "Brno, Czech Republic": "Czechia", "Sarajevo, Bosnia and Herzegovina": "Bosnia and Herzegovina",
        "Caracas, Venezuela": "Venezuela, Bolivarian Republic of", "Beijing CHN": "China", "germany": "Germany", "Nowhere": None, "": None, "Seoul, South Korea.": "Korea, Republic of",
    }
    assert {a: country_at_end(a, table) for a in cases} == cases and country_at_end(None, table) is None
    two = {"GUINEA": "Guinea", "NEW GUINEA": "New Guinea"}
    assert country_at_end("Papua New Guinea", two) == "Guinea" and country_at_end("Papua New Guinea", two, longest=True) == "New Guinea"


def test_sections_of_a_body():
    import xml.etree.ElementTree as ET

    def sections(body):
        return body_sections(ET.fromstring(f"<article>{body}</article>").find("body"))

    assert sections("") == {} and sections("<body/>") == {}
    assert sections("<body><p>a</p><p>b</p></body>") == {"Introduction": "ab"}
    assert sections("<body><p>a</p><sec><title>T</title><p>x</p></sec><p>z</p></body>") == {"T": "T x", "Introduction": "a"}
    assert sections("<body><p>a</p><sec><p>x</p></sec><sec><title>T</title></sec></body>") == {"T": "T", "Introduction": "x"}
    assert sections("<body><p>a</p><sec><title>T</title></sec><sec><p>x</p></sec></body>") == {"T": "T"}
    assert sections("<body><sec><title>Introduction</title>old</sec><p>a</p></body>") == {"Introduction": "Introduction old"}
    assert sections("<body>lost<sec><p>x</p></sec></body>") == {}


def test_sinks(spark, small, tmp_path):
    p = corpus.papers(spark, small).select("doc_id", "date", "journal")
    corpus.write_papers(p, str(tmp_path / "p"))
    one = corpus.read_papers(spark, str(tmp_path / "p"), [2003])
    assert one.count() == p.where("year(date) = 2003").count() > 0
    report = p.groupBy("journal").agg(F.count(F.lit(1)).alias("n"))
    corpus.write_report(report, str(tmp_path / "r"))
    assert corpus.read_report(spark, str(tmp_path / "r"), report.schema).count() == report.count()
    calls = []
    for _ in range(2):
        corpus.compute_or_load(spark, str(tmp_path), "x", {"a": 1}, lambda: calls.append(1) or report)
    assert calls == [1]
    corpus.write_metadata(spark, str(tmp_path / "m"), sections=["a"], most=3)
    assert corpus.read_metadata(spark, str(tmp_path / "m")) == {"most": 3, "sections": ["a"]}


@pytest.mark.parametrize("time", [None, "seen"])
def test_stream_counts(spark, small, tmp_path, time):
    from lexdrift.streaming.counts import read_counts, start_counts

    p = corpus.papers(spark, small).select("doc_id", "year", "month", "abstract")
    p = p.withColumn("seen", F.lit("2025-01-01").cast("timestamp"))
    p.unionByName(p.limit(5)).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start_counts(stream, str(tmp_path / "out"), str(tmp_path / "state"), time).awaitTermination(120)
    words, totals = read_counts(spark, str(tmp_path / "out"))
    assert totals.agg(F.sum("n_papers")).first()[0] == p.count()
    expected = frequency.word_counts(frequency.postings(p), "year", "month")
    assert words.exceptAll(expected.select(words.columns)).count() == 0 and words.count() == expected.count()


def test_overlay_and_alignment(spark):
    report = spark.createDataFrame([("2024-06-01", "abstract", 0.3), ("2020-06-01", "abstract", 0.0)], "date string, section string, usage double").withColumn("date", F.to_date("date"))
    published = spark.createDataFrame([("2024-09-01", "abstract", 0.17, "marker words"), ("2024-09-01", "full", 0.2, "detector")], "date string, section string, estimate double, method string")
    got = reports.overlay(report, published.withColumn("date", F.to_date("date"))).collect()
    assert [(r.usage, r.estimate, r.method) for r in got] == [(0.3, 0.17, "marker words")]
    a = spark.createDataFrame([("apple", 1), ("berry", 3)], "word string, n long")
    b = spark.createDataFrame([("apple", 2), ("peach", 3)], "word string, n long")
    assert {tuple(r) for r in frequency.aligned(a, b, ["word"], "n").collect()} == {("apple", 1, 2), ("berry", 3, 0), ("peach", 0, 3)}
    wide = reports.transposed(spark.createDataFrame([("x", 1, 2), ("y", 3, 4)], "k string, p int, q int"), ["p", "q"], "k", ["x", "y"])
    assert {tuple(r) for r in wide.collect()} == {("p", 1, 3), ("q", 2, 4)}


def test_overlay_broadcasts_the_report_alone(spark):
    """Of report and estimates, it is the report that goes to all tasks, though the estimates seem small; they aren't repeated for the months around either."""
    report = spark.createDataFrame([(f"2024-{m:02}-01", "a", 0.1 * m) for m in range(1, 13)], "date string, section string, usage double").withColumn("date", F.to_date("date"))
    published = spark.range(2000).select(F.date_add(F.lit("2023-01-15").cast("date"), (F.col("id") % 900).cast("int")).alias("date"), F.lit("a").alias("section"), F.col("id").alias("estimate"))
    got = reports.overlay(report, published)
    text = got._jdf.queryExecution().executedPlan().toString()
    sent = text[text.index("BroadcastExchange") :]
    assert text.count("BroadcastExchange") == 1 and "usage" in sent and "estimate" not in sent and text.count("Generate") == 1
    near = report.crossJoin(published.withColumnRenamed("date", "published_on").withColumnRenamed("section", "_s")).where(F.abs(F.months_between("date", "published_on")) <= 6)
    want = near.select("date", "section", "usage", "published_on", "estimate")
    assert got.columns == ["date", "section", "usage", "published_on", "estimate"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_draws_by_brute_force(spark):
    """A crop is a run of the text's words and a sample some of its words in any order, each drawn anew by key and the same in reruns."""
    from collections import Counter

    from lexdrift.functions.text import crop, sample

    texts = [" ".join(f"w{k % 7}" for k in range(n)) for n in (0, 3, 9, 10, 11, 40, 200)] + ["  a\tb \n c  " + "d " * 30]
    df = spark.createDataFrame([(k, t) for k in range(20) for t in texts], "k long, t string")
    drawn = df.select("t", "k", crop(F.col("t"), 10, F.col("k")).alias("c"), sample(F.col("t"), 10, F.col("k")).alias("s"))
    rows = drawn.collect()
    for r in rows:
        w = r.t.split()
        if len(w) <= 10:
            assert r.c == r.s == r.t
            continue
        assert r.c.split() in [w[k : k + 10] for k in range(len(w) - 9)]
        assert len(r.s.split()) == 10 and not Counter(r.s.split()) - Counter(w)
    long = [r for r in rows if len(r.t.split()) == 200]
    assert len({r.s for r in long}) > 10 and len({r.c for r in long}) > 3
    assert sorted(rows, key=str) == sorted(drawn.collect(), key=str)


def test_means_without_a_grid(spark, small):
    p = corpus.tokenised(spark, small)
    rows = frequency.postings(p).where("word like 'th%'")
    months = frequency.calendar(p, 2000, 2025, monthly=True)
    dense = frequency.yearly_mean(frequency.grid(frequency.word_counts(rows, "year", "month"), ["word"], months, ("year", "month")), "word").where("year >= 2010")
    sparse = frequency.mean_of_months(rows, months, "word", 2010, 2025)
    both = dense.join(sparse.withColumnRenamed("mean_freq", "other"), ["word", "year"], "full").collect()
    assert len(both) > 100 and all(abs(r.mean_freq - r.other) < 1e-12 for r in both)


def test_groups_by_the_papers_own_words(spark, small):
    p = corpus.tokenised(spark, small)
    words = [r.word for r in frequency.document_frequency(frequency.postings(p)).orderBy(F.desc("doc_freq"), "word").limit(9).collect()]
    groups = {"a": words[:3], "b": words[2:], "none": []}
    got = {(r.grp, r.year): r.n for r in frequency.group_frequency(p, groups, frequency.calendar(p, 2000, 2025), "year").collect()}
    own = p.select("year", "words").collect()
    assert got == {(g, y): sum(r.year == y and not set(w).isdisjoint(r.words) for r in own) for g, w in groups.items() for y in range(2000, 2026)}


def test_partial_months_names_and_order(spark):
    df = spark.createDataFrame([(2024, 1), (2024, 12), (2025, 9), (2025, 12)], "year int, month int")
    assert [tuple(r) for r in frequency.without_partial(df, 2024 * 12 + 1, 2025 * 12 + 9).collect()] == [(2024, 12), (2025, 9)]
    names = spark.createDataFrame([("J. of X",), ("Y",), (None,)], "j string").select(reports.remapped(F.col("j"), {"J. of X": "Journal of X"}))
    assert [r[0] for r in names.collect()] == ["Journal of X", "Y", None]
    s = spark.createDataFrame([("methods",), ("other",)], "s string").select(reports.section_order(F.col("s"), ["introduction", "methods"]))
    assert [r[0] for r in s.collect()] == [2, 3]


def test_lists_of_the_best_and_the_next(spark):
    best = spark.createDataFrame([("a", 2), ("b", 0)], "section string, step int")
    lists = spark.createDataFrame([("a", s, s / 10, f"w{s}") for s in range(4)] + [("b", 0, 0.0, "x")], "section string, step int, cutoff double, word string")
    got = {(r.section, r.kind, r.word) for r in cutoffs.chosen_lists(best, lists, ("section",)).collect()}
    assert got == {("a", "opt", "w2"), ("a", "subopt", "w1"), ("a", "subsubopt", "w0"), ("b", "opt", "x")}


def test_languages_of_long_texts(spark):
    df = spark.createDataFrame([(None, "zzz", "der Hund und die Katze"), (None, None, None)], "language string, abstract string, full string")
    assert [r.language for r in cleaning.infer_language(df, long="full").collect()] == ["de", None]


def test_usage_next_to_one(spark):
    from lexdrift.functions import estimate

    df = spark.createDataFrame([(0.5, 1.0), (0.5, 1 - 1e-12), (0.9999, 0.9995), (0.5, 1.2)], "q double, p double")
    got = [r[0] for r in df.select(estimate.usage(F.col("q"), F.col("p"))).collect()]
    assert got[:2] == [None, None] and abs(got[2] - 0.8) < 1e-9 and abs(got[3] - 3.5) < 1e-9
