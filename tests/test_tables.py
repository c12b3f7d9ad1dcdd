"""Matrix, quantiles, sketch, partitions, overlay and the smaller operators, by definition."""

import datetime
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexdrift.functions import estimate
from lexdrift.operators import cleaning, frequency, matrix, quantiles, reports
from lexdrift.plans import queries
from lexdrift.sources import corpus
from lexdrift.sources.xml import country_table


def papers(spark, n=50):
    rng = random.Random(0)
    rows = [(k * 3 % 101, [f"w{rng.randrange(40):02d}" for _ in range(rng.randrange(12))]) for k in range(n)]
    rows = [(k, sorted(set(w))) for k, w in rows] + [(500, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, words array<string>")


def test_matrix_written_and_read(spark, tmp_path):
    rows, df = papers(spark)
    matrix.write_matrix(df, str(tmp_path / "m"), size=8)
    words, packed = matrix.read_matrix(spark, str(tmp_path / "m"))
    ids = {r.word: r.word_id for r in words.collect()}
    vocabulary = sorted({w for _, ws in rows for w in ws or []})
    assert ids == {w: k for k, w in enumerate(vocabulary)}
    got, blocks = {}, packed.orderBy("block").collect()
    assert [r.block for r in blocks] == list(range(7)) and all(len(r["keys"]) == 8 for r in blocks[:-1])
    for r in blocks:
        for k, key in enumerate(r["keys"]):
            got[key] = [vocabulary[i] for i in r.ids[r.starts[k] : r.starts[k + 1]]]
    assert got == {k: ws or [] for k, ws in rows} and list(got) == sorted(got)
    sums = {r.word_id: r.n for r in matrix.column_sums(packed).collect()}
    assert sums == {ids[w]: n for w, n in Counter(w for _, ws in rows for w in ws or []).items()}


def test_matrix_of_nothing(spark, tmp_path):
    _, df = papers(spark)
    matrix.write_matrix(df.limit(0), str(tmp_path / "m"))
    words, packed = matrix.read_matrix(spark, str(tmp_path / "m"))
    assert words.count() == packed.count() == 0 and matrix.column_sums(packed).collect() == []


def test_dense_ranks(spark):
    df = spark.createDataFrame([(x,) for x in [5, 3, 3, None, 9, -1]], "x long")
    assert {r.x: r.at for r in matrix.dense_ranks(df, "x", "at").collect()} == {None: 0, -1: 1, 3: 2, 5: 3, 9: 4}


@pytest.mark.parametrize("ranges,few", [(1024, 100_000), (4, 100_000), (4, 0)])
def test_quantiles_are_exact(spark, monkeypatch, ranges, few):
    """Ties, one value, negative and far apart values, null keys: as by sorting all of a group."""
    monkeypatch.setattr(quantiles, "FEW", few)
    rng = random.Random(1)
    groups = {"ties": [rng.choice([3, 3, 3, 8]) for _ in range(90)], "one": [7], "wide": [rng.randrange(-(10**6), 10**6) for _ in range(200)], None: [0, 10, 20, 10**9], "two": [1, 2]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("ties", None), ("null", None)]
    shares = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    got = {(r.g, r.share): r.quantile for r in quantiles.quantiles(spark.createDataFrame(rows, "g string, v long"), ["g"], "v", shares, ranges).collect()}
    assert got.keys() == {(g, s) for g in groups for s in shares}
    for (g, s), q in got.items():
        assert q == pytest.approx(np.quantile(groups[g], s), rel=1e-12, abs=1e-6)


def test_quantiles_of_all_rows_and_of_none(spark):
    df = spark.createDataFrame([(v,) for v in range(101)], "v long")
    assert {(r.share, r.quantile) for r in quantiles.quantiles(df, [], "v", [0.5, 0.95]).collect()} == {(0.5, 50.0), (0.95, 95.0)}
    assert quantiles.quantiles(df.limit(0).withColumn("g", F.lit("x")), ["g"], "v", [0.5]).collect() == []


def test_the_sketch_loses_nothing_and_sends_less(spark, small):
    p = corpus.tokenised(spark, small)
    rows = frequency.postings(p)
    for share in (1e-6, 0.02, 0.1):
        for buckets in (16, 1 << 20):
            want = {tuple(r) for r in frequency.document_frequency(rows, p, share).collect()}
            assert {tuple(r) for r in frequency.frequent(rows, p, share, buckets).collect()} == want
    # words that the sketch lets through, of all different words
    at = F.pmod(F.xxhash64("word"), F.lit(1 << 20))
    n = p.count()
    full = rows.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= 0.02 * n).select("at")
    through = rows.withColumn("at", at).join(full, "at", "left_semi").select("word").distinct().count()
    assert through < 0.25 * rows.select("word").distinct().count()
    floor = frequency.frequent(rows, p, 0.02)
    assert through >= floor.count() > 0


def test_partitions_are_pruned_when_the_query_runs(spark, small):
    parts = corpus.section_parts(spark, small)
    path = parts.inputFiles()[0].split("/section=")[0]
    assert corpus.partitions_of(spark, path, "section") == ["discussion", "full", "introduction", "methods", "results"]
    one = parts.where("section = 'methods' and year = 2020")
    read = {r[0] for r in one.select("_metadata.file_path").distinct().collect()}
    assert read and all("section=methods/year=2020" in f for f in read)
    df = queries.section_docfreq(spark, small)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() and "year" in plan.split("PartitionFilters")[1][:300]
    assert {r.section for r in df.select("section").distinct().collect()} == {"discussion", "introduction", "methods", "results"}


def test_overlay_is_an_interval_join(spark):
    day = datetime.date
    report = [(day(2023, m, 1), s, m / 10) for m in range(1, 13) for s in ("full", "abstract")]
    published = [(day(2023, 6, 15), "full", 0.2, "x"), (day(2023, 1, 1), "abstract", 0.1, "y"), (day(2022, 3, 31), "full", 0.3, "y"), (day(2023, 7, 1), "other", 0.3, "y")]
    a, b = spark.createDataFrame(report, "date date, section string, usage double"), spark.createDataFrame(published, "date date, section string, estimate double, mode string")
    for months in (0, 2, 6):
        got = reports.overlay(a, b, months)
        near = F.abs(F.months_between("r.date", "p.date")) <= months
        want = a.alias("r").crossJoin(b.alias("p")).where(near & (F.col("r.section") == F.col("p.section")))
        assert sorted((r.section, r.date, r.published_on, r.estimate) for r in got.collect()) == sorted(tuple(r) for r in want.select("r.section", "r.date", "p.date", "estimate").collect())
    assert "NestedLoop" not in reports.overlay(a, b)._jdf.queryExecution().executedPlan().toString()


def test_labels_are_clipped(spark):
    df = spark.createDataFrame([(100.0, 0.06, 0.06), (2.0, 0.005, 0.01), (None, None, 0.5), (1.0, 0.011, 0.3)], "r double, g double, f double")
    got = [tuple(r) for r in df.select(*[c.alias(k) for k, c in estimate.label_rule(F.col("r"), F.col("g"), F.col("f")).items()]).collect()]
    assert got[0] == (90.0, 0.049, True, True) and got[1] == (2.0, 0.005, True, False) and got[3][2:] == (False, False)
    assert got[2][2:] in [(True, True), (False, False)] and got[2][0] in (None, 90.0)


def test_types_dates_and_lists(spark):
    day = datetime.date
    rows = [("review-article", day(2020, 11, 1), "bioRxiv"), ("case-report", day(2020, 10, 31), "J"), (None, None, None), ("review-article", day(2021, 1, 1), "arXiv")]
    df = spark.createDataFrame(rows, "article_type string, date date, journal string")
    assert cleaning.of_type(df).count() == 4 and cleaning.of_type(df, "review-article").count() == 2
    assert cleaning.since(df, "2020-11-01").count() == 2
    assert reports.listed_share(df, ["bioRxiv", "arXiv"]).first()[:] == (4, 2, 0.5)


def test_word_lists_from_files(spark, tmp_path):
    from lexdrift.functions.lists import read_words

    (tmp_path / "a.txt").write_text("delve\n\n crucial \ndelve\n", encoding="utf-8")
    assert read_words(str(tmp_path / "a.txt")) == ["delve", "crucial", "delve"]
    assert sorted(r.word for r in corpus.read_word_table(spark, str(tmp_path / "a.txt")).collect()) == ["crucial", "delve"]


def test_records_and_packages(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"pmc-id": "1", "title": "T", "section_titles": ["A"], "sections": ["x"]}\n{"pmc-id": "2"}\n')
    rows = corpus.read_records(spark, str(tmp_path)).orderBy("`pmc-id`").collect()
    assert [(r["pmc-id"], r["title"], r["sections"], r["country"]) for r in rows] == [("1", "T", ["x"], None), ("2", None, None, None)]
    names = ["oa_comm_xml.PMC000xxxxxx.baseline.2024-12-18.tar.gz", "oa_comm_xml.PMC000xxxxxx.baseline.2024-12-18.filelist.csv", "oa_comm_xml.incr.2024-12-19.tar.gz"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [tuple(r) for r in corpus.baseline_packages(df).collect()] == [(names[0], "2024-12-18")]
    assert [r.name for r in corpus.baseline_packages(df, ".csv").collect()] == [names[1]]


def test_months_side_by_side(spark):
    rows = spark.createDataFrame([("a", 2020, 12), ("a", 2021, 1), ("a", 2021, 1), ("b", 2021, 2), ("b", 2019, 1)], "word string, year int, month int")
    got = {(r.word, r.i): r.n for r in frequency.monthly(rows, 2020 * 12 + 11, 2021 * 12 + 1).collect()}
    assert got == {("a", 24251): 1, ("a", 24252): 2, ("a", 24253): 0, ("b", 24251): 0, ("b", 24252): 0, ("b", 24253): 1}


def test_official_country_names(spark):
    """All codes have a name, and no name is one of those that only the JVM uses."""
    table = country_table(spark)
    names = {table[c] for c in table if len(c) == 3 and c.isupper()}
    assert len([c for c in table if len(c) == 2]) >= 249
    assert table["BES"] == "Bonaire, Sint Eustatius and Saba" and table["SHN"] == "Saint Helena, Ascension and Tristan da Cunha" and table["UM"] == "United States Minor Outlying Islands"
    assert not names & {"Caribbean Netherlands", "Saint Helena", "U.S. Outlying Islands", "Sint Maarten", "Heard and McDonald Islands", "South Georgia and South Sandwich Islands"}
