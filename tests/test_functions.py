import datetime

from pyspark.sql import functions as F

from lexdrift.functions import estimate, text
from lexdrift.functions.dates import parse_date


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_dates(spark):
    cases = {
        "17-11-2025": datetime.date(2025, 11, 17),
        "Nov-Dec-2025": datetime.date(2025, 11, 1),
        "Fall-2025": datetime.date(2025, 9, 1),
        "17-11-2024-November-17": datetime.date(2024, 11, 17),
        "Someday-2025": None,
        "31-2-2024": None,
        "": None,
        None: None,
    }
    got = [r[0] for r in column(spark, cases).select(parse_date(F.col("x"))).collect()]
    assert got == list(cases.values())


def test_tokens(spark):
    got = [r[0] for r in column(spark, ["Delves into AI-driven COVID19", "naïve cafés these_words", "the cat", "Into into", "", None]).select(text.tokens(F.col("x"))).collect()]
    assert got == [["delves", "into", "driven"], [], [], ["into"], [], None]


def test_crop_and_sample(spark):
    line = "This is a very thorough test"
    row = column(spark, [line]).select(*[f(F.col("x"), n, F.lit(1)) for f in (text.crop, text.sample) for n in (7, 3)]).first()
    assert row[0] == line and row[2] == line
    assert len(row[1].split()) == 3 and row[1] in line
    assert len(row[3].split()) == 3 and set(row[3].split()) <= set(line.split())


def test_titles(spark):
    cases = {"1. Introduction": "introduction", "METHODS:": "methods", "Results & analysis": "results", "Funding": "", None: "", "experiment 2": "experiment", "Summary and outlook": "conclusion"}
    got = [r[0] for r in column(spark, cases).select(text.canonical_title(F.col("x"))).collect()]
    assert got == list(cases.values())


def test_sections(spark):
    rows = [
        (["Introduction", "Methods", "Results"], ["a", "b", "c"]),
        (["Method", "Funding", "2. Methods"], ["this is the first method", "x", "this is the second method"]),
        ([], ["a"]),
    ]
    df = spark.createDataFrame(rows, "t array<string>, s array<string>")
    got = [r[0] for r in df.select(text.standard_sections(F.col("t"), F.col("s"))).collect()]
    assert got == [{"introduction": "a", "methods": "b", "results": "c"}, {"methods": "this is the first method this is the second method"}, {}]


def test_labels(spark):
    cases = {
        "Journal of Neurology": "neurology",
        "Neurological Journal": None,
        "Journal of Cancer Biochemistry": "biochemistry",
        "The Biochemistry of Cancer": "cancer",
        "Biomaterials": "material",
        "Cancer, and more Cancer": "cancer",
        None: None,
    }
    got = [r[0] for r in column(spark, cases).select(text.last_label(F.col("x"))).collect()]
    assert got == list(cases.values())


def test_estimates(spark):
    one = spark.range(1)
    se = one.select(estimate.standard_error(F.lit(0.5), F.lit(0.7), F.lit(120000), "binomial")).first()[0]
    assert abs(se - 0.00316228) < 1e-8
    use = [one.select(estimate.usage(F.lit(q), F.lit(p))).first()[0] for q, p in ((1.0, 0.9998), (0.9999, 0.9998), (0.5, 1.0))]
    assert abs(use[0] - 1) < 1e-9 and abs(use[1] - 0.5) < 1e-9 and use[2] is None
    assert one.select(estimate.standard_error(F.lit(1.0), F.lit(1.0), F.lit(100), "both", F.lit(0.1), "gap")).first()[0] > 0
