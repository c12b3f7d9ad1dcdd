import math

import duckdb
import pytest

import __spark_entry__ as driver
from lexdrift.plans import queries
from lexdrift.plans.oracles import ORACLES
from lexdrift.plans.queries import QUERIES


def rows(names, values):
    def norm(v):
        return None if isinstance(v, float) and math.isnan(v) else round(v, 5) + 0.0 if isinstance(v, float) else v

    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted([tuple(norm(r[k]) for k in order) for r in values], key=str)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in ("region", "nation", "documents", "pages", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    got = rows(df.columns, df.collect())
    if name in ORACLES:
        q = duck.execute(ORACLES[name])
        names = [x[0] for x in q.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, q.fetchall())
    else:
        assert got


def test_entry(spark):
    assert driver.entry(spark).limit(1).count() == 1
    assert set(driver.oracle_sql()) <= set(driver.queries())


HEADLINE = ["word_year_freq", "token_docfreq", "two_groups_month", "ols_projection", "excess_words", "cutoff_sweep", "optimal_cutoff", "country_freq", "lemma_sum"]


@pytest.mark.parametrize("name", HEADLINE)
def test_texts_are_not_read_again(spark, small, name):
    """Headline queries read the kept words of the papers, never the documents, and don't split texts."""
    df = QUERIES[name](spark, small)
    files = df.inputFiles()
    assert files and all("/corpus/" in f for f in files)
    assert "regexp" not in df._jdf.queryExecution().executedPlan().toString()


def test_plans_start_no_jobs_and_send_no_papers(spark, small):
    """Once the tables of a session are kept, making a plan runs nothing, and sweeps and groups shuffle counts, not papers or words."""
    names = ("two_groups_month", "ols_projection", "cutoff_sweep", "optimal_cutoff", "country_freq", "low_frequency_month")
    for name in names:
        QUERIES[name](spark, small)
    tracker = spark.sparkContext.statusTracker()
    for name in names:
        before = len(tracker.getJobIdsForGroup())
        plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert len(tracker.getJobIdsForGroup()) == before, name
        assert not [line for line in plan.splitlines() if "hashpartitioning(" in line and ("doc_id" in line or "word" in line.split("hashpartitioning(")[1].split(")")[0])], name


def test_entry_without_a_dependency(monkeypatch):
    """Without a library that the subpackage builds on, or without the pipeline, the other queries are there."""
    import importlib
    import sys

    llm = pytest.importorskip("lexdrift.llm.registry")
    monkeypatch.setattr(llm, "missing", lambda: ["xxhash"])
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        alone = importlib.reload(driver)
        assert set(alone.queries()) == set(QUERIES) and set(alone.oracle_sql()) == set(ORACLES)
    finally:
        monkeypatch.undo()
        importlib.reload(driver)
