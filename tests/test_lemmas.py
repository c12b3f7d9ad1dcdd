import re
import shutil

import duckdb
import pytest

from lexdrift.functions.lists import DETACHED, IRREGULAR, LEMMAS, SPELLINGS
from lexdrift.operators import frequency, lemmas
from lexdrift.plans.oracles import ORACLES
from lexdrift.plans.queries import QUERIES
from lexdrift.sources import corpus

KNOWN = "delve study class watch box shelf woman use find show criterion make plan analyse describe note showcase color colour modeled modelled organize organise center centre edema oedema defense defence hour four for"


def words(spark, text):
    return spark.createDataFrame([(w,) for w in text.split()], "word string")


def pairs(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(dict(rows)) == len(rows)
    return dict(rows)


def by_definition(asked, known, exceptions=None):
    """Word by word: fixed lists, then verbs, then nouns, the shortest known base form of the first round of endings that has any."""

    def base(word, rules):
        forms = {word}
        for _ in range(2):
            forms = {f[: len(f) - len(old)] + new for f in forms for old, new in rules if f.endswith(old) and len(f) > len(old)}
            if found := forms & known:
                return min(found, key=lambda f: (len(f), f))

    out = {}
    for w in asked:
        new = LEMMAS.get(w) or (exceptions or {}).get(w) or IRREGULAR.get(w) or base(w, DETACHED["verb"]) or base(w, DETACHED["noun"])
        if new and new != w:
            out[w] = new
    return out


def test_lemmas_of_forms(spark):
    asked = "delves delving delved studies studied classes watches boxes shelves women uses using found shown criteria made planned planning analysing describes described noted delve thing things chatbots showcasing zzzs"
    known = words(spark, KNOWN + " " + asked)
    got = pairs(lemmas.lemma_table(words(spark, asked), known))
    assert got["delves"] == got["delving"] == got["delved"] == "delve" and got["studies"] == "study" and "studied" not in got
    assert [got[w] for w in "classes watches boxes shelves women uses using found shown criteria made planned planning".split()] == "class watch box shelf woman use use find show criterion make plan plan".split()
    assert got["chatbots"] == "chatbot" and got["showcasing"] == "showcase" and got["things"] == "thing"
    assert not {"delve", "thing", "zzzs"} & set(got)


def test_a_given_table_wins(spark):
    asked = words(spark, "found leaves data chatbots")
    exceptions = spark.createDataFrame([("found", "found"), ("leaves", "leaf"), ("data", "datum"), ("chatbots", "robot")], "word string, lemma string")
    got = pairs(lemmas.lemma_table(asked, words(spark, "leave leaf find"), exceptions))
    assert got == {"leaves": "leaf", "data": "datum", "chatbots": "chatbot"}
    assert pairs(lemmas.lemma_table(asked, words(spark, "leave leaf find")))["leaves"] == "leave"


def test_verbs_come_before_nouns_and_two_rounds(spark):
    got = pairs(lemmas.lemma_table(words(spark, "buses meetings axes"), words(spark, "bus meet ax axe buse meeting")))
    assert got == {"buses": "bus", "meetings": "meeting", "axes": "ax"}
    assert pairs(lemmas.lemma_table(words(spark, "meetings"), words(spark, "meet"))) == {"meetings": "meet"}


def test_lemmas_of_the_corpus(spark, small):
    known = {r.word for r in corpus.vocabulary(spark, small).collect()}
    assert pairs(corpus.renames(spark, small)[1]) == by_definition({w for w in known if len(w) >= 4}, known)


def test_spellings(spark):
    asked = "colour colours modelled organise centre oedema defence hour four filling tiller"
    got = pairs(lemmas.spelling_table(words(spark, asked), words(spark, KNOWN + " hor filing tiler colors")))
    assert got == {"colour": "color", "colours": "colors", "modelled": "modeled", "organise": "organize", "centre": "center", "oedema": "edema", "defence": "defense"}
    given = spark.createDataFrame([("hour", "our"), ("colour", "colr"), ("absent", "x")], "word string, new string")
    got = pairs(lemmas.spelling_table(words(spark, "hour colour centre"), words(spark, KNOWN), given))
    assert got == {"hour": "our", "colour": "colr", "centre": "center"}
    assert all(re.compile(old) for old, _ in SPELLINGS)


def test_the_lemma_is_that_of_the_american_word(spark):
    """colours -> colors -> color; a word without a rule stays; counts of all variants are summed up."""
    counts = spark.createDataFrame([("colours", 2), ("colors", 3), ("color", 4), ("other", 1)], "word string, n long")
    known = counts.select("word")
    out = lemmas.count_sum(lemmas.rename(counts, lemmas.spelling_table(known, known), lemmas.lemma_table(known, known)))
    assert {tuple(r) for r in out.collect()} == {("color", 9), ("other", 1)}


def test_no_words(spark):
    none = words(spark, "")
    assert pairs(lemmas.lemma_table(none, none)) == {} and pairs(lemmas.spelling_table(none, none)) == {}
    assert frequency.word_counts(none).collect() == []


@pytest.mark.parametrize("buckets", [1, 1 << 20])
@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_lemmas_of_papers(spark, buckets, threshold):
    """Two variants in a paper are one; a doc_id with two rows is one paper; papers without words or without changes stay. Whatever the sketch lets through."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        rows = [(1, ["colours", "color", "other"]), (1, ["colors", "more"]), (2, ["colours"]), (3, ["other", "color"]), (4, []), (5, None), (None, ["colours"])]
        papers = spark.createDataFrame(rows, "doc_id long, words array<string>")
        vocabulary = words(spark, "colours colors color other more")
        changed = lemmas.changed_words(lemmas.spelling_table(vocabulary, vocabulary), lemmas.lemma_table(vocabulary, vocabulary))
        assert pairs(changed) == {"colours": "color", "colors": "color"}
        out = lemmas.lemmatised(papers, changed, buckets=buckets)
        got = [(r.doc_id, sorted(r.words)) for r in out.collect()]
        assert sorted(got, key=str) == [(1, ["color", "more", "other"]), (2, ["color"]), (3, ["color", "other"]), (4, []), (5, []), (None, ["color"])]
        assert pairs(lemmas.count_lemmatised(out)) == {"color": 3, "other": 2, "more": 1}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["lemma_union", "lemma_sweep", "lemma_usage"])
def test_postings_are_not_renamed_one_by_one(spark, small, name):
    """Renaming tables of any size meet no posting in these queries, and postings aren't shuffled by paper and lemma: they read the papers' lemmas."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES[name](spark, small)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert any("/lemmatised-" in f for f in df.inputFiles()) and not any(f"/{t}-" in f for f in df.inputFiles() for t in ("spellings", "lemmas", "changed"))
        dealt = [line.split("hashpartitioning(")[1].split(", 4)")[0] for line in plan.splitlines() if "hashpartitioning(" in line]
        assert dealt and not [x for x in dealt if "doc_id" in x and ("lemma" in x or "word" in x)]
        if name == "lemma_union":
            assert len(dealt) == 1 and "Join" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_union_of_odd_papers(spark, small, tmp_path):
    """Rows of one doc_id are one paper, rows without a doc_id are none, as in SQL."""
    texts = [(1, "Colours and meetings, color"), (1, "colors; meeting meets"), (27, "colour meet"), (27, None), (2, ""), (None, "colours meeting"), (3, "studied studies study")]
    docs = spark.createDataFrame([(k, t, "en", "src1") for k, t in texts], "doc_id long, text string, lang string, source string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for t in ("nation", "region"):
        shutil.copy(f"{small}/{t}.parquet", tmp_path)
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = QUERIES["lemma_union"](spark, str(tmp_path))
    want = con.execute(ORACLES["lemma_union"])
    names = [x[0] for x in want.description]
    got = [tuple(r) for r in df.select(*names).collect()]
    assert sorted(got, key=str) == sorted(want.fetchall(), key=str) and ("color", 2001, 2) in got
