from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexdrift.operators import cleaning, language
from lexdrift.sources import corpus

TEXTS = [
    ("en", "the weather was fine and the people were walking through the streets of the old town"),
    ("en", "nothing that they had said about the house was true and everybody knew it"),
    ("de", "das Wetter war schön und die Leute gingen durch die Straßen der alten Stadt"),
    ("de", "nichts von dem was sie über das Haus gesagt hatten war wahr und jeder wusste es"),
    ("fr", "le temps était beau et les gens marchaient dans les rues de la vieille ville"),
    ("fr", "rien de ce qu'ils avaient dit de la maison n'était vrai et tout le monde le savait"),
]


def by_hand(text):
    import re

    out = []
    for w in re.split(r"[^\w]+|[\d_]+", (text or "").lower()):
        out += [f" {w} "[k : k + 3] for k in range(len(w))]
    return out


def ranks(counts):
    return {g: k for k, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: language.PROFILE], 1)}


def nearest(text, known):
    own = ranks(Counter(by_hand(text)))
    scores = [(sum(abs(k - p[g]) if g in p else language.PROFILE for g, k in own.items()), lang) for lang, p in known.items() if p.keys() & own.keys()]
    return min(scores, default=(None, None))


@pytest.fixture(scope="module")
def rows(spark):
    texts = [(k, lang, None, t) for k, (lang, t) in enumerate(TEXTS)]
    texts += [(10, None, "short", "die Straßen der Stadt waren alt und das Haus war schön"), (11, None, "the old streets were fine", None), (12, None, None, None), (13, None, "12 34", "ab 5"), (14, None, "", "les rues de la maison")]
    return spark.createDataFrame(texts, "doc_id long, language string, head string, abstract string")


def test_profiles_and_distances_by_hand(spark, rows):
    got = {}
    for r in language.profiles(rows).collect():
        got.setdefault(r.language, {})[r.gram] = r.place
    want = {lang: ranks(Counter(g for own, t in TEXTS if own == lang for g in by_hand(t))) for lang in ("en", "de", "fr")}
    assert got == want
    out = {r.doc_id: r for r in language.detect(rows.where("language is null"), language.profiles(rows), short="head", long="abstract").collect()}
    assert sorted(out) == [10, 11, 12, 13, 14]
    for k, by, text in ((10, "abstract", "die Straßen der Stadt waren alt und das Haus war schön"), (11, "head", "the old streets were fine"), (14, "abstract", "les rues de la maison")):
        assert (out[k].distance, out[k].language) == nearest(text, want) and out[k].told_by == by
    assert [out[k].language for k in (10, 11, 14)] == ["de", "en", "fr"]
    assert all(out[k].language is None and out[k].told_by is None and out[k].distance is None for k in (12, 13))


def test_inference_keeps_what_is_declared(spark, rows):
    known = language.profiles(rows)
    out = {r.doc_id: (r.language, r.language_by) for r in language.inferred(rows, known, short="head", long="abstract").collect()}
    assert len(out) == rows.count() and out[0] == ("en", "declared") and out[10] == ("de", "abstract") and out[11] == ("en", "head") and out[12] == (None, "failed")
    f = cleaning.funnel(language.inferred(rows, known, short="head", long="abstract"), steps=[("language", F.col("language") == "en")]).first()
    assert f.language_failures == 2 and f.after_language == 3


def test_held_out_accuracy(spark, small):
    """The languages of papers that don't tell theirs, learned from the others: by a line's worth of text, nearly always the right one."""
    p = corpus.papers(spark, small).withColumn("true", F.col("language")).withColumn("language", F.when(F.col("doc_id") % 2 == 0, F.col("language"))).withColumn("head", F.get("sections", F.lit(0)))
    out = language.inferred(p, language.profiles(p), short="head", long="abstract").where("true is not null and doc_id % 2 = 1 and language_by <> 'failed'").select("true", "language").collect()
    right = sum(r.true == r.language for r in out)
    print(f"languages: {right} of {len(out)} right")
    assert len(out) > 50 and right >= 0.97 * len(out)


def test_no_rows_and_no_profiles(spark, rows):
    none = rows.limit(0)
    assert language.profiles(none).collect() == []
    assert language.detect(none, language.profiles(rows)).collect() == []
    assert {r.language for r in language.detect(rows, language.profiles(none)).collect()} == {None}


def test_texts_are_ranked_where_they_stand(spark, rows):
    """Detection shuffles nothing, and profiles take apart different words only."""
    known = language.profiles(rows)
    plan = language.detect(rows, known, short="head", long="abstract")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    plan = known._jdf.queryExecution().optimizedPlan().toString()
    counted, first = plan.rindex("explode(filter(split"), plan.index("Aggregate [language")
    assert first < counted and plan[:counted].count("Aggregate") == 2


def test_equal_ranks_and_many_rows(spark):
    """Equally frequent n-grams go by alphabet, letters beyond ASCII after the others; equally near languages too."""
    texts = ["zz zz éé aa", "éa éa ab", "zé", None, "aa aa aa bb bb cc dd ee ff gg hh ii jj kk ll mm"]
    df = spark.createDataFrame([(k, ("b", "a", None)[k % 3], texts[k % 5]) for k in range(60)], "doc_id long, language string, abstract string")
    known = language.profiles(df)
    want = {lang: ranks(Counter(g for k in range(60) if ("b", "a", None)[k % 3] == lang for g in by_hand(texts[k % 5]))) for lang in ("a", "b")}
    out = {r.doc_id: (r.language, r.distance) for r in language.detect(df, known, least=1).collect()}
    near = lambda t: min(((d, x) for d, x in [(nearest(t, {x: want[x]})) for x in want] if x), default=(None, None))
    assert out == {k: near(texts[k % 5])[::-1] for k in range(60)}
