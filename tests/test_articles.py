import pytest

from lexdrift.plans.queries import xml_articles
from lexdrift.sources.articles import irregular, read_records
from lexdrift.sources.xml import country_table, parse_articles

HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE article PUBLIC "-//NLM//DTD JATS 1.2//EN" "x.dtd">\n'
META = '<front><journal-meta><journal-title-group><journal-title>J &amp; <i>K</i></journal-title></journal-title-group></journal-meta><article-meta>{0}</article-meta></front>'
REGULAR = {
    "nothing": "<article/>",
    "empty body": "<article><body/></article>",
    "attributes": HEAD + '<article article-type="review-article" xml:lang="fr" xmlns:xlink="http://www.w3.org/1999/xlink">' + META.format("") + "</article>",
    "ids": "<article>" + META.format('<article-id pub-id-type="doi">d</article-id><article-id pub-id-type="pmc">PMC&#x31;2</article-id><article-id pub-id-type="pmid"> 7 </article-id>') + "</article>",
    "title": "<article>" + META.format("<title-group><article-title>A <i>b</i>\n  c &lt;d&gt; &#233; <sup>2</sup></article-title></title-group>") + "</article>",
    "two titles": "<article>" + META.format("<title-group><article-title>one</article-title><article-title>two</article-title></title-group>") + "</article>",
    "dates": "<article>" + META.format('<pub-date pub-type="ppub"><year>2001</year></pub-date><pub-date date-type="pub"> <day> 3 </day> <month>4</month><year>2002</year></pub-date>') + "</article>",
    "epub": "<article>" + META.format('<pub-date date-type="pub"><year>2001</year></pub-date><pub-date pub-type="epub"><month>5</month><year>2003</year></pub-date>') + "</article>",
    "empty date": "<article>" + META.format('<pub-date pub-type="epub"/>') + "</article>",
    "abstracts": "<article>" + META.format('<abstract abstract-type="graphical"><p>no</p></abstract><abstract><title>Aim</title><p>one &amp; <b>two</b></p></abstract><abstract xml:lang="en" id="a">three</abstract>') + "</article>",
    "country": "<article>" + META.format("<contrib-group><contrib><aff>Berlin, <country>Germany</country></aff></contrib><aff>Paris, France.</aff></contrib-group><aff>Nowhere</aff>") + "</article>",
    "country by address": "<article>" + META.format("<aff><label>1</label>Dept of X, Seoul, South Korea; </aff>") + "</article>",
    "country of the first only": "<article>" + META.format("<aff>Mars</aff><aff>Rome, Italy</aff>") + "</article>",
    "nested country": "<article>" + META.format("<aff><addr-line><country>Spain</country></addr-line> Lisbon, Portugal</aff>") + "</article>",
    "sections": "<article><body><sec id='s1'><title>Intro</title><p>a <i>b</i> c</p><p>d</p></sec><sec><title>Methods</title><sec><title>Sub</title><p>x &amp; y</p></sec></sec></body></article>",
    "same title": "<article><body><sec><title>A</title><p>1</p></sec><sec><title>B</title><p>2</p></sec><sec><title>A</title><p>3</p></sec></body></article>",
    "untitled first": "<article><body><sec><p>first</p></sec><sec><title>B</title><p>2</p></sec></body></article>",
    "untitled later": "<article><body><sec><title>B</title><p>2</p></sec><sec><p>later</p></sec></body></article>",
    "untitled, with an introduction": "<article><body><sec><p>first</p></sec><sec><title>Introduction</title><p>2</p></sec><sec><title>C</title></sec></body></article>",
    "ahead": "<article><body><p>one <b>two</b></p><p>three</p><fig><label>F</label></fig><sec><title>A</title><p>x</p></sec><p>after</p></body></article>",
    "ahead over an introduction": "<article><body><p>one</p><sec><title>Introduction</title><p>x</p></sec><sec><title>A</title></sec></body></article>",
    "no sections": "<article><body><p>only &#8211; text</p> tail <p>more</p></body></article>",
    "only untitled": "<article><body><sec><p>x</p></sec><sec><p>y</p></sec></body></article>",
    "spaces": "<article>\n <body>\n  <sec>\n   <title>A</title>\n   <p> x </p>\n  </sec>\n </body>\n</article>\n",
}
ODD = {
    "comment": "<article><body><sec><title>A</title><p>x<!-- y -->z</p></sec></body></article>",
    "marked section": "<article><body><p><![CDATA[a < b]]></p></body></article>",
    "broken": "<article><body>",
    "no article": "<other/>",
    "empty": "",
    "namespace": '<article xmlns="http://x"><body><p>x</p></body></article>',
    "title with markup": "<article><body><sec><title>A <i>b</i></title><p>x</p></sec></body></article>",
    "empty title": "<article><body><sec><title/><p>x</p></sec></body></article>",
    "unknown entity": "<article><body><p>a&nbsp;b</p></body></article>",
    "section in a box": "<article><body><boxed-text><sec><title>In</title></sec></boxed-text><sec><title>A</title></sec></body></article>",
    "bracket in an attribute": '<article><body><p a="x>y">z</p></body></article>',
    "not text": "<article>\x00</article>",
}


def frame(spark, cases):
    return spark.createDataFrame([(name, bytearray(text.encode())) for name, text in cases.items()] + [("null", None)] * (cases is ODD), "path string, content binary")


def records(df):
    return {r["path"]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("cases", [REGULAR, ODD], ids=["regular", "odd"])
def test_the_same_as_the_other_parser(spark, cases):
    files = frame(spark, cases)
    countries = country_table(spark)
    got, want = records(read_records(files, countries, ("path",))), records(parse_articles(files, countries, ("path",)))
    assert got.keys() == want.keys()
    for name in want:
        assert got[name] == want[name], name


def test_regular_files_stay_on_the_jvm(spark, small):
    assert irregular(frame(spark, REGULAR)).count() == 0
    assert {r["path"] for r in irregular(frame(spark, ODD)).collect()} == {*ODD, "null"}
    assert irregular(xml_articles(spark, small)).count() == 0


def test_the_queries_look_at_each_article_once(spark, small):
    """The text of an article is made and parsed once: one scan of the documents and one step in Python, and no column of Spark's parser."""
    from lexdrift.plans.queries import QUERIES

    plan = QUERIES["xml_records"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("MapInArrow") == 1 and "from_xml" not in plan


def test_articles_have_only_characters_of_xml(spark, tmp_path):
    """What XML hasn't goes, as in the SQL, and so do characters beyond the first plane; the rest is as it was."""
    texts = ["a\r\nb & <c>\td", "\x00x\x1f\ny\ufffe\uffffz", "\U0001f600 q\U0010ffff", "\ud7ff\ue000\ufffd", "", None, "plain\n\nlines"]
    spark.createDataFrame([(8 * k + 1, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    for tasks in (None, 3):
        got = {r["pmc-id"]: r["sections"] for r in parse_articles(xml_articles(spark, str(tmp_path), tasks)).collect()}
        lines = {str(8 * k + 1): "".join(c for c in t or "" if c in "\t\n" or " " <= c <= "\ud7ff" or "\ue000" <= c <= "\ufffd").split("\n") for k, t in enumerate(texts) if (8 * k + 1) % 7}
        assert {k: [s.split(" ", 2 if s.startswith("Part ") else 1)[-1] for s in v if s not in ("Before.",)] for k, v in got.items() if k in lines} == {
            k: [x or ("Intro", "Methods", "Results")[i] for i, x in enumerate(v)] for k, v in lines.items()
        }
