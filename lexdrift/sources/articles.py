"""Article XML to paper records with Spark's own XML expressions; what they can't tell apart goes to the parser of xml.py.

An article is read with a declared schema, in which elements with mixed content are strings: their inner XML. Ampersands are escaped once more before that, so
that these strings are XML still, with their entities as they were. Text is what stands between the tags. Regular articles, those without comments,
marked sections, namespaces of their own and the like, never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lists import COUNTRY_ALIASES
from ..functions.text import let
from .corpus import RAW
from .xml import country_table, parse_articles

_AFF = "aff array<string>"
_FRONT = f"""struct<`journal-meta` array<struct<`journal-title-group` array<struct<`journal-title` array<string>>>>>,
    `article-meta` array<struct<`article-id` array<struct<`_pub-id-type` string, _VALUE string>>, `title-group` array<struct<`article-title` array<string>>>, {_AFF},
        `contrib-group` array<struct<{_AFF}, contrib array<struct<{_AFF}>>>>, `pub-date` array<struct<`_pub-type` string, `_date-type` string, parts array<string>>>>>>"""
_ROOT = f"`_article-type` string, `_xml:lang` string, front {_FRONT}, body struct<sec array<string>>, _corrupt string"
#: Python's white space.
_BLANK = r"[\s\x1c-\x1f\x85\p{Z}]+"
#: What Spark's parser and the one of xml.py may see in different ways, or what can't be taken apart as text.
_ODD = [
    r"<!|<\?",  # comments, marked sections, instructions
    r"xmlns=",  # names in a namespace
    r"=\s*'[^'<>]*\"[^'<>]*'|=\s*\"[^\"<>]*>|=\s*'[^'<>]*>",  # quotes and brackets in attributes
    r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]{2,6}|#x[0-9A-Fa-f]{2,5});)",  # other entities
    r"&#(?:0*(?:1[124-9]|2[0-9]|3[01])|x0*(?:[bcBCefEF]|1[0-9a-fA-F])|5[5-7][0-9]{3}|6553[4-9]|x[dD][89a-fA-F][0-9a-fA-F]{2}|x[fF]{3}[eEfF]);",  # characters that XML hasn't
    r"<front[\s>][^\x00]*<front[\s>]",
]


def _parsed(xml: Column, schema: str) -> Column:
    """A struct of an XML text, with strings for mixed content in which entities are as they were."""
    options = {"ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "wildcardColName": "parts"}
    return F.from_xml(F.replace(xml, F.lit("&"), F.lit("&amp;")), F.lit(schema), options)


def plain(inner: Column) -> Column:
    """The pieces of text of an inner XML, set apart by spaces."""

    def told(text: Column) -> Column:
        named = text
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            named = F.replace(named, F.lit(entity), F.lit(char))
        # numbered ones are left to the parser
        return F.when(F.contains(text, F.lit("&#")), F.xpath_string(F.concat(F.lit("<t>"), text, F.lit("</t>")), F.lit("/t"))).when(F.contains(text, F.lit("&")), named).otherwise(text)

    return let(F.array_join(F.filter(F.split(inner, "<[^>]*>"), lambda t: t != ""), " "), told)


def _first(texts: Column) -> Column:
    return F.get(texts, F.lit(0))


def names_of(countries: Mapping[str, str]) -> dict[str, str]:
    """What an address may end with, and the country: aliases as they are written, and after a blank, so that the two can't clash, names and codes in capitals."""
    aliases = {name: c for name, code in COUNTRY_ALIASES.items() if (c := countries.get(code.upper()))}
    return aliases | {f" {name}": c for name, c in countries.items()}


def country_at_end(address: Column, names: Column, most: int) -> Column:
    """The country that the fewest words at the end of an address name, at most so many, by a map of names_of()."""

    def last(words: Column) -> Column:
        tails = F.transform(F.sequence(F.lit(1), F.least(F.size(words), F.lit(most))), lambda n: F.regexp_replace(F.array_join(F.slice(words, -n, n), " "), r"^[.,;]+|[.,;]+$", ""))
        found = F.aggregate(tails, F.lit(None).cast("string"), lambda c, e: F.coalesce(c, F.element_at(names, e), F.element_at(names, F.concat(F.lit(" "), F.upper(e)))))
        return F.when(F.size(words) > 0, found)

    return let(F.filter(F.split(address, _BLANK), lambda w: w != ""), last)


def _record(x: Column, names: Column, most: int) -> dict[str, Column]:
    """The fields of a record from the parsed front and attributes of an article; names and most as for country_at_end()."""
    metas = F.coalesce(x["front"]["article-meta"], F.array())
    each = lambda rows, name: F.flatten(F.transform(rows, lambda r: F.coalesce(r[name], F.array())))
    journal = each(each(F.coalesce(x["front"]["journal-meta"], F.array()), "journal-title-group"), "journal-title")
    ids = each(metas, "article-id")
    groups = each(metas, "contrib-group")
    affs = [each(metas, "aff"), each(groups, "aff"), each(each(groups, "contrib"), "aff")]
    own = lambda t: F.coalesce(_parsed(F.concat(F.lit("<a>"), t, F.lit("</a>")), "country array<string>, _corrupt string")["country"], F.array())
    named = F.transform(F.array(*affs), lambda a: _first(F.flatten(F.transform(F.filter(a, lambda t: F.contains(t, F.lit("<country"))), own))))
    places = F.concat(named, F.array(*[_first(a) for a in affs]))
    country = F.aggregate(places, F.lit(None).cast("string"), lambda c, p: F.coalesce(c, country_at_end(plain(p), names, most)))
    days = each(metas, "pub-date")
    kinds = [F.filter(days, lambda d: d["_pub-type"] == "epub"), F.filter(days, lambda d: d["_date-type"] == "pub"), F.filter(days, lambda d: d["_pub-type"] == "ppub")]
    day = F.coalesce(*[_first(k) for k in kinds])
    whole = lambda t: F.regexp_replace(plain(t), f"^{_BLANK}|{_BLANK}$", "")
    parts = F.filter(F.transform(F.coalesce(day["parts"], F.array()), whole), lambda t: t != "")
    # they hold no others, and stand nowhere else in a front
    abstracts = F.regexp_extract_all(x["head"], F.lit(r"(?s)<abstract(?:\s(?:(?!=\s*[\"']graphical[\"'])[^>])*)?>(.*?)</abstract>"), F.lit(1))
    return {
        "article-type": x["_article-type"],
        "language": x["_xml:lang"],
        "journal": plain(_first(journal)),
        "pmc-id": plain(_first(F.filter(ids, lambda i: i["_pub-id-type"] == "pmc"))["_VALUE"]),
        "pmid": plain(_first(F.filter(ids, lambda i: i["_pub-id-type"] == "pmid"))["_VALUE"]),
        "title": plain(_first(each(each(metas, "title-group"), "article-title"))),
        "country": country,
        "date": F.when(day.isNotNull(), F.array_join(parts, "-")),
        "abstract": F.array_join(F.transform(abstracts, plain), ""),
    }


def _sections(secs: Column, ahead: Column) -> Column:
    """Map of titles to texts of the sections (inner XML) of a body, and of the text ahead of all."""
    pairs = F.transform(secs, lambda s: F.struct(F.nullif(F.regexp_extract(s, r"(?s)^\s*<title(?:\s[^>]*)?>([^<]*)", 1), F.lit("")).alias("t"), plain(s).alias("x")))

    def made(pairs: Column, titled: Column, keys: Column, ahead: Column) -> Column:
        """Titles and texts; what has no title may be the Introduction."""
        texts = F.transform(keys, lambda k: F.element_at(F.filter(titled, lambda p: p["t"] == k), -1)["x"])  # of equal titles the last text
        bare = (F.size(keys) > 0) & (F.size(keys) < F.size(pairs))
        first = _first(pairs)["x"]
        own = lambda texts: F.when(bare, F.when(first != _first(texts), first)).when(F.length(ahead) > 0, ahead)
        return let(F.transform(keys, plain), lambda names: let(texts, lambda texts: let(own(texts), lambda opening: put(names, texts, opening))))

    def put(names: Column, texts: Column, opening: Column) -> Column:
        at = F.array_position(names, F.lit("Introduction")).cast("int")
        fresh = opening.isNotNull() & (at == 0)
        return F.struct(
            F.when(fresh, F.concat(names, F.array(F.lit("Introduction")))).otherwise(names).alias("titles"),
            F.when(opening.isNull(), texts).when(at == 0, F.concat(texts, F.array(opening))).otherwise(F.transform(texts, lambda t, i: F.when(i + 1 == at, opening).otherwise(t))).alias("texts"),
        )

    def titled(pairs: Column) -> Column:
        named = F.filter(pairs, lambda p: p["t"].isNotNull())
        return let(named, lambda rows: let(F.array_distinct(F.transform(rows, lambda p: p["t"])), lambda keys: let(ahead, lambda before: made(pairs, rows, keys, before))))

    return let(pairs, titled)


def _taken_apart(files: DataFrame) -> DataFrame:
    """files with the parsed article (x) of those that are regular; x is null for the others."""
    own = [F.col(c) for c in files.columns]
    text = F.col("content").cast("string")
    files = files.select(*own, text.alias("_text"), F.instr(text, "<article").alias("_at"))
    root, prolog = F.expr("substring(_text, _at)"), F.expr("substring(_text, 1, _at - 1)")
    opening = r"(?i)^\x{FEFF}?\s*(<\?xml(?:(?!encoding)[^>])*(encoding=[\"']utf-8[\"'](?:[^>])*)?\?>)?\s*(<!DOCTYPE[^>\[]*>)?\s*$"
    even = F.is_valid_utf8(F.coalesce("_text", F.lit(""))) & (F.col("_at") > 0) & prolog.rlike(opening)
    for pattern in _ODD:
        even = even & ~root.rlike(pattern)
    # what comes before the first section of the body, and the front without empty abstracts, as they are written
    before = F.regexp_extract(root, r"(?s)<body(?:\s[^>]*)?(?<!/)>(.*?)(?:<sec[\s/>]|</body>)", 1)
    head = F.regexp_replace(F.regexp_extract(root, r"(?s)^(.*?)</front>", 1), r"<abstract(?:\s[^>]*)?/>", "")
    files = files.select(*own, F.when(even, _parsed(root, _ROOT)).alias("r"), F.when(even, before).alias("before"), F.when(even, head).alias("head"))
    some = F.col("r.body").isNotNull() & (F.length("before") > 0)
    files = files.select(*own, "r", "head", F.when(some, _parsed(F.concat(F.lit("<b>"), F.col("before"), F.lit("</b>")), "parts array<string>, _corrupt string")).alias("a"))
    secs = F.coalesce("r.body.sec", F.array())
    # a title with markup, none at the start, or several: told by the other parser
    clear = F.forall(secs, lambda s: (F.regexp_count(s, F.lit(r"<title[\s>]")) == 0) | (s.rlike(r"^\s*<title(?:\s[^>]*)?>[^<]+</title>") & ~F.regexp_replace(s, r"(?s)<sec[\s>].*", "").rlike(r"(?s)<title[\s>].*<title[\s>]")))
    whole = F.col("r").isNotNull() & F.col("r._corrupt").isNull() & F.col("a._corrupt").isNull()
    made = F.struct("r.`_article-type`", "r.`_xml:lang`", "r.front", "head", secs.alias("secs"), F.coalesce("a.parts", F.array()).alias("ahead"))
    return files.select(*own, F.when(F.coalesce(whole & clear, F.lit(False)), made).alias("x"))


def read_records(files: DataFrame, countries: Mapping[str, str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Paper records of rows (path, content), as parse_articles() gives them, with `_corrupt`; columns in keep stay beside them.

    Regular articles are read by Spark's expressions, the others by the parser in Python.
    """
    given = country_table(files.sparkSession) if countries is None else dict(countries)
    names = names_of(given)
    most = max(len(n.split()) for n in names) if names else 1  # longer endings name none
    files = _taken_apart(files.select("content", *keep))
    # rows of one or none, where a filter would be pushed down to where it has everything parsed a second time
    regular = files.select(*keep, F.explode(F.filter(F.array("x"), lambda x: x.isNotNull())).alias("x"))
    # the map is a row of its own, of some hundred names, beside each article
    regular = regular.crossJoin(F.broadcast(files.sparkSession.createDataFrame([(names,)], "_names map<string,string>")))
    x = F.col("x")
    fields = _record(x, F.col("_names"), most)
    ahead = F.array_join(F.transform(x["ahead"], plain), "")
    made = _sections(x["secs"], ahead)
    regular = regular.select(*[c.alias(name) for name, c in fields.items()], made.alias("made"), *keep)
    regular = regular.select(*fields, F.col("made.titles").alias("section_titles"), F.col("made.texts").alias("sections"), F.lit(None).cast("string").alias("_corrupt"), *keep)
    order = [*RAW.fieldNames(), "_corrupt", *keep]
    odd = parse_articles(files.where(x.isNull()), given, keep)
    return regular.select(*[F.col(f"`{c}`") for c in order]).unionByName(odd.select(*[F.col(f"`{c}`") for c in order]))


def irregular(files: DataFrame) -> DataFrame:
    """The rows (path, content) that the parser in Python has to read."""
    return _taken_apart(files).where("x is null").drop("x")
