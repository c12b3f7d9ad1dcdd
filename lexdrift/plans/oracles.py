"""The queries in DuckDB SQL, over the driver's tables."""

from __future__ import annotations

from ..functions.lists import COMMON_MARKERS, CUTOFFS, DETACHED, IGNORED_WORDS, IRREGULAR, LEMMAS, SPELLINGS
from ..operators.cleaning import STOP_WORDS
from ..operators.frequency import EXACT
from ..operators.language import LEAST, PROFILE
from .queries import (
    ADDRESSES, COMMON, END, FIRST, FLOOR, LAST, LENGTH, LOW_CUTOFF, MARKER_LEAST, MARKER_MOST, MEANS, MOST_COUNTRY_SE, MOST_SE, POOL, POOLED, POOLED_CUTOFFS, PUBLISHED_FLOOR, PUBLISHED_SE,
)

PAPERS = """papers AS (
    SELECT d.doc_id, (2000 + d.doc_id % 26)::INTEGER AS year, (1 + (d.doc_id // 26) % 12)::INTEGER AS month,
        CASE d.doc_id % 4 WHEN 0 THEN 'research-article' WHEN 1 THEN 'review-article' WHEN 2 THEN 'case-report' ELSE 'editorial' END AS article_type,
        n.n_name AS country, r.r_name AS region, d.source AS journal, d.lang AS language, d.text AS abstract,
        string_split(coalesce(d.text, ''), chr(10)) AS lines
    FROM documents d LEFT JOIN nation n ON d.doc_id % 25 = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey)"""
POSTINGS = r"""postings AS (
    SELECT doc_id, year, month, unnest(list_distinct(list_filter(regexp_split_to_array(lower(abstract), '[^\p{L}\p{N}_]+'),
        lambda w: regexp_full_match(w, '[a-z]{4,}')))) AS word FROM papers)"""
MARKERS = f"""markers AS (
    SELECT word, count(*) AS doc_freq, CASE WHEN count(*) * 100 >= {COMMON} * (SELECT count(*) FROM papers) THEN 'common' ELSE 'rare' END AS grp
    FROM postings GROUP BY word
    HAVING count(*) * 100 BETWEEN {MARKER_LEAST} * (SELECT count(*) FROM papers) AND {MARKER_MOST} * (SELECT count(*) FROM papers))"""
YEARS = f"""years AS (
    SELECT y.year::INTEGER AS year, count(p.doc_id) AS n_papers FROM range({FIRST}, {LAST + 1}) y(year) LEFT JOIN papers p ON p.year = y.year GROUP BY y.year)"""
MONTHS = f"""months AS (
    SELECT y.year::INTEGER AS year, m.month::INTEGER AS month, count(p.doc_id) AS n_papers
    FROM range({FIRST}, {LAST + 1}) y(year) CROSS JOIN range(1, 13) m(month) LEFT JOIN papers p ON p.year = y.year AND p.month = m.month GROUP BY ALL)"""
BASE = f"{PAPERS}, {POSTINGS}, {MARKERS}, {YEARS}, {MONTHS}"
WORD_YEAR = """wy AS (
    SELECT k.word, y.year, y.n_papers, count(p.doc_id) AS n, (count(p.doc_id) + 1.0::DOUBLE) / (y.n_papers + 1) AS freq
    FROM markers k CROSS JOIN years y LEFT JOIN postings p ON p.word = k.word AND p.year = y.year GROUP BY k.word, y.year, y.n_papers)"""
WORD_MONTH = """wm AS (
    SELECT k.word, y.year, y.month, y.n_papers, count(p.doc_id) AS n, (count(p.doc_id) + 1.0::DOUBLE) / (y.n_papers + 1) AS freq
    FROM markers k CROSS JOIN months y LEFT JOIN postings p ON p.word = k.word AND p.year = y.year AND p.month = y.month GROUP BY k.word, y.year, y.month, y.n_papers)"""
MEAN = f"""wmean AS (
    SELECT w.word, m.year, avg((coalesce(c.n, 0) + 1.0::DOUBLE) / (m.n_papers + 1)) AS mean_freq
    FROM (SELECT DISTINCT word FROM postings) w CROSS JOIN months m LEFT JOIN (SELECT word, year, month, count(*) AS n FROM postings GROUP BY ALL) c ON c.word = w.word AND c.year = m.year AND c.month = m.month
    WHERE m.year >= {MEANS} GROUP BY w.word, m.year)"""
LAGGED = """lagged AS (
    SELECT word, year, mean_freq AS freq, projection, mean_freq / nullif(projection, 0) AS ratio, mean_freq - projection AS gap FROM (
        SELECT *, lag(mean_freq, 2) OVER w + greatest(2 * (lag(mean_freq, 2) OVER w - lag(mean_freq, 3) OVER w), 0.0) AS projection, lag(mean_freq, 3) OVER w AS third
        FROM wmean WINDOW w AS (PARTITION BY word ORDER BY year)) WHERE third IS NOT NULL)"""
EXCESS = f"""excess AS (
    SELECT word, year, ratio, gap FROM lagged WHERE word NOT IN ({", ".join(repr(w) for w in IGNORED_WORDS)}) AND round(freq, 9) >= 0.001
        AND (log10(round(ratio, 9)) > log10(2) - (log10(round(freq, 9)) + 4) * log10(2) / 4 OR round(gap, 9) > 0.01))"""


def groups(period: str) -> str:
    on, keys = ("AND h.month = y.month", "y.year, y.month, y.n_papers") if period == "months" else ("", "y.year, y.n_papers")
    return f"""hits AS (SELECT DISTINCT m.grp, p.doc_id, p.year, p.month FROM postings p JOIN markers m USING (word)),
    groups AS (SELECT g.grp, {keys}, count(h.doc_id) AS n, (count(h.doc_id) + 1.0::DOUBLE) / (y.n_papers + 1) AS freq
        FROM (SELECT DISTINCT grp FROM markers) g CROSS JOIN {period} y LEFT JOIN hits h ON h.grp = g.grp AND h.year = y.year {on} GROUP BY g.grp, {keys})"""


def regression(source: str, keys: str, index: str, end: int, length: int) -> str:
    return f"""rows_t AS (SELECT *, ({index} - {end - length})::DOUBLE AS t FROM {source} WHERE {index} >= {end - length}),
    fit AS (SELECT {keys}, regr_slope(freq, t) AS b, regr_intercept(freq, t) AS a, regr_syy(freq, t) AS syy, regr_sxy(freq, t) AS sxy,
        regr_sxx(freq, t) AS sxx, avg(t) AS mt, count(*) AS k FROM rows_t WHERE t < {length} GROUP BY {keys}),
    proj AS (SELECT *, CASE WHEN abs(projection) >= 1e-9 THEN freq / projection END AS ratio, freq - projection AS gap, CASE WHEN abs(1 - projection) >= 1e-9 THEN (freq - projection) / (1 - projection) END AS usage FROM (
        SELECT r.*, a + b * t AS projection, sqrt(CASE WHEN syy - sxy * sxy / nullif(sxx, 0) > {EXACT} * syy THEN syy - sxy * sxy / sxx WHEN sxx > 0 THEN 0 END / nullif(k - 2, 0) * (1 + 1.0 / k + (t - mt) * (t - mt) / nullif(sxx, 0))) AS sdev
        FROM rows_t r JOIN fit USING ({keys})))"""


def variance(p: str, q: str, n: str, version: str, function: str) -> str:
    """The square of the standard error."""
    var = {"binomial": f"{p} * (1 - {p}) / {n}", "regression": "sdev * sdev", "both": f"(sdev * sdev + {p} * (1 - {p}) / {n})"}[version]
    own = f"{q} * (1 - {q}) / {n}"
    if function == "gap":
        return f"({var} + {own})"
    return f"((({q} - 1) / ((1 - {p}) * (1 - {p}))) ** 2 * ({var}) + {own} / ((1 - {p}) * (1 - {p})))"


GROUP_YEAR = f"{groups('years')}, {regression('groups', 'grp', 'year', END, LENGTH)}"
GROUP_MONTH = f"{groups('months')}, indexed AS (SELECT *, year * 12 + month - 1 AS i FROM groups), {regression('indexed', 'grp', 'i', 2022 * 12 + 10, 24)}"


def cuts_of(values: list[float]) -> str:
    return f"cuts AS (SELECT c.cutoff, (row_number() OVER (ORDER BY c.cutoff) - 1)::INTEGER AS step FROM (SELECT unnest([{', '.join(map(repr, values))}]::DOUBLE[]) AS cutoff) c)"


CUTS = cuts_of(CUTOFFS)
F2024 = "f2024 AS (SELECT word, freq FROM wy WHERE year = 2024)"
SWEEP = """swept AS (
    SELECT c.cutoff, c.step, y.year, y.n_papers, count(DISTINCT h.doc_id) AS n, (count(DISTINCT h.doc_id) + 1.0::DOUBLE) / (y.n_papers + 1) AS freq
    FROM cuts c CROSS JOIN years y LEFT JOIN (SELECT p.doc_id, p.year, f.freq AS f FROM postings p JOIN f2024 f USING (word)) h ON h.year = y.year AND h.f < c.cutoff GROUP BY c.cutoff, c.step, y.year, y.n_papers)"""
ESTIMATED = f"""{regression('swept', 'cutoff, step', 'year', END, LENGTH)},
    est AS (SELECT * FROM (SELECT *, max(projection) OVER (PARTITION BY step) AS top,
        sqrt({variance("(CASE WHEN projection >= 1 THEN 0.9999999999999999::DOUBLE ELSE projection END)", "(CASE WHEN freq = 1 THEN 0.9999999999999999::DOUBLE ELSE freq END)", "n_papers", "regression", "usage")}) AS se FROM proj) WHERE top < 0.999)"""
ALL_CUTS = f"{BASE}, {WORD_YEAR}, {F2024}, {CUTS}, {SWEEP}, {ESTIMATED}"
BEST = f"""best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY most_se, year ORDER BY round(usage, 9) DESC, step) AS rk FROM (
    SELECT *, min(CASE WHEN se > most_se THEN step END) OVER (PARTITION BY most_se, year) AS bad FROM est CROSS JOIN (VALUES {", ".join(f"({b}::DOUBLE)" for b in MOST_SE)}) l(most_se) WHERE year >= 2023)
    WHERE bad IS NULL OR step < bad) WHERE rk = 1)"""

#: The first lines' words, and the sweep over pooled years: the last period's cutoffs with their errors, and the first whose error is too large.
HEADS = rf"""pp AS (SELECT doc_id, ((year - {FIRST}) // {POOL})::INTEGER AS year, country, lines[1] AS head FROM papers WHERE year < {FIRST + POOL * (POOLED + 1)}),
    hp AS (SELECT * FROM (SELECT doc_id, year, unnest(list_distinct(list_filter(regexp_split_to_array(lower(head), '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{4,}}')))) AS word FROM pp) JOIN markers USING (word))"""
POOLED_SWEEP = f"""{BASE}, {cuts_of(POOLED_CUTOFFS)}, {HEADS}, py AS (SELECT year, count(*) AS n_papers FROM pp GROUP BY year),
    fl AS (SELECT word, (count(*) + 1.0::DOUBLE) / ((SELECT count(*) FROM pp) + 1) AS freq FROM hp WHERE grp = 'common' GROUP BY word),
    ph AS (SELECT doc_id, year, min(freq) AS f FROM hp JOIN fl USING (word) GROUP BY doc_id, year),
    swept AS (SELECT c.cutoff, c.step, y.year, y.n_papers, count(h.doc_id) AS n, (count(h.doc_id) + 1.0::DOUBLE) / (y.n_papers + 1) AS freq
        FROM cuts c CROSS JOIN py y LEFT JOIN ph h ON h.year = y.year AND h.f < c.cutoff GROUP BY c.cutoff, c.step, y.year, y.n_papers),
    {ESTIMATED.replace(str(END - LENGTH), "0").replace(f"t < {LENGTH}", f"t < {POOLED}")},
    pe AS (SELECT *, min(CASE WHEN se > {PUBLISHED_SE} THEN step END) OVER () AS bad FROM est WHERE year = {POOLED})"""
#: Every other paper without its language; the profiles of the declared ones, and what the others are nearest to.
GRAMS = r"""unnest(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}]+'), lambda w: len(w) > 0), lambda w: list_transform(range(1, len(w) + 1), lambda i: substr(' ' || w || ' ', i, 3)))))"""
ENOUGH = r"coalesce(list_sum(list_transform(regexp_split_to_array(lower({0}), '[^\p{{L}}]+'), lambda w: len(w))), 0) >= {1}"
LANGUAGES = f"""undeclared AS (SELECT * REPLACE (CASE WHEN doc_id % 2 = 0 THEN language END AS language), lines[1] AS head FROM papers),
    lg AS (SELECT language, gram, count(*) AS n FROM (SELECT language, {GRAMS.format("abstract")} AS gram FROM undeclared WHERE language IS NOT NULL) GROUP BY ALL),
    known AS (SELECT language, gram, place FROM (SELECT *, (row_number() OVER (PARTITION BY language ORDER BY n DESC, gram))::INTEGER AS place FROM lg) WHERE place <= {PROFILE}),
    chosen AS (SELECT doc_id, CASE WHEN {ENOUGH.format("head", LEAST)} THEN 'head' WHEN {ENOUGH.format("abstract", LEAST)} THEN 'abstract' END AS told_by, head, abstract FROM undeclared WHERE language IS NULL),
    og AS (SELECT doc_id, gram, count(*) AS n FROM (SELECT doc_id, {GRAMS.format("CASE c.told_by WHEN 'head' THEN head WHEN 'abstract' THEN abstract END")} AS gram FROM chosen c) GROUP BY ALL),
    own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) AS place FROM og) WHERE place <= {PROFILE}),
    dist AS (SELECT o.doc_id, l.lang, sum(coalesce(abs(o.place - k.place), {PROFILE})) AS distance, count(k.place) AS hits FROM own o CROSS JOIN (SELECT DISTINCT language AS lang FROM known) l
        LEFT JOIN known k ON k.language = l.lang AND k.gram = o.gram GROUP BY o.doc_id, l.lang),
    nearest AS (SELECT doc_id, min(struct_pack(d := distance, l := lang)) AS m FROM dist WHERE hits > 0 GROUP BY doc_id),
    detected AS (SELECT c.doc_id, m.l AS lang, CASE WHEN m IS NOT NULL THEN c.told_by END AS told_by, m.d::BIGINT AS distance FROM chosen c LEFT JOIN nearest n ON n.doc_id = c.doc_id)"""

SECTIONS = """secs AS (
    SELECT doc_id, year, section, string_agg(line, ' ' ORDER BY i) AS text FROM (
        SELECT doc_id, year, i, ['introduction', 'methods', 'results', 'discussion'][(i - 1) % 4 + 1] AS section, lines[i] AS line
        FROM papers, unnest(range(1, len(lines) + 1)) u(i) WHERE doc_id % 9 <> 4) GROUP BY ALL)"""
WORDS = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> ''))"
COUNTRY = """rare AS (SELECT DISTINCT p.doc_id FROM postings p JOIN markers m USING (word) WHERE m.grp = 'rare'),
    member AS (
        SELECT doc_id, year, country AS grp FROM papers WHERE country IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_4', 'NATION_5')
        UNION ALL SELECT doc_id, year, CASE WHEN country IN ('NATION_2', 'NATION_7', 'NATION_12') THEN 'english' ELSE 'non-english' END FROM papers WHERE country IS NOT NULL),
    cf AS (SELECT grp, year, count(*) AS n_papers, count(r.doc_id) AS n, (count(r.doc_id) + 1.0::DOUBLE) / (count(*) + 1) AS freq FROM member LEFT JOIN rare r USING (doc_id) GROUP BY grp, year)"""
RAW_JOURNAL = "CASE doc_id % 6 WHEN 0 THEN 'Journal of Neurology' WHEN 1 THEN 'Neurological Journal' WHEN 2 THEN 'Journal of Cancer Biochemistry' WHEN 3 THEN 'The Biochemistry of Cancer' WHEN 4 THEN 'Biomaterials' ELSE 'Annals of Things' END"
LABEL = "CASE doc_id % 6 WHEN 0 THEN 'neurology' WHEN 2 THEN 'biochemistry' WHEN 3 THEN 'cancer' WHEN 4 THEN 'material' END"
SKEWED = "sk AS (SELECT year, CASE WHEN doc_id % 2 = 0 THEN 'big' || (doc_id % 3) ELSE journal END AS journal FROM papers)"
PRESENT = "present AS (SELECT DISTINCT year, journal || (doc_id % 7) AS key FROM papers)"


def detached(kind: str, source: str) -> str:
    """(word, new) for each word of a source, as the table `kind`: what the rules lead to among the known words, in two rounds."""
    rules = ", ".join(f"('{old}', '{new}')" for old, new in DETACHED[kind])
    cut = "left({0}, len({0}) - len(old)) || new"
    return f"""{kind}_rules AS (SELECT * FROM (VALUES {rules}) r(old, new)),
    {kind}_c1 AS (SELECT word, {cut.format('word')} AS base FROM {source} JOIN {kind}_rules ON ends_with(word, old) AND len(word) > len(old)),
    {kind}_1 AS (SELECT word, min(struct_pack(n := len(base), base := base)).base AS new FROM {kind}_c1 WHERE base IN (SELECT word FROM known) GROUP BY word),
    {kind}_c2 AS (SELECT word, {cut.format('base')} AS base FROM {kind}_c1 JOIN {kind}_rules ON ends_with(base, old) AND len(base) > len(old) WHERE word NOT IN (SELECT word FROM {kind}_1)),
    {kind} AS (SELECT * FROM {kind}_1 UNION ALL SELECT word, min(struct_pack(n := len(base), base := base)).base FROM {kind}_c2 WHERE base IN (SELECT word FROM known) GROUP BY word)"""


_GIVEN = ", ".join(f"('{w}', '{x}')" for w, x in (IRREGULAR | LEMMAS).items())
#: The words that change: lemma (word, new) and spelling (word, new).
RENAMES = rf"""known AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(abstract), '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{2,}}'))) AS word FROM papers),
    given AS (SELECT * FROM (VALUES {_GIVEN}) g(word, new)),
    free AS (SELECT word FROM known WHERE len(word) >= 4 AND word NOT IN (SELECT word FROM given)),
    {detached("verb", "free")},
    noun_words AS (SELECT word FROM free WHERE word NOT IN (SELECT word FROM verb)),
    {detached("noun", "noun_words")},
    lemma AS (SELECT * FROM given WHERE word IN (SELECT word FROM known) UNION ALL SELECT * FROM verb UNION ALL SELECT * FROM noun),
    spelling AS (SELECT word, arg_min(base, k) AS new FROM (SELECT word, r.k, regexp_replace(word, r.old, r.new) AS base FROM known JOIN (VALUES {", ".join(f"({k}, '{old}', '{new}')" for k, (old, new) in enumerate(SPELLINGS))}) r(k, old, new)
        ON len(word) >= 4 AND regexp_matches(word, r.old)) WHERE base IN (SELECT word FROM known) AND base <> word GROUP BY word)"""
RENAMED = f"""{RENAMES}, american AS (SELECT p.*, coalesce(s.new, p.word) AS w FROM postings p LEFT JOIN spelling s USING (word)),
    renamed AS (SELECT a.doc_id, a.year, a.month, coalesce(l.new, a.w) AS lemma FROM american a LEFT JOIN lemma l ON l.word = a.w)"""


def r(x: str, name: str = "") -> str:
    return f"round({x}, 6) + 0.0 AS {name or x}"


LEMMA_SWEEP = f"""{PAPERS}, {POSTINGS.replace("postings AS", "raw AS")}, {RENAMED.replace("FROM postings p", "FROM raw p")},
    postings AS (SELECT DISTINCT doc_id, year, month, lemma AS word FROM renamed WHERE len(lemma) >= 4),
    {MARKERS}, {YEARS}, {WORD_YEAR}, {F2024}, {cuts_of([0.02, 0.05, 0.07, 0.1, 0.15, 0.2, 0.3, 0.5, 1.0])}, {SWEEP}"""
BY_SECTION = rf"""{BASE}, {SECTIONS},
    parts AS (SELECT doc_id, year, section, text FROM secs
        UNION ALL SELECT doc_id, year, 'full', string_agg(text, '' ORDER BY list_position(['introduction', 'methods', 'results', 'discussion'], section)) FROM secs GROUP BY doc_id, year),
    sp AS (SELECT doc_id, year, section, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{4,}}')))) AS word FROM parts),
    sm AS (SELECT sp.* FROM sp JOIN markers USING (word)),
    sy AS (SELECT s.section, y.year, count(p.doc_id) AS n_papers FROM (SELECT DISTINCT section FROM parts) s CROSS JOIN years y LEFT JOIN parts p ON p.section = s.section AND p.year = y.year GROUP BY s.section, y.year),
    sf AS (SELECT k.section, k.word, y.year, y.n_papers, count(p.doc_id) AS n, (count(p.doc_id) + 1.0::DOUBLE) / (y.n_papers + 1) AS freq
        FROM (SELECT DISTINCT section, word FROM sm) k JOIN sy y ON y.section = k.section LEFT JOIN sm p ON p.section = k.section AND p.word = k.word AND p.year = y.year GROUP BY k.section, k.word, y.year, y.n_papers)"""
SECTION_SWEEP = f"""{BY_SECTION}, {CUTS},
    sh AS (SELECT p.section, p.doc_id, p.year, min(f.freq) AS f FROM sm p JOIN sf f ON f.section = p.section AND f.word = p.word AND f.year = 2024 GROUP BY p.section, p.doc_id, p.year),
    swept AS (SELECT y.section, c.cutoff, c.step, y.year, y.n_papers, count(h.doc_id) AS n, (count(h.doc_id) + 1.0::DOUBLE) / (y.n_papers + 1) AS freq
        FROM cuts c CROSS JOIN sy y LEFT JOIN sh h ON h.section = y.section AND h.year = y.year AND h.f < c.cutoff GROUP BY y.section, c.cutoff, c.step, y.year, y.n_papers)"""
SECTION_BEST = f"""{SECTION_SWEEP}, {ESTIMATED.replace("cutoff, step", "section, cutoff, step").replace("PARTITION BY step", "PARTITION BY section, step")},
    {BEST.replace("PARTITION BY most_se", "PARTITION BY section, most_se")}"""
#: What each of ADDRESSES names, by the official list of countries.
COUNTRIES_OF_ADDRESSES = [
    "Korea, Republic of", "Germany", "Russian Federation", "Viet Nam", "Ireland", "New Zealand", "South Africa", "Austria", "Czechia", "Venezuela, Bolivarian Republic of", "China",
    "United Kingdom of Great Britain and Northern Ireland", None, "Türkiye", None,
]
#: The title of the i-th line's section of the made articles.
TITLE_OF_LINE = "coalesce(['Intro', 'Methods', 'Results'][i], 'Part ' || i)"
#: Made articles: their sections' lines, and what the records have of them.
MADE = r"""d AS (SELECT *, regexp_replace(replace(coalesce(text, ''), chr(13), ''), '[^\x09\x0A\x20-\x{D7FF}\x{E000}-\x{FFFD}]', '', 'g') AS t FROM documents),
        s AS (SELECT *, string_split(t, chr(10)) AS l FROM d),
        n AS (SELECT *, len(l) AS m, doc_id % 7 = 0 AS bare, doc_id % 4 = 0 AND len(l) > 1 AS untitled FROM s)"""
CHARS = f"""CASE WHEN bare THEN 0 ELSE (CASE WHEN doc_id % 3 = 0 AND NOT untitled THEN 7 ELSE 0 END) + list_sum([CASE WHEN untitled AND i = 2 THEN 0 ELSE length({TITLE_OF_LINE}) + length(l[i]) + (l[i] <> '')::INTEGER END for i in range(1, m + 1)]) END::BIGINT"""
_STAGES = ["before_prep", "after_article_type", "after_sections", "after_abstract", "after_language", "after_date"]
ORACLES = {
    "corpus_funnel": f"""WITH {PAPERS}, s AS (SELECT article_type IN ('research-article', 'review-article', 'case-report') AS a, doc_id % 9 <> 4 AS b, length(abstract) >= 250 AS c, language = 'en' AS d FROM papers)
        SELECT count(*) AS before_prep, count_if(a)::BIGINT AS after_article_type, count_if(a AND b)::BIGINT AS after_sections, count_if(a AND b AND c)::BIGINT AS after_abstract,
        count_if(a AND b AND c AND d)::BIGINT AS after_language, count_if(a AND b AND c AND d)::BIGINT AS after_date FROM s""",
    "funnel_discarded": f"""WITH {PAPERS}, s AS (SELECT journal, count(*) AS n, count_if(article_type <> 'editorial' AND doc_id % 9 <> 4 AND length(abstract) >= 250 AND language = 'en') AS k FROM papers GROUP BY journal)
        SELECT sum(n)::BIGINT AS before_prep, sum(k)::BIGINT AS after_prep, round(avg(1 - k / n), 6) AS mean_discarded, round(quantile_cont(1 - k / n, 0.5), 6) AS median_discarded FROM s""",
    "dedupe_latest": f"WITH {PAPERS} SELECT doc_id, year, journal, 1::INTEGER AS load FROM papers",
    "language_inferred": f"""WITH {PAPERS}, w AS (SELECT doc_id, language, regexp_split_to_array(lower(abstract), '[^\\p{{L}}]+') AS w FROM papers),
        s AS (SELECT doc_id, language, l.lang, l.k, len(list_filter(w, lambda x: list_contains(l.own, x))) AS n FROM w CROSS JOIN (VALUES {", ".join(f"('{lang}', {k}, {own})" for k, (lang, own) in enumerate(STOP_WORDS.items()))}) l(lang, k, own)),
        b AS (SELECT doc_id, max(language) AS language, arg_max(lang, n * 100 - k) AS lang, max(n) AS n FROM s GROUP BY doc_id)
        SELECT CASE WHEN doc_id % 2 = 0 THEN language WHEN n > 0 THEN lang END AS language, count(*) AS n FROM b GROUP BY 1""",
    "section_standardize": """WITH x AS (SELECT doc_id, i, line, ['introduction', 'methods', 'results', 'discussion', 'background', '', 'conclusion', 'methods'][(i - 1) % 8 + 1] AS section
        FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))
        SELECT doc_id, section, length(string_agg(line, ' ' ORDER BY i)) AS n_chars, md5(string_agg(line, ' ' ORDER BY i)) AS digest FROM x WHERE section <> '' GROUP BY doc_id, section""",
    "section_set_filter": f"""WITH {PAPERS}, {SECTIONS} SELECT doc_id, sum(length(text))::BIGINT AS full_chars, max(CASE WHEN section = 'methods' THEN length(text) END) AS methods_chars
        FROM secs GROUP BY doc_id HAVING count(*) = 4 AND min(length(text)) >= 250""",
    "section_length_quantiles": f"""WITH {PAPERS}, {SECTIONS}, n AS (SELECT section, {WORDS.format('text')} AS n FROM secs)
        SELECT section, floor(quantile_cont(n, 0.05) + 1e-9)::BIGINT AS p05, floor(quantile_cont(n, 0.5) + 1e-9)::BIGINT AS median, floor(quantile_cont(n, 0.95) + 1e-9)::BIGINT AS p95, min(n) AS least, round(avg(n), 6) AS mean FROM n GROUP BY section""",
    "melt_lengths": f"""WITH {PAPERS}, {SECTIONS} SELECT p.doc_id, t.section, coalesce({WORDS.format('s.text')}, 0)::BIGINT AS n_words
        FROM papers p CROSS JOIN (SELECT unnest(['introduction', 'methods', 'results', 'discussion']) AS section) t LEFT JOIN secs s ON s.doc_id = p.doc_id AND s.section = t.section""",
    "date_normalize": """WITH x AS (SELECT doc_id, 2000 + doc_id % 26 AS y, 1 + doc_id % 12 AS m, 1 + doc_id % 28 AS d,
        ['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'][1 + doc_id % 12] AS s, ['Spring', 'Summer', 'Fall', 'Winter'][1 + doc_id % 4] AS e FROM documents)
        SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN d || '-' || m || '-' || y WHEN 1 THEN s || '-Dec-' || y WHEN 2 THEN e || '-' || y WHEN 3 THEN d || '-' || m || '-' || y || '-November-17' WHEN 4 THEN 'Someday-' || y END AS raw,
        strftime(CASE doc_id % 6 WHEN 0 THEN make_date(y, m, d) WHEN 1 THEN make_date(y, m, 1) WHEN 2 THEN make_date(y, [3, 6, 9, 12][1 + doc_id % 4], 1) WHEN 3 THEN make_date(y, m, d) END, '%Y-%m-%d') AS date FROM x""",
    "token_docfreq": f"WITH {PAPERS}, {POSTINGS} SELECT word, count(*) AS doc_freq FROM postings GROUP BY word",
    "docfreq_floor": f"WITH {PAPERS}, {POSTINGS} SELECT word, count(*) AS doc_freq FROM postings GROUP BY word HAVING count(*) >= 0.05::DOUBLE * (SELECT count(*) FROM papers)",
    "papers_per_month": f"WITH {PAPERS}, {MONTHS} SELECT * FROM months",
    "mean_papers_per_month": f"WITH {PAPERS}, m AS (SELECT count(*) AS n FROM papers GROUP BY year, month) SELECT round(avg(n), 6) AS mean_papers, max(n) AS most FROM m",
    "word_year_freq": f"WITH {BASE}, {WORD_YEAR} SELECT word, year, n, n_papers, {r('freq')} FROM wy",
    "word_month_grid": f"WITH {BASE}, {WORD_MONTH} SELECT word, year, month, n, {r('freq')}, round(year + (month - 1) / 12, 6) AS time FROM wm WHERE year >= 2018",
    "yearly_mean_freq": f"WITH {PAPERS}, {POSTINGS}, {MONTHS}, {MEAN} SELECT word, year, {r('mean_freq')} FROM wmean",
    "lag_projection": f"WITH {PAPERS}, {POSTINGS}, {MONTHS}, {MEAN}, {LAGGED} SELECT word, year, {r('projection')}, {r('ratio')}, {r('gap')} FROM lagged",
    "excess_words": f"WITH {PAPERS}, {POSTINGS}, {MONTHS}, {MEAN}, {LAGGED}, {EXCESS} SELECT word, year, {r('ratio')}, {r('gap')} FROM excess",
    "excess_count_per_year": f"WITH {PAPERS}, {POSTINGS}, {MONTHS}, {MEAN}, {LAGGED}, {EXCESS} SELECT year, count(*) AS n_words FROM excess GROUP BY year",
    "excess_distinct": f"WITH {PAPERS}, {POSTINGS}, {MONTHS}, {MEAN}, {LAGGED}, {EXCESS} SELECT DISTINCT word FROM excess",
    "ratio_filter": f"""WITH {PAPERS}, {POSTINGS}, {MONTHS}, {MEAN}, two AS (SELECT word, max(CASE WHEN year = 2022 THEN mean_freq END) AS a, max(CASE WHEN year = 2024 THEN mean_freq END) AS b FROM wmean GROUP BY word)
        SELECT word, round(b / nullif(a, 0), 6) AS ratio FROM two WHERE round(b / nullif(a, 0), 9) > 1.1""",
    "two_groups_year": f"WITH {BASE}, {groups('years')} SELECT grp, year, n, n_papers, {r('freq')} FROM groups",
    "two_groups_month": f"WITH {BASE}, {groups('months')} SELECT grp, year, month, n, {r('freq')} FROM groups",
    "ols_projection": f"WITH {BASE}, {GROUP_YEAR} SELECT grp, year, {r('freq')}, {r('projection')}, {r('sdev')} FROM proj",
    "gap_ratio_usage": f"WITH {BASE}, {GROUP_YEAR} SELECT grp, year, {r('gap')}, {r('ratio')}, {r('usage')} FROM proj",
    "word_projection": f"""WITH {BASE}, {WORD_YEAR}, {regression('wy', 'word', 'year', END, LENGTH)}
        SELECT word, year, {r('freq')}, {r('projection')}, {r('gap')}, {r('ratio')}, {r('sdev')}, {r('usage')} FROM proj WHERE year >= 2020""",
    "month_projection": f"WITH {BASE}, {GROUP_MONTH} SELECT grp, year, month, {r('projection')}, {r('sdev')}, {r('usage')} FROM proj WHERE year >= 2022",
    "last_usage": f"WITH {BASE}, {GROUP_MONTH} SELECT grp, round(arg_max(usage, i), 6) AS usage FROM proj GROUP BY grp",
    "standard_errors": f"""WITH {BASE}, {WORD_YEAR}, {groups('years')}, both_kinds AS (SELECT word, year, n_papers, freq FROM wy UNION ALL SELECT grp, year, n_papers, freq FROM groups), {regression('both_kinds', 'word', 'year', END, LENGTH)},
        c AS (SELECT word, year, n_papers, sdev, CASE WHEN freq = 1 THEN 0.9999999999999999::DOUBLE ELSE freq END AS q,
            CASE WHEN round(projection, 12) >= 1 THEN 0.9999999999999999::DOUBLE ELSE round(projection, 12) END AS p FROM proj)
        SELECT word, year, {", ".join(f"CASE WHEN {x} >= 0 THEN printf('%.5e', sqrt(greatest({x}, 0))) END AS {f}_{v}" for f in ("usage", "gap") for v in ("binomial", "regression", "both") for x in [variance('p', 'q', 'n_papers', v, f)])} FROM c""",
    "usage_band": f"""WITH {BASE}, {GROUP_YEAR}, c AS (SELECT grp, year, usage, n_papers, sdev, CASE WHEN freq = 1 THEN 0.9999999999999999::DOUBLE ELSE freq END AS q,
            CASE WHEN round(projection, 12) >= 1 THEN 0.9999999999999999::DOUBLE ELSE round(projection, 12) END AS p FROM proj WHERE year >= 2018),
        b AS (SELECT grp, year, usage, {variance('p', 'q', 'n_papers', 'regression', 'usage')} AS v FROM c), e AS (SELECT *, CASE WHEN v >= 0 THEN sqrt(greatest(v, 0)) END AS se FROM b)
        SELECT grp, year, {", ".join(f"CASE WHEN {x} IS NOT NULL THEN printf('%.5e', {x}) END AS {n}" for n, x in (("usage", "usage"), ("low", "usage - se"), ("high", "usage + se")))} FROM e""",
    "low_frequency_month": f"""WITH {BASE}, {WORD_YEAR}, low AS (SELECT word FROM wy WHERE year = 2024 AND round(freq, 9) < {LOW_CUTOFF}), h AS (SELECT DISTINCT doc_id, year, month FROM postings JOIN low USING (word)),
        g AS (SELECT 'low' AS grp, m.year, m.month, m.n_papers, m.year * 12 + m.month - 1 AS i, count(h.doc_id) AS n, (count(h.doc_id) + 1.0::DOUBLE) / (m.n_papers + 1) AS freq
            FROM months m LEFT JOIN h USING (year, month) WHERE m.year * 12 + m.month - 1 <= {LAST * 12 + 9} GROUP BY m.year, m.month, m.n_papers), {regression('g', 'grp', 'i', 2022 * 12 + 10, 60)}
        SELECT year, month, n, {r('freq')}, {r('projection')}, {r('sdev')}, {r('gap')} FROM proj""",
    "common_markers_freq": f"""WITH {PAPERS}, {POSTINGS}, {YEARS} SELECT y.year, count(DISTINCT p.doc_id) AS n, y.n_papers, round((count(DISTINCT p.doc_id) + 1) / (y.n_papers + 1), 6) AS freq
        FROM years y LEFT JOIN (SELECT * FROM postings WHERE word IN ({", ".join(repr(w) for w in COMMON_MARKERS)})) p USING (year) GROUP BY y.year, y.n_papers""",
    "error_band": f"WITH {BASE}, {GROUP_YEAR} SELECT grp, year, round(projection - sdev, 6) + 0.0 AS low, round(projection + sdev, 6) AS high FROM proj WHERE year >= 2018",
    "cutoff_lists": f"WITH {BASE}, {WORD_YEAR}, {F2024}, {CUTS} SELECT cutoff, count(*) AS n_words FROM f2024 JOIN cuts ON freq < cutoff GROUP BY cutoff",
    "cutoff_sweep": f"WITH {BASE}, {WORD_YEAR}, {F2024}, {CUTS}, {SWEEP} SELECT cutoff, year, n, {r('freq')} FROM swept WHERE year >= 2018",
    "sweep_filtered": f"WITH {ALL_CUTS} SELECT cutoff, year, {r('projection')}, {r('gap')}, {r('usage')}, round(freq * (1 - freq) / n_papers, 6) AS binomial_var FROM est",
    "optimal_cutoff": f"WITH {ALL_CUTS}, {BEST} SELECT most_se, year, cutoff, {r('usage')} FROM best",
    "fixed_cutoff": f"WITH {ALL_CUTS}, {BEST} SELECT b.most_se, e.cutoff, e.year, {r('e.usage', 'usage')} FROM est e JOIN best b ON e.step = b.step AND b.year = 2025",
    "chosen_words": f"WITH {ALL_CUTS}, {BEST} SELECT b.most_se, f.word FROM f2024 f JOIN best b ON f.freq < b.cutoff AND b.year = 2025",
    "neighbour_cutoffs": f"""WITH {BASE}, {WORD_YEAR}, {F2024}, {CUTS}, n AS (SELECT step, count(*) AS n_words FROM f2024 JOIN cuts ON freq < cutoff GROUP BY step)
        SELECT cutoff, c.step, lag(cutoff, 1) OVER (ORDER BY c.step) AS lower, lag(cutoff, 2) OVER (ORDER BY c.step) AS second_lower, coalesce(n_words, 0) AS n_words FROM cuts c LEFT JOIN n ON n.step = c.step""",
    "marker_order": f"WITH {BASE}, {WORD_YEAR} SELECT word, {r('freq')} FROM wy WHERE year = 2024",
    "country_freq": f"WITH {BASE}, {COUNTRY} SELECT grp, year, n_papers, n, {r('freq')} FROM cf",
    "country_pivot": f"WITH {BASE}, {COUNTRY} SELECT grp, {', '.join(f'max(CASE WHEN year = {y} THEN round(freq, 6) END) AS y{y}' for y in range(2022, 2026))} FROM cf WHERE year >= 2022 GROUP BY grp",
    "country_compare": f"""WITH {BASE}, {COUNTRY} SELECT a.grp, CASE WHEN a.grp IN ('english', 'NATION_2') THEN 'NES' ELSE 'NNES' END AS side, round(a.freq, 6) AS before, round(b.freq, 6) AS after, round(b.freq - a.freq, 6) + 0.0 AS change
        FROM cf a JOIN cf b ON a.grp = b.grp AND a.year = 2022 AND b.year = 2025""",
    "region_freq": f"""WITH {BASE}, {COUNTRY} SELECT region AS grp, year, count(*) AS n_papers, count(r.doc_id) AS n, round((count(r.doc_id) + 1) / (count(*) + 1), 6) AS freq
        FROM papers LEFT JOIN rare r USING (doc_id) GROUP BY region, year""",
    "discipline_label": f"SELECT DISTINCT {RAW_JOURNAL} AS journal, {LABEL} AS label FROM documents",
    "discipline_freq": f"""WITH {BASE}, {COUNTRY}, l AS (SELECT doc_id, year, {LABEL} AS grp FROM papers)
        SELECT grp, year, count(*) AS n_papers, count(r.doc_id) AS n, round((count(r.doc_id) + 1) / (count(*) + 1), 6) AS freq FROM l LEFT JOIN rare r USING (doc_id)
        WHERE grp IN (SELECT grp FROM l GROUP BY grp HAVING count(*) > 50) GROUP BY grp, year""",
    "discipline_share": f"SELECT round(avg(({LABEL} IS NOT NULL)::INTEGER), 6) AS labelled, count(DISTINCT {LABEL}) AS labels FROM documents",
    "journal_counts": "SELECT source AS journal, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, journal LIMIT 5",
    "journal_other": f"WITH {PAPERS}, {SKEWED}, c AS (SELECT journal, count(*) AS n FROM sk GROUP BY journal) SELECT CASE WHEN n < 100 THEN 'Other' ELSE journal END AS journal, sum(n)::BIGINT AS n FROM c GROUP BY 1",
    "journal_share": f"""WITH {PAPERS}, {SKEWED}, c AS (SELECT year, journal, count(*) AS n, sum(count(*)) OVER (PARTITION BY year) AS t FROM sk GROUP BY year, journal)
        SELECT year, CASE WHEN n * 20 < t THEN 'Other' ELSE journal END AS journal, sum(n)::BIGINT AS n, round(sum(n) / max(t), 6) AS share FROM c GROUP BY 1, 2""",
    "journals_removed": f"WITH {PAPERS}, {PRESENT} SELECT year, key FROM present a WHERE year + 1 IN (SELECT year FROM present) AND NOT EXISTS (SELECT 1 FROM present b WHERE b.year = a.year + 1 AND b.key = a.key)",
    "journals_added": f"WITH {PAPERS}, {PRESENT} SELECT year, key FROM present a WHERE year - 1 IN (SELECT year FROM present) AND NOT EXISTS (SELECT 1 FROM present b WHERE b.year = a.year - 1 AND b.key = a.key)",
    "journals_removed_often": f"""WITH {PAPERS}, c AS (SELECT year, journal || (doc_id % 3) AS key, count(*) AS n FROM papers GROUP BY ALL)
        SELECT year, key FROM c a WHERE n > 1 AND year + 1 IN (SELECT year FROM c) AND NOT EXISTS (SELECT 1 FROM c b WHERE b.year = a.year + 1 AND b.key = a.key)""",
    "journal_names": "SELECT CASE WHEN source IN ('src0', 'src3', 'src6', 'src9', 'src12', 'src15', 'src18') THEN replace(source, 'src', 'Source ') ELSE source END AS journal, count(*) AS n FROM documents GROUP BY 1",
    "journals_per_year": f"WITH {PAPERS} SELECT year, count(DISTINCT journal) AS journals, count(DISTINCT country) AS countries FROM papers GROUP BY year",
    "null_share": f"""WITH {PAPERS}, s AS (SELECT avg((doc_id IS NULL)::INTEGER) AS a, avg((doc_id % 5 = 0 OR country IS NULL)::INTEGER) AS b, avg((doc_id % 3 = 0 OR language IS NULL)::INTEGER) AS c, avg((journal IS NULL)::INTEGER) AS d FROM papers)
        SELECT 'doc_id' AS "column", round(a, 6) AS null_share FROM s UNION ALL SELECT 'country', round(b, 6) FROM s UNION ALL SELECT 'language', round(c, 6) FROM s UNION ALL SELECT 'journal', round(d, 6) FROM s""",
    "dup_ids": "SELECT doc_id % 400 AS id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "lemma_sum": f"WITH {PAPERS}, {POSTINGS}, {RENAMED} SELECT lemma, year, count(*) AS n FROM renamed WHERE length(lemma) >= 4 GROUP BY lemma, year",
    "lemma_union": f"WITH {PAPERS}, {POSTINGS}, {RENAMED} SELECT lemma, year, count(DISTINCT doc_id) AS n FROM renamed WHERE length(lemma) >= 4 GROUP BY lemma, year",
    "delemmatize": f"WITH {BASE}, {RENAMES} SELECT word FROM markers UNION SELECT word FROM lemma WHERE new IN (SELECT word FROM markers)",
    "word_lemmas": f"WITH {PAPERS}, {RENAMES} SELECT word, new, 'lemma' AS kind FROM lemma UNION ALL SELECT word, new, 'spelling' FROM spelling",
    "layout_topk": f"""WITH {PAPERS}, l AS (SELECT article_type, array_to_string(list_sort(['introduction', 'methods', 'results', 'discussion'][:least(len(lines) - (doc_id % 9 = 4)::INTEGER, 4)]), '|') AS layout FROM papers)
        SELECT article_type, layout, count(*) AS n FROM l GROUP BY ALL ORDER BY n DESC, article_type, layout LIMIT 5""",
    "title_counts": """WITH x AS (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
        SELECT ['introduction', 'methods', 'results and analysis', 'discussion', 'related work', 'funding', 'summary and outlook', 'materials and methods'][(i - 1) % 8 + 1] AS title,
        ['introduction', 'methods', 'results', 'discussion', 'background', '', 'conclusion', 'methods'][(i - 1) % 8 + 1] AS section, count(*) AS n FROM x GROUP BY 1, 2""",
    "substring_probe": f"WITH {PAPERS} SELECT year, count_if(contains(lower(abstract), 'tion the'))::BIGINT AS n FROM papers GROUP BY year",
    "crop_words": f"""WITH {PAPERS}, w AS (SELECT doc_id, abstract, list_filter(regexp_split_to_array(abstract, '\\s+'), lambda x: x <> '') AS w FROM papers),
        s AS (SELECT *, ('0x' || substr(md5(doc_id || ':0'), 1, 15))::BIGINT % greatest(len(w) - 49, 1) + 1 AS place FROM w),
        c AS (SELECT doc_id, abstract, w, CASE WHEN len(w) <= 50 THEN abstract ELSE array_to_string(w[place:place + 49], ' ') END AS c FROM s)
        SELECT doc_id, least(len(w), 50)::BIGINT AS n_words, len(w) <= 50 OR contains(array_to_string(w, ' '), c) AS contained, md5(c) AS digest FROM c""",
    "sample_words": f"""WITH {PAPERS}, w AS (SELECT doc_id, abstract, list_filter(regexp_split_to_array(abstract, '\\s+'), lambda x: x <> '') AS w FROM papers),
        s AS (SELECT doc_id, abstract, w, list_sort(list_transform(range(1, len(w) + 1), lambda i: struct_pack(h := md5(doc_id || ':' || (i - 1) || ':0'), w := w[i])))[1:50] AS s FROM w)
        SELECT doc_id, least(len(w), 50)::BIGINT AS n_words, md5(CASE WHEN len(w) <= 50 THEN abstract ELSE array_to_string(list_transform(s, lambda x: x.w), ' ') END) AS digest FROM s""",
    "floor_year_mean": f"WITH {BASE}, {WORD_MONTH} SELECT word, year, round(avg(freq), 6) + 0.0 AS freq FROM wm GROUP BY word, year",
    "aligned_counts": f"WITH {PAPERS}, {POSTINGS} SELECT word, count_if(year < 2013)::BIGINT AS left_n, count_if(year >= 2013)::BIGINT AS right_n FROM postings GROUP BY word",
    "lemma_sweep": f"WITH {LEMMA_SWEEP} SELECT cutoff, year, n, {r('freq')} FROM swept WHERE year >= 2018",
    "lemma_usage": f"""WITH {LEMMA_SWEEP}, {regression('swept', 'cutoff, step', 'year', END, LENGTH)}, x AS (SELECT *, max(projection) OVER (PARTITION BY step) AS top FROM proj)
        SELECT cutoff, year, {r('projection')}, {r('gap')}, {r('usage')} FROM x WHERE top < 0.95""",
    "section_year_freq": f"WITH {BY_SECTION} SELECT section, list_position(['introduction', 'methods', 'results', 'discussion', 'full'], section)::INTEGER AS place, word, year, n, n_papers, {r('freq')} FROM sf",
    "section_projection": f"WITH {BY_SECTION}, {regression('sf', 'section, word', 'year', END, LENGTH)} SELECT section, word, year, {r('projection')}, {r('sdev')}, {r('gap')}, {r('ratio')} FROM proj WHERE year >= 2023",
    "section_sweep": f"WITH {SECTION_SWEEP} SELECT section, cutoff, year, n, {r('freq')} FROM swept WHERE year >= 2018",
    "section_optimum": f"WITH {SECTION_BEST} SELECT most_se, section, year, cutoff, {r('usage')}, {r('se')} FROM best",
    "subopt_lists": f"""WITH {SECTION_BEST} SELECT b.section, k.kind, c.cutoff, f.word FROM best b CROSS JOIN (VALUES ('opt', 0), ('subopt', 1), ('subsubopt', 2)) k(kind, down)
        JOIN cuts c ON c.step = b.step - k.down JOIN sf f ON f.section = b.section AND f.year = 2024 AND f.freq < c.cutoff WHERE b.year = 2025 AND b.most_se = {MOST_SE[1]}""",
    "xml_records": rf"""WITH {MADE}
        SELECT doc_id, 'research-article' AS article_type, 'en' AS language, coalesce(source, 'none') AS journal, CASE WHEN doc_id % 2 = 0 THEN (doc_id + 7)::VARCHAR END AS pmid,
            'A  title  of ' || doc_id AS title, [{", ".join("NULL" if c is None else repr(c) for c in COUNTRIES_OF_ADDRESSES)}][doc_id % {len(ADDRESSES)} + 1] AS country,
            CASE WHEN doc_id % 5 = 0 THEN '' ELSE '3-4-' END || (2000 + doc_id % 26) AS date, 'yes ' || doc_id AS abstract,
            CASE WHEN bare THEN '' ELSE array_to_string(list_filter([CASE WHEN untitled AND i = 2 THEN NULL ELSE {TITLE_OF_LINE} END for i in range(1, m + 1)] || [CASE WHEN doc_id % 3 = 0 AND NOT untitled THEN 'Introduction' END], lambda x: x IS NOT NULL), '|') END AS titles,
            {CHARS} AS section_chars
        FROM n""",
    "xml_ingest": f"""WITH {MADE}, f AS (SELECT doc_id, 's' || (doc_id % 8) AS segment, {CHARS} AS c FROM n), twice AS (SELECT * FROM f UNION ALL SELECT * FROM f WHERE doc_id % 24 = 1)
        SELECT segment, count(*) AS n_papers, count(DISTINCT doc_id) AS n_ids, sum(c)::BIGINT AS section_chars, (SELECT count(*) FROM f) AS read_1, 0::BIGINT AS read_2, (SELECT count(*) FROM twice WHERE segment = 's1') AS read_3
        FROM twice GROUP BY segment""",
    "upsert_by_key": f"""WITH {PAPERS}, a AS (SELECT doc_id, year, journal, 1::INTEGER AS load FROM papers WHERE doc_id % 3 <> 0)
        SELECT * FROM a UNION ALL SELECT doc_id, year, journal || 'x', 2::INTEGER FROM papers WHERE year >= 2020 AND doc_id NOT IN (SELECT doc_id FROM a)""",
    "language_profiles": f"WITH {PAPERS}, {LANGUAGES} SELECT language, gram, place FROM known",
    "language_detected": f"WITH {PAPERS}, {LANGUAGES} SELECT doc_id, lang AS language, told_by, distance FROM detected",
    "funnel_language": f"""WITH {PAPERS}, {LANGUAGES}, s AS (SELECT u.doc_id, article_type IN ('research-article', 'review-article', 'case-report') AS a, u.doc_id % 9 <> 4 AS b, length(abstract) >= 250 AS c,
            coalesce(language, lang) = 'en' AS d, language IS NULL AND lang IS NULL AS failed FROM undeclared u LEFT JOIN detected USING (doc_id))
        SELECT count(*) AS before_prep, count_if(a)::BIGINT AS after_article_type, count_if(a AND b)::BIGINT AS after_sections, count_if(a AND b AND c)::BIGINT AS after_abstract, count_if(a AND b AND c AND failed)::BIGINT AS language_failures,
        count_if(a AND b AND c AND d)::BIGINT AS after_language, count_if(a AND b AND c AND d)::BIGINT AS after_date FROM s""",
    "matrix_counts": f"WITH {PAPERS}, {POSTINGS} SELECT word, count(*) AS doc_freq FROM postings GROUP BY word",
    "matrix_rows": f"""WITH {PAPERS}, {POSTINGS}, v AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS i FROM (SELECT DISTINCT word FROM postings)),
        x AS (SELECT doc_id, count(*)::INTEGER AS n, min(i) AS a, max(i) AS b, sum(i)::BIGINT AS s FROM postings JOIN v USING (word) GROUP BY doc_id)
        SELECT p.doc_id, row_number() OVER (ORDER BY p.doc_id) - 1 AS row, coalesce(n, 0)::INTEGER AS n_words, a AS first_id, b AS last_id, coalesce(s, 0) AS id_sum FROM papers p LEFT JOIN x USING (doc_id)""",
    "frequent_words": f"WITH {PAPERS}, {POSTINGS} SELECT word, count(*) AS doc_freq FROM postings GROUP BY word HAVING count(*) >= {FLOOR}::DOUBLE * (SELECT count(*) FROM papers)",
    "published_floor": f"WITH {PAPERS}, {POSTINGS} SELECT word, count(*) AS doc_freq FROM postings GROUP BY word HAVING count(*) >= {PUBLISHED_FLOOR}::DOUBLE * (SELECT count(*) FROM papers)",
    "section_length_ranks": f"""WITH {PAPERS}, {SECTIONS}, n AS (SELECT section, {WORDS.format('text')} AS n FROM secs)
        SELECT section, floor(quantile_cont(n, 0.05) + 1e-9)::BIGINT AS p05, floor(quantile_cont(n, 0.5) + 1e-9)::BIGINT AS median, floor(quantile_cont(n, 0.95) + 1e-9)::BIGINT AS p95 FROM n GROUP BY section""",
    "section_docfreq": f"""WITH {BY_SECTION}, n AS (SELECT p.section, avg(coalesce(k, 0)) AS mean FROM parts p LEFT JOIN (SELECT doc_id, section, count(*) AS k FROM sp GROUP BY ALL) c USING (doc_id, section) GROUP BY p.section)
        SELECT section, word, count(*) AS n FROM sp WHERE year >= 2018 AND section IN (SELECT section FROM n WHERE mean < (SELECT max(mean) FROM n)) GROUP BY section, word""",
    "literature_overlay": f"""WITH {BASE}, {GROUP_MONTH}, r AS (SELECT make_date(year, month, 1) AS date, grp AS section, usage FROM proj WHERE year >= 2022),
        e AS (SELECT (date_trunc('day', ts) + to_months((event_id % 36 - 12)::INTEGER))::DATE AS date, CASE WHEN event_id % 2 = 0 THEN 'common' ELSE 'rare' END AS section, value, event_type AS mode FROM events),
        m AS (SELECT r.section, r.date, e.mode, e.value, r.usage, (year(r.date) - year(e.date)) * 12 + month(r.date) - month(e.date) AS whole, day(r.date) - day(e.date) AS days,
            day(r.date) = day(last_day(r.date)) AND day(e.date) = day(last_day(e.date)) AS ends FROM r JOIN e ON r.section = e.section)
        SELECT section, strftime(date, '%Y-%m') AS month, mode, count(*) AS n, {r('avg(value)', 'mean_estimate')}, {r('max(usage)', 'usage')} FROM m
        WHERE abs(whole + CASE WHEN ends THEN 0 ELSE days / 31.0::DOUBLE END) <= 6 GROUP BY section, date, mode""",
    "excess_labels": f"""WITH {PAPERS}, {POSTINGS}, {MONTHS}, {MEAN}, {LAGGED}, x AS (SELECT word, freq, least(round(ratio, 9), 90) AS ratio, least(round(gap, 9), 0.049) AS gap, round(freq, 9) AS f FROM lagged
            WHERE year = 2024 AND word NOT IN ({", ".join(repr(w) for w in IGNORED_WORDS)}) AND round(freq, 9) >= 0.001)
        SELECT word, {r('freq')}, {r('ratio')}, {r('gap')}, coalesce(log10(ratio) > log10(2.2) - (log10(f) + 4) * log10(2) / 4, false) AS by_ratio, coalesce(gap > 0.011, false) AS by_gap FROM x""",
    "country_precise": f"""WITH {BASE}, {HEADS}, {COUNTRY.replace("FROM postings p JOIN markers m USING (word) WHERE m.grp", "FROM hp p WHERE p.grp").replace("FROM papers", "FROM pp")}, {regression('cf', 'grp', 'year', POOLED, POOLED)},
        s AS (SELECT grp, n_papers, usage, sqrt({variance("(CASE WHEN projection >= 1 THEN 0.9999999999999999::DOUBLE ELSE projection END)", "(CASE WHEN freq = 1 THEN 0.9999999999999999::DOUBLE ELSE freq END)", "n_papers", "regression", "usage")}) AS se FROM proj WHERE year = {POOLED})
        SELECT most_se, grp, n_papers, {r('usage')}, {r('se')} FROM s CROSS JOIN (VALUES {", ".join(f"({x}::DOUBLE)" for x in MOST_COUNTRY_SE)}) l(most_se) WHERE round(se, 9) < most_se""",
    "preprint_share": f"""WITH {PAPERS} SELECT year, count(*) AS n_papers, count_if(coalesce(journal IN ('src1', 'src2', 'src4', 'src5'), false))::BIGINT AS n,
        round(count_if(coalesce(journal IN ('src1', 'src2', 'src4', 'src5'), false)) / count(*), 6) AS share FROM papers GROUP BY year""",
    "papers_by_type": f"""WITH {PAPERS}, p AS (SELECT * FROM papers WHERE year * 12 + month >= 2020 * 12 + 11) SELECT year, count(*) AS n, 'all' AS kind FROM p GROUP BY year
        UNION ALL SELECT year, count(*), 'review-article' FROM p WHERE article_type = 'review-article' GROUP BY year""",
    "section_month_projection": "WITH " + BY_SECTION.replace("SELECT doc_id, year, section", "SELECT doc_id, year, month, section").replace("SELECT doc_id, year, 'full'", "SELECT doc_id, year, month, 'full'").replace("GROUP BY doc_id, year)", "GROUP BY doc_id, year, month)").replace("SELECT doc_id, year, i,", "SELECT doc_id, year, month, i,") + f""",
        i AS (SELECT unnest(range({2022 * 12 + 10 - 60}, {LAST * 12 + 12})) AS i),
        mn AS (SELECT section, year * 12 + month - 1 AS i, count(*) AS n_papers FROM parts GROUP BY ALL), mc AS (SELECT section, word, year * 12 + month - 1 AS i, count(*) AS n FROM sm GROUP BY ALL),
        grid AS (SELECT k.section, k.word, i.i, (coalesce(c.n, 0) + 1.0::DOUBLE) / (coalesce(m.n_papers, 0) + 1) AS freq FROM (SELECT DISTINCT section, word FROM mc WHERE i >= {2022 * 12 + 10 - 60}) k CROSS JOIN i
            LEFT JOIN mc c ON c.section = k.section AND c.word = k.word AND c.i = i.i LEFT JOIN mn m ON m.section = k.section AND m.i = i.i)""" + "".join(
        f""", p{k} AS (WITH {regression('grid', 'section, word', 'i', 2022 * 12 + 10, k)} SELECT {k}::INTEGER AS months, section, word, (i % 12 + 1)::INTEGER AS month, {r('freq')}, {r('projection')}, {r('sdev')}, {r('gap')} FROM proj WHERE i >= {LAST * 12})""" for k in (24, 60)
    ) + " SELECT * FROM p24 UNION ALL SELECT * FROM p60",
    "listed_sweep": f"WITH {BASE}, {WORD_YEAR}, f2024 AS (SELECT word, freq FROM wy JOIN markers USING (word) WHERE year = 2024 AND grp = 'common'), {CUTS}, {SWEEP} SELECT cutoff, year, n, {r('freq')} FROM swept WHERE year >= 2018",
    "pooled_errors": f"""WITH {POOLED_SWEEP} SELECT cutoff, {r('freq')}, {r('projection')}, {r('usage')}, {r('se')}, bad IS NULL OR step < bad AS "within" FROM pe""",
    "pooled_optimum": f"""WITH {POOLED_SWEEP} SELECT cutoff, {r('usage')}, {r('se')} FROM pe WHERE bad IS NULL OR step < bad ORDER BY round(usage, 9) DESC, step LIMIT 1""",
    "html_titles": r"""SELECT page_id, nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '[ \t\r\n]+', ' ', 'g')), '') AS title FROM pages""",
}
ORACLES["funnel_transposed"] = f"WITH f AS ({ORACLES['corpus_funnel']}) " + " UNION ALL ".join(f"SELECT '{k}' AS measure, {k} AS value FROM f" for k in _STAGES)


def _in_two_steps(sql: str) -> str:
    """round(x, 6) as the queries do it: to nine digits, off the edge, then to six."""
    out, at = "", 0
    while (start := sql.find("round(", at)) >= 0:
        depth, end = 1, start + len("round(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[start + len("round(") : end - 1]
        if inner.endswith(", 6"):
            out += f"{sql[at:start]}round(round({_in_two_steps(inner[:-3])}, 9) + 1e-10, 6)"
        else:
            out += f"{sql[at:start]}round({_in_two_steps(inner)})"
        at = end
    return out + sql[at:]


ORACLES = {name: _in_two_steps(sql) for name, sql in ORACLES.items()}
