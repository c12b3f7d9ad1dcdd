"""Readers and writers of papers, and the papers that the driver's documents stand for."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import standard_sections, tokens
from ..operators.lemmas import changed_words, lemma_table, lemmatised, spelling_table

FIRST_YEAR, YEARS = 2000, 26
TITLES = ["introduction", "methods", "results", "discussion"]

RAW = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("article-type", "language", "journal", "pmc-id", "pmid", "title", "country", "date", "abstract")]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("section_titles", "sections")]
)
CLEAN = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("article-type", "language", "journal", "pmc-id", "pmid", "title", "country")]
    + [T.StructField("date", T.DateType()), T.StructField("abstract", T.StringType()), T.StructField("sections", T.MapType(T.StringType(), T.StringType()))]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Raw paper records, one JSON object a line, with a declared schema."""
    return spark.read.schema(RAW).json(path)


def write_papers(papers: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by year; the table is the union of all years. mode `ignore` keeps a table that is there."""
    papers.withColumn("year", F.year("date")).write.mode(mode).partitionBy("year").parquet(path)


def read_papers(spark: SparkSession, path: str, years: list[int] | None = None) -> DataFrame:
    """The papers of all or of some years; years that aren't asked for aren't read."""
    papers = spark.read.parquet(path)
    return papers.where(F.col("year").isin(years)) if years else papers


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def read_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_word_table(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a text file with a word a line, or of a folder of such files: published marker words and the like. Blank lines and repeats go."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def write_metadata(spark: SparkSession, path: str, **parameters) -> None:
    """The parameters of a run as a JSON file beside its tables."""
    import json

    spark.createDataFrame([(json.dumps(parameters, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


#: Schemas of the tables that were read in this process, by path: their files needn't be looked into again.
_schemas: dict[str, T.StructType] = {}


def compute_or_load(spark: SparkSession, folder: str, name: str, parameters: dict, make, by: tuple[str, ...] = ()) -> DataFrame:
    """A result kept as a table under a hash of its parameters: computed once, then read. Other parameters are another table. by: what it is partitioned by."""
    import hashlib
    import json

    path = f"{folder}/{name}-{hashlib.sha256(json.dumps(parameters, sort_keys=True).encode()).hexdigest()[:16]}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        rows = make()
        (rows.hint("rebalance", *by).write.partitionBy(*by) if by else rows.write).mode("overwrite").parquet(path)
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def partitions_of(spark: SparkSession, path: str, key: str) -> list[str]:
    """The values of a partitioned table's first key, by its directories: nothing is read."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory()]
    unescape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    return sorted(unescape(n.removeprefix(f"{key}=")) for n in names if n.startswith(f"{key}="))


def baseline_packages(names: DataFrame, suffix: str = "tar.gz") -> DataFrame:
    """Of listed file names (name), the baseline packages and their dates; with .csv or .txt, the file lists beside them."""
    rows = names.where(F.contains("name", F.lit("baseline")) & F.col("name").endswith(suffix))
    return rows.withColumn("baseline_date", F.nullif(F.regexp_extract("name", r"\d{4}-\d{2}-\d{2}", 0), F.lit("")))


def read_metadata(spark: SparkSession, path: str) -> dict:
    """The parameters that write_metadata() kept."""
    import json

    return json.loads(spark.read.text(path).first()[0])


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without, and gets one of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, for as long as the driver runs."""
    import uuid

    path = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialised(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _stamp(spark: SparkSession, path: str) -> list[str]:
    """Name, length and time of the files of a table: other files are other data."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f"{x.getPath()} {x.getLen()} {x.getModificationTime()}" for x in fs.listStatus(at))


def kept(spark: SparkSession, sf_dir: str, name: str, make, by: tuple[str, ...] = ()) -> DataFrame:
    """A table that all queries of a session share, kept in its shared folder as long as its driver runs; partitioned by the columns in `by`."""
    folder = f"{shared_folder(spark)}/corpus"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return compute_or_load(spark, folder, name, {t: _stamp(spark, f"{sf_dir}/{t}.parquet") for t in ("documents", "nation", "region")}, make, by)


def tokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The papers without their texts, with the distinct words of the abstract, and those of two and three letters as `short`. Texts are split once, for all queries
    of a session."""

    def make() -> DataFrame:
        p = papers(spark, sf_dir).select("doc_id", "year", "month", "article_type", "country", "region", "journal", tokens(F.col("abstract"), 2).alias("all"))
        return p.select(*[c for c in p.columns if c != "all"], F.filter("all", lambda w: F.length(w) >= 4).alias("words"), F.filter("all", lambda w: F.length(w) < 4).alias("short"))

    return kept(spark, sf_dir, "tokens", make)


def head_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The papers with the distinct words of their first line, as tokenised() has those of the whole abstract."""

    def make() -> DataFrame:
        return papers(spark, sf_dir).select("doc_id", "year", "month", "country", tokens(F.get("sections", F.lit(0))).alias("words"))

    return kept(spark, sf_dir, "heads", make)


def section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, year, month, section, words) of each section of each paper, and of all of them joined in their order, as `full`."""

    def make() -> DataFrame:
        p = papers(spark, sf_dir).withColumn("m", standard_sections(F.col("section_titles"), F.col("sections"))).where(F.size("m") > 0)
        full = F.concat(*[F.coalesce(F.element_at("m", t), F.lit("")) for t in TITLES])
        p = p.select("doc_id", "year", "month", F.explode(F.map_concat("m", F.create_map(F.lit("full"), full))).alias("section", "text"))
        return p.select("doc_id", "year", "month", "section", tokens(F.col("text")).alias("words"))

    return kept(spark, sf_dir, "sections", make)


def section_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """section_tokens() as a table partitioned by section and year, of which queries read the directories that they ask for."""
    return kept(spark, sf_dir, "parts", lambda: section_tokens(spark, sf_dir), ("section", "year"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, doc_freq) of all words of two letters and more, which may be base forms of longer ones."""

    def make() -> DataFrame:
        rows = tokenised(spark, sf_dir).select(F.explode(F.concat("words", "short")).alias("word"))
        return rows.groupBy("word").agg(F.count(F.lit(1)).alias("doc_freq"))

    return kept(spark, sf_dir, "vocabulary", make)


def renames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(word, new) of the corpus's words of four letters and more: American spellings, and lemmas. Found once for all queries of a session."""
    known = vocabulary(spark, sf_dir)
    words = known.where(F.length("word") >= 4)
    return kept(spark, sf_dir, "spellings", lambda: spelling_table(words, known)), kept(spark, sf_dir, "lemmas", lambda: lemma_table(words, known))


def lemma_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, year, words) of the papers, with the distinct lemmas of their words of four letters and more. Words are renamed once, for all queries of a session."""

    def make() -> DataFrame:
        changed = kept(spark, sf_dir, "changed", lambda: changed_words(*renames(spark, sf_dir)))
        return lemmatised(tokenised(spark, sf_dir), changed, "year")

    return kept(spark, sf_dir, "lemmatised", make)


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as papers: dates, types, countries and section titles follow from doc_id, sections are the text's lines in turn.
    Some papers have a title less than they have sections.

    doc_id, year, month, date, article_type, country, region, journal, language, abstract, section_titles, sections.
    """
    docs = table(spark, sf_dir, "documents")
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    places = places.select(F.col("n_nationkey").cast("long").alias("_n"), F.col("n_name").alias("country"), F.col("r_name").alias("region"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    titles = F.transform(lines, lambda _, i: F.element_at(F.array(*[F.lit(x) for x in TITLES]), (i % 4 + 1).cast("int")))
    k = F.col("doc_id")
    out = docs.select(
        "doc_id",
        (F.lit(FIRST_YEAR) + k % YEARS).cast("int").alias("year"),
        (1 + F.floor(k / YEARS) % 12).cast("int").alias("month"),
        F.element_at(F.array(*[F.lit(x) for x in ("research-article", "review-article", "case-report", "editorial")]), (k % 4 + 1).cast("int")).alias("article_type"),
        F.col("source").alias("journal"),
        F.col("lang").alias("language"),
        F.col("text").alias("abstract"),
        F.slice(titles, F.lit(1), F.size(lines) - F.when(k % 9 == 4, 1).otherwise(0)).alias("section_titles"),
        lines.alias("sections"),
        (k % 25).alias("_n"),
    )
    return out.withColumn("date", F.make_date("year", "month", F.lit(1))).join(F.broadcast(places), "_n", "left").drop("_n")
