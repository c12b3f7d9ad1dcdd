import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexdrift.operators import cleaning
from lexdrift.sources import ingest
from lexdrift.sources.xml import parse_articles

COUNTRIES = {"DEU": "Germany"}


def article(k, title="A title"):
    return f'<article article-type="research-article"><front><article-meta><article-id pub-id-type="pmc">{k}</article-id><title-group><article-title>{title}</article-title></title-group></article-meta></front></article>'


@pytest.fixture
def folder(tmp_path):
    for k in range(6):
        at = tmp_path / "in" / f"PMC00{k % 3}xxxxxx"
        at.mkdir(parents=True, exist_ok=True)
        (at / f"PMC100000{k}.xml").write_text(article(k))
    (tmp_path / "in" / "PMC000xxxxxx" / "readme.xml").write_text("<a/>")
    return tmp_path


def run(spark, folder, **options):
    return ingest.ingest(spark, str(folder / "in"), str(folder / "out"), lambda files: parse_articles(files, COUNTRIES, ("segment",)), **options)


def ids(spark, folder):
    return sorted((r["segment"], r["pmc-id"], r["title"]) for r in spark.read.parquet(str(folder / "out")).collect())


def files(folder, name="out"):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in (folder / name).rglob("*.parquet")}


def test_only_what_changed_is_read(spark, folder):
    assert run(spark, folder) == {"segments": 3, "files": 6, "gone": 0}
    assert [k for _, k, _ in ids(spark, folder)] == ["0", "3", "1", "4", "2", "5"]
    before = files(folder) | files(folder, "out.manifest")
    assert run(spark, folder) == {"segments": 0, "files": 0, "gone": 0}
    assert files(folder) | files(folder, "out.manifest") == before
    # a file that changed, and one that is new
    time.sleep(0.01)
    changed = folder / "in" / "PMC001xxxxxx" / "PMC1000001.xml"
    changed.write_text(article(1, "Another title"))
    (folder / "in" / "PMC001xxxxxx" / "PMC1000007.xml").write_text(article(7))
    assert run(spark, folder) == {"segments": 1, "files": 3, "gone": 0}
    assert [x for x in ids(spark, folder) if x[0] == "PMC001xxxxxx"] == [("PMC001xxxxxx", "1", "Another title"), ("PMC001xxxxxx", "4", "A title"), ("PMC001xxxxxx", "7", "A title")]
    after = files(folder)
    assert {p: t for p, t in after.items() if "PMC001" not in p} == {p: t for p, t in before.items() if "PMC001" not in p and p.startswith("out/")}
    assert run(spark, folder) == {"segments": 0, "files": 0, "gone": 0}


def test_replace_reads_all_again(spark, folder):
    run(spark, folder)
    assert run(spark, folder, replace=True) == {"segments": 3, "files": 6, "gone": 0}
    assert len(ids(spark, folder)) == 6


def test_what_is_gone_goes(spark, folder):
    run(spark, folder)
    os.remove(folder / "in" / "PMC000xxxxxx" / "PMC1000000.xml")
    for p in (folder / "in" / "PMC002xxxxxx").iterdir():
        p.unlink()
    assert run(spark, folder) == {"segments": 1, "files": 1, "gone": 1}
    assert [k for _, k, _ in ids(spark, folder)] == ["3", "1", "4"]
    assert run(spark, folder) == {"segments": 0, "files": 0, "gone": 0}


def test_a_failure_is_made_good(spark, folder):
    """The manifest is written last, so a segment whose parsing failed is read by the next run."""

    def fails(files):
        return parse_articles(files, COUNTRIES, ("segment",)).withColumn("title", F.when(F.raise_error(F.lit("lost")).isNull(), "x"))

    with pytest.raises(Exception, match="lost"):
        ingest.ingest(spark, str(folder / "in"), str(folder / "out"), fails)
    assert run(spark, folder)["files"] == 6
    assert len(ids(spark, folder)) == 6


def test_listing_opens_no_file(spark, folder):
    plan = ingest.listing(spark, str(folder / "in"))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    assert {(r.segment, r.length) for r in ingest.listing(spark, str(folder / "in")).collect()} == {(f"PMC00{k}xxxxxx", len(article(0))) for k in range(3)}


def load(spark, rows):
    return spark.createDataFrame(rows, "pmc_id long, year int, load int, other string")


def kept(spark, path):
    return sorted(map(tuple, ingest.merged(spark, path).select("pmc_id", "year", "load", "other").collect()), key=str)


def test_upsert_equals_the_whole_merge(spark, tmp_path):
    path = str(tmp_path / "papers")
    first = [(k, 2000 + k % 4, 1, "x") for k in range(60)] + [(None, 2000, 1, "a"), (None, 2000, 1, "b")]
    assert ingest.upsert(spark, path, load(spark, first), "pmc_id", "year", buckets=4) > 4
    times = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    second = [(k, 2002, 2, "y") for k in range(0, 90, 2)] + [(7, 2002, 2, "y"), (7, 2002, 2, "y")]
    ingest.upsert(spark, path, load(spark, second), "pmc_id", "year", F.col("other"), buckets=4)
    there = {(k, y) for k, y, _, _ in first}
    want = first + [r for r in dict.fromkeys(second) if r[:2] not in there]
    assert kept(spark, path) == sorted(want, key=str)
    # the same as one merge of everything
    whole = cleaning.keep_first(load(spark, first + second).where("pmc_id is not null").withColumn("k", F.struct("pmc_id", "year")), "k", "load", "other").drop("k")
    assert [r for r in kept(spark, path) if r[0] is not None] == sorted(map(tuple, whole.collect()), key=str)
    assert all(p.exists() and p.stat().st_mtime_ns == t for p, t in times.items() if "year=2002" not in str(p))


def test_the_newest_may_win_and_buckets_stay(spark, tmp_path):
    path = str(tmp_path / "papers")
    ingest.upsert(spark, path, load(spark, [(k, 2000, 1, "x") for k in range(50)]), "pmc_id", "year", buckets=8)
    times = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    assert ingest.upsert(spark, path, load(spark, [(3, 2000, 2, "y")]), "pmc_id", "year", buckets=8, newest=True) == 1
    assert [r for r in kept(spark, path) if r[2] == 2] == [(3, 2000, 2, "y")] and len(kept(spark, path)) == 50
    assert sum(p.exists() and p.stat().st_mtime_ns == t for p, t in times.items()) >= len(times) - 2
    assert ingest.upsert(spark, path, load(spark, []), "pmc_id", "year", buckets=8) == 0


def test_parts_without_new_rows_are_not_read(spark, tmp_path):
    path = str(tmp_path / "papers")
    ingest.upsert(spark, path, load(spark, [(k, 2000 + k % 5, 1, "x") for k in range(50)]), "pmc_id", "year", buckets=2)
    scan = spark.read.parquet(path).where((F.col("year") == 2003) & (F.col("bucket") == 1))
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "(year" in plan.split("PartitionFilters")[1][:200]




def test_many_small_files_make_few_tasks(spark, tmp_path, monkeypatch):
    """Files are looked at once a run, in a bounded number of tasks; more bytes make more tasks."""
    for k in range(150):
        folder = tmp_path / "in" / f"s{k % 2}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"PMC{1000000 + k}.xml").write_text("x" * 100)
    monkeypatch.setattr(ingest, "DEALT", 1)
    cores = spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))
    try:
        seen, looked = [], []
        own = ingest.listing
        monkeypatch.setattr(ingest, "listing", lambda *a: looked.append(a) or own(*a))

        def parse(files):
            seen.append(files.rdd.getNumPartitions())
            return files.select("segment", F.length("content").alias("n"))

        assert ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), parse)["files"] == 150
        assert len(looked) == 1 and seen == [cores] and spark.read.parquet(str(tmp_path / "out")).count() == 150
        monkeypatch.setattr(ingest, "TASK_BYTES", 500)
        ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "again"), parse)
        assert seen[1] == 30
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def landed(top):
    return sorted((p.parent.name, p.read_bytes().rstrip(b"\n")) for p in top.rglob("part-*.txt"))


def test_local_files_are_landed_by_the_tasks(spark, tmp_path):
    """A file for each row and nothing beside it, none lost when more come; another store gets the same from Spark's writer."""
    rows = [(f"s{k % 3}", bytearray(f"row {k % 20}".encode())) for k in range(50)] + [("s0", bytearray("\u00e9 \U0001f600\nx".encode())), (None, bytearray(b"lost"))]
    files = spark.createDataFrame(rows, "segment string, content binary").repartition(3)
    want = sorted(("segment=" + (s or ingest.NONE), bytes(c)) for s, c in rows)
    for top in (tmp_path / "a b%20c", tmp_path / "plain"):
        ingest.land(files, top.as_uri() if top.name != "plain" else str(top))
        assert landed(top) == want and len([p for p in top.rglob("*") if p.is_file()]) == len(rows)
        ingest.land(files, top.as_uri() if top.name != "plain" else str(top))
        assert landed(top) == sorted(want * 2)
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.landing.link./in", tmp_path.as_uri())
    ingest.land(files, "viewfs://landing/in/other")
    assert landed(tmp_path / "other") == want


def test_the_query_lands_articles_without_checksums(spark, small, tmp_path, monkeypatch):
    """Hadoop's local writer makes a checksum beside each file, and a process for the permissions of either."""
    from lexdrift.plans import queries

    paths = iter([(tmp_path / "in").as_uri(), (tmp_path / "out").as_uri()])
    monkeypatch.setattr(queries, "scratch", lambda spark: next(paths))
    rows = queries.QUERIES["xml_ingest"](spark, small).collect()
    files = [p.name for p in (tmp_path / "in").rglob("*") if p.is_file()]
    assert len(files) == sum(r.n_papers for r in rows) and all(n.startswith("part-") for n in files)


def test_files_are_listed_once_if_all_are_due(spark, folder, monkeypatch):
    from pyspark.sql.readwriter import DataFrameReader

    loads, own = [], DataFrameReader.load
    monkeypatch.setattr(DataFrameReader, "load", lambda self, path=None, *a, **k: loads.append(path) or own(self, path, *a, **k))
    assert run(spark, folder)["files"] == 6 and len(loads) == 1
    (folder / "in" / "PMC001xxxxxx" / "PMC1000007.xml").write_text(article(7))
    assert run(spark, folder) == {"segments": 1, "files": 3, "gone": 0}
    # of the others no file is opened
    assert len(loads) == 3 and [p.rsplit("/", 1)[-1] for p in loads[2]] == ["PMC001xxxxxx"]
