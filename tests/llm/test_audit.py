import re
from itertools import permutations

import duckdb
import pytest
from helpers import documents, empty

from lexdrift.llm import audit


def by_definition(docs, labels):
    """Every order, every step, document by document."""
    texts = [(d, t or "", p or "") for d, t, p in docs]
    fails = []
    for d, t, _ in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t)}
        f["E"] = d is not None and any(e is not None and e < d and u == t for e, u, _ in texts)
        fails.append({k for k, v in f.items() if v})
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    out = {}
    for part in {p for _, _, p in texts}:
        own = [k for k, (_, _, p) in enumerate(texts) if p == part]
        removed = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = set(own)
            for step, f in enumerate(order, 1):
                gone = {k for k in left if f in fails[k]}
                redundant = sum(f in fails[k] for k in own if k not in left)
                left -= gone
                removed[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(fails[k] == {f} for k in own), sum(texts[k][0] in good for k in gone), sum(texts[k][0] in toxic for k in gone), f]
        for key in out:
            if key[0] == part:
                out[key][-1] = removed[out[key][-1]]
    return {k: tuple(v) for k, v in out.items()}


def got(df):
    rows = df.collect()
    found = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_all_orders_by_definition(spark):
    docs = documents(spark, 60)
    extra = [(500 + k, "word " * 120 if k % 2 else "Every # WORD is Different " + " ".join(f"W{i}" for i in range(110)), "en" if k % 3 else None, None, None, None, None) for k in range(8)]
    extra += [(None, "word " * 120, "en", None, None, None, None)] * 3 + [(1, None, "fr", None, None, None, None), (503, "word " * 120, "de", None, None, None, None), (503, "word " * 120, "de", None, None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    labels = [(k, int(k % 3 == 0), int(k % 5 == 0)) for k in range(0, 600, 2)] + [(503, 0, None), (503, 1, 1), (None, 1, 1), (501, None, 1)]
    have = got(audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert have == by_definition([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()], labels)


def test_lattice():
    assert len(set(audit.lattice_edges())) == 80
    assert audit.failures(b"") == 1
    assert audit.failures(b" \n") == 1


@pytest.mark.parametrize("size", [1, 5, 33])
def test_windows(monkeypatch, size):
    text = ("The cat & the DOG " * 9 + "é" * 50 + "\x0bend").encode()
    whole = audit.failures(text)
    monkeypatch.setattr(audit, "WINDOW", size)
    assert audit.failures(text) == whole


def test_paths(spark):
    rows = audit.paths(spark).collect()
    assert len(rows) == 600 and len({(r["applied"], r["bit"]) for r in rows}) == 80


def test_no_rows_and_other_columns(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(empty(spark), labels).collect() == []
    docs = spark.createDataFrame([(1, "a", "en", 1, 2), (2, "a", None, 3, 4)], "doc_id long, text string, lang string, part long, `a.b` long")
    assert {r["part"] for r in audit.audit(docs, labels).collect()} == {"en", ""}


def test_query_and_sql(spark, small):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = audit.query(spark, small)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({audit.ORACLE_SQL})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
