import random

import pytest
from helpers import changed, documents, empty, prose
from pyspark.sql import functions as F

from lexdrift.llm import lines


def brute(rows):
    """New texts of (id, text) by all pairs of lines; equal ids are one document."""
    first, sets, order = {}, {}, {}
    for i, text in rows:
        for k, line in enumerate(lines.split((text or "").encode())):
            if line.strip():
                own = line.decode()
                sets.setdefault(line, {own[j : j + 8] for j in range(len(own) - 7)} or {own})
                order.setdefault(line, []).append((i is not None, i or 0, k))
    keys = list(sets)
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            x, y = sets[keys[a]], sets[keys[b]]
            both = len(x & y)
            if both and 100 * both >= 75 * (len(x) + len(y) - both):
                parent[root(keys[a])] = root(keys[b])
    for k in keys:
        first[root(k)] = min(first.get(root(k), min(order[k])), min(order[k]))
    out = []
    for i, text in rows:
        keep = [line for k, line in enumerate((text or "").split("\n")) if not (low := line.encode().lower()).strip() or first[root(low)] == (i is not None, i or 0, k)]
        out.append((i, None if text is None else "\n".join(keep)))
    return out


def test_against_all_pairs(spark):
    docs = documents(spark, 60)
    extra = [(1000 + k, "\n".join([changed(prose(7, 16), k, 0.03), "Common line of all documents here", prose(2000 + k, 15)])) for k in range(30)]
    docs = docs.select("doc_id", "text", "score").unionByName(spark.createDataFrame(extra, "doc_id long, text string").withColumn("score", F.lit("x")))
    got = lines.deduplicate(docs)
    assert got.columns == ["doc_id", "text", "score", "n_lines", "n_kept", "kept_in"]
    expected = brute([(r.doc_id, r.text) for r in docs.collect()])
    rows = got.collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted(expected, key=str)
    for r in rows:
        assert r.n_kept <= r.n_lines and bool(r.kept_in) == (r.n_kept < r.n_lines)
    assert lines.deduplicate(empty(spark)).count() == 0


def test_recall_at_the_threshold():
    """Of pairs of lines that are just alike enough, nearly all share a band."""
    pairs = []
    for k in range(400):
        a = prose(k, 40).replace("\n", " ").lower().encode()
        b = changed(a.decode(), k, 0.02).encode()
        if lines.alike([a], [b])[0]:
            pairs.append((a, b))
    x, y = (lines.signatures([p[j] for p in pairs]) for j in (0, 1))
    assert len(pairs) > 100 and ((x == y).any(1)).mean() > 0.97


def test_alike_by_definition():
    cases = [(b"abcdefgh", b"abcdefgh", True), (b"abc", b"abc", True), (b"abc", b"abd", False), (b"abcdefghijklmnopqrstuvwxyz", b"abcdefghijklmnopqrstuvwxy", True)]
    assert lines.alike([a for a, _, _ in cases], [b for _, b, _ in cases]).tolist() == [c for _, _, c in cases]


@pytest.mark.parametrize("text", [None, "", "\n\n", "only one"])
def test_odd_texts_stay(spark, text):
    got = lines.deduplicate(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.text == text and got.n_lines == got.n_kept


def templated(n, seed=0):
    """Lines of one template, most of them too different to link, some with a copy that links with them."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    out = []
    for k in range(n):
        own = "".join(rng.choice(letters) for _ in range(rng.randint(10, 14)))
        line = f"This page was last changed by the user {own} and its text is under the licence that is named below"
        out.append(line)
        if k % 10 == 0:
            out.append(line.replace("licence", "".join(rng.choice(letters) for _ in range(rng.randint(3, 7)))))
    rng.shuffle(out)
    return out


def test_templates_against_all_pairs(spark):
    """Lines that share a template fill the same groups; each pair that links is found there all the same."""
    texts = templated(2000)
    rows = [(k, "\n".join(texts[k * 20 : k * 20 + 20])) for k in range(len(texts) // 20)]
    expected = brute(rows)
    got = lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    dropped = sum(len(a.split("\n")) for _, a in rows) - sum(len(a.split("\n")) for _, a in expected)
    assert 100 < dropped < 1000
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted(expected)


def near(n, vary, seed):
    """n lines of one template, each with some of its words replaced."""
    rng = random.Random(seed)
    words = prose(seed, 40).replace("\n", " ").lower().split()
    out = []
    for _ in range(n):
        own = list(words)
        for k in rng.sample(range(len(own)), rng.randint(*vary)):
            own[k] = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(len(own[k])))
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("n", "vary"), [(300, (2, 4)), (300, (1, 4)), (400, (0, 3))])
def test_recall_within_groups(spark, n, vary, capsys):
    """Groups above the size of a block, of lines that link, don't link, or link by way of others: the share of all links whose ends are one component."""
    texts = near(n, vary, n + vary[1])
    rows = [(k, "\n".join(texts[k * 10 : k * 10 + 10])) for k in range(n // 10)]
    expected = brute(rows)
    got = sorted((r.doc_id, r.text) for r in lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    kept, true = (sum(len([x for x in t.split("\n") if x]) for _, t in out) for out in (got, expected))
    recall = (n - kept) / (n - true)
    with capsys.disabled():
        print(f"lines {n}, kept {kept}, by all pairs {true}, recall of dropped lines {recall:.3f}")
    assert n > true and 0.99 <= recall <= 1


def test_characters_not_bytes():
    """A shingle is as many characters in any script."""
    a = "日本語の文章がここにあります".encode()
    h, first = lines.shingles([a, b"short", "日本".encode()])
    assert first.tolist() == [0, 14 - 7, 8, 9] and len(set(h.tolist())) == 9


def test_other_columns_keep_their_names(spark):
    rows = [(1, "one line of this text stays here\nanother", "a", 5, None), (2, "one line of this text stays here", "b", 6, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, key int, gone string").withColumn("id", F.lit(9)).withColumn("rest", F.lit("r"))
    got = lines.deduplicate(docs).orderBy("doc_id").collect()
    assert [(r._id, r.key, r.gone, r.id, r.rest, r.text, r.n_kept) for r in got] == [("a", 5, None, 9, "r", rows[0][1], 2), ("b", 6, "z", 9, "r", "", 0)]
