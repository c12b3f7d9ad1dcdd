import random

import pytest
from helpers import documents, empty

from lexdrift.llm import counts


@pytest.fixture(scope="module")
def tok():
    return counts.tokenizer(*counts.tokenizer_files())


def full(tok, text):
    return len(tok.count.__self__.encoding.encode_ordinary(text))


def test_random_edits(tok):
    rng = random.Random(2)
    al = list("ab'sltrev 1  \n\n,.é日\t") + ["'ll", "   ", "the "]
    for _ in range(400):
        doc = counts.Counted("".join(rng.choice(al) for _ in range(rng.randint(0, 200))), tok)
        for _ in range(12):
            n = len(doc.text)
            s = rng.randint(0, n)
            e = min(n, s + rng.choice([0, 0, 1, 2, 5, 60, 200]))
            new = "".join(rng.choice(al) for _ in range(rng.choice([0, 0, 1, 2, 3, 40, 300])))
            expected = doc.text[:s] + new + doc.text[e:]
            doc.edit(s, e, new)
            assert doc.text == expected and doc.tokens == full(tok, expected)
            for level, above in zip(doc.nodes, doc.nodes[1:], strict=False):
                assert (level.reshape(-1, 2, 3).sum(1) == above[: len(level) // 2]).all()


def test_only_what_edits_touch_is_encoded(tok):
    text = "some plain words that go on and on, " * 500
    doc = counts.Counted(text, tok)
    doc.edit(9000, 9003, "xyz")
    assert doc.encoded < 10 and doc.tokens == full(tok, doc.text)


def test_query_rows(spark, tok):
    docs = documents(spark)
    got = sorted(map(tuple, counts.count_edits(docs).select("doc_id", "n_tokens", "edited_tokens").collect()), key=str)
    expected = []
    for r in docs.collect():
        text = r.text or ""
        for s, e, new in counts.edits(text):
            assert 0 <= s <= e <= len(text) or not text
            text = text[:s] + new + text[e:]
        expected.append((r.doc_id, full(tok, r.text or ""), full(tok, text)))
    assert got == sorted(expected, key=str)
    assert counts.count_edits(empty(spark)).count() == 0
