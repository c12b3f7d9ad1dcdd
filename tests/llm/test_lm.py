import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from helpers import documents, empty

from lexdrift.llm import lm


def brute(names, logp, text):
    """The log probability of a whole text, by all its segmentations."""
    p = dict(zip(names, logp, strict=True))
    text, total = b"".join(b" " + w for w in lm.words_of(text)), 0.0
    for k in range(max(len(text), 1)):
        for cuts in itertools.combinations(range(1, len(text)), k):
            parts = [text[a:b] for a, b in zip((0, *cuts), (*cuts, len(text)), strict=True)] if text else []
            if all(x in p for x in parts):
                total += math.exp(sum(p[x] for x in parts))
    return math.log(total)


NAMES = [b" ", b" a", b"a", b"b", b"ab", b"ba", b"abb", b" ab", b"\xc3\xa9"]


def test_lattice():
    logp = np.log(np.linspace(0.05, 0.2, len(NAMES)))
    lattice = lm.Lattice(NAMES, logp)
    words = [b"a", b"ab", b"abba", b"abbab", b"bbabba", "aé".encode(), b"a"]
    assert np.allclose(lattice.score(words), [brute(NAMES, logp, w) for w in words])
    assert lattice.score([b"zz"])[0] == -np.inf


def test_windows(monkeypatch):
    names, logp = lm.vocabulary(lm.model_path())
    lattice = lm.Lattice(names, logp)
    word = ("thequickbrownfox" * 30).encode()[:401]
    whole = lattice.score([word])[0]
    for window in (1, 7, 50, 400, 402, 500):
        monkeypatch.setattr(lm, "WINDOW", window)
        assert abs(lattice.long(word) - whole) < 1e-8 * abs(whole)


def test_whole_texts_by_all_segmentations(spark, monkeypatch):
    """The query's score is the marginal of the whole text, and of its end."""
    logp = np.log(np.linspace(0.05, 0.2, len(NAMES)) / 2)
    monkeypatch.setattr(lm, "vocabulary", lambda path: (NAMES, logp))
    texts = ["a ab", "AB  ba\ta", "abba b", "", None, "a", "b ab a ba"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = lm.Model(docs.where("doc_id < 3"))
    for r in lm.score(docs, model).collect():
        t = (texts[r.doc_id] or "").encode()
        assert r.score == pytest.approx((brute(NAMES, logp, t) if t else 0.0) / math.log(10) + math.log10(3.5 / (model.n + 1)))


def test_every_word_has_a_probability():
    names, logp = lm.vocabulary(lm.model_path())
    s = lm.Lattice(names, logp).score([bytes(range(128, 140)), b"\x00", "日本語".encode(), b"x" * 3000, b"y" * 9000])
    assert np.isfinite(s).all() and (s < 0).all()


@pytest.mark.parametrize("hot", [lm.HOT, 7])
def test_scores(spark, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT", hot)
    docs = documents(spark)
    train = docs.where("at is null or at % 5 <> 1")
    model = lm.Model(train)
    got = lm.score(docs, model).collect()
    counts, ends = Counter(), 0
    for r in train.collect():
        counts.update(lm.words_of((r.text or "").encode()))
        ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    lattice = lm.Lattice(*model.pieces)
    base = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    expected = []
    for r in docs.collect():
        words = lm.words_of((r.text or "").encode())
        b = sum(base(counts[w]) for w in words) + base(ends)
        s = math.log10((ends + 0.5) / (n + 1)) + sum(lattice.score([w])[0] for w in words) / math.log(10)
        expected.append((r.doc_id or -1, len(words) + 1, sum(counts[w] > 0 for w in words) + 1, n, b, s))
    got = sorted((r.doc_id or -1, *list(r)[1:]) for r in got)
    for a, b in zip(got, sorted(expected), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4]) and a[5] == pytest.approx(b[5])


def test_no_training(spark):
    docs = documents(spark)
    got = lm.score(docs, lm.Model(empty(spark))).collect()
    assert len(got) == docs.count() and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in got)
    assert lm.score(empty(spark), lm.Model(empty(spark))).count() == 0
    blank = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    rows = lm.score(blank, lm.Model(blank)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in rows] == [(1, 1, 2)] * 2


def test_long_pieces_are_in_the_vocabulary():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=lm.model_path())
    long = {p for p in (sp.id_to_piece(i).replace(lm.SPACE, " ").encode() for i in range(sp.vocab_size()) if not sp.is_byte(i)) if len(p) > 24 and b" " not in p[1:]}
    assert long and long <= set(lm.vocabulary(lm.model_path())[0])


def test_expected_counts_by_brute_force():
    logp = np.log(np.linspace(0.05, 0.2, len(NAMES)))
    want = np.zeros(len(NAMES))
    p = dict(zip(NAMES, logp, strict=True))
    words = [b"abba", b"ab", b"ba"]
    for w in words:
        text, total = b" " + w, math.exp(brute(NAMES, logp, w))
        for k in range(len(text)):
            for cuts in itertools.combinations(range(1, len(text)), k):
                parts = [text[a:b] for a, b in zip((0, *cuts), (*cuts, len(text)), strict=True)]
                if all(x in p for x in parts):
                    for x in parts:
                        want[NAMES.index(x)] += math.exp(sum(p[y] for y in parts)) / total
    assert np.allclose(lm.Lattice(NAMES, logp).expected(words), want)


@pytest.mark.parametrize("hot", [lm.HOT, 7])
def test_a_fitted_model_by_hand(spark, monkeypatch, hot):
    """A word's probability is its discounted share, and what is taken off times that of its segmentations; every word takes the chance that no end comes first."""
    monkeypatch.setattr(lm, "HOT", hot)
    docs = documents(spark)
    train = docs.where("at is null or at % 5 <> 1")
    model = lm.Model(train, fitted=True)
    counts, ends = Counter(), 0
    for r in train.collect():
        counts.update(lm.words_of((r.text or "").encode()))
        ends += 1
    m, lattice = sum(counts.values()), lm.Lattice(*model.pieces)
    assert abs(np.exp(model.pieces[1]).sum() - 1) < 1e-9
    end = (ends + 0.5) / (m + ends + 1)

    def one(w):
        taken = (lm.DISCOUNT * len(counts) + 1) / (m + 1)
        return math.log10(1 - end) + (np.logaddexp(math.log(taken) + lattice.score([w])[0], math.log((counts[w] - lm.DISCOUNT) / (m + 1)) if counts[w] else -np.inf)) / math.log(10)

    want = sorted((r.doc_id or -1, math.log10(end) + sum(map(one, lm.words_of((r.text or "").encode())))) for r in docs.collect())
    got = sorted((r.doc_id or -1, r.score) for r in lm.score(docs, model).collect())
    assert [k for k, _ in got] == [k for k, _ in want] and [x for _, x in got] == pytest.approx([x for _, x in want])


def test_held_out_texts_near_the_base(spark, small):
    """The model spells unknown words, which the base score has at the share of half a token, and yet it isn't far below on texts that it hasn't seen."""
    got = lm.query(spark, small).where("held_out").agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    print("held-out log10 a token: %.2f, base %.2f" % tuple(got))
    assert got[0] > 1.5 * got[1]
