import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from helpers import documents, empty

from lexdrift.llm import pieces


@pytest.fixture(scope="module")
def both():
    return pieces.Encoder(pieces.model_path()), sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


def same(both, text):
    own, ref = both
    ids = np.frombuffer(own.encode(text), np.uint32).tolist()
    assert ids == ref.encode(text, add_bos=True, add_eos=True), text
    assert own.decode(ids) == ref.decode(ids)


def test_random_texts(both):
    rng = random.Random(4)
    parts = ["a", "the", "ing", " ", "  ", "\n", "▁", "é", "ß", "日本", "😀", "\t", "\x00", "www", "....", "==", "0", "<s>", "<0x0A>", "​", "́", "\r\n", "ﬁ"]
    for _ in range(3000):
        same(both, "".join(rng.choice(parts) for _ in range(rng.randint(0, 24))))
    for _ in range(3000):
        same(both, "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéE_-=/.") for _ in range(rng.randint(1, 60))))


def test_long_run(both):
    rng = random.Random(5)
    same(both, "".join(rng.choice("aeinrstthe") for _ in range(20000)))


def test_decode_any_ids(both):
    own, ref = both
    rng = random.Random(6)
    for _ in range(2000):
        ids = [rng.randint(3, 31999) if rng.random() < 0.5 else rng.randint(3, 258) for _ in range(rng.randint(0, 12))]
        assert own.decode(ids) == ref.decode(ids)


def test_full_tables_change_nothing(both, monkeypatch):
    monkeypatch.setattr(pieces, "TABLE", 5)
    own = pieces.Encoder(pieces.model_path())
    for text in ("a few words and then some more words that go on", "again a few words and then some"):
        assert own.encode(text) == both[0].encode(text)


def test_round_trip(spark, both):
    docs = documents(spark)
    got = sorted(map(tuple, pieces.round_trip(docs).collect()), key=str)
    exp = []
    for r in docs.collect():
        ids = both[1].encode(r.text or "", add_bos=True, add_eos=True)
        raw = np.array(ids, "<u4").tobytes()
        exp.append((r.doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(both[1].decode(ids).encode()).hexdigest()))
    assert got == sorted(exp, key=str)
    first = pieces.encode(docs.where("doc_id = 1")).first()
    assert first.ids == both[1].encode(docs.where("doc_id = 1").first().text, add_bos=True, add_eos=True)
    assert pieces.round_trip(empty(spark), with_ids=True).count() == 0
