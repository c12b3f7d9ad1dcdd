import hashlib

import numpy as np
from helpers import documents, empty, prose

from lexdrift.llm import fingerprints as g


def plain(text: bytes) -> list[int]:
    """Boundaries by the definition, a byte at a time."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + g.MOST)
        cut = end
        for k in range(at + g.LEAST - 1, end):
            if len(text) - at <= g.LEAST:
                break
            h = 0
            for b in (b"\x00" * g.WINDOW + text)[k + 1 : k + 1 + g.WINDOW]:
                h = (h * 2 + int(g.GEAR[b])) & 0xFFFFFFFF
            n = k - at + 1
            mask = (1 << (g.HARD if n < g.NORMAL else g.EASY)) - 1
            if (h >> (32 - g.HARD)) & mask == 0:
                cut = k + 1
                break
        out.append(cut)
        at = cut
    return out


def test_boundaries():
    texts = [prose(k, 20 + 30 * k).encode() for k in range(6)] + [b"", b"a", b"x" * 1000]
    assert list(g.boundaries(texts)) == [plain(t) for t in texts]
    # a text's boundaries don't depend on its neighbours
    assert list(g.boundaries(texts[::-1]))[::-1] == [plain(t) for t in texts]


def test_shift_resistance():
    text = prose(1, 800).encode()
    a, b = g.fingerprints([text, b"something put before " + text])
    assert g.containment(a, b) > 0.9
    assert g.from_text(g.as_text(a)) == a
    assert g.containment(a, a) == 1 and g.containment({}, {}) == 1 and g.containment({}, a) == 0 == g.containment(a, {})


def test_neighbours(spark):
    docs = documents(spark)
    got = g.compare_neighbours(docs).collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0), reverse=True)
    expected = []
    for k, r in enumerate(rows):
        text, follow = r.text or "", rows[(k + 1) % len(rows)].text or ""
        new = g.edited(text, follow)
        a, b, c = g.fingerprints([x.encode() for x in (text, new, follow)])
        expected.append((r.doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), g.as_text(a), g.as_text(b), g.containment(a, b), g.containment(a, c)))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert g.compare_neighbours(empty(spark)).count() == 0
    one = g.compare_neighbours(docs.where("doc_id = 1")).first()
    assert one.near_next == 1.0 and one.near_edited <= 1


def test_edited():
    assert g.edited("abcde", "XYZ") == "abcXY" and g.edited("abcd", "X") == "abX" and g.edited("", "X") == ""
    assert np.isfinite(g.containment({1: 3}, {1: 3}))
