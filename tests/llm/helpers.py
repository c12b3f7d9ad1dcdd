"""Documents for tests: ordinary prose by rule, near copies, and the odd cases that every operator has to take."""

from __future__ import annotations

import random

SYLLABLES = {
    "en": ["th", "ing", "er", "on", "and", "tion", "ble", "st", "re", "ly", "ou", "wh"],
    "de": ["sch", "ung", "ein", "keit", "ver", "lich", "ß", "über", "zu", "ge"],
    "fr": ["eau", "ment", "que", "ère", "oi", "tion", "aux", "ç", "elle", "ou"],
}


def prose(seed: int, words: int, lang: str = "en") -> str:
    rng = random.Random(f"{lang}{seed}")
    out = []
    for k in range(words):
        w = "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3)))
        out.append(w + (".\n" if k % 17 == 16 else ""))
    return " ".join(out).replace("\n ", "\n").capitalize()


def changed(text: str, seed: int, share: float = 0.03) -> str:
    rng = random.Random(seed)
    words = text.split(" ")
    for _ in range(max(1, int(share * len(words)))):
        words[rng.randrange(len(words))] = f"new{rng.randrange(99)}"
    return " ".join(words)


ODD = [None, "", " ", "\n\n", "a", "A a", "one two three four", "1234 5678", "é" * 40, "x" * 9000, "same line here again\n" * 3, "日本 語 テキスト", "tab\tand\x0bmore\x0c\r\n"]


def documents(spark, n: int = 60, odd: bool = True, seed: int = 0):
    """Rows (doc_id, text, lang, source, n_chars, score, at): prose, exact and near copies, odd texts, a repeated row, and names that clash."""
    rows, texts = [], []
    for k in range(n):
        lang = ("en", "de", "fr")[k % 3]
        texts.append((prose(seed + k, 10 + k * 4, lang), lang))
    texts += [texts[5], texts[5], (changed(texts[40][0], 1), "de"), (changed(texts[40][0], 2), "de"), (changed(texts[41][0], 3, 0.01), "fr")]
    if odd:
        texts += [(t, None) for t in ODD]
    for k, (t, lang) in enumerate(texts):
        rows.append((k * 3 + 1, t, lang, None if k % 11 == 10 else f"s{k % 4}", None if t is None else len(t), "clash", k))
    if odd:
        rows.append(rows[7])
        rows.append((None, "a document without an id", "en", "s1", 24, None, None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, at int")


def empty(spark):
    return documents(spark, 45, odd=False).limit(0)
