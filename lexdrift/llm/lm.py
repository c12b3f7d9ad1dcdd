"""Language-model scores from a subword lattice.

The pieces of an existing vocabulary have one probability each, by the vocabulary's own scores, and an end has one too. A text's probability is
the sum over all its segmentations into pieces, by a forward recursion in log space, times that of the end. White space stands as one space
before each word, and pieces hold a space at most at their start, so the lattice of a text falls apart into those of its words, each of which
is scored once for all texts that hold it. What training texts give is the share of ends, and the counts behind the base score.

The counts of all words stay distributed. The HOT most frequent words are broadcast; the others are joined. Words of more than
LONG_BYTES bytes go by a 128-bit digest there.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, map_arrow, map_batches, materialise, parts, table
from .pieces import SPACE, model_path

#: Words that are broadcast; words a worker counts before it passes them on; bytes of a word that stands for itself.
HOT, COUNTED, LONG_BYTES = 100_000, 200_000, 48
#: Bytes of a word from which its lattice is gone through in windows.
WINDOW = 4096
LN10 = math.log(10)
MASK, SALT = (1 << 64) - 1, 0xD6E8FEB86659FD93


def words_of(text: bytes) -> list[bytes]:
    """Runs of bytes other than \\x20 and \\x09-\\x0D, ASCII letters in lower case."""
    return text.lower().split()


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes, a space for the word start, single bytes last; and their log probabilities, which sum to 1.

    The scores of a vocabulary of the unigram type are log probabilities. Those of the merge type are ranks, which count as Zipf's law has
    it: 1 / (10 + rank). A byte that is no piece has a probability far below all others, so that every text has segmentations.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    own: dict[bytes, float] = {}
    for i in range(sp.vocab_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)):
            p = sp.id_to_piece(i).replace(SPACE, " ").encode()
            if b" " not in p[1:]:
                own[p] = sp.get_score(i)
    ranks = sorted(set(own.values()), reverse=True)
    if all(s == int(s) for s in ranks):
        rank = {s: k for k, s in enumerate(ranks)}
        weight = {p: 1 / (10 + rank[s]) for p, s in own.items()}
    else:
        weight = {p: math.exp(s) for p, s in own.items()}
    least = min(weight.values()) / 10
    for b in range(256):
        weight.setdefault(bytes([b]), least)
    names = list(weight)
    p = np.array([weight[x] for x in names])
    return names, np.log(p / p.sum())


class Lattice:
    """Marginal log probabilities of words over all segmentations, for many words at once."""

    def __init__(self, names: list[bytes], logp: np.ndarray):
        self.names, self.logp = names, np.append(logp, -np.inf)
        self.longest = max(map(len, names))
        self.factor = np.uint64(0x9E3779B97F4A7C15 | 1)
        self.powers = np.ones(self.longest + 1, np.uint64)
        for k in range(self.longest):
            self.powers[k + 1] = int(self.powers[k]) * int(self.factor) & MASK
        keys = np.zeros(len(names), np.uint64)
        for k, p in enumerate(names):
            h = 0
            for b in p:
                h = (h * int(self.factor) + b + 1) & MASK
            keys[k] = (h + len(p) * SALT) & MASK
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)] = True

    def arcs(self, words: np.ndarray) -> np.ndarray:
        """Piece of each (word, start, length - 1) of an (n, L) array of bytes; len(names) where there is none."""
        n, length = words.shape
        most = min(length, self.longest)
        prefix = np.zeros((n, length + 1), np.uint64)
        for j in range(length):
            prefix[:, j + 1] = prefix[:, j] * self.factor + words[:, j].astype(np.uint64) + np.uint64(1)
        out = np.full((n, length, most), len(self.names), np.int32)
        for k in range(1, most + 1):
            h = prefix[:, k:] - prefix[:, : length + 1 - k] * self.powers[k] + np.uint64(k * SALT & MASK)
            hit = self.maybe[(h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)]
            some = h[hit]
            at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
            ids = np.where(self.keys[at] == some, self.order[at], len(self.names)).astype(np.int32)
            view = out[:, : length + 1 - k, k - 1]
            view[hit] = ids
        return out

    def forward(self, arcs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, length, most = arcs.shape
        lp = self.logp[arcs]
        alpha = np.full((n, length + 1), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, length + 1):
            ks = np.arange(1, min(j, most) + 1)
            t = alpha[:, j - ks] + lp[:, j - ks, ks - 1]
            m = t.max(1)
            m = np.where(np.isfinite(m), m, 0)
            with np.errstate(divide="ignore"):
                alpha[:, j] = m + np.log(np.exp(t - m[:, None]).sum(1))
        return alpha, lp

    def expected(self, words: list[bytes]) -> np.ndarray:
        """How often each piece occurs in the segmentations of words below WINDOW bytes, as likely as they are."""
        out = np.zeros(len(self.names) + 1)
        for _, x in self.groups(words):
            arcs = self.arcs(x)
            alpha, lp = self.forward(arcs)
            n, length, most = arcs.shape
            beta = np.full((n, length + 1), -np.inf)
            beta[:, length] = 0
            for j in range(length - 1, -1, -1):
                ks = np.arange(1, min(length - j, most) + 1)
                t = beta[:, j + ks] + lp[:, j, ks - 1]
                m = t.max(1)
                m = np.where(np.isfinite(m), m, 0)
                with np.errstate(divide="ignore"):
                    beta[:, j] = m + np.log(np.exp(t - m[:, None]).sum(1))
            for k in range(1, most + 1):
                share = np.exp(alpha[:, : length + 1 - k] + lp[:, : length + 1 - k, k - 1] + beta[:, k:] - alpha[:, -1:])
                out += np.bincount(arcs[:, : length + 1 - k, k - 1].ravel(), share.ravel(), len(out))
        return out[:-1]

    def groups(self, words: list[bytes]) -> Iterable[tuple[np.ndarray, np.ndarray]]:
        """(positions, bytes with the leading space) of words of equal length, some at a time."""
        sizes = np.array([len(w) for w in words])
        order = np.argsort(sizes, kind="stable")
        a = 0
        while a < len(order):
            size = sizes[order[a]]
            cells = (size + 1) * min(size + 1, self.longest)
            b = min(int(np.searchsorted(sizes[order], size, "right")), a + max(1, 1_000_000 // int(cells)))
            own = order[a:b]
            yield own, np.frombuffer(b"".join([b" " + words[i] for i in own]), np.uint8).reshape(b - a, size + 1)
            a = b

    def long(self, word: bytes) -> float:
        """The log probability of one word, in windows: what is held doesn't grow with the word."""
        text = np.frombuffer(b" " + word, np.uint8)
        alpha = np.zeros(1)  # of the last positions before the window, the latest last
        for a in range(0, len(text), WINDOW):
            back = len(alpha) - 1
            arcs = self.arcs(text[None, a - back : a + WINDOW])
            lp = self.logp[arcs[0]]
            size = len(lp)
            held = np.concatenate([alpha, np.full(size - back, -np.inf)])
            for j in range(back + 1, size + 1):
                ks = np.arange(1, min(j, lp.shape[1]) + 1)
                t = held[j - ks] + lp[j - ks, ks - 1]
                m = t.max()
                if m > -np.inf:
                    held[j] = m + math.log(np.exp(t - m).sum())
            alpha = held[-(min(size, self.longest) + 1) :]
        return float(alpha[-1])

    def score(self, words: list[bytes]) -> np.ndarray:
        """Natural log probability of each word and the space before it."""
        out = np.zeros(len(words))
        short = [k for k, w in enumerate(words) if len(w) < WINDOW]
        for own, x in self.groups([words[k] for k in short]):
            out[np.array(short)[own]] = self.forward(self.arcs(x))[0][:, -1]
        for k, w in enumerate(words):
            if len(w) >= WINDOW:
                out[k] = self.long(w)
        return out


def key_of(word: bytes) -> bytes:
    """The word, or what stands for a long one."""
    return word if len(word) <= LONG_BYTES and word[0] else b"\x00" + xxhash.xxh3_128_hexdigest(word).encode()


def _scored(lattice: Lattice, words: list[bytes]) -> list[float]:
    return [x for a in range(0, len(words), 4096) for x in lattice.score(words[a : a + 4096]).tolist()]


def _gathered(batches: Iterable[pa.RecordBatch], rows: int = 1 << 14) -> Iterable[pa.RecordBatch]:
    """The batches, of rows of bounded size, some at a time: lattices of many words of one length take little longer than those of a few."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def count_words(docs: DataFrame, pieces: tuple) -> DataFrame:
    """(word, n, lattice) over all texts, counted within tasks first; lattice is the word's natural log probability."""
    sent = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        own: Counter[bytes] = Counter()
        long: dict[bytes, bytes] = {}
        for batch in batches:
            for part in parts(batch):
                for text in part["text"].cast(pa.binary()).to_pylist():
                    words = words_of(text or b"")
                    own.update(map(key_of, words))
                    long.update((key_of(w), w) for w in words if key_of(w) is not w)
                if len(own) > COUNTED or sum(map(len, long.values())) > 1 << 24:
                    yield out(own, long)
                    own, long = Counter(), {}
        if own:
            yield out(own, long)

    def out(own: Counter, long: dict) -> pa.RecordBatch:
        scores = dict(zip(long, _scored(Lattice(*sent.value), list(long.values())), strict=True)) if long else {}
        return pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(own.values(), pa.int64()), pa.array([scores.get(w) for w in own], pa.float64())], names=["word", "n", "lattice"])

    counted = map_batches(docs.select("text"), run, "word string, n long, lattice double").groupBy("word").agg(F.sum("n").alias("n"), F.max("lattice").alias("lattice"))

    def complete(batches):
        lattice = Lattice(*sent.value)
        for batch in _gathered(batches):
            words, known = batch["word"].cast(pa.binary()).to_pylist(), batch["lattice"].to_pylist()
            fresh = iter(_scored(lattice, [w for w, x in zip(words, known, strict=True) if x is None]))
            yield pa.RecordBatch.from_arrays([batch["word"], batch["n"], pa.array([next(fresh) if x is None else x for x in known])], names=["word", "n", "lattice"])

    return map_batches(counted, complete, "word string, n long, lattice double")


#: Texts, and characters of each, of which the pieces' probabilities are fitted to so many different words; rounds of it; what is taken off each word's count for words that aren't known.
TEXTS, CHARS, FITTED, ROUNDS, DISCOUNT = 4000, 10_000, 40_000, 10, 0.5


def fit(train: DataFrame, pieces: tuple, most: int = FITTED, rounds: int = ROUNDS) -> tuple[list[bytes], np.ndarray]:
    """The pieces with probabilities by expectation and maximisation over different words, at most so many, of TEXTS training texts, each with the least hashes.

    Each round sums expected counts by tasks. A tenth of a count goes to each piece, in proportion to its probability so far, so that none gets none.
    """
    split = F.explode(F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+")).alias("word")
    some = train.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("h"), F.left("text", F.lit(CHARS)).alias("text")).orderBy("h", "text").limit(TEXTS)
    words = some.repartition(8, "h").select(split).where((F.col("word") != "") & (F.octet_length("word") <= LONG_BYTES)).distinct()
    words = materialise(words.orderBy(F.xxhash64("word"), "word").limit(most).repartition(8, "word"))
    names, logp = pieces
    for _ in range(rounds):
        sent = train.sparkSession.sparkContext.broadcast((names, logp))

        def run(batches):
            lattice = Lattice(*sent.value)
            total = np.zeros(len(lattice.names))
            for batch in _gathered(batches):
                total += lattice.expected(batch["word"].cast(pa.binary()).to_pylist())
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["piece", "n"])

        found = map_batches(words, run, "piece long, n double").toArrow()  # a row for each task and piece
        if not len(found):
            break
        order = np.lexsort((found["n"].to_numpy(), found["piece"].to_numpy()))  # sums that don't depend on the order of tasks
        n = np.bincount(found["piece"].to_numpy()[order], found["n"].to_numpy()[order], len(names)) + 0.1 * len(names) * np.exp(logp)
        logp = np.log(n / n.sum())
    return names, logp


class Model:
    """The vocabulary's pieces, and what is learned: distributed counts, totals, the frequent words.

    A fitted model has learned more: the pieces' probabilities, and an arc over the whole of each training word. That has the word's share of the training words, less
    DISCOUNT counts, and what is taken off is the share of words that pieces spell. So a word's probability is the sum over all its segmentations still, and
    all words' and the end's are 1 in all but for what the lattice gives to words that hold a space.
    """

    def __init__(self, train: DataFrame, path: str | None = None, fitted: bool = False):
        self.pieces = vocabulary(path or model_path())
        self.fitted = fitted
        if fitted:
            self.pieces = fit(train, self.pieces)
        self.counts = materialise(count_words(train, self.pieces))
        self.ends = train.count()
        tokens, types = (x or 0 for x in self.counts.agg(F.sum("n"), F.count(F.lit(1))).first())
        self.n, self.v = tokens + self.ends, types + (self.ends > 0)
        # natural logarithms of what a count of one gives, and of the share of words that pieces spell; a text's words and its end share one mass in the base score alone
        self.words, self.spelled = tokens, (math.log((DISCOUNT * types + 1) / (tokens + 1)) if fitted else 0.0)
        if fitted:
            whole = F.log((F.col("n") - DISCOUNT) / F.lit(tokens + 1.0))
            spelled = F.col("lattice") + self.spelled
            high, low = F.greatest(whole, spelled), F.least(whole, spelled)
            self.counts = self.counts.withColumn("lattice", high + F.log1p(F.exp(low - high)))
        hot = self.counts.orderBy(F.desc("n"), "word").limit(HOT).toArrow()
        names = [w.encode() for w in hot["word"].to_pylist()]
        self.hot = dict(zip(names, zip(self.base(hot["n"].to_numpy()).tolist(), (hot["lattice"].to_numpy() / LN10).tolist(), strict=True), strict=True))

    def base(self, c: np.ndarray | int) -> np.ndarray:
        """log10 of the smoothed share of a token."""
        return np.log10((np.asarray(c, float) + 0.5) / (self.n + 0.5 * (self.v + 1)))

    @property
    def end(self) -> float:
        """log10 probability of an end, its smoothed share of the training tokens."""
        return math.log10((self.ends + 0.5) / (self.n + 1))

    @property
    def inside(self) -> float:
        """log10 probability that a word follows and no end, which a fitted model takes once for each word; the others leave it out."""
        return math.log10(1 - (self.ends + 0.5) / (self.n + 1)) if self.fitted else 0.0


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for rows (doc_id, text).

    score is the log10 of the marginal probability of the text over all its segmentations, and of the end. A null or empty text is its end
    alone. Repeated rows give repeated results, no rows none; other columns are ignored. Without training texts every token is unknown.
    Rows are told apart by doc_id and a 64-bit hash of the text, not by where they stand, so that a task that runs again changes nothing.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.hot, model.pieces))
    n, v, ends, spelled = model.n, model.v, model.ends, model.spelled

    def run(batch):
        hot, pieces = sent.value
        for part in parts(batch):
            heads: dict[str, list] = {x: [] for x in ("doc_id", "mark", "word", "n_tokens", "known", "base", "model")}
            rare: dict[str, list] = {x: [] for x in ("doc_id", "mark", "word", "tf", "lattice")}
            lattice = None
            for i, text in zip(part["doc_id"].to_pylist(), part["text"].cast(pa.binary()).to_pylist(), strict=True):
                words = words_of(text or b"")
                mark = xxhash.xxh3_64_intdigest(text or b"") - (1 << 63)
                k, b, m = 0, 0.0, 0.0
                for w, t in Counter(words).items():
                    name = key_of(w)
                    if (x := hot.get(name)) is not None:
                        k += t
                        b += t * x[0]
                        m += t * x[1]
                        continue
                    if name is not w:
                        lattice = lattice or Lattice(*pieces)
                    for x, value in zip(rare, (i, mark, name, t, None if name is w else float(lattice.score([w])[0])), strict=True):
                        rare[x].append(value)
                # a row for the document itself, whose word is none, as it holds a space
                for x, value in zip(heads, (i, mark, b" %d" % mark, len(words) + 1, k, b, m), strict=True):
                    heads[x].append(value)
            own, more = len(heads["word"]), len(rare["word"])
            yield {
                "doc_id": heads["doc_id"] + rare["doc_id"],
                "mark": heads["mark"] + rare["mark"],
                "word": pa.array(heads["word"] + rare["word"], pa.binary()).cast(pa.string()),
                "n_tokens": heads["n_tokens"] + [None] * more,
                "known": heads["known"] + [0] * more,
                "base": heads["base"] + [0.0] * more,
                "model": heads["model"] + [0.0] * more,
                "tf": [None] * own + rare["tf"],
                "own_lattice": [None] * own + rare["lattice"],
            }

    schema = "doc_id long, mark long, word string, n_tokens long, known long, base double, model double, tf long, own_lattice double"
    joined = map_arrow(docs.select("doc_id", "text"), run, schema).join(model.counts, "word", "left")

    def unseen(batches):
        lattice = Lattice(*sent.value[1])
        for batch in _gathered(batches):
            tf, seen = batch["tf"].to_pylist(), batch["lattice"].to_pylist()
            own = batch["own_lattice"].to_pylist()
            words = batch["word"].cast(pa.binary()).to_pylist()
            fresh = list({w for w, t, x, y in zip(words, tf, seen, own, strict=True) if t is not None and x is None and y is None})
            found = dict(zip(fresh, _scored(lattice, fresh), strict=True))
            ln = [0.0 if t is None else x if x is not None else spelled + (y if y is not None else found[w]) for w, t, x, y in zip(words, tf, seen, own, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("doc_id", "mark", "n_tokens", "known", "base", "model", "tf", "n")], pa.array(ln, pa.float64())], names=["doc_id", "mark", "n_tokens", "known", "base", "model", "tf", "n", "ln"])

    rows = map_batches(joined, unseen, "doc_id long, mark long, n_tokens long, known long, base double, model double, tf long, n long, ln double")
    c, tf = F.coalesce("n", F.lit(0)).cast("double"), F.coalesce("tf", F.lit(0))
    base = F.log10((c + 0.5) / F.lit(n + 0.5 * (v + 1)))
    summed = rows.groupBy("doc_id", "mark").agg(
        F.count("n_tokens").alias("copies"),  # repeated rows come as often each, and sum up
        F.max("n_tokens").alias("n_tokens"),
        F.sum(F.col("known") + F.when(c > 0, tf).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + tf * base).alias("base_score"),
        F.sum(F.col("model") + tf * F.col("ln") / LN10).alias("score"),
    )
    per = F.col("copies").cast("double")
    out = summed.select(
        "doc_id",
        "n_tokens",
        (F.floor(F.col("n_known") / F.col("copies")) + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") / per + float(model.base(ends))).alias("base_score"),
        (F.col("score") / per + (F.col("n_tokens") - 1) * model.inside + model.end).alias("score"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    )
    return out.drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = Model(docs.where(fold("doc_id", 5) != 1), fitted=True)
    return score(docs, model).withColumn("held_out", fold("doc_id", 5) == 1).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
