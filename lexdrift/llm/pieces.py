"""SentencePiece encoding and decoding of merge-type (BPE) models.

A text's encoding is the only sequence of pieces whose neighbours are each compatible: merging the two pieces' characters anew gives
back the two pieces. The search goes left to right over the longest vocabulary match at each position (Aho-Corasick), takes shorter
prefixes where a neighbour is not compatible, and steps back where none fits; a bitfield of failed positions keeps that linear.

Merges never cross into a space that follows another character, so texts are cut there into runs; each distinct run is encoded once
per worker and kept in a bounded table.
"""

from __future__ import annotations

import hashlib
from array import array

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, parts, table

SPACE = "▁"
#: Entries of a worker's tables of runs and of compatible pairs; a full table is emptied.
TABLE = 400_000


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Encoder:
    """The vocabulary of a model file, and exact encoding and decoding with it."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.byte = {}
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte[int(p[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id[p], self.score[p] = i, sp.get_score(i)
        if len(self.byte) < 256 or any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a model with byte fallback and spaces at the start of pieces is needed")
        probe = " ½  á\tb\n "
        if sp.decode(sp.encode(probe)) != probe or sp.encode("a")[0] != self.id.get(SPACE + "a", -1):
            raise ValueError("the model's normaliser changes texts")
        self.byte_of = {i: bytes([b]) for b, i in self.byte.items()}
        self.text = [self.byte_of.get(i) or (b"" if i in (self.bos, self.eos) else " ⁇ ".encode() if i == self.unk else p.replace(SPACE, " ").encode()) for i, p in enumerate(self.pieces)]
        self.code = [i.to_bytes(4, "little") for i in range(n)]
        self.pairs: dict[int, bool] = {}
        self.size = [len(p) for p in self.pieces]
        self.automaton = ahocorasick.Automaton()
        whole = {p for p in self.id if len(p) == 1 or self.merge(p) == [p]}  # merging a piece's own characters makes it
        for p in whole:
            self.automaton.add_word(p, (len(p), self.id[p]))
        self.automaton.make_automaton()
        # the longest shorter piece that each begins with; -1: none, -2: its first character, which has no id
        self.shorter = [-1] * n
        for p in whole:
            if len(p) > 1:
                self.shorter[self.id[p]] = next((self.id[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in whole), -2)
        self.inner, self.head = Runs(self, SPACE), Runs(self, "")

    def merge(self, text: str) -> list[str]:
        """Merge the best neighbours, the leftmost of equals, until none are in the vocabulary. For short strings."""
        out, score = list(text), self.score
        while len(out) > 1:
            best, at = None, -1
            for k in range(len(out) - 1):
                s = score.get(out[k] + out[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            out[at : at + 2] = [out[at] + out[at + 1]]
        return out

    def fits(self, a: int, b: int) -> bool:
        """Whether two neighbours stay as they are when their characters merge anew. Below 0: a character without an id, which never merges."""
        r = True
        if a >= 0 and b >= 0:
            p, q = self.pieces[a], self.pieces[b]
            r = self.merge(p + q) == [p, q]
        if len(self.pairs) >= TABLE:
            self.pairs.clear()
        self.pairs[a * (1 << 21) + b] = r
        return r

    def split(self, text: str) -> list[int]:
        """Ids of the pieces of a run; -1 - code point for a character without an id."""
        if not text:
            return []
        n, ids, known, shorter, sizes = len(text), self.id, self.pairs.get, self.shorter, self.size
        longest = [ids[c] if c in ids else -1 - ord(c) for c in text]
        reach = [1] * n
        for end, (size, i) in self.automaton.iter(text):
            at = end + 1 - size
            if size > reach[at]:
                reach[at], longest[at] = size, i
        failed = bytearray(n // 8 + 1)
        out: list[int] = []
        at, now, last = 0, longest[0], None
        while True:
            end = at + (sizes[now] if now >= 0 else 1)
            if not failed[end >> 3] >> (end & 7) & 1:
                fit = True if last is None else known(last * 2097152 + now)
                if self.fits(last, now) if fit is None else fit:
                    out.append(now)
                    if end == n:
                        return out
                    at, last, now = end, now, longest[end]
                    continue
            less = shorter[now] if now >= 0 else -1
            if less == -2:
                less = -1 - ord(text[at])
            elif less == -1:
                failed[at >> 3] |= 1 << (at & 7)
                less = out.pop()
                at -= sizes[less] if less >= 0 else 1
                last = out[-1] if out else None
            now = less

    def codes(self, text: str) -> bytes:
        """The ids of a run as little-endian 32-bit integers; a character outside the vocabulary gives its bytes."""
        code = self.code
        return b"".join([code[i] if i >= 0 else b"".join([code[self.byte[b]] for b in chr(-1 - i).encode()]) for i in self.split(text)])

    def encode(self, text: str) -> bytes:
        """Ids with begin and end."""
        out = [self.code[self.bos]]
        if text:
            inner, head, newline = self.inner.__getitem__, self.head.__getitem__, self.codes("\n") if "\n" in text else b""
            text = text.replace(SPACE, " ")
            for k, line in enumerate((" " + text).split("\n")):
                if k:
                    out.append(newline)
                words = line.split(" ")
                if words[0]:
                    out.append(head(words[0]))
                if "" in words[1:]:
                    # several spaces, or one at the end, belong to the word that follows
                    run = ""
                    for w in words[1:]:
                        run += SPACE
                        if w:
                            out.append(inner(w) if run == SPACE else self.codes(run + w))
                            run = ""
                    if run:
                        out.append(self.codes(run))
                else:
                    out.extend(map(inner, words[1:]))
        out.append(self.code[self.eos])
        return b"".join(out)

    def decode(self, ids: array | list[int]) -> str:
        """Pieces joined; the space put before the text goes; bytes that aren't UTF-8 become U+FFFD, one each."""
        names = self.text
        raw = b"".join([names[i] for i in ids])
        first = next((i for i in ids if i not in (self.bos, self.eos)), None)
        if first is not None and first not in self.byte_of and self.pieces[first].startswith(SPACE):
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            out = []
            while raw:
                try:
                    out.append(raw.decode())
                    break
                except UnicodeDecodeError as e:
                    out += [raw[: e.start].decode(), "�"]
                    raw = raw[e.start + 1 :]
            return "".join(out)


class Runs(dict):
    """Codes of the runs met so far, each with the same start."""

    def __init__(self, encoder: Encoder, start: str):
        self.encoder, self.start = encoder, start

    def __missing__(self, word: str) -> bytes:
        if len(self) >= TABLE:
            self.clear()
        out = self.encoder.codes(self.start + word)
        if len(word) <= 64:
            self[word] = out
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int, with begin and end) for rows (doc_id, text). A null text is an empty one: begin and end alone."""
    path = path or model_path()

    def run(batch):
        e = encoder(path)
        for part in parts(batch):
            yield {"doc_id": part["doc_id"], "ids": _lists([e.encode(t or "") for t in part["text"].to_pylist()])}

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int) for rows (doc_id, text).

    Each row stands alone: repeated rows give repeated results, no rows none, other columns are ignored. Null or empty texts have two ids
    and decode to the empty text. A run without spaces is kept whole however long it is.
    """
    path = path or model_path()

    def run(batch):
        e = encoder(path)
        for part in parts(batch):
            codes = [e.encode(t or "") for t in part["text"].to_pylist()]
            out = {"doc_id": part["doc_id"], "n_tokens": [len(c) // 4 for c in codes], "ids_sha256": [hashlib.sha256(c).hexdigest() for c in codes]}
            out["decoded_sha256"] = [hashlib.sha256(e.decode(memoryview(c).cast("I").tolist()).encode()).hexdigest() for c in codes]
            yield out | ({"ids": _lists(codes)} if with_ids else {})

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_arrow(docs.select("doc_id", "text"), run, schema + ", ids array<int>" * with_ids)


def _lists(codes: list[bytes]) -> pa.ListArray:
    lengths = pa.array([0] + [len(c) // 4 for c in codes], pa.int32())
    return pa.ListArray.from_arrays(pc.cumulative_sum(lengths), pa.Array.from_buffers(pa.int32(), sum(map(len, codes)) // 4, [None, pa.py_buffer(b"".join(codes))]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
