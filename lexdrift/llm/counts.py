"""Token counts that follow edits.

A text is split into pre-tokens, whose token counts are the leaves of a segment tree; each node has the sums of characters, pre-tokens and
tokens below it. An edit descends by characters to the leaves it touches, splits that region anew with some context on the left, goes on
until its boundaries fall on old ones again, and updates the sums on the way up. The rest of the text isn't read again.
"""

from __future__ import annotations

import base64

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, parts, table

#: Pre-tokens that a new leaf holds. An edit adds to the leaves it touches, which split beyond four times that.
LEAF = 16
#: Characters before an edit that the split of the text before it may have looked at: a contraction has three.
CONTEXT = 3
TABLE = 400_000


class Known(dict):
    """Token counts of the pre-tokens met so far, a bounded table."""

    def __init__(self, encoding):
        self.encoding = encoding

    def __missing__(self, pre: str) -> int:
        n = len(self.encoding.encode_ordinary(pre))
        if len(self) >= TABLE:
            self.clear()
        if len(pre) <= 64:
            self[pre] = n
        return n


class Tokenizer:
    """Byte-level BPE over pre-tokens, which the pattern finds without gaps."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern)
        self.count = Known(tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})).__getitem__


def tokenizer_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


_tokenizers: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(path: str, pattern: str) -> Tokenizer:
    if (path, pattern) not in _tokenizers:
        _tokenizers[path, pattern] = Tokenizer(path, pattern)
    return _tokenizers[path, pattern]


class Counted:
    """A text with the segment tree over its pre-tokens.

    `nodes[level][k]` is [characters, pre-tokens, tokens] of the k-th node of a level; level 0 are the leaves, of which each node above has
    two. Edits keep the number of leaves; grow() builds the tree anew once a leaf has become large.
    """

    def __init__(self, text: str, tok: Tokenizer):
        self.tok, self.text = tok, text
        self.encoded = 0  # pre-tokens that edits encoded
        pre = tok.split.findall(text)
        self._build(np.array(list(map(len, pre)), np.int64), np.array(list(map(tok.count, pre)), np.int64))

    def _build(self, s: np.ndarray, c: np.ndarray) -> None:
        starts = np.arange(0, max(1, len(s)), LEAF)
        self.leaves = [(s[k : k + LEAF], c[k : k + LEAF]) for k in starts.tolist()]
        if len(s):
            level = np.stack([np.add.reduceat(s, starts), np.minimum(LEAF, len(s) - starts), np.add.reduceat(c, starts)], 1)
        else:
            level = np.zeros((1, 3), np.int64)
        self.nodes = [level]
        while len(level) > 1:
            if len(level) % 2:
                level = np.vstack([level, np.zeros((1, 3), np.int64)])
                self.nodes[-1] = level
            level = level.reshape(-1, 2, 3).sum(1)
            self.nodes.append(level)

    @property
    def tokens(self) -> int:
        return int(self.nodes[-1][0, 2])

    @property
    def pretokens(self) -> int:
        return int(self.nodes[-1][0, 1])

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character position (the last one for the end), and where that leaf begins."""
        k, start = 0, 0
        for level in range(len(self.nodes) - 2, -1, -1):
            k *= 2
            here = self.nodes[level]
            if k + 1 < len(here) and at >= start + here[k, 0] and here[k + 1, 1] > 0:
                start += int(here[k, 0])
                k += 1
        return k, start

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end]."""
        old, shift = self.text, len(new) - (end - start)
        self.text = text = old[:start] + new + old[end:]
        back = max(0, start - CONTEXT)
        a, a_start = self.find(back)
        # the boundary at or before the context, within its leaf
        inner = a_start + np.concatenate([[0], np.cumsum(self.leaves[a][0])])
        begin = int(inner[np.searchsorted(inner, back, "right") - 1])
        head = int(np.searchsorted(inner, begin))
        # boundaries behind the edit, one leaf after the other until the new split meets one
        b, b_start = self.find(end)
        sizes: list[int] = []
        counts: list[int] = []
        at = begin
        while True:
            ends = b_start + np.concatenate([[0], np.cumsum(self.leaves[b][0])])
            last = b + 1 >= len(self.leaves)
            known = set((ends[ends >= end] + shift).tolist())
            more = self._until(text, at, end + shift, known, len(text) if last else int(ends[-1]) + shift)
            sizes += more[0]
            counts += more[1]
            at = more[2]
            if at >= end + shift and (at in known or at >= len(text)):
                break
            # the new split ran over this leaf's end: what it holds is covered, the next leaf has the boundaries that may meet
            while b + 1 < len(self.leaves) and b_start + int(self.nodes[0][b, 0]) + shift < at:
                b_start += int(self.nodes[0][b, 0])
                b += 1
        ends = b_start + np.concatenate([[0], np.cumsum(self.leaves[b][0])])
        tail = int(np.searchsorted(ends, at - shift))
        first = (np.concatenate([self.leaves[a][0][:head], sizes]).astype(np.int64), np.concatenate([self.leaves[a][1][:head], counts]).astype(np.int64))
        rest = (self.leaves[b][0][tail:], self.leaves[b][1][tail:])
        if a == b:
            self._set(a, np.concatenate([first[0], rest[0]]), np.concatenate([first[1], rest[1]]))
        else:
            self._set(a, *first)
            for k in range(a + 1, b):
                self._set(k, *(np.zeros(0, np.int64),) * 2)
            self._set(b, *rest)
        if max(len(self.leaves[a][0]), len(self.leaves[b][0])) > 4 * LEAF:
            self.grow()

    def _until(self, text: str, at: int, least: int, known: set[int], most: int) -> tuple[list[int], list[int], int]:
        """Split on from a boundary until one at `least` or later is known, or `most` is reached."""
        sizes, counts = [], []
        while at < len(text) and not (at >= least and (at in known or at >= most)):
            end = self.tok.split.match(text, at).end()
            sizes.append(end - at)
            counts.append(self.tok.count(text[at:end]))
            self.encoded += 1
            at = end
        return sizes, counts, at

    def _set(self, k: int, sizes: np.ndarray, counts: np.ndarray) -> None:
        self.leaves[k] = (sizes, counts)
        self.nodes[0][k] = (sizes.sum(), len(sizes), counts.sum())
        for level in range(1, len(self.nodes)):
            k //= 2
            self.nodes[level][k] = self.nodes[level - 1][2 * k : 2 * k + 2].sum(0)

    def grow(self) -> None:
        """The tree over the present pre-tokens, without splitting or encoding any of them."""
        self._build(np.concatenate([x for x, _ in self.leaves]), np.concatenate([y for _, y in self.leaves]))


def edits(text: str) -> list[tuple[int, int, str]]:
    """The edits of the query, one after the other (start, end, new) in the text as it then is: its first 32 characters are inserted at a
    quarter, 16 are deleted at the middle, and 24 at three quarters are replaced by themselves in reverse."""
    n = len(text)
    q, h = n // 4, n // 2 + min(32, n)
    cut = min(16, n + min(32, n) - h)
    m = n + min(32, n) - cut
    t = 3 * m // 4
    after = text[:q] + text[:32] + text[q:]
    after = after[:h] + after[h + cut :]
    return [(q, q, text[:32]), (h, h + cut, ""), (t, min(m, t + 24), after[t : t + 24][::-1])]


def count_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, edited_tokens, reencoded, n_edits for rows (doc_id, text).

    n_tokens counts the text, edited_tokens what the edits above make of it; reencoded is the number of pre-tokens that the edits had to
    encode. Each row stands alone: repeated rows give repeated results, no rows none, other columns are ignored. Null or empty texts have
    no tokens, before and after. Texts count whole, however long.
    """
    files = tokenizer_files()

    def run(batch):
        tok = tokenizer(*files)
        for part in parts(batch):
            out: dict[str, list] = {k: [] for k in ("n_pretokens", "n_tokens", "edited_tokens", "reencoded", "n_edits")}
            for text in part["text"].to_pylist():
                doc = Counted(text or "", tok)
                out["n_pretokens"].append(doc.pretokens)
                out["n_tokens"].append(doc.tokens)
                changes = edits(text or "")
                for change in changes:
                    doc.edit(*change)
                out["edited_tokens"].append(doc.tokens)
                out["reencoded"].append(doc.encoded)
                out["n_edits"].append(len(changes))
            yield {"doc_id": part["doc_id"]} | out

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_pretokens long, n_tokens long, edited_tokens long, reencoded long, n_edits int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_edits(table(spark, sf_dir, "documents"))
