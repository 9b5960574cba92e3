"""Operator 4: edit-aware token counts.

A text splits into pre-tokens, whose lengths and token counts are kept in the leaves
of a segment tree; its root has the text's count. An edit changes the pre-tokens that it touches and a
few around them: splitting starts again at a boundary shortly before the edit and
stops at the first boundary behind it that the old text had too. Only what lies
between is encoded anew; the leaves and the sums above them are updated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealforge.llm.common import map_columns, read_table

VOCABULARY = "byte_bpe_50k.tiktoken"
CACHE = 500_000
#: Pre-tokens before an edit that are split again: the pattern looks one character ahead.
CONTEXT = 2
#: Pre-tokens of a leaf when a tree is built.
LEAF = 32

_encoders: dict = {}


class PreTokenCounts(dict):
    """Tokens of a pre-token, remembered; the memory is emptied when full."""

    def __init__(self, path: str | None = None):
        import base64

        import public_tokenizers
        import regex
        import tiktoken

        super().__init__()
        with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)

    def __missing__(self, piece: str) -> int:
        if len(self) > CACHE:
            self.clear()
        n = self[piece] = len(self.encoding.encode_ordinary(piece))
        return n


def counts_for(path: str | None = None) -> PreTokenCounts:
    if path not in _encoders:
        _encoders[path] = PreTokenCounts(path)
    return _encoders[path]


class CountTree:
    """A text with the lengths and token counts of its pre-tokens in a segment tree.

    A leaf holds a few pre-tokens in order, an inner node the sums of its two halves:
    code points, tokens, pre-tokens. Edits come one after the other, as many as there
    are. The tree is built anew when a leaf has grown many times its size.
    """

    def __init__(self, text: str, counts: PreTokenCounts):
        self.text, self.counts, self.encoded = text, counts, 0
        self.build([(len(p), counts[p]) for p in counts.pattern.findall(text)])

    def build(self, pieces: list[tuple[int, int]]) -> None:
        self.leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.nodes = [(0, 0, 0)] * self.size + [self.sums(leaf) for leaf in self.leaves] + [(0, 0, 0)] * (self.size - len(self.leaves))
        for i in range(self.size - 1, 0, -1):
            self.join(i)

    @staticmethod
    def sums(leaf: list[tuple[int, int]]) -> tuple[int, int, int]:
        return sum(n for n, _ in leaf), sum(t for _, t in leaf), len(leaf)

    def join(self, i: int) -> None:
        a, b = self.nodes[2 * i], self.nodes[2 * i + 1]
        self.nodes[i] = (a[0] + b[0], a[1] + b[1], a[2] + b[2])

    @property
    def total(self) -> int:
        return self.nodes[1][1]

    @property
    def pieces(self) -> int:
        return self.nodes[1][2]

    def leaf_at(self, offset: int) -> tuple[int, int]:
        """The leaf that holds a code point (the last one with any, beyond the end), and where it starts."""
        i, start = 1, 0
        if not self.nodes[1][0]:
            return 0, 0
        offset = max(0, min(offset, self.nodes[1][0] - 1))
        while i < self.size:
            i *= 2
            if self.nodes[i][0] <= offset - start:
                start += self.nodes[i][0]
                i += 1
        return i - self.size, start

    def split_from(self, offset: int) -> tuple[int, int, int]:
        """(leaf, index, start) of a pre-token CONTEXT before the one at an offset, or the text's first."""
        leaf, start = self.leaf_at(offset)
        k, at = 0, start
        while k < len(self.leaves[leaf]) and at + self.leaves[leaf][k][0] <= offset:
            at += self.leaves[leaf][k][0]
            k += 1
        for _ in range(CONTEXT):
            while k == 0 and leaf > 0:
                leaf -= 1
                k = len(self.leaves[leaf])
            if k == 0:
                break
            k -= 1
            at -= self.leaves[leaf][k][0]
        return leaf, k, at

    def edit(self, start: int, end: int, new: str) -> str:
        """Replace text[start:end] and bring the tree up to date; gives the new text.

        `encoded` counts the pre-tokens that were encoded for edits.
        """
        text, shift = self.text[:start] + new + self.text[end:], len(new) - (end - start)
        first, k, at = self.split_from(start)
        last, j, old = first, k, at  # the old pre-token that is compared next, and where it starts
        added, behind = [], start + len(new)
        while at < len(text):
            if at >= behind:
                while old < at - shift and last < len(self.leaves):
                    if j < len(self.leaves[last]):
                        old += self.leaves[last][j][0]
                        j += 1
                    else:
                        last, j = last + 1, 0
                if old == at - shift and old >= end:
                    break
            piece = self.counts.pattern.match(text, at).group()
            added.append((len(piece), self.counts[piece]))
            self.encoded += 1
            at += len(piece)
        else:
            last, j = len(self.leaves), 0
        self.text = text
        self.replace(first, k, last, j, added)
        return text

    def replace(self, first: int, k: int, last: int, j: int, added: list[tuple[int, int]]) -> None:
        """The pre-tokens from (first, k) to before (last, j) give way to others."""
        rest = self.leaves[last][j:] if last < len(self.leaves) else []
        if last == first:
            self.leaves[first] = self.leaves[first][:k] + added + rest
        else:
            self.leaves[first] = self.leaves[first][:k] + added
            for i in range(first + 1, min(last, len(self.leaves))):
                self.leaves[i] = []
            if last < len(self.leaves):
                self.leaves[last] = rest
        if len(self.leaves[first]) > 8 * LEAF:
            self.build([p for leaf in self.leaves for p in leaf])
            return
        touched = range(first, min(last, len(self.leaves) - 1) + 1)
        for i in touched:
            self.nodes[self.size + i] = self.sums(self.leaves[i])
        nodes = {(self.size + i) // 2 for i in touched}
        while nodes and nodes != {0}:
            for i in nodes:
                self.join(i)
            nodes = {i // 2 for i in nodes if i > 1}


def two_edits(text: str) -> list[tuple[int, int, str]]:
    """The edits of the query: the middle tenth gives way to the first twentieth, then the last fiftieth goes."""
    n, m = len(text), len(text) - (len(text) * 11 // 20 - len(text) * 9 // 20) + len(text) // 20
    return [(n * 9 // 20, n * 11 // 20, text[: n // 20]), (m - m // 50, m, "")]


def count_tokens(docs: DataFrame, edits=two_edits, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_pre_tokens, edited_tokens, encoded_pre_tokens of every row.

    edits gives a text's edits, (start, end, replacement) each, made in turn. A null
    text counts as empty and has no tokens; repeated rows get equal results, an empty
    table none, null ids stay null; a very long text counts whole; columns other than
    doc_id and text are not read.
    """

    def work(cols):
        out = {name: [] for name in ("n_tokens", "n_pre_tokens", "edited_tokens", "encoded_pre_tokens")}
        for text in cols["text"]:
            tree = CountTree(text or "", counts_for(vocabulary))
            before = tree.total, tree.pieces
            for edit in edits(text or ""):
                tree.edit(*edit)
            for name, n in zip(out, (*before, tree.total, tree.encoded)):
                out[name].append(n)
        return {"doc_id": cols["doc_id"]} | out

    return map_columns(docs.select(F.col("doc_id"), F.col("text")), work, "doc_id long, n_tokens long, n_pre_tokens long, edited_tokens long, encoded_pre_tokens long")


def op4_token_counts(spark, sf_dir):
    return count_tokens(read_table(spark, sf_dir, "documents"))
