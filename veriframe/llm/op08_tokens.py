"""Token counts that follow edits, with a segment tree of pre-tokens for each document.

A byte-level BPE counts tokens for each pre-token alone, so a document's count is a sum over its pre-tokens.
They stand in the leaves of a segment tree (``LEAF`` to a leaf) whose nodes hold characters and tokens of
their subtrees. An edit descends by characters to its leaves, cuts pre-tokens anew from the last border that
the edit can't have moved, and stops at the first new border behind the edit that is an old one: from there
on the text and so the pre-tokens are the old ones. Only what lies between is encoded again; the sums on the
paths above the touched leaves are updated.

Borders. A pre-token is found from its start alone; its pattern looks at most two characters past its end
(the white space that it leaves, and the character behind). So one that ends two or more characters before
an edit stays as it is.

The vocabulary is a file of a public tokenizer. Its path is a parameter; the driver reads it and ships it in a
broadcast (about a megabyte), so executors need no such file. Nothing is trained.

One narrow pass, no shuffle. Null text counts as empty (0 tokens), texts are cut and counted whole, repeated
rows give repeated rows, empty tables give empty results, other columns are ignored. Edits (start, end,
replacement) are in code points of the text, sorted and disjoint; others are an error. Null edits are none.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import slices

#: Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 32
LOOKAHEAD = 2
MEMO = 500_000


class Counter:
    """Tokens of pre-tokens, with a bounded memo."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex
        import tiktoken

        self.cut = regex.compile(pattern)
        self._bpe = tiktoken.Encoding("veriframe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._memo: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        memo = self._memo
        if len(memo) > MEMO:
            memo.clear()
        for p in set(pieces).difference(memo):
            memo[p] = len(self._bpe._encode_single_piece(p))
        return [memo[p] for p in pieces]


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of lines "token in base64, rank"."""
    if not os.path.isfile(path):
        raise FileNotFoundError(f"no vocabulary at {path}: give the path of a tokenizer's file of ranks")
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Tree:
    """Pre-tokens of one text: sizes and token counts in leaves, sums in the nodes above."""

    def __init__(self, text: str, counter: Counter):
        self.counter = counter
        pieces = counter.cut.findall(text)
        sizes, counts = list(map(len, pieces)), counter.counts(pieces)
        n = max(1, -(-len(pieces) // LEAF))
        self.width = 1 << (n - 1).bit_length()
        self.sizes = [sizes[i : i + LEAF] for i in range(0, len(sizes), LEAF)] or [[]]
        self.counts = [counts[i : i + LEAF] for i in range(0, len(counts), LEAF)] or [[]]
        ends = np.cumsum([0, *map(sum, self.sizes)]).tolist()
        self.texts = [text[a:b] for a, b in zip(ends, ends[1:])]
        self.nodes = np.zeros((2 * self.width, 2), np.int64)
        self.nodes[self.width : self.width + n] = list(zip(map(sum, self.sizes), map(sum, self.counts), strict=True))
        low = self.width
        while low > 1:
            self.nodes[low // 2 : low] = self.nodes[low : 2 * low].reshape(-1, 2, 2).sum(axis=1)
            low //= 2
        self.encoded = 0

    @property
    def chars(self) -> int:
        return int(self.nodes[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.nodes[1, 1])

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a place of the text (the last with text for its end), and the leaf's start."""
        node, start = 1, 0
        place = min(place, max(0, self.chars - 1))
        while node < self.width:
            node *= 2
            if place >= start + self.nodes[node, 0]:
                start += int(self.nodes[node, 0])
                node += 1
        return min(node - self.width, len(self.texts) - 1), start

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end]."""
        first, at = self.leaf_at(max(0, start - 2 * LOOKAHEAD))
        last, _ = self.leaf_at(max(end, start + 1))
        while first and start - at < LOOKAHEAD + 1:
            first -= 1
            at -= len(self.texts[first])
        reach = last + 1
        while not self._recut(first, min(reach, len(self.texts) - 1), start - at, end - at, new):
            reach = last + 2 * (reach - last)

    def _recut(self, first: int, last: int, start: int, end: int, new: str) -> bool:
        """Cut leaves first to last anew; False if no old border is met in them and there are more leaves."""
        sizes = [s for leaf in self.sizes[first : last + 1] for s in leaf]
        counts = [c for leaf in self.counts[first : last + 1] for c in leaf]
        borders = [0, *np.cumsum(sizes).tolist()]
        old = "".join(self.texts[first : last + 1])
        whole = last == len(self.texts) - 1 or not any(self.texts[last + 1 :])
        text = old[:start] + new + old[end:]
        shift = len(new) - (end - start)
        kept = max(0, next((i for i, b in enumerate(borders) if b > start - LOOKAHEAD), len(borders)) - 1)
        behind = {b + shift: i for i, b in enumerate(borders) if b >= end}
        place, made, meets = borders[kept], [], None
        if place == len(text):
            meets = len(sizes)
        else:
            for m in self.counter.cut.finditer(text, place):
                if m.start() in behind and m.start() >= start + len(new):
                    meets = behind[m.start()]
                    break
                if not whole and m.end() > len(text) - LOOKAHEAD:
                    return False  # it could go on in the next leaf
                made.append(m[0])
            else:
                if not whole:
                    return False
                meets = len(sizes)
        fresh = self.counter.counts(made)
        self.encoded += len(made)
        sizes = sizes[:kept] + list(map(len, made)) + sizes[meets:]
        counts = counts[:kept] + fresh + counts[meets:]
        n = last - first + 1
        cut = [len(sizes) * k // n for k in range(n + 1)]
        at = 0
        for k in range(n):
            leaf = first + k
            self.sizes[leaf], self.counts[leaf] = sizes[cut[k] : cut[k + 1]], counts[cut[k] : cut[k + 1]]
            size = sum(self.sizes[leaf])
            self.texts[leaf] = text[at : at + size]
            at += size
            self.nodes[self.width + leaf] = size, sum(self.counts[leaf])
        self._update(first, last)
        return True

    def _update(self, first: int, last: int) -> None:
        low, high = (self.width + first) // 2, (self.width + last) // 2
        while low:
            self.nodes[low : high + 1] = self.nodes[2 * low : 2 * high + 2].reshape(-1, 2, 2).sum(axis=1)
            low, high = low // 2, high // 2

    def text(self) -> str:
        return "".join(self.texts)


EDITS = "array<struct<start:int,end:int,new:string>>"
COUNTED = "doc_id long, n_chars long, n_tokens long, n_edits long, n_chars_after long, n_tokens_after long, n_pretokens_encoded_again long"


def _in_order(edits: list[tuple[int, int, str]], length: int) -> list[tuple[int, int, str]]:
    """The edits, if they are sorted, disjoint and within the text."""
    at = 0
    for start, end, _ in edits:
        if not at <= start <= end <= length:
            raise ValueError(f"edits must be sorted, disjoint and within the text of {length} characters: {start} to {end} comes after {at}")
        at = end
    return edits


def _counted(docs: DataFrame, vocabulary: str, pattern: str, edits_of) -> DataFrame:
    """COUNTED of docs (doc_id, text, perhaps edits); edits_of gives the edits of a text and its edits column."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    given = "edits" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value, pattern)
        names = [x.split()[0] for x in COUNTED.split(", ")]
        for b in slices(batches):
            rows = []
            held = b.column("edits").to_pylist() if given else [None] * b.num_rows
            for doc_id, text, own in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), held, strict=True):
                tree = Tree(text or "", counter)
                chars, tokens, edits = tree.chars, tree.tokens, _in_order(edits_of(text or "", own), len(text or ""))
                for start, end, new in reversed(edits):  # from the back: the places of those before stay
                    tree.edit(start, end, new)
                rows.append((doc_id, chars, tokens, len(edits), tree.chars, tree.tokens, tree.encoded))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return docs.mapInArrow(run, COUNTED)


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str = PATTERN) -> DataFrame:
    """Counts before and after the edits of each row of docs (doc_id, text, edits as EDITS)."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("edits").cast(EDITS).alias("edits"))
    return _counted(narrow, vocabulary, pattern, lambda text, own: [(e["start"], e["end"], e["new"] or "") for e in own or []])


def count_masked(docs: DataFrame, vocabulary: str, mask: str = r"[0-9]{4,}", new: str = "0", pattern: str = PATTERN) -> DataFrame:
    """Counts before and after every match of ``mask`` is replaced, for each row of docs (doc_id, text)."""
    found = re.compile(mask)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _counted(narrow, vocabulary, pattern, lambda text, _: [(m.start(), m.end(), new) for m in found.finditer(text)])
