"""Token counts under edits: a segment tree of pre-token runs per document, kept as a table.

:func:`counted` encodes each document once and keeps its tree: the leaves are runs
of about ``LEAF`` characters, cut at spaces where a pre-token must begin, and the
running sums of their characters and tokens give the sums of every subtree.

:func:`edited` takes kept trees and edits. An edit replaces [start, end) by a text:
the leaves that it touches, and the neighbour that its context reaches, are joined,
edited, cut anew and encoded again, and the sums on their paths to the root change.
All other leaves keep their counts; subtrees that no edit enters are never unfolded.
Its result is a table of kept trees again, so edits may follow edits.

A cut is safe if both neighbours of the space are no white space: then a pre-token
ends before it whatever else the text holds (added tokens hold no space). An edit
that ends next to a cut may change a neighbour, so a leaf whose border is within
``CONTEXT`` characters of the edit belongs to the region.

Defined results: a null text is empty (no token, one empty leaf); edits are applied
in order, offsets being those of the text as it is then, clipped to it; a null list
of edits is empty; repeated rows give repeated results; an empty table gives an
empty table. Texts of any length are read whole; the tree has one leaf per ``LEAF``
characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.tokens import ChunkEncoder
from palimpsest.session import share_package

LEAF, CONTEXT = 256, 2

KEPT = "doc_id long, text string, chars_before array<long>, tokens_before array<long>"
COUNTS = "doc_id long, n_tokens long, n_tokens_edited long, n_chars long, n_chars_edited long, n_chars_encoded long"


def safe(text: str, at: int) -> bool:
    return 0 < at < len(text) - 1 and text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()


def leaves_of(text: str, size: int = LEAF) -> list[str]:
    """The text in pieces of about ``size`` characters, each beginning at a safe space."""
    out, start = [], 0
    while len(text) - start > size:
        cut = text.find(" ", start + size)
        while cut >= 0 and not safe(text, cut):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        out.append(text[start:cut])
        start = cut
    return [*out, text[start:]]


class Kept:
    """A document's kept tree: the text and, for each leaf and the end, the characters and tokens before it."""

    def __init__(self, text: str, chars: np.ndarray, tokens: np.ndarray):
        self.text, self.chars, self.tokens = text, chars, tokens

    @classmethod
    def of(cls, text: str, encoder: ChunkEncoder, size: int = LEAF) -> Kept:
        leaves = leaves_of(text, size)
        return cls(text, running(map(len, leaves)), running(map(encoder.count, leaves)))


def running(values) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.fromiter(values, dtype=np.int64))])


class Tree:
    """Sums of characters and tokens over leaves, as a treap in leaf order: O(log n) for finding and replacing.

    A node holds one leaf and its subtrees, or stands for leaves ``low`` to ``high``
    of a kept tree until someone looks inside.
    """

    __slots__ = ("text", "tokens", "left", "right", "weight", "chars", "total", "leaves", "kept", "low", "high")

    def __init__(self, text: str, tokens: int, weight: int):
        self.text, self.tokens, self.weight = text, tokens, weight
        self.left = self.right = self.kept = None
        self.update()

    @classmethod
    def folded(cls, kept: Kept, low: int, high: int, weight: int) -> Tree | None:
        if low == high:
            return None
        node = cls.__new__(cls)
        node.kept, node.low, node.high, node.weight = kept, low, high, weight
        node.left = node.right = None
        node.chars, node.total, node.leaves = int(kept.chars[high] - kept.chars[low]), int(kept.tokens[high] - kept.tokens[low]), high - low
        return node

    def unfolded(self) -> Tree:
        """This node with its own leaf, the middle one, and folded halves."""
        if self.kept is not None:
            kept, low, high, middle = self.kept, self.low, self.high, (self.low + self.high) // 2
            self.kept = None
            self.text = kept.text[kept.chars[middle] : kept.chars[middle + 1]]
            self.tokens = int(kept.tokens[middle + 1] - kept.tokens[middle])
            self.left = Tree.folded(kept, low, middle, self.weight >> 1)
            self.right = Tree.folded(kept, middle + 1, high, self.weight >> 1)
        return self

    def update(self) -> Tree:
        chars, total, leaves = len(self.text), self.tokens, 1
        for side in (self.left, self.right):
            if side is not None:
                chars, total, leaves = chars + side.chars, total + side.total, leaves + side.leaves
        self.chars, self.total, self.leaves = chars, total, leaves
        return self


def merge(a: Tree | None, b: Tree | None) -> Tree | None:
    if a is None or b is None:
        return a or b
    if a.weight >= b.weight:
        a.unfolded()
        a.right = merge(a.right, b)
        return a.update()
    b.unfolded()
    b.left = merge(a, b.left)
    return b.update()


def split(node: Tree | None, leaves: int) -> tuple[Tree | None, Tree | None]:
    """The first ``leaves`` leaves, and the others."""
    if node is None or leaves <= 0:
        return None, node
    if leaves >= node.leaves:
        return node, None
    left = node.unfolded().left
    before = left.leaves if left is not None else 0
    if leaves <= before:
        first, node.left = split(node.left, leaves)
        return first, node.update()
    node.right, rest = split(node.right, leaves - before - 1)
    return node.update(), rest


class CountedText:
    """A text whose token count follows its edits."""

    def __init__(self, kept: Kept, encoder: ChunkEncoder, size: int = LEAF):
        self.encoder, self.size, self.encoded, self._state = encoder, size, 0, 0x2545F491
        self.root = Tree.folded(kept, 0, len(kept.chars) - 1, self._weight())

    def _weight(self) -> int:
        self._state = (self._state * 1103515245 + 12345) & 0x7FFFFFFF
        return self._state

    def _build(self, leaves: list[str]) -> Tree | None:
        root = None
        for leaf in leaves:
            self.encoded += len(leaf)
            root = merge(root, Tree(leaf, self.encoder.count(leaf), self._weight()))
        return root

    @property
    def tokens(self) -> int:
        return self.root.total

    def __len__(self) -> int:
        return self.root.chars

    def leaf_at(self, place: int) -> tuple[int, int]:
        """(number, first character) of the leaf that holds the character, the last one for the end."""
        node, number, first = self.root, 0, 0
        while True:
            if node.unfolded().left is not None:
                if place < first + node.left.chars:
                    node = node.left
                    continue
                number, first = number + node.left.leaves, first + node.left.chars
            if place < first + len(node.text) or node.right is None:
                return number, first
            number, first, node = number + 1, first + len(node.text), node.right

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces [start, end) by ``new``."""
        start = min(max(start, 0), len(self))
        end = min(max(end, start), len(self))
        low, first = self.leaf_at(max(start - CONTEXT, 0))
        high, _ = self.leaf_at(min(end + CONTEXT, max(len(self) - 1, 0)))
        before, rest = split(self.root, low)
        region, after = split(rest, high - low + 1)
        old = "".join(text for text, _, _ in walked(region))
        leaves = leaves_of(old[: start - first] + new + old[end - first :], self.size)
        if after is not None or before is not None:
            leaves = [x for x in leaves if x] or [""]
        self.root = merge(merge(before, self._build(leaves)), after)

    def kept(self) -> Kept:
        """The tree as it is now, to be kept: folded subtrees are copied as they are."""
        parts = list(walked(self.root))
        chars = np.concatenate([np.zeros(1, dtype=np.int64), *(c for _, c, _ in parts)])
        tokens = np.concatenate([np.zeros(1, dtype=np.int64), *(t for _, _, t in parts)])
        return Kept("".join(text for text, _, _ in parts), np.cumsum(chars), np.cumsum(tokens))


def walked(root: Tree | None) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(text, characters of leaves, tokens of leaves) of leaves and folded subtrees, in order."""
    waiting, node = [], root
    while waiting or node is not None:
        while node is not None and node.kept is None:
            waiting.append(node)
            node = node.left
        if node is not None:
            k, low, high = node.kept, node.low, node.high
            yield k.text[k.chars[low] : k.chars[high]], np.diff(k.chars[low : high + 1]), np.diff(k.tokens[low : high + 1])
        node = None
        if waiting:
            own = waiting.pop()
            yield own.text, np.array([len(own.text)]), np.array([own.tokens])
            node = own.right


def counted(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Kept trees, a row per row of ``docs``; to be stored, so that edits find them."""
    share_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(tokenizer_path)
        for batch in batches:
            trees = [Kept.of(text.as_py() or "", encoder) for text in batch.column(1)]
            yield kept_batch(batch.column(0), trees)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, KEPT)


def kept_batch(ids: pa.Array, trees: list[Kept]) -> pa.RecordBatch:
    lists = (pa.array([getattr(t, k) for t in trees], pa.list_(pa.int64())) for k in ("chars", "tokens"))
    return pa.RecordBatch.from_arrays([ids, pa.array([t.text for t in trees], pa.string()), *lists], [f.split()[0] for f in KEPT.split(", ")])


def kept_rows(batch: pa.RecordBatch) -> Iterator[tuple[Kept, list]]:
    """(kept tree, edits) of rows (doc_id, text, chars_before, tokens_before, edits); no list is made of the sums."""
    for text, chars, tokens, edits in zip(*(batch.column(k) for k in range(1, 5))):
        yield Kept(text.as_py(), *(x.values.to_numpy(zero_copy_only=False) for x in (chars, tokens))), edits.as_py() or []


def _with_edits(trees: DataFrame, edits: Column) -> DataFrame:
    share_package(trees.sparkSession)
    return trees.select("doc_id", "text", "chars_before", "tokens_before", edits.alias("edits"))


def _applied(kept: Kept, edits: list, encoder: ChunkEncoder) -> CountedText:
    tree = CountedText(kept, encoder)
    for e in edits:
        tree.edit(e["start"], e["end"], e["text"] or "")
    return tree


def edited(trees: DataFrame, edits: Column, tokenizer_path: str | None = None) -> DataFrame:
    """Kept trees after ``edits``: an array of (start, end, text) over the columns of ``trees``, in code points from 0, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(tokenizer_path)
        for batch in batches:
            yield kept_batch(batch.column(0), [_applied(kept, e, encoder).kept() for kept, e in kept_rows(batch)])

    return _with_edits(trees, edits).mapInArrow(run, KEPT)


def edited_counts(trees: DataFrame, edits: Column, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, n_chars, n_chars_edited, n_chars_encoded (again, for the edits), as :func:`edited` without its trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(tokenizer_path)
        for batch in batches:
            rows = []
            for kept, e in kept_rows(batch):
                tree = _applied(kept, e, encoder)
                rows.append((int(kept.tokens[-1]), tree.tokens, len(kept.text), len(tree), tree.encoded))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], [f.split()[0] for f in COUNTS.split(", ")])

    return _with_edits(trees, edits).mapInArrow(run, COUNTS)


def review_edits(text: Column) -> Column:
    """The edits of the registered query, one of each sort: a cut of seven characters at two thirds, an insertion
    in the middle of what is there at a third, a word replaced at the start, and a note at the end."""
    n = F.coalesce(F.char_length(text), F.lit(0)).cast("long")
    third = F.floor(n / 3).cast("long")

    def edit(start: Column, end: Column, new: str) -> Column:
        return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(new).alias("text"))

    far = F.lit(1 << 40)
    return F.array(edit(2 * third, 2 * third + 7, ""), edit(third, third, " (see note 1)"), edit(F.lit(0), F.lit(3), "Now"), edit(far, far, "\nChecked by hand."))
