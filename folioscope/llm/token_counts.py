"""Edit-aware token counts.

A document is held as a segment tree: its leaves are runs of a few pre-tokens that are encoded independently of what
stands around them (they meet at a single space between two other characters), every node has the code points, the tokens
and the leaves of its subtree. An edit descends to the leaves that it touches; these are rewritten, merged with a neighbour
for as long as the place where they meet is no longer such a boundary, re-encoded, and the sums above them are updated. A
leaf that has grown beyond twice its size is split into a subtree, and a subtree out of balance is built anew from its
leaves, without reading their texts. The rest of the document is not read again.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.bpe import Codec, codec, independent_pieces

#: Pieces in a leaf.
LEAF = 32


class _Node:
    """A leaf with a text, or a node with two children."""

    __slots__ = ("chars", "leaves", "left", "right", "text", "tokens")

    def __init__(self, text: str = "", tokens: int = 0):
        self.left = self.right = None
        self.text, self.chars, self.tokens, self.leaves = text, len(text), tokens, 1

    def sum_up(self) -> None:
        a, b = self.left, self.right
        self.chars, self.tokens, self.leaves = a.chars + b.chars, a.tokens + b.tokens, a.leaves + b.leaves

    @property
    def lopsided(self) -> bool:
        return self.left is not None and max(self.left.leaves, self.right.leaves) > 3 * min(self.left.leaves, self.right.leaves) + 4


def _balanced(leaves: list[_Node]) -> _Node:
    while len(leaves) > 1:
        above = []
        for i in range(0, len(leaves) - 1, 2):
            node = _Node()
            node.left, node.right = leaves[i], leaves[i + 1]
            node.sum_up()
            above.append(node)
        leaves = above + leaves[len(above) * 2 :]
    return leaves[0]


class TokenTree:
    """The tokens of one document under edits."""

    def __init__(self, text: str, own: Codec, leaf: int = LEAF):
        self.own, self.leaf = own, leaf
        self.root = _balanced(self._leaves(independent_pieces(text)))
        self.reencoded = 0

    @property
    def count(self) -> int:
        return self.root.tokens

    @property
    def length(self) -> int:
        return self.root.chars

    @property
    def leaves(self) -> int:
        return self.root.leaves

    def text(self) -> str:
        return "".join(x.text for x in self._under(self.root))

    def depth(self) -> int:
        below, level = [self.root], 0
        while below := [x for n in below if n.left is not None for x in (n.left, n.right)]:
            level += 1
        return level

    def _leaves(self, pieces: list[str]) -> list[_Node]:
        groups = [pieces[i : i + self.leaf] for i in range(0, len(pieces), self.leaf)] or [[]]
        return [_Node("".join(g), self.own.count_pieces(g)) for g in groups]

    def _under(self, node: _Node) -> list[_Node]:
        """The leaves below a node, in order."""
        out, left = [], [node]
        while left:
            node = left.pop()
            if node.left is None:
                out.append(node)
            else:
                left += (node.right, node.left)
        return out

    def _at(self, place: int) -> list[_Node]:
        """The path from the root to the leaf that holds the code point at place, or to the last one."""
        path = [self.root]
        while (node := path[-1]).left is not None:
            if place >= node.left.chars:
                place -= node.left.chars
                path.append(node.right)
            else:
                path.append(node.left)
        return path

    def _put(self, path: list[_Node], new: _Node) -> None:
        """new in place of the last node of the path; sums are updated and the highest node out of balance is built anew."""
        if len(path) == 1:
            self.root = new
            return
        if path[-2].left is path[-1]:
            path[-2].left = new
        else:
            path[-2].right = new
        for node in reversed(path[:-1]):
            node.sum_up()
        for i, node in enumerate(path[:-1]):
            if node.lopsided:
                self._put(path[: i + 1], _balanced(self._under(node)))
                return

    def _drop(self, path: list[_Node]) -> str:
        """Take a leaf that is not the only one out of the tree; its text."""
        above = path[-2]
        self._put(path[:-1], above.right if above.left is path[-1] else above.left)
        return path[-1].text

    def edit(self, start: int, stop: int, new: str) -> None:
        """Put new in place of the code points from start to stop; both are clipped to the text."""
        start = min(max(start, 0), self.length)
        stop = min(max(stop, start), self.length)
        path = self._at(start)
        first = sum(n.left.chars for n, below in zip(path, path[1:], strict=False) if below is n.right)
        touched = path[-1].text
        after = first + len(touched)  # where the next leaf is, once those taken are out of the tree
        while first + len(touched) < stop:
            touched += self._drop(self._at(after))
        touched = touched[: start - first] + new + touched[stop - first :]
        while first and not _meets((path := self._at(first - 1))[-1].text, touched):
            text = self._drop(path)
            touched, first, after = text + touched, first - len(text), after - len(text)
        while after < self.length and not _meets(touched, (path := self._at(after))[-1].text):
            touched += self._drop(path)
        self.reencoded += len(touched)
        path, pieces = self._at(first), independent_pieces(touched)
        if not pieces and len(path) > 1:
            self._drop(path)
        elif len(pieces) > 2 * self.leaf:
            self._put(path, _balanced(self._leaves(pieces)))
        else:
            self._put(path, _Node(touched, self.own.count_pieces(pieces)))


def _meets(left: str, right: str) -> bool:
    """Whether two texts are encoded independently: the right one begins with one space, and no other is beside it."""
    return len(right) > 1 and right[0] == " " and not right[1].isspace() and bool(left) and not left[-1].isspace()


def edited_counts(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, n_chars_edited, n_edits, n_chars_reencoded: one row for each row of docs.

    docs has doc_id, text and edits, an array of (start, stop, new) in code points, each against the text that the ones
    before it left. A null text is empty; null edits are none; a null start is 0, a null stop the start, a null new
    nothing. Repeated rows are counted each, further columns are ignored. A map over the rows, without a shuffle.
    """

    def run(batches):
        own = codec(rank_file, pattern)
        for batch in batches:
            rows = []
            for text, edits in zip(batch["text"], batch["edits"], strict=True):
                tree = TokenTree(text or "", own)
                before, edits = tree.count, [] if edits is None else [e for e in edits if e is not None]
                for e in edits:
                    start = int(e["start"] or 0)
                    tree.edit(start, start if e["stop"] is None else int(e["stop"]), e["new"] or "")
                rows.append((before, tree.count, tree.length, len(edits), tree.reencoded))
            out = pd.DataFrame(rows, columns=["n_tokens", "n_tokens_edited", "n_chars_edited", "n_edits", "n_chars_reencoded"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    rows = docs.select(F.col("doc_id").cast("string"), "text", "edits").mapInPandas(
        run, "doc_id string, n_tokens long, n_tokens_edited long, n_chars_edited long, n_edits long, n_chars_reencoded long"
    )
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def sample_edits(text: Column, seed: Column) -> Column:
    """Four edits of any text: an insertion at a third, a deletion of six code points, a replacement across the middle and
    an appended line."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    place = F.pmod(F.xxhash64(F.coalesce(seed, F.lit(0))), n + 1)
    edit = lambda start, stop, new: F.struct(start.alias("start"), stop.alias("stop"), F.lit(new).alias("new"))
    third, middle = F.floor(n / 3), F.floor(n / 2)
    return F.array(edit(third, third, " [sic]"), edit(place, place + 6, ""), edit(middle, middle + 12, "\n1,024 "), edit(n + 64, n + 64, "\nEnd of text."))


def apply_edits(text: str, edits: Sequence[tuple[int, int, str]]) -> str:
    """The edited text, by plain slicing."""
    for start, stop, new in edits:
        start = min(max(start, 0), len(text))
        stop = min(max(stop, start), len(text))
        text = text[:start] + new + text[stop:]
    return text
