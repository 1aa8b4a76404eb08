"""Token counts that survive edits: a segment tree of pre-tokens per document.

A text is cut into pre-tokens, which a byte-pair tokenizer never merges across. Leaves hold runs of
pre-tokens with their characters and tokens, inner nodes hold sums. An edit is encoded again only from
the last leaf that ends safely before it up to the first old leaf border after it that is a
pre-token border in the new text too; from there on both texts are cut alike. Only the sums above the
exchanged leaves change.

The splitting pattern looks ahead by ``AHEAD`` characters at most and never back, so a leaf that
ends that far before an edit is untouched by it.

Trees are stored as two arrays per document (characters and tokens per leaf). Nulls: a null text is an
empty one with no leaves; a null list of edits changes nothing; null parts of an edit count as 0 or
empty. Positions beyond the end are moved to it. Null ids and repeated rows are kept. An empty table
gives an empty result. Columns named as the outputs are replaced, others are kept.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparkbi.llm.common import per_worker, ship_by_value

LEAF = 64  # pre-tokens in a leaf
AHEAD = 3
MOST_PIECES = 400_000  # pre-tokens whose counts are kept at a time; the store is emptied beyond
# The splitting rule of the vocabulary files, and white space as it counts there.
BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
GENERAL = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANKS}\p{{L}}\p{{N}}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")
#: Here both patterns agree: no numbers that are not digits, no control characters that only Python takes for white space.
UNUSUAL = re.compile("[^\t-\r -~\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ɏΑ-Ωα-ώЀ-ҁҊ-ԯ‐-―‘-‟†-•…€]")


class PieceCounts(dict):
    """Tokens of each pre-token, as far as met."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as file:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
        self.encode = tiktoken.Encoding("pieces", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, piece: str) -> int:
        self[piece] = count = len(self.encode(piece.encode()))
        return count

    def cut(self, text: str, at: int = 0) -> Iterator[re.Match]:
        """Pre-tokens from ``at`` on, which must be a border of one."""
        if len(self) > MOST_PIECES:
            self.clear()
        return (GENERAL if UNUSUAL.search(text, at) else PLAIN).finditer(text, at)

    def leaves(self, text: str) -> tuple[list[int], list[int]]:
        """Characters and tokens of each leaf of a whole text."""
        if len(self) > MOST_PIECES:
            self.clear()
        pieces = (GENERAL if UNUSUAL.search(text) else PLAIN).findall(text)
        runs = [pieces[at : at + LEAF] for at in range(0, len(pieces), LEAF)]
        return [sum(map(len, run)) for run in runs], [sum(map(self.__getitem__, run)) for run in runs]


class Node:
    """A leaf or the sum of two nodes."""

    __slots__ = ("chars", "left", "leaves", "right", "tokens")

    def __init__(self, chars: int, tokens: int, left: Node | None = None, right: Node | None = None):
        self.chars, self.tokens, self.left, self.right = chars, tokens, left, right
        self.leaves = left.leaves + right.leaves if left else 1


def _joined(left: Node | None, right: Node | None) -> Node | None:
    if left is None or right is None:
        return left or right
    return Node(left.chars + right.chars, left.tokens + right.tokens, left, right)


def build(leaves: list[tuple[int, int]]) -> Node | None:
    """A balanced tree over (characters, tokens)."""
    level: list[Node] = [Node(*leaf) for leaf in leaves]
    while len(level) > 1:
        level = [_joined(*level[at : at + 2]) if at + 1 < len(level) else level[at] for at in range(0, len(level), 2)]
    return level[0] if level else None


def border_before(node: Node | None, position: int) -> tuple[int, int]:
    """Number and start of the last leaf border at or before ``position``."""
    number = start = 0
    while node is not None and node.left is not None:
        if position >= start + node.left.chars:
            number, start, node = number + node.left.leaves, start + node.left.chars, node.right
        else:
            node = node.left
    if node is not None and position >= start + node.chars:
        number, start = number + 1, start + node.chars
    return number, start


def exchanged(node: Node | None, low: int, high: int, new: list[tuple[int, int]]) -> Node | None:
    """The tree with leaves ``low`` to ``high - 1`` exchanged; nodes outside are used again."""
    if node is None or (low <= 0 and high >= node.leaves):
        return build(new)
    if node.left is None:
        before, after = (build(new), node) if high <= 0 else (node, build(new))
        return _joined(before, after)
    middle = node.left.leaves
    if high <= middle and low < middle:
        return _joined(exchanged(node.left, low, high, new), node.right)
    if low >= middle:
        return _joined(node.left, exchanged(node.right, low - middle, high - middle, new))
    return _joined(exchanged(node.left, low, middle, new), exchanged(node.right, 0, high - middle, []))


def edited(counts: PieceCounts, text: str, tree: Node | None, at: int, drop: int, put: str) -> tuple[str, Node | None, int]:
    """Text and tree after one edit, and how many characters were encoded again."""
    at = min(max(at, 0), len(text))
    drop = min(max(drop, 0), len(text) - at)
    new = text[:at] + put + text[at + drop :]
    shift = len(put) - drop
    low, start = border_before(tree, max(at - AHEAD, 0)) if at > AHEAD else (0, 0)
    safe = at + len(put)  # old borders count from here on
    end, high, leaves = start, None, []
    chars = tokens = pieces = 0
    for piece in counts.cut(new, start):
        if end >= safe:
            number, border = border_before(tree, end - shift)
            if border == end - shift and tree is not None:
                high = number
                break
        chars, tokens, pieces, end = chars + len(piece[0]), tokens + counts[piece[0]], pieces + 1, piece.end()
        if pieces == LEAF:
            leaves.append((chars, tokens))
            chars = tokens = pieces = 0
    if pieces:
        leaves.append((chars, tokens))
    if high is None:
        high = tree.leaves if tree is not None else 0
    if high == low and not leaves:
        return new, tree, 0
    return new, exchanged(tree, low, high, leaves), end - start


def leaves_of(tree: Node | None) -> list[tuple[int, int]]:
    waiting, found = [tree] if tree else [], []
    while waiting:
        node = waiting.pop()
        if node.left is None:
            found.append((node.chars, node.tokens))
        else:
            waiting += [node.right, node.left]
    return found


TREE = [T.StructField("leaf_chars", T.ArrayType(T.IntegerType())), T.StructField("leaf_tokens", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]
AGAIN = T.StructField("encoded_chars", T.LongType())
ROWS = 256  # rows whose trees are held at a time


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def _tree_columns(chars: list[list[int]], tokens: list[list[int]]) -> list[pa.Array]:
    lists = pa.list_(pa.int32())
    return [pa.array(chars, lists), pa.array(tokens, lists), pa.array([sum(own) for own in tokens], pa.int64())]


def with_trees(docs: DataFrame, tokenizer: str, text_column: str = "text") -> DataFrame:
    """``docs`` with ``leaf_chars``, ``leaf_tokens`` and ``n_tokens``. ``tokenizer``: path of a rank file on every executor."""
    kept = docs.drop(*[field.name for field in TREE])
    schema = T.StructType([*kept.schema.fields, *TREE])
    place = kept.columns.index(text_column)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = per_worker("piece_counts", tokenizer, lambda: PieceCounts(tokenizer))
        for batch in _slices(batches):
            made = [counts.leaves(text.as_py() or "") for text in batch.column(place)]
            columns = _tree_columns([chars for chars, _ in made], [tokens for _, tokens in made])
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema.names)

    return kept.mapInArrow(grow, schema)


def apply_edits(docs: DataFrame, tokenizer: str, edits: Column, text_column: str = "text") -> DataFrame:
    """``docs`` as ``with_trees`` gives them, after ``edits``: array of (at, drop, put), applied in order.

    Text and tree are replaced by the edited ones, ``n_tokens`` is the new root's sum and
    ``encoded_chars`` says how many characters were encoded again.
    """
    made = [*TREE, AGAIN]
    kept = [field for field in docs.schema.fields if field.name not in {own.name for own in made}]
    schema = T.StructType([*kept, *made])
    place = [field.name for field in kept].index(text_column)
    rows = docs.select(*[F.col(f"`{field.name}`") for field in kept], "leaf_chars", "leaf_tokens", edits.alias("_edits"))

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = per_worker("piece_counts", tokenizer, lambda: PieceCounts(tokenizer))
        for batch in _slices(batches):
            *columns, chars, tokens, lists = batch.columns
            texts, new_chars, new_tokens, encoded = [], [], [], []
            for text, own_chars, own_tokens, changes in zip(columns[place], chars, tokens, lists):
                after, again = text.as_py() or "", 0
                tree = build(list(zip(own_chars.as_py(), own_tokens.as_py())))
                for one in changes.as_py() or ():
                    after, tree, more = edited(counts, after, tree, one["at"] or 0, one["drop"] or 0, one["put"] or "")
                    again += more
                leaves = leaves_of(tree)
                texts.append(after)
                new_chars.append([leaf[0] for leaf in leaves])
                new_tokens.append([leaf[1] for leaf in leaves])
                encoded.append(again)
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *_tree_columns(new_chars, new_tokens), pa.array(encoded, pa.int64())], schema.names)

    return rows.mapInArrow(change, schema)


ship_by_value(__name__)
