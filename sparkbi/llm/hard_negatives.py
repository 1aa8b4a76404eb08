"""Hard negatives by exact search in a multiway hyperplane tree (GNAT).

Every row goes to the nearest of the top split points, which cuts space by hyperplanes. For each split point
and each subtree the tree knows the range of distances between them. A score window [low, high] of an
anchor is an annulus around it, because |a - x|^2 = |a|^2 + |x|^2 - 2 score; by the triangle inequality it tells
which distances to a split point are possible, and a subtree whose range does not meet them is passed over.
A subtree is cut into shards of at most about ``SHARD`` rows; a task that serves a shard
goes on splitting it in the same way down to leaves, which are compared exactly.

A search looks into the home subtree of each anchor first. Its last place there raises the low end of the window, and
with the narrower annulus the other subtrees are ruled out or visited. Anchors are searched in blocks of
the same home, so one task holds one shard and one block, whatever the sizes of labels, subtrees and anchor
sets. The split points come from a bounded sample (``SAMPLE_PER_SPLIT`` a point) and only steer the work; every row is indexed and the
result is exact.

Scores are inner products of whole numbers, floor(scale * x) for every component x. Vectors of unequal
length are read as if zeros followed the shorter ones. Rows with a null id, label or vector, or a null or non-finite
component take no part. Equal rows (id, label and vector) count once; rows that share only their id are rows of
their own, but none is the positive or negative of another. Ties go to the smaller id, then to the vector's
hash. An anchor without positives, an empty window and an empty table give no rows. Other columns
are not looked at. Very long vectors only make rows wider.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sparkbi.llm.common import broadcast_if, saved, ship_by_value

SCALE = 256
SHARD = 8192
QUERIES_PER_BLOCK = 4096
#: Top split points, at most; their ranges are the square of that many pairs of numbers, at any size of the table.
MOST_SPLITS = 256
ROWS_PER_SPLIT = 4096
SAMPLE_PER_SPLIT = 8
DEGREE, LEAF = 16, 256
#: Distances carry rounding of about 1e-16 of themselves; windows are widened by more than that.
SLACK = 1e-6
LOWEST, HIGHEST = -(2**62), 2**62
FOUND = "anchor long, other long, node long, id long, tie long, score long"


def whole(column: pd.Series, dimensions: int) -> np.ndarray:
    """Vectors of whole numbers as a float matrix, zeros behind short ones; products stay exact, see ``exact_type``."""
    matrix = np.zeros((len(column), dimensions))
    for at, vector in enumerate(column):
        matrix[at, : len(vector)] = vector
    return matrix


def exact_type(a: np.ndarray, b: np.ndarray) -> type:
    """The number type in which inner products of rows are exact: doubles below 2 ** 53 in every partial sum, else longs."""
    top = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if top >= 2.0**62:
        raise ValueError("vector entries are too large for exact scores")
    return np.float64 if top < 2.0**53 else np.int64


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    kind = exact_type(a, b)
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2.0 * (a.astype(kind, copy=False) @ b.astype(kind, copy=False).T)
    return np.sqrt(np.maximum(squares, 0))


def spread_points(points: np.ndarray, wanted: int) -> np.ndarray:
    """Positions of split points far from each other: each next one is the farthest from those before it."""
    chosen = [0]
    nearest = _distances(points, points[:1])[:, 0]
    while len(chosen) < wanted and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _distances(points, points[chosen[-1:]])[:, 0])
    return np.array(chosen)


@dataclass
class Node:
    """A leaf (rows only) or a split: its points, and per child the ranges of distances to them and of squared norms."""

    rows: np.ndarray
    points: np.ndarray | None = None
    near: np.ndarray | None = None
    far: np.ndarray | None = None
    norms: tuple[np.ndarray, np.ndarray] | None = None
    children: list[Node] = field(default_factory=list)


def plant(matrix: np.ndarray, rows: np.ndarray) -> Node:
    """The tree over ``rows`` of ``matrix``."""
    if len(rows) <= LEAF:
        return Node(rows)
    step = max(1, len(rows) // (4 * DEGREE))
    pool = rows[::step]
    points = matrix[pool[spread_points(matrix[pool], DEGREE)]]
    if len(points) == 1:
        return Node(rows)  # the pool holds one vector only
    apart = _distances(matrix[rows], points)
    home = apart.argmin(axis=1)
    parts = [np.flatnonzero(home == child) for child in range(len(points))]
    parts = [part for part in parts if len(part)]
    if len(parts) == 1:
        return Node(rows)
    squares = (matrix[rows] ** 2).sum(axis=1)
    return Node(
        rows,
        points,
        np.array([apart[part].min(axis=0) for part in parts]),
        np.array([apart[part].max(axis=0) for part in parts]),
        (np.array([squares[part].min() for part in parts]), np.array([squares[part].max() for part in parts])),
        [plant(matrix, rows[part]) for part in parts],
    )


def open_children(to_points: np.ndarray, squares: np.ndarray, low: np.ndarray, high: np.ndarray, near: np.ndarray, far: np.ndarray, norms) -> np.ndarray:
    """Which children (columns) can hold a row whose score lies in the query's window (rows).

    ``to_points``: distances of queries and split points; ``near`` and ``far``: ranges by child and point.
    """
    least, most = norms
    inner = squares[:, None] + least - 2.0 * high[:, None]
    outer = squares[:, None] + most - 2.0 * low[:, None]
    possible = outer >= -SLACK
    inner, outer = np.sqrt(np.maximum(inner, 0)), np.sqrt(np.maximum(outer, 0))
    slack = SLACK * (1 + outer)
    for point in range(to_points.shape[1]):
        at = to_points[:, point, None]
        possible &= (at - outer <= far[:, point] + slack) & (inner - at <= far[:, point] + slack) & (at + outer >= near[:, point] - slack)
    return possible


class Search:
    """The best ``places`` rows of every query so far, found leaf by leaf."""

    def __init__(self, tree_rows: pd.DataFrame, queries: pd.DataFrame, dimensions: int, places: int, same_label: bool):
        self.matrix, self.asked = whole(tree_rows.vec, dimensions), whole(queries.vec, dimensions)
        labels = pd.factorize(pd.concat([tree_rows.label, queries.label], ignore_index=True))[0]
        self.labels, self.asked_labels = labels[: len(tree_rows)], labels[len(tree_rows) :]
        self.ids, self.ties, self.nodes = (tree_rows[name].to_numpy() for name in ("id", "tie", "node"))
        self.own = queries.own.to_numpy()
        kind = exact_type(self.asked, self.matrix)
        self.numbers, self.asked_numbers = self.matrix.astype(kind, copy=False), self.asked.astype(kind, copy=False)
        # the ends of an open window are powers of two, other ends are scores: both types hold them exactly
        self.low, self.high = queries.low.to_numpy().astype(kind), queries.high.to_numpy().astype(kind)
        self.squares = (self.asked**2).sum(axis=1)
        self.same_label, self.places = same_label, places
        self.score = np.full((len(queries), places), LOWEST - 1, dtype=np.int64)
        self.row = np.full((len(queries), places), -1, dtype=np.int64)

    def visit(self, node: Node, asking: np.ndarray) -> None:
        if not len(asking):
            return
        if not node.children:
            return self._leaf(node.rows, asking)
        to_points = _distances(self.asked[asking], node.points)
        for child in range(len(node.children)):
            # windows may have narrowed in the children before
            one = slice(child, child + 1)
            norms = (node.norms[0][one], node.norms[1][one])
            low, high = self.low[asking].astype(float), self.high[asking].astype(float)
            may = open_children(to_points, self.squares[asking], low, high, node.near[one], node.far[one], norms)
            self.visit(node.children[child], asking[may[:, 0]])

    def _leaf(self, rows: np.ndarray, asking: np.ndarray) -> None:
        scores = self.asked_numbers[asking] @ self.numbers[rows].T
        some = (scores >= self.low[asking][:, None]).any(axis=1)
        who, scores = asking[some], scores[some]
        fits = (scores >= self.low[who][:, None]) & (scores <= self.high[who][:, None])
        fits &= (self.asked_labels[who][:, None] == self.labels[rows]) == self.same_label
        fits &= self.own[who][:, None] != self.ids[rows]
        some = fits.any(axis=1)
        who, scores, fits = who[some], scores[some], fits[some]
        if not len(who):
            return
        # only as many columns as the fullest query needs
        width = int(fits.sum(axis=1).max())
        places = np.argsort(~fits, axis=1, kind="stable")[:, :width]
        found = np.take_along_axis(fits, places, axis=1)
        new_score = np.where(found, np.take_along_axis(scores, places, axis=1), LOWEST - 1).astype(np.int64)
        score = np.concatenate([self.score[who], new_score], axis=1)
        row = np.concatenate([self.row[who], np.where(found, rows[places], -1)], axis=1)
        order = np.lexsort((self.ties[row], self.ids[row], -score), axis=1)[:, : self.places]
        self.score[who] = np.take_along_axis(score, order, axis=1)
        self.row[who] = np.take_along_axis(row, order, axis=1)
        # a row must now reach the last place; equal scores may still win by their id
        self.low[who] = np.maximum(self.low[who], self.score[who, -1].astype(self.low.dtype))


def _search_task(dimensions: int, places: int, same_label: bool):
    """Task code: one shard and one block of queries to the best rows of the shard for each query."""

    def search(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(block):
            return pd.DataFrame({name.split()[0]: pd.Series(dtype="int64") for name in FOUND.split(", ")})
        state = Search(shard, block, dimensions, places, same_label)
        state.visit(plant(state.matrix, np.arange(len(shard))), np.arange(len(block)))
        who, place = np.nonzero(state.row >= 0)
        row = state.row[who, place]
        return pd.DataFrame(
            {
                "anchor": block.anchor.to_numpy()[who],
                "other": block.other.to_numpy()[who],
                "node": state.nodes[row],
                "id": state.ids[row],
                "tie": state.ties[row],
                "score": state.score[who, place],
            }
        )

    return search


@dataclass
class Index:
    """The top of the tree: split points, ranges and the placed rows (subtree, shard, node, id, label, tie, vec)."""

    placed: DataFrame
    dimensions: int
    points: np.ndarray
    near: np.ndarray
    far: np.ndarray
    norms: tuple[np.ndarray, np.ndarray]


def _rows(table: DataFrame, id_column: str, vector_column: str, label: Column) -> DataFrame:
    """Distinct rows that take part: id, label, vec (whole numbers), tie."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    rows = table.select(F.col(id_column).cast("long").alias("id"), label.alias("label"), F.col(vector_column).alias("vec"))
    taking = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", finite)
    numbers = F.transform("vec", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return rows.where(F.coalesce(taking, F.lit(False))).distinct().select("id", "label", F.xxhash64("vec").alias("tie"), numbers.alias("vec"))


def build_index(rows: DataFrame) -> Index | None:
    """Place all ``rows`` under top split points from a bounded sample; None for an empty table."""
    nodes = saved(rows.withColumn("node", F.monotonically_increasing_id()))
    many, dimensions = nodes.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if not many or not dimensions:
        return None
    wanted = max(1, min(MOST_SPLITS, many // ROWS_PER_SPLIT))
    enough = SAMPLE_PER_SPLIT * wanted
    picked = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) <= int(min(1.0, 2 * enough / many) * (1 << 30))
    sample = whole(nodes.where(picked).select("vec").limit(enough).toPandas().vec, dimensions)
    points = sample[spread_points(sample, wanted)] if len(sample) else np.zeros((1, dimensions))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = _distances(whole(batch.column("vec").to_pandas(), dimensions), points).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), *batch.columns], ["subtree", *batch.schema.names])

    kinds = ", ".join(f"{item.name} {item.dataType.simpleString()}" for item in nodes.schema)
    placed = nodes.mapInArrow(place, f"subtree int, {kinds}")
    sized = saved(placed)
    shards = sized.groupBy("subtree").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"))  # a row per split point
    dealt = sized.join(F.broadcast(shards), "subtree").withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")).drop("shards")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per subtree and point the range of distances; point -1 stands for the squared norms."""
        width = len(points) + 1
        near, far = np.full((len(points), width), math.inf), np.full((len(points), width), -math.inf)
        for batch in batches:
            matrix = whole(batch.column("vec").to_pandas(), dimensions)
            home = batch.column("subtree").to_numpy()
            seen = np.concatenate([_distances(matrix, points), (matrix**2).sum(axis=1)[:, None]], axis=1)
            np.minimum.at(near, home, seen)
            np.maximum.at(far, home, seen)
        child, point = np.nonzero(np.isfinite(near))
        yield pa.RecordBatch.from_arrays(
            [pa.array(child, pa.int32()), pa.array(point, pa.int32()), pa.array(near[child, point]), pa.array(far[child, point])], ["subtree", "point", "near", "far"]
        )

    ranges = sized.mapInArrow(measure, "subtree int, point int, near double, far double").groupBy("subtree", "point").agg(F.min("near"), F.max("far"))
    near, far = np.full((len(points), len(points) + 1), math.inf), np.full((len(points), len(points) + 1), -math.inf)
    for subtree, point, least, most in ranges.collect():  # a row per pair of split points
        near[subtree, point], far[subtree, point] = least, most
    return Index(dealt, dimensions, points, near[:, :-1], far[:, :-1], (near[:, -1], far[:, -1]))


def _visits(queries: DataFrame, index: Index, first: bool) -> DataFrame:
    """A row per query and subtree to look into: the home subtree at ``first``, then all others that the ranges leave open."""
    dimensions, points, near, far, norms = index.dimensions, index.points, index.near, index.far, index.norms

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, 2048):
                batch = whole_batch.slice(start, 2048)
                asked = whole(batch.column("vec").to_pandas(), dimensions)
                to_points = _distances(asked, points)
                home = to_points.argmin(axis=1)
                at_home = np.arange(len(points)) == home[:, None]
                wanted = at_home
                if not first:
                    low, high = (batch.column(name).to_numpy().astype(float) for name in ("low", "high"))
                    wanted = open_children(to_points, (asked**2).sum(axis=1), low, high, near, far, norms) & ~at_home
                who, subtree = np.nonzero(wanted)
                columns = [pa.array(home[who], pa.int32()), pa.array(subtree, pa.int32()), *(column.take(pa.array(who)) for column in batch.columns)]
                yield pa.RecordBatch.from_arrays(columns, ["home", "subtree", *batch.schema.names])

    kinds = ", ".join(f"{item.name} {item.dataType.simpleString()}" for item in queries.schema)
    return queries.mapInArrow(visit, f"home int, subtree int, {kinds}")


def _block_of(queries: dict[int, int]) -> Column:
    """The block of a query: neighbouring homes share one until it is full, a home with more queries has several."""
    number, filled, ranges = 0, 0, []
    for home, many in queries.items():
        if filled and filled + many > QUERIES_PER_BLOCK:
            number, filled = number + 1, 0
        parts = -(-many // QUERIES_PER_BLOCK)
        ranges.append((home, number, parts))
        number, filled = (number + parts, 0) if parts > 1 else (number, filled + many)
    if not ranges:
        return F.lit(0)
    first = F.create_map(*[F.lit(x) for home, number, _ in ranges for x in (home, number)])
    parts = F.create_map(*[F.lit(x) for home, _, parts in ranges for x in (home, parts)])
    return F.element_at(first, F.col("home")) + F.pmod(F.xxhash64("anchor", "other"), F.element_at(parts, F.col("home"))).cast("int")


def _round(index: Index, queries: DataFrame, first: bool, places: int, same_label: bool) -> DataFrame:
    """The best rows per query and shard among the subtrees that this round looks into."""
    visits = saved(_visits(queries.where("low <= high"), index, first))
    counted = visits.groupBy("home").agg(F.count_distinct("anchor", "other").alias("n")).orderBy("home").collect()  # a row per split point
    blocks = visits.withColumn("block", _block_of({row["home"]: row["n"] for row in counted}))
    pairs = blocks.select("subtree", "block").distinct()
    served = index.placed.join(broadcast_if(pairs, pairs.count(), 1_000_000), "subtree")
    shards = index.placed.select("subtree", "shard").distinct()
    asked = blocks.join(broadcast_if(shards, shards.count(), 1_000_000), "subtree")
    keys = ["subtree", "shard", "block"]
    task = _search_task(index.dimensions, places, same_label)
    # toDF gives the two sides columns of their own, though both come from the same visits
    left, right = served.toDF(*served.columns), asked.toDF(*asked.columns)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(task, FOUND)


def _best(found: DataFrame, places: int) -> DataFrame:
    """The first ``places`` rows of every query; a shard sends no more than that many."""
    order = W.partitionBy("anchor", "other").orderBy(F.desc("score"), "id", "tie")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= places)


def search(index: Index, queries: DataFrame, places: int, same_label: bool) -> DataFrame:
    """The exact first ``places`` rows of every query (anchor, other, own, label, vec, low, high) with their ``rank``."""
    near = saved(_best(_round(index, queries, True, places, same_label), places))
    last = near.where(F.col("rank") == places).select("anchor", "other", F.col("score").alias("reached"))
    narrowed = queries.join(last, ["anchor", "other"], "left").withColumn("low", F.greatest("low", "reached")).drop("reached")
    rest = _round(index, narrowed, False, places, same_label)
    return _best(near.drop("rank").unionByName(rest), places)


def hard_negatives(
    table: DataFrame,
    anchors: Column,
    label: Column | None = None,
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int] = (30, 90),
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """Per anchor and positive the best rows of other labels that score ``window`` percent of the positive.

    ``anchors`` picks anchors by the column ``id``. Returns ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``,
    ``positive_score`` and ``negative_score``.
    """
    index = build_index(_rows(table, id_column, vector_column, F.col("label") if label is None else label))
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    if index is None:
        kinds = ["int" if name == "rank" else "long" for name in names]
        return table.where(F.lit(False)).select(*[F.lit(None).cast(kind).alias(name) for name, kind in zip(names, kinds)])
    asked = index.placed.where(anchors).select(F.col("node").alias("anchor"), F.col("id").alias("own"), "label", "vec")
    asked = saved(asked)
    open_window = [F.lit(-1).cast("long").alias("other"), F.lit(LOWEST).cast("long").alias("low"), F.lit(HIGHEST).cast("long").alias("high")]
    close = saved(search(index, asked.select("*", *open_window), positives, True))
    positive = close.select("anchor", F.col("node").alias("other"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # the whole scores s with window[0] * p <= 100 * s <= window[1] * p
    least, most = F.col("positive_score") * window[0], F.col("positive_score") * window[1]
    low = ((least + F.pmod(-least, F.lit(100))) / 100).cast("long")
    high = ((most - F.pmod(most, F.lit(100))) / 100).cast("long")
    asking = asked.join(positive, "anchor").withColumns({"low": low, "high": high})
    asking = saved(asking)
    hard = search(index, asking.select("anchor", "other", "own", "label", "vec", "low", "high"), negatives, False)
    facts = asking.select("anchor", "other", F.col("own").alias("anchor_id"), "positive_id", "positive_score")
    named = hard.join(facts, ["anchor", "other"])
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ship_by_value(__name__)
