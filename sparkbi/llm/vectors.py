"""Near copies among embeddings: spherical k-means cells and blocked cosine products.

Unit vectors go to the cell of the centroid with the largest cosine. Two vectors with cosine of at
least ``threshold`` are at most ``chord`` apart, so the partner of a vector can lie in another cell
only if the vector is near the boundary: its lead over that cell's centroid is at most chord times
the distance of the two centroids. A difference of length chord rarely points straight at the
boundary if differences spread over all dimensions: its part in one direction then has standard deviation
chord / sqrt(dimensions). ``reach`` says how many of these a vector looks beyond, which misses links where
vectors differ along few directions; None, the default, takes the full chord, which misses nothing.

Cells are cut into blocks of at most ``BLOCK`` vectors, one row each in a saved table. Pairs of blocks are
met by reading that table from both sides, partition against partition, so no vector is copied, shuffled or
written for a pair: disk grows with the vectors, only the products grow with their square. A pair multiplies
the vectors of both blocks that look into the other's cell: first in single precision, with a margin above its
error, then what is left in double. A task reports link counts and one star per linked group, never the pairs:
two rows for each of its vectors at most. Equal vectors are one node with a weight, however many there are; they
are told equal by 128 bits of hash.

Vectors that are null, zero or hold null or non-finite components link with nothing; vectors of
different length do not link. A null id is kept; a component's id is its smallest non-null one.
Repeated rows are rows of their own, linked to each other. An empty table gives an empty result.
Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkbi.llm.common import join_classes, saved, ship_by_value
from sparkbi.llm.components import connected_components

BLOCK = 1024
PART = 32 * BLOCK  # vectors of a partition of the saved blocks
PAIRS_PER_BATCH = 8  # pairs of blocks that are handed to a task's Python at once
MOST_CELLS = 2048
SAMPLE_PER_CELL = 40  # at most 40 * 2048 vectors train the centroids; every vector is indexed
ROUNDS = 8
ROUNDING = 1e-9  # of leads and distances in double precision


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by the largest component first, so squares do not overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(values.reshape(len(column), -1))


def fit_centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means on a bounded sample of unit vectors, started from spread-out rows."""
    cells = min(cells, len(sample))
    centroids = sample[:: len(sample) // cells][:cells].copy()
    for _ in range(ROUNDS):
        nearest = np.argmax(sample @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(lengths > 1e-12, sums / np.maximum(lengths, 1e-12), centroids)
    return centroids


def _apart(centroids: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * centroids @ centroids.T))


def _assign(centroids: np.ndarray):
    """Task code: (id, vec, hash_a, hash_b) to (cell, hash_a, hash_b, n, least, vec); equal vectors of a batch are one row from here on."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = pa.Table.from_batches([whole.slice(start, 4096)])
                placed = batch.append_column("at", pa.array(np.arange(batch.num_rows)))
                once = placed.group_by(["hash_a", "hash_b"], use_threads=False).aggregate([("at", "min"), ("at", "count"), ("id", "min")])
                vec = batch["vec"].combine_chunks().take(once["at_min"].combine_chunks())
                cell = np.argmax(_matrix(vec) @ centroids.T, axis=1).astype(np.int32)
                columns = [pa.array(cell), *(once[name].combine_chunks() for name in ("hash_a", "hash_b", "at_count", "id_min")), vec]
                yield pa.RecordBatch.from_arrays(columns, ["cell", "hash_a", "hash_b", "n", "least", "vec"])

    return assign


def _pack(centroids: np.ndarray, chord: float, kind: type):
    """Task code: rows in the order of their cells to one row per block; ``visits`` are the cells that one of its vectors looks into."""
    apart = _apart(centroids)

    def block(rows: pa.Table) -> pa.RecordBatch:
        cell, vec = rows["cell"][0].as_py(), rows["vec"].combine_chunks()
        cosines = _matrix(vec) @ centroids.T
        visits = np.flatnonzero((cosines[:, [cell]] - cosines <= chord * apart[cell] + ROUNDING).any(axis=0)).astype(np.int32)
        raw = vec.flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes()
        whole = lambda column: pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
        lists = [whole(rows[name].combine_chunks()) for name in ("hash_a", "hash_b", "n", "least")]
        columns = [pa.array([cell], pa.int32()), pa.array([len(vec)], pa.int32()), whole(pa.array(visits)), *lists, pa.array([raw], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["cell", "size", "visits", "hash_a", "hash_b", "n", "least", "raw"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if left is None else pa.concat_tables([left, rows])
            cells = rows["cell"].to_numpy()
            starts = np.r_[0, np.flatnonzero(np.diff(cells)) + 1, len(cells)]
            for start, end in zip(starts[:-1], starts[1:], strict=True):
                last = end == len(cells)
                full = start + (end - start) // BLOCK * BLOCK if last else end  # the last cell may go on in the next batch
                for at in range(start, full, BLOCK):
                    yield block(rows.slice(at, min(BLOCK, full - at)))
                if last:
                    left = rows.slice(full, end - full)
        if left is not None and left.num_rows:
            yield block(left)

    return pack


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to one edge per node, to the smallest node that it reaches by them."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least, new = np.minimum(label[left], label[right]), label.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _linked(near: np.ndarray, left_node: np.ndarray, right_node: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Smallest node that links inside the two blocks reach, for the left and the right nodes."""
    far = np.iinfo(np.int64).max
    left_label, right_label = left_node.copy(), right_node.copy()
    while True:
        new_right = np.minimum(right_label, np.where(near, left_label[:, None], far).min(axis=0))
        new_left = np.minimum(left_label, np.where(near, new_right, far).min(axis=1))
        if same:
            new_left = new_right = np.minimum(new_left, new_right)
        if (new_left == left_label).all() and (new_right == right_label).all():
            return left_label, right_label
        left_label, right_label = new_left, new_right


class _Found:
    """Link counts and stars of a task, merged when they become many."""

    def __init__(self) -> None:
        self.counts: list[tuple[np.ndarray, np.ndarray]] = []
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, counts: list, edges: list) -> None:
        self.counts += counts
        self.edges += edges
        self.held += sum(len(node) for node, _ in counts + edges)
        if self.held > 500_000:
            self.merge()
            self.held = 0

    def merge(self) -> None:
        if self.counts:
            node, at = np.unique(np.concatenate([node for node, _ in self.counts]), return_inverse=True)
            links = np.zeros(len(node), dtype=np.int64)
            np.add.at(links, at, np.concatenate([links for _, links in self.counts]))
            self.counts = [(node, links)]
        if self.edges:
            self.edges = [_stars(np.concatenate([a for a, _ in self.edges]), np.concatenate([b for _, b in self.edges]))]

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for node, links in self.counts:
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node), pa.array(links)], ["a", "b", "links"])
        for node, label in self.edges:
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(label), pa.array(np.zeros(len(node), dtype=np.int64))], ["a", "b", "links"])


def _compare(centroids: np.ndarray, threshold: float, slack: float, kind: type):
    """Task code for pairs of blocks: link counts as (node, node, links) and stars as (node, smallest node, 0)."""
    apart, chord, dimensions, span = _apart(centroids), math.sqrt(2 - 2 * threshold), centroids.shape[1], BLOCK
    # a product of n terms of unit vectors in single precision is off by at most about n + 2 roundings
    least = threshold - (dimensions + 8) * 2.0**-23

    def opened(row: dict, side: str) -> tuple:
        unit = _unit(np.frombuffer(row[f"{side}_raw"], dtype=kind).astype(np.float64).reshape(row[f"{side}_size"], dimensions))
        return unit, row[f"{side}_cell"], row[f"{side}_block"] * span + np.arange(len(unit)), np.array(row[f"{side}_n"], dtype=np.int64)

    def lookers(unit: np.ndarray, home: int, other: int) -> np.ndarray:
        look = slack if home < other else chord  # the lower cell's vectors look as far as asked, the other side only leaves out what cannot link
        return np.flatnonzero(unit @ (centroids[home] - centroids[other]) <= look * apart[home, other] + ROUNDING)

    def pair(left: tuple, right: tuple, same: bool, found: _Found) -> None:
        (a, left_cell, left_node, left_n), (b, right_cell, right_node, right_n) = left, right
        if left_cell != right_cell:
            own, others = lookers(a, left_cell, right_cell), lookers(b, right_cell, left_cell)
            a, left_node, left_n, b, right_node, right_n = a[own], left_node[own], left_n[own], b[others], right_node[others], right_n[others]
            if not len(a) or not len(b):
                return
        maybe = a.astype(np.float32) @ b.astype(np.float32).T >= least
        if same:
            np.fill_diagonal(maybe, False)
        if not maybe.any():
            return
        own = np.flatnonzero(maybe.any(axis=1))
        others = own if same else np.flatnonzero(maybe.any(axis=0))
        near = a[own] @ b[others].T >= threshold
        if same:
            np.fill_diagonal(near, False)
        left_node, right_node = left_node[own], right_node[others]
        counts = [(left_node, near @ right_n[others])] + ([] if same else [(right_node, left_n[own] @ near)])
        labels = zip((left_node, right_node), _linked(near, left_node, right_node, same), strict=True)
        stars = list(labels)[:1] if same else labels
        found.add([(node[links > 0], links[links > 0]) for node, links in counts], [(node[node != label], label[node != label]) for node, label in stars])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, kept = _Found(), (None, None)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["left_block"] != kept[0]:
                    kept = (row["left_block"], opened(row, "left"))
                same = row["left_block"] == row["right_block"]
                pair(kept[1], kept[1] if same else opened(row, "right"), same, found)
        yield from found.rows()

    return compare


@contextmanager
def _few_rows_a_batch(spark: SparkSession) -> Iterator[None]:
    """A row is a pair of blocks here, so Python gets few at once; the session's setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(PAIRS_PER_BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _blocks(rows: DataFrame, many: int, dimensions: int, chord: float) -> tuple[DataFrame, np.ndarray]:
    """The vectors of one length as saved blocks, and the centroids of their cells; ``rows``: id, vec, hash_a, hash_b."""
    spark = rows.sparkSession
    cells = max(1, min(MOST_CELLS, math.ceil(math.sqrt(many) / 4)))
    share = min(1.0, SAMPLE_PER_CELL * cells / many)
    # equal vectors are sampled together and count once
    picked = rows.where(F.pmod("hash_a", F.lit(1 << 30)) < int(share * (1 << 30)) + 1).dropDuplicates(["hash_a", "hash_b"])
    sample = picked.select("vec").limit(2 * SAMPLE_PER_CELL * cells).toArrow().column(0).combine_chunks()
    centroids = fit_centroids(_matrix(sample), cells) if len(sample) else np.eye(1, dimensions)
    types, kind = {field.name: field.dataType.simpleString() for field in rows.schema}, np.float32 if rows.schema["vec"].dataType.elementType.typeName() == "float" else np.float64
    placed = rows.mapInArrow(_assign(centroids), f"cell int, hash_a long, hash_b long, n long, least {types['id']}, vec {types['vec']}")
    parts = max(math.ceil(many / PART), min(2 * spark.sparkContext.defaultParallelism, cells))
    order = ["cell", "hash_a", "hash_b"]
    once = placed.repartitionByRange(parts, *order).groupBy(*order).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.first("vec").alias("vec"))
    lists = f"hash_a array<long>, hash_b array<long>, n array<long>, least array<{types['id']}>"
    packed = once.sortWithinPartitions("cell").mapInArrow(_pack(centroids, chord, kind), f"cell int, size int, visits array<int>, {lists}, raw binary")
    return saved(packed.withColumn("block", F.monotonically_increasing_id())), centroids


def _links(blocks: DataFrame, centroids: np.ndarray, threshold: float, slack: float, kind: type) -> DataFrame:
    """(a, b, links) of all vectors of one length, from pairs of their blocks; saved."""
    names = ["block", "cell", "size", "visits", "n", "raw"]
    left, right = (blocks.select(*[F.col(name).alias(f"{side}_{name}") for name in names]) for side in ("left", "right"))
    low, high = F.col("left_block"), F.col("right_block")
    # each pair once, and as many of them in the task of (i, j) as in that of (j, i)
    once = (low == high) | ((F.pmod(low + high, F.lit(2)) == 0) == (low < high))
    met = (F.col("left_cell") == F.col("right_cell")) | (F.array_contains("left_visits", F.col("right_cell")) & F.array_contains("right_visits", F.col("left_cell")))
    # partition against partition, both read from the saved files: nothing is shuffled
    pairs = left.hint("shuffle_replicate_nl").join(right, once & met).drop("left_visits", "right_visits")
    with _few_rows_a_batch(blocks.sparkSession):
        return saved(pairs.mapInArrow(_compare(centroids, threshold, slack, kind), "a long, b long, links long"))


def near_vectors(table: DataFrame, threshold: float = 0.95, reach: float | None = None, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id`` and ``kept`` (whether it stands for its component)."""
    rows = table.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vec"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    usable = F.col("vec").isNotNull() & F.forall("vec", number) & F.exists("vec", lambda x: x != 0)
    usable = F.coalesce(usable, F.lit(False))
    plain = F.transform("vec", lambda x: x + F.lit(0).cast(rows.schema["vec"].dataType.elementType))  # -0.0 is 0.0
    whole = rows.where(usable).withColumns({"hash_a": F.xxhash64(plain), "hash_b": F.xxhash64(F.lit(1), plain)})
    lengths = whole.groupBy(F.size("vec").alias("length")).agg(F.approx_count_distinct("hash_a").alias("many")).collect()
    chord, kind = math.sqrt(2 - 2 * threshold), np.float32 if rows.schema["vec"].dataType.elementType.typeName() == "float" else np.float64
    node, key = F.col("block") * BLOCK + F.col("at"), F.struct("hash_a", "hash_b").alias("key")
    nodes = found = None
    for of in lengths:
        blocks, centroids = _blocks(whole.where(F.size("vec") == of.length), of.many, of.length, chord)
        blocks = blocks.withColumn("block", F.col("block") * len(lengths) + F.lit(lengths.index(of)))  # apart from those of other lengths
        slack = chord if reach is None else min(chord, reach * chord / math.sqrt(of.length))
        part = _links(blocks, centroids, threshold, slack, kind)
        listed = blocks.select("block", F.posexplode(F.arrays_zip("hash_a", "hash_b", "n", "least")).alias("at", "entry"))
        own = listed.select("block", "at", "entry.*").select(node.alias("node"), key, "n", "least")
        nodes, found = (own, part) if nodes is None else (nodes.union(own), found.union(part))
    alone = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    linked = alone.where("false")
    if nodes is not None:
        components = connected_components(found.where("a <> b").select("a", "b"))
        counted = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
        labelled = (
            nodes.join(counted, "node", "left")
            .join(components, "node", "left")
            .select("key", "n", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("root"))
        )
        groups = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
        classes = saved(labelled.join(groups, "root").select("key", "n", "n_links", "component_id"))
        linked = join_classes(whole.select("id", key), classes, "key").select("id", "n_links", "component_id")
    return linked.unionByName(alone).select(
        F.col("id").alias(id_column), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


ship_by_value(__name__)
