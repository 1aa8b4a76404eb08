"""Whitening of embeddings from a covariance that is put together out of variances only.

Polarisation: var(a + b) = var(a) + var(b) + 2 cov(a, b). So one pass sums the squares of every centred
dimension and of every sum of two centred dimensions, and half the differences of these variances are the
cross-covariances. Every component c is read as the integer floor(scale * c) + shift, and all sums are exact:
values are centred on the integer nearest to their mean before they are squared, and what the mean lies beside
that integer is taken off in whole numbers. The matrix, dimensions squared in size at any number of
rows, goes to the driver for ``eigh``; the rows never do.

Rows whose vector is null or holds null or non-finite entries take no part and are not returned. Vectors
shorter than the longest one are read as if zeros followed. Repeated rows count as often as they occur, equal
vectors get equal results. A row with a null id is kept with its null id. A component
without variance (up to rounding) cannot be scaled to one and is left out, so a table of one row, or of equal
rows only, gives an empty result, as does an empty table. Equal eigenvalues come in the order that ``eigh`` gives
them. Other columns are not looked at. Very long vectors cost the square of their length, in any task and in the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sparkbi.llm.common import ship_by_value

SCALE, SHIFT = 1024, 100_000
#: Sums of whole numbers leave the tasks as decimals; longs could overflow when they are added up.
WHOLE = "decimal(38,0)"
#: Rows that are squared at once; the sums of one dimension with all others take that many longs times the dimensions.
SLICE = 2048
#: An eigenvalue below this share of the trace is rounding.
LEAST_SHARE = 1e-12


@dataclass
class Whitening:
    """What the rows are measured with: count, sums per dimension, eigenvalues and vectors, largest first."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def trace(self) -> float:
        return float(np.trace(self.covariance))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite), F.lit(False))


def whole_numbers(column: pa.Array, dimensions: int, scale: int = SCALE, shift: int = SHIFT) -> np.ndarray:
    """Vectors as a matrix of longs, zeros behind short ones; numbers beyond 2 ** 52 are refused."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    values = np.zeros((len(column), dimensions))
    values[np.arange(dimensions) < lengths[:, None]] = flat
    floored = np.floor(values * scale)
    if floored.size and np.abs(floored).max() >= 2.0**52:
        raise ValueError("a vector entry is too large for exact sums")
    return floored.astype(np.int64) + shift


def _squares(values: np.ndarray) -> list[int]:
    """Exact column sums of squares."""
    top = int(np.abs(values).max(initial=0))
    exact = values if top * top * len(values) < 2**62 else values.astype(object)
    return [int(total) for total in (exact * exact).sum(axis=0)]


def _sum_task(dimensions: int):
    """Task code: vectors to the count of rows and the sum of every dimension, a row each."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dimensions
        for batch in batches:
            if batch.num_rows:
                matrix = whole_numbers(batch.column(0), dimensions)
                n += len(matrix)
                wide = matrix if int(np.abs(matrix).max()) * len(matrix) < 2**62 else matrix.astype(object)
                sums = [old + int(new) for old, new in zip(sums, wide.sum(axis=0))]
        if n:
            totals = pa.array([Decimal(total) for total in [n, *sums]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, dimensions), pa.int32()), totals], ["i", "total"])

    return add


def _variance_task(centres: list[int]):
    """Task code: vectors to the sums of squares of every centred dimension (i, i) and of every sum of two (i, j)."""
    dimensions = len(centres)
    middle = np.array(centres, np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = False
        own, both = [0] * dimensions, [[0] * (dimensions - i - 1) for i in range(dimensions)]
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                found = True
                y = whole_numbers(whole.slice(start, SLICE).column(0), dimensions) - middle
                own = [old + new for old, new in zip(own, _squares(y))]
                for i in range(dimensions - 1):
                    both[i] = [old + new for old, new in zip(both[i], _squares(y[:, i : i + 1] + y[:, i + 1 :]))]
        if found:
            rows = [(i, i, total) for i, total in enumerate(own)]
            rows += [(i, i + 1 + step, total) for i, totals in enumerate(both) for step, total in enumerate(totals)]
            left, right, totals = zip(*rows)
            columns = [pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.array([Decimal(t) for t in totals], pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(columns, ["i", "j", "total"])

    return add


def covariance_from_variances(n: int, sums: list[int], squares: dict[tuple[int, int], int], centres: list[int]) -> np.ndarray:
    """The covariance matrix (divisor ``n``) from sums of squares around ``centres``; each entry is rounded once."""
    rest = [total - n * centre for total, centre in zip(sums, centres)]

    def spread(square: int, off: int) -> int:
        """n squared times a variance: the sum of squares around the true mean, in whole numbers."""
        return n * square - off * off

    dimensions = len(sums)
    found = np.zeros((dimensions, dimensions))
    single = [spread(squares[i, i], rest[i]) for i in range(dimensions)]
    for i in range(dimensions):
        found[i, i] = float(Fraction(single[i], n * n))
        for j in range(i + 1, dimensions):
            twice = spread(squares[i, j], rest[i] + rest[j]) - single[i] - single[j]
            found[i, j] = found[j, i] = float(Fraction(twice, 2 * n * n))
    return found


def fit_whitening(vectors: DataFrame) -> Whitening | None:
    """Measure the only column of ``vectors`` (usable vectors); None without rows or dimensions."""
    dimensions = vectors.agg(F.max(F.size(F.col(vectors.columns[0])))).first()[0]
    if not dimensions:
        return None
    added = vectors.mapInArrow(_sum_task(dimensions), f"i int, total {WHOLE}").groupBy("i").agg(F.sum("total").alias("total"))
    by_dimension = {row["i"]: int(row["total"]) for row in added.collect()}  # a row per dimension
    n, sums = by_dimension[-1], [by_dimension[i] for i in range(dimensions)]
    centres = [(2 * total + n) // (2 * n) for total in sums]
    pairs = vectors.mapInArrow(_variance_task(centres), f"i int, j int, total {WHOLE}").groupBy("i", "j").agg(F.sum("total").alias("total"))
    squares = {(row["i"], row["j"]): int(row["total"]) for row in pairs.collect()}  # a row per pair of dimensions
    covariance = covariance_from_variances(n, sums, squares, centres)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    # either sign will do; the largest entry of an axis is made positive so that reruns agree
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(dimensions)] < 0, -1.0, 1.0)
    return Whitening(n, sums, covariance, values, axes)


def _project(fit: Whitening, components: int):
    """Vectors to deviations (whole numbers) and whitened coordinates of the first ``components`` axes."""
    dimensions = len(fit.sums)
    centres = [(2 * total + fit.n) // (2 * fit.n) for total in fit.sums]
    middle = np.array(centres, np.int64)
    rest = [total - fit.n * centre for total, centre in zip(fit.sums, centres)]
    off = np.array([total / fit.n for total in rest])
    axes = fit.vectors[:, :components] / np.sqrt(fit.values[:components])

    def project(column: pa.Array) -> tuple[list[int], np.ndarray]:
        y = whole_numbers(column, dimensions) - middle
        # n * x - S in whole numbers, as objects where longs could overflow
        top = int(np.abs(y).max(initial=0)) * fit.n + fit.n
        away = (y if top * top * dimensions < 2**62 else y.astype(object)) * fit.n - np.array(rest, dtype=object if top * top * dimensions >= 2**62 else np.int64)
        return [int(total) for total in (away * away).sum(axis=1)], (y - off) @ axes

    return project


def identity_error(vectors: DataFrame, fit: Whitening, components: int) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, measured over all rows."""
    project = _project(fit, components)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(components), np.zeros((components, components))
        for batch in batches:
            if batch.num_rows:
                z = project(batch.column(0))[1]
                sums += z.sum(axis=0)
                products += z.T @ z
        cells = [(-1, i, float(sums[i])) for i in range(components)] + [(i, j, float(products[i, j])) for i in range(components) for j in range(components)]
        left, right, totals = zip(*cells)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.array(totals, pa.float64())], ["i", "j", "total"])

    added = vectors.mapInArrow(add, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))
    cell = {(row["i"], row["j"]): row["total"] / fit.n for row in added.collect()}  # a row per pair of components
    means = [cell[-1, i] for i in range(components)]
    return max(abs(cell[i, j] - means[i] * means[j] - (i == j)) for i in range(components) for j in range(components))


def whitened(table: DataFrame, components: int = 8, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """A row per usable vector and component: id, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    ``deviation`` is the exact sum over the dimensions of (n * x - S) squared, as a decimal.
    """
    rows = table.select(F.col(id_column).alias("_id"), F.col(vector_column).alias("_vec")).where(usable(F.col("_vec")))
    vectors = rows.select("_vec")
    fit = fit_whitening(vectors)
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, component int, deviation {WHOLE}, whitened double, explained double"
    kept = 0 if fit is None else min(components, int((fit.values > LEAST_SHARE * max(fit.trace, 0.0)).sum()))
    if not kept:
        nothing = rows.where(F.lit(False)).select("_id", *[F.lit(None).cast(kind).alias(name) for name, kind in (("component", "int"), ("n", "long"))])
        empty = nothing.withColumns({"deviation": F.lit(None).cast(WHOLE)} | {name: F.lit(None).cast("double") for name in ("whitened", "explained", "identity_error")})
        return empty.withColumnRenamed("_id", id_column)
    project = _project(fit, kept)
    explained = (fit.values[:kept] / fit.trace).tolist()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                away, z = project(batch.column(1))
                many = pa.array(np.repeat(np.arange(batch.num_rows), kept))
                columns = [
                    batch.column(0).take(many),
                    pa.array(np.tile(np.arange(1, kept + 1), batch.num_rows), pa.int32()),
                    pa.array([Decimal(total) for total in away], pa.decimal128(38, 0)).take(many),
                    pa.array(z.ravel()),
                    pa.array(np.tile(explained, batch.num_rows)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "component", "deviation", "whitened", "explained"])

    found = rows.mapInArrow(task, schema)
    error = identity_error(vectors, fit, kept)
    return found.select(F.col("_id").alias(id_column), "component", F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))


ship_by_value(__name__)
