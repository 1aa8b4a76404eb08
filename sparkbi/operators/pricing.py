"""Price per unit of each feature: non-negative ridge, least squares and a bootstrap interval.

Rows never leave the tasks. Each task reduces its rows to weighted Gram sums, one small row
per bootstrap replicate; Spark adds them up and only p-by-p systems are solved.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from sparkbi.functions.columns import as_double, require
from sparkbi.functions.hashing import row_hash
from sparkbi.operators.running import numbered_copies

# The functions below run inside tasks; they travel with the job, so executors need only numpy and pandas.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_BOOTSTRAP, MAX_BOOTSTRAP = 20, 2000
REPLICATES_AT_ONCE = 100
POISSON_CDF = np.cumsum([np.exp(-1.0) / f for f in np.cumprod([1.0, *range(1, 16)])])


def _weights(hashes: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) weights that depend only on row content, replicate and seed."""
    with np.errstate(over="ignore"):
        step = np.uint64(0x9E3779B97F4A7C15)
        mixed = hashes.astype(np.uint64)[:, None] + (replicates.astype(np.uint64) + np.uint64(seed) * np.uint64(2**20))[None, :] * step
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed = mixed ^ (mixed >> np.uint64(31))
    uniform = (mixed >> np.uint64(11)).astype(np.float64) / 2.0**53
    drawn = np.searchsorted(POISSON_CDF, uniform, side="right").astype(np.float64)
    drawn[:, replicates == 0] = 1.0  # replicate 0 is the data itself
    return drawn


def _moments(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the upper triangle of [1, features, target]."""
    return np.triu_indices(width + 2)


def _partial_sums(features: Sequence[str], target: str, bootstrap: int, seed: int):
    rows, columns = _moments(len(features))
    names = [f"g{index}" for index in range(len(rows))]

    def reduce_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((bootstrap + 1, len(rows)))
        for batch in batches:
            data = np.column_stack([np.ones(len(batch)), batch[[*features, target]].to_numpy(dtype=float)])
            products = data[:, rows] * data[:, columns]
            for start in range(0, bootstrap + 1, REPLICATES_AT_ONCE):
                block = np.arange(start, min(start + REPLICATES_AT_ONCE, bootstrap + 1))
                sums[block] += _weights(batch["_hash"].to_numpy(), block, seed).T @ products
        yield pd.DataFrame(sums, columns=names).assign(replicate=np.arange(bootstrap + 1))

    return reduce_task, names


def non_negative(gram: np.ndarray, moment: np.ndarray, sweeps: int = 20_000, tolerance: float = 1e-12) -> np.ndarray:
    """Minimise w'Gw/2 - m'w over w >= 0 for a stack of systems, by coordinate descent.

    Raises when ``sweeps`` do not reach the ``tolerance``.
    """
    solution = np.zeros_like(moment)
    diagonal = np.einsum("bjj->bj", gram)
    largest = 0.0
    for _ in range(sweeps):
        largest = 0.0
        for j in range(moment.shape[1]):
            gap = moment[:, j] - np.einsum("bk,bk->b", gram[:, j, :], solution)
            safe = np.where(diagonal[:, j] > 0, diagonal[:, j], 1.0)
            updated = np.where(diagonal[:, j] > 0, np.maximum(0.0, solution[:, j] + gap / safe), 0.0)
            largest = max(largest, float(np.max(np.abs(updated - solution[:, j]) / (1.0 + np.abs(updated)))))
            solution[:, j] = updated
        if largest < tolerance:
            return solution
    raise ArithmeticError(f"no convergence in {sweeps} sweeps: last change {largest:.1e}")


def _solver(features: Sequence[str], names: list[str], alpha: float):
    width = len(features)
    rows, columns = _moments(width)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            full = np.zeros((len(batch), width + 2, width + 2))
            full[:, rows, columns] = full[:, columns, rows] = batch[names].to_numpy()
            count = np.maximum(full[:, 0, 0], 1e-300)
            inner = slice(1, width + 1)
            gram, moment = full[:, inner, inner], full[:, inner, -1]
            mean_x, mean_y = full[:, 0, inner] / count[:, None], full[:, 0, -1] / count
            centred = gram - count[:, None, None] * mean_x[:, :, None] * mean_x[:, None, :]
            against = moment - count[:, None] * mean_x * mean_y[:, None]
            ridge = non_negative(centred + alpha * np.eye(width), against)
            plain = np.full_like(ridge, np.nan)
            base = batch["replicate"].to_numpy() == 0
            if base.any():
                plain[base] = non_negative(gram[base], moment[base])
            yield pd.DataFrame(
                {
                    "replicate": np.repeat(batch["replicate"].to_numpy(), width),
                    "stat": np.tile(np.asarray(features, dtype=object), len(batch)),
                    "ridge": ridge.ravel(),
                    "nnls": plain.ravel(),
                }
            )

    return solve


def price_model(
    items: DataFrame,
    features: Sequence[str],
    target: str = "total_gold",
    alpha: float = 10.0,
    bootstrap: int = 200,
    seed: int = 42,
    row_key: Sequence[str] | None = None,
    references: DataFrame | None = None,
) -> DataFrame:
    """One row per feature with its ridge and least-squares price and 95 % interval.

    Rows with a positive target count; features without any mass are left out; at least two
    more rows than features are needed. ``row_key`` names the columns that identify a row
    for resampling (all columns by default). ``references`` adds ``reference_prices``.
    """
    if not MIN_BOOTSTRAP <= bootstrap <= MAX_BOOTSTRAP:
        raise ValueError(f"bootstrap must be between {MIN_BOOTSTRAP} and {MAX_BOOTSTRAP}")
    require(items, [*features, target, *(row_key or [])])
    key = items.select(*(row_key or items.columns))
    data = items.where(F.col(target) > 0).select(
        *[F.coalesce(as_double(items, name), F.lit(0.0)).alias(name) for name in features],
        as_double(items, target).alias(target),
        row_hash(key).alias("_row"),
    )
    # Equal rows are drawn each on its own, so they need different hashes.
    data = numbered_copies(data, "_copy").withColumn("_hash", F.xxhash64("_row", "_copy"))
    # The mass of each feature over all items decides whether it takes part.
    masses = items.agg(
        F.count_if(F.col(target) > 0).alias("rows"), *[F.sum(F.abs(as_double(items, name))).alias(name) for name in features]
    ).first()
    used = [name for name in features if (masses[name] or 0) > 0]
    if not used or masses["rows"] < len(used) + 2:
        raise ValueError("too few items for the price model")

    reduce_task, names = _partial_sums(used, target, bootstrap, seed)
    schema = ", ".join(f"{name} double" for name in names) + ", replicate long"
    partial = data.select(*used, target, "_hash").mapInPandas(reduce_task, schema)
    sums = partial.groupBy("replicate").agg(*[F.sum(name).alias(name) for name in names])
    solved = sums.mapInPandas(_solver(used, names, alpha), "replicate long, stat string, ridge double, nnls double")
    drawn = F.when(F.col("replicate") > 0, F.col("ridge"))
    base = F.col("replicate") == 0
    # At most MAX_BOOTSTRAP values per feature reach these percentiles.
    table = solved.groupBy("stat").agg(
        F.max(F.when(base, F.col("ridge"))).alias("ridge_gold_per_unit"),
        F.max(F.when(base, F.col("nnls"))).alias("nnls_gold_per_unit"),
        F.percentile(drawn, 0.025).alias("ci95_low"),
        F.percentile(drawn, 0.975).alias("ci95_high"),
    )
    if references is None:
        table = table.withColumn("reference_gold_per_unit", F.lit(None).cast("double"))
    else:
        table = table.join(references.select("stat", "reference_gold_per_unit"), "stat", "left")
    return table.select(
        "stat",
        "reference_gold_per_unit",
        "ridge_gold_per_unit",
        "nnls_gold_per_unit",
        "ci95_low",
        "ci95_high",
        F.lit(masses["rows"]).cast("long").alias("sample_items"),
    )
