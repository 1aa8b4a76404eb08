"""Average ranks in place: one range partitioning, one sort, no join.

Rows are placed by (group, value) in sorted partitions, which are read in blocks of a fixed number of rows, so
a task holds one block however large its partition. A first pass over the blocks notes, for each, the
weights of its first and last group and value; that is two small rows per block, from which the driver tells
what every block inherits and what follows it. A second pass over the same blocks then ranks the rows where
they are. A group, or a single value, with a third of all rows is spread over as many blocks as it needs.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F

from sparkbi.session import cut_lineage

#: Rows of a block: a task holds some ten times their bytes, and the driver two rows for each.
BLOCK_ROWS = 100_000

#: Weights at the ends of a block, for groups and for values: of the first and of the last one, and whether they are the same one.
ENDS = "part int, block int, level int, first_sum long, last_sum long, alone boolean"


def _changes(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Positions at which a row differs from the one before in any of ``names``; 0 is the first."""
    differs = np.zeros(len(table), bool)
    differs[:1] = True
    for name in names:
        column = table.column(name).combine_chunks()
        here, before = column.slice(1), column.slice(0, len(column) - 1)
        unequal = pc.fill_null(pc.not_equal(here, before), False).to_numpy(zero_copy_only=False)
        nulls = pc.is_null(column).to_numpy(zero_copy_only=False)
        differs[1:] |= unequal | (nulls[1:] != nulls[:-1])
    return np.flatnonzero(differs)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of a partition in their order, ``size`` at a time, however they are batched."""
    held, rows = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - rows)
            batch = batch.slice(part.num_rows)
            held.append(part)
            rows += part.num_rows
            if rows == size:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _ends(keys: Sequence[str], value: str, schema: str, size: int):
    """Task code: a block to a row for its groups and one for its values, with the keys at both ends."""
    names = [*keys, value]
    columns = [part.split()[0].strip("`") for part in schema.split(", ")]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in enumerate(_blocks(batches, size)):
            weight = table.column("_weight").to_numpy()
            rows = []
            for level, own in enumerate((keys, names)):
                starts = _changes(table, own)
                rows.append((TaskContext.get().partitionId(), block, level, int(weight[: (*starts, len(weight))[1]].sum()), int(weight[starts[-1] :].sum()), len(starts) == 1))
            edges = [column.take(pa.array([place] * 2)) for place in (0, len(table) - 1) for column in table.select(names).columns]
            part, number, level, *sums = [pa.array(column) for column in zip(*rows)]
            arrays = [part.cast(pa.int32()), number.cast(pa.int32()), level.cast(pa.int32()), *sums, *[edge.combine_chunks() for edge in edges]]
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return ends


def _carried(found: list[dict[str, Any]], names: Sequence[str]) -> dict[tuple[int, int], tuple[int, int]]:
    """Per partition and block the weight of its first key in earlier blocks and of its last key in later ones."""
    carry: dict[tuple[int, int], tuple[int, int]] = {}
    before: dict[str, Any] | None = None
    inherited = 0
    for row in found:
        same = before is not None and all(before[f"_last_{name}"] == row[f"_first_{name}"] for name in names)
        inherited = (before["last_sum"] + (inherited if before["alone"] else 0)) if same else 0
        carry[row["part"], row["block"]] = (inherited, 0)
        before = row
    after, following = None, 0
    for row in reversed(found):
        same = after is not None and all(after[f"_first_{name}"] == row[f"_last_{name}"] for name in names)
        following = (after["first_sum"] + (following if after["alone"] else 0)) if same else 0
        place = row["part"], row["block"]
        carry[place] = (carry[place][0], following)
        after = row
    return carry


def _sums(weight: np.ndarray, starts: np.ndarray, carry: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Per key of a block its weight over all blocks, and the row each key starts at."""
    sums = np.add.reduceat(weight, starts)
    sums[0] += carry[0]
    sums[-1] += carry[1]
    return sums, np.diff(np.r_[starts, len(weight)])


def _ranked(table: pa.Table, group: Sequence[str], names: Sequence[str], of_group: tuple[int, int], of_value: tuple[int, int], prefix: str) -> list[pa.RecordBatch]:
    """One block with its ranks, given what its first and last group and value have elsewhere."""
    weights = table.column("_weight").to_numpy().astype(np.int64)
    groups, values = _changes(table, group), _changes(table, names)
    totals, group_rows = _sums(weights, groups, of_group)
    same, value_rows = _sums(weights, values, of_value)
    upto = np.cumsum(weights) - weights
    # what the group has before the value's first row here, less what of the value lies in earlier blocks
    start = np.repeat(upto[groups], group_rows)[values]
    before = upto[values] - start
    inherited = np.where(np.searchsorted(groups, values, side="right") == 1, of_group[0], 0)
    before = before + inherited
    before[0] -= of_value[0]
    opens = np.zeros(len(weights), bool)
    opens[values] = True
    opens[0] = of_value[0] == 0
    spread = [np.repeat(before, value_rows), np.repeat(same, value_rows), np.repeat(totals, group_rows)]
    made = [*spread, spread[0] + (spread[1] + 1) / 2, opens]
    columns = table.drop_columns(["_weight"])
    for name, array in zip(("before", "same", "total", "rank", "opens"), made):
        columns = columns.append_column(f"{prefix}{name}", pa.array(array))
    return columns.combine_chunks().to_batches()


def with_ranks(df: DataFrame, group: Sequence[str], value: str, weight: str, ties: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """The rows of ``df`` and, with ``prefix`` before their names, for each row's value within its group:

    ``before`` (weight of smaller values), ``same`` (of equal values), ``total`` (of the group), ``rank`` (the average
    rank of its copies) and ``opens`` (true in one row of each value). ``weight`` counts copies; ``ties`` spread the
    rows of one value over several blocks.
    """
    placed = df.withColumn("_weight", F.col(weight).cast("long"))
    order = [F.col(name) for name in dict.fromkeys([*group, value, *ties])]
    blocks = cut_lineage(placed.repartitionByRange(*order).sortWithinPartitions(*order))
    size = BLOCK_ROWS
    kinds = {field.name: field.dataType.simpleString() for field in df.schema.fields}
    names = [*group, value]
    schema = ", ".join([ENDS, *[f"`_{end}_{name}` {kinds[name]}" for end in ("first", "last") for name in names]])
    found = [row.asDict() for row in blocks.mapInArrow(_ends(group, value, schema, size), schema).orderBy("part", "block").collect()]  # two rows per block
    by_group = _carried([row for row in found if row["level"] == 0], group)
    by_value = _carried([row for row in found if row["level"] == 1], names)

    by_part: dict[int, list[tuple[tuple[int, int], tuple[int, int]]]] = {}
    for place, carry in by_group.items():  # by rising block
        by_part.setdefault(place[0], []).append((carry, by_value[place]))
    carried = blocks.sparkSession.sparkContext.broadcast(by_part)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in enumerate(_blocks(batches, size)):
            of_group, of_value = carried.value[TaskContext.get().partitionId()][block]
            yield from _ranked(table, group, names, of_group, of_value, prefix)

    out = ", ".join([*[f"`{name}` {kind}" for name, kind in kinds.items()], f"{prefix}before long, {prefix}same long, {prefix}total long, {prefix}rank double, {prefix}opens boolean"])
    return blocks.mapInArrow(rank, out)


# task code goes with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
