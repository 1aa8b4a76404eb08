"""Running totals over ordered groups without ever holding one group in one task.

A plain window sends a whole group to a single task. Here rows are range-partitioned by
(group, order), so a hot group spreads over as many blocks as its size needs. Each block
is scanned on its own, block totals are carried across blocks (one small row per block),
and both parts are combined. As-of joins and the inventory fold are built on this.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sparkbi.functions.hashing import row_hash
from sparkbi.session import cut_lineage

GROUP, BLOCK = "_group", "_block"
COPIES_PER_RUN = 1_000_000


def blocked(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Tag rows with their group key and a block number that follows the order.

    Adaptive execution merges neighbouring small blocks, which keeps their order. The
    result is checkpointed: block numbers come from sampled range bounds, and two readers
    of the tags must see the same ones.
    """
    key = F.struct(*[F.col(name) for name in group]) if group else F.struct(F.lit(0).alias("all"))
    ranged = df.withColumn(GROUP, key).repartitionByRange(GROUP, *[F.col(name) for name in order])
    return cut_lineage(ranged.withColumn(BLOCK, F.spark_partition_id()))


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column] | None = None,
    peaks: dict[str, str] | None = None,
    lasts: dict[str, Column] | None = None,
    totals: dict[str, Column] | None = None,
) -> DataFrame:
    """Add running columns to ``df`` within ``group``, ordered by ``order`` ascending.

    ``sums`` include the current row, ``peaks`` name a running sum and give the highest
    value it has reached, ``lasts`` give the latest non-null value so far and ``totals``
    the sum over the whole group. The order must be unique within a group for the result
    to be repeatable.
    """
    sums, peaks, lasts, totals = sums or {}, peaks or {}, lasts or {}, totals or {}
    inputs = {**sums, **lasts, **totals}
    columns = list(df.columns)
    tagged = blocked(df.withColumns({f"_in_{name}": column for name, column in inputs.items()}), group, order)
    local = W.partitionBy(GROUP, BLOCK).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    scanned = tagged.withColumns(
        {f"_sum_{name}": F.sum(f"_in_{name}").over(local) for name in sums}
        | {f"_last_{name}": F.last(f"_in_{name}", ignorenulls=True).over(local) for name in lasts}
    ).withColumns({f"_peak_{name}": F.max(f"_sum_{of}").over(local) for name, of in peaks.items()})

    carried = _carry(scanned if peaks else tagged, order, sums, peaks, lasts, totals)
    combined = (
        {name: F.col(f"_sum_{name}") + F.col(f"_c_{name}") for name in sums}
        | {name: F.greatest(F.col(f"_peak_{name}") + F.col(f"_c_{of}"), F.col(f"_c_{name}")) for name, of in peaks.items()}
        | {name: F.coalesce(F.col(f"_last_{name}"), F.col(f"_c_{name}")) for name in lasts}
        | {name: F.col(f"_c_{name}") for name in totals}
    )
    outputs = [column.alias(name) for name, column in combined.items()]
    return scanned.join(carried, [GROUP, BLOCK]).select(*columns, *outputs)


def _carry(rows, order, sums, peaks, lasts, totals) -> DataFrame:
    """What each block inherits from the earlier blocks of its group."""
    place = F.struct(*[F.col(name) for name in order])
    per_block = rows.groupBy(GROUP, BLOCK).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(f"_in_{name}").alias(f"_b_{name}") for name in {**sums, **totals}],
        *[F.max(f"_peak_{name}").alias(f"_b_{name}") for name in peaks],
        *[F.max_by(f"_in_{name}", F.when(F.col(f"_in_{name}").isNotNull(), place)).alias(f"_b_{name}") for name in lasts],
    )
    # At most one row per block and group here, so these windows stay small for any group.
    before = W.partitionBy(GROUP).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(GROUP)
    shifted = per_block.withColumns(
        {f"_c_{name}": F.coalesce(F.sum(f"_b_{name}").over(before), F.lit(0)) for name in sums}
        | {f"_c_{name}": F.last(f"_b_{name}", ignorenulls=True).over(before) for name in lasts}
        | {f"_c_{name}": F.sum(f"_b_{name}").over(whole) for name in totals}
    ).withColumns({f"_c_{name}": F.max(F.col(f"_b_{name}") + F.col(f"_c_{of}")).over(before) for name, of in peaks.items()})
    return shifted.select(GROUP, BLOCK, *[f"_c_{name}" for name in (*sums, *peaks, *lasts, *totals)])


def numbered_copies(df: DataFrame, number: str) -> DataFrame:
    """The rows of ``df`` with ``number`` counting equal rows from 0, whatever the partitioning.

    Equal rows are counted first and written out again from their count. A row with very many
    copies is cut into runs that are dealt to different tasks before they are written out.
    """
    columns = [F.col(f"`{name}`") for name in df.columns]
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    few = counted.where(F.col("_n") <= COPIES_PER_RUN).select(*columns, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias(number))
    runs = counted.where(F.col("_n") > COPIES_PER_RUN).withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(COPIES_PER_RUN))))
    dealt = runs.repartition("_from", *columns)
    upto = F.least(F.col("_from") + COPIES_PER_RUN, F.col("_n")) - 1
    return few.unionByName(dealt.select(*columns, F.explode(F.sequence(F.col("_from"), upto)).alias(number)))


def hash_sample(df: DataFrame, size: int, seed: int) -> DataFrame:
    """Exactly ``min(size, rows)`` rows drawn uniformly, the same ones for any partitioning.

    Every copy of a row has a place drawn from a seeded hash of its content; the smallest places make the
    sample. The copies of a row are counted and never written out: places of n copies in ascending
    order are sums of exponential gaps, the k-th with rate n - k + 1, so only the first few of a row
    have to be drawn, those below a bound that leaves a little more than ``size`` places among all rows
    (fewer than ``size`` would be a deviation of ten standard errors).
    """
    columns = [F.col(f"`{name}`") for name in df.columns]
    total = df.agg(F.count(F.lit(1))).scalar()
    share = F.lit(size + 10 * math.sqrt(size) + 50) / total
    bound = F.when(share >= 1, F.lit(math.inf)).otherwise(-F.log1p(-share))
    counted = df.withColumn("_row", row_hash(df, seed)).groupBy(*columns, "_row").agg(F.count(F.lit(1)).alias("_n"))
    unit = lambda number: (F.shiftrightunsigned(F.xxhash64("_row", number), 11) + 0.5) / F.lit(2.0**53)
    gap = lambda number: -F.log(unit(number)) / (F.col("_n") - number + 1)
    first = F.lit(1).cast("long")
    reached = counted.where(gap(first) < bound)
    # no row has more places below the bound than this, up to a deviation of ten standard errors
    mean = F.col("_n") * share
    most = F.when(share >= 1, F.col("_n")).otherwise(F.least(F.col("_n"), F.ceil(mean + 10 * F.sqrt(mean) + 30)))
    places = reached.withColumn("_copy", F.explode(F.sequence(first, most.cast("long"))))
    upto = W.partitionBy(*columns, "_row").orderBy("_copy").rowsBetween(W.unboundedPreceding, W.currentRow)
    drawn = places.withColumn("_place", F.sum(gap(F.col("_copy"))).over(upto)).where(F.col("_place") < bound)
    return drawn.orderBy("_place", "_row", *columns).limit(size).select(*columns)
