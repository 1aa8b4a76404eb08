"""Joins in which a few keys, the null key among them, hold a large part of the left rows.

A frequent-items sketch over the left keys names every key with at least ``SHARE`` of the rows, 1 / ``SHARE`` keys at
most. Left rows of such a key are dealt over several parts, and the right rows of these keys alone are copied to
each part; all other rows join as usual. The split is part of the plan, so it does not depend on
what adaptive execution sees, and it works for null keys, which match each other here.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sparkbi.functions.columns import is_number

#: A key with this share of the left rows or more is split.
SHARE = 0.005
#: Items the sketch keeps track of; every key above 3.5 / ITEMS of the rows is certain to be among them.
ITEMS = 8192
MOST_PARTS = 256


def key_hash(df: DataFrame, names: Sequence[str]) -> Column:
    """One number per combination of keys; nulls have a place of their own.

    Numbers are hashed as doubles, so equal keys of unlike number types agree. Unlike keys with one hash are only split in vain.
    """
    parts = []
    for place, name in enumerate(names):
        column = F.col(f"`{name}`")
        parts += [F.lit(place), column.isNull(), column.cast("double") + F.lit(0.0) if is_number(df.schema[name].dataType) else column]
    return F.xxhash64(*parts)


def comparable(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str]) -> bool:
    """Whether equal keys of both sides are sure to have one hash: numbers, or columns of one type."""
    kinds = [(left.schema[l].dataType, right.schema[r].dataType) for l, r in zip(left_on, right_on)]
    return all(one == other or is_number(one) and is_number(other) for one, other in kinds)


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float = SHARE) -> dict[int, float]:
    """Hashes of the keys that hold at least ``share`` of the rows, with their share; one scan of the key columns."""
    most = int(1 / share)
    found = df.select(key_hash(df, keys).alias("key")).agg(
        F.call_function("approx_top_k", F.col("key"), F.lit(most), F.lit(ITEMS)).alias("top"), F.count(F.lit(1)).alias("rows")
    )
    row = found.first()
    return {item["item"]: item["count"] / row["rows"] for item in row["top"] or [] if item["count"] >= max(2, share * row["rows"])}


def join_split(
    left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str], how: str, heavy: dict[int, float], tasks: int
) -> DataFrame:
    """Null-safe ``left`` or ``inner`` join of frames without common column names, ``heavy`` keys split over about their share of ``tasks``."""
    match = [F.col(f"`{l}`").eqNullSafe(F.col(f"`{r}`")) for l, r in zip(left_on, right_on)]
    if not heavy or not comparable(left, right, left_on, right_on):
        return left.join(right, reduce(Column.__and__, match), how)
    # twice its share, so a part of a heavy key is no larger than half of an even task's rows
    parts = {key: max(2, min(MOST_PARTS, round(2 * share * tasks + 0.5))) for key, share in heavy.items()}
    of = F.create_map(*[F.lit(x) for item in parts.items() for x in item])
    wanted = lambda df, names: F.coalesce(F.element_at(of, key_hash(df, names)), F.lit(1))
    dealt = left.withColumn("_part", F.pmod(F.monotonically_increasing_id(), wanted(left, left_on)).cast("int"))
    copied = right.withColumn("_copy", F.explode(F.sequence(F.lit(0), wanted(right, right_on) - 1)))
    joined = dealt.join(copied, reduce(Column.__and__, match, F.col("_part") == F.col("_copy")), how)
    return joined.drop("_part", "_copy")
