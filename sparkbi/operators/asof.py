"""Backward as-of attachment: the latest known value at or before a row's time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sparkbi.functions.columns import require
from sparkbi.operators.running import running

MEASURES, QUESTIONS = 0, 1


def attach_asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    time: str,
    value: str,
    tie: Sequence[str] = (),
    name: str | None = None,
) -> DataFrame:
    """Add to ``left`` the last ``right.value`` of the same key with ``right.time <= left.time``.

    Each distinct (key, time) is asked once and answered once, so copies on either side cost
    nothing further on. Questions and answers form one ordered stream per key and the last
    value is carried forward block by block: a key of any size is spread over many tasks.
    ``tie`` orders right rows of equal time; left rows without an earlier match get null.
    """
    name = name or value
    require(left, [*keys, time])
    require(right, [*keys, time, value, *tie])
    moment = [*keys, time]
    asked = left.select(*moment).distinct().withColumn("_side", F.lit(QUESTIONS))
    place = F.struct(*[F.col(column) for column in tie], F.col(value).isNotNull().alias("_present"), F.col(value))
    latest = F.max(F.struct(place.alias("_place"), F.struct(F.col(value).alias("v")).alias("_known")))
    known = right.groupBy(*moment).agg(latest["_known"].alias("_known")).withColumn("_side", F.lit(MEASURES))
    merged = known.unionByName(asked, allowMissingColumns=True)
    carried = running(merged, keys, [time, "_side"], lasts={"_seen": F.col("_known")})
    answers = carried.where(F.col("_side") == QUESTIONS).select(
        *[F.col(column).alias(f"_k_{column}") for column in moment], F.col("_seen.v").alias(f"_v_{name}")
    )
    match = reduce(Column.__and__, [F.col(column).eqNullSafe(F.col(f"_k_{column}")) for column in moment])
    return left.join(answers, match, "left").select(*left.columns, F.col(f"_v_{name}").alias(name))
