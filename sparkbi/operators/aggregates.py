"""Named group aggregates with the null and order rules of the data model."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sparkbi.functions.columns import as_double, dtype, is_number, number, require, sum0
from sparkbi.operators.quantiles import exact_quantiles

FUNCTIONS = (
    "sum", "mean", "count", "min", "max", "median", "std", "var",
    "nunique", "first", "last", "prod", "any", "all",
)
NEEDS_NUMBER = ("sum", "mean", "median", "std", "var", "prod", "any", "all")


def position(df: DataFrame, order_by: Sequence[str], *ties: str) -> Column:
    """A sortable struct over the order columns and ties, nulls last."""
    require(df, [*order_by, *ties])
    parts = []
    for name in dict.fromkeys([*order_by, *ties]):
        parts += [F.col(name).isNull().alias(f"no_{name}"), F.col(name).alias(name)]
    return F.struct(*parts)


def first_value(df: DataFrame, column: str, order_by: Sequence[str] | None = None, last: bool = False) -> Column:
    """First (or last) non-null value in ``order_by``; the value itself breaks ties.

    Without an order the smallest (largest) value is taken, so reruns agree.
    """
    place = F.when(F.col(column).isNotNull(), position(df, list(order_by or []), column))
    return (F.max(place) if last else F.min(place))[column]


def named_aggregate(df: DataFrame, function: str, column: str, order_by: Sequence[str] | None = None) -> Column:
    """One aggregate expression; ``median`` is handled by ``group_aggregate``."""
    value = F.col(column)
    if function == "sum":
        return sum0(number(df, column))
    if function == "mean":
        return F.avg(number(df, column))
    if function == "count":
        return F.count(value)
    if function == "min":
        return F.min(value)
    if function == "max":
        return F.max(value)
    if function == "std":
        return F.stddev_samp(number(df, column))
    if function == "var":
        return F.var_samp(number(df, column))
    if function == "nunique":
        return F.count_distinct(value)
    if function == "prod":
        return F.coalesce(F.product(number(df, column)), F.lit(1.0))
    if function == "any":
        return F.coalesce(F.bool_or(number(df, column) != 0), F.lit(False))
    if function == "all":
        return F.coalesce(F.bool_and(number(df, column) != 0), F.lit(True))
    return first_value(df, column, order_by, last=function == "last")


def group_aggregate(
    df: DataFrame, keys: Sequence[str], metrics: dict[str, str], order_by: Sequence[str] | None = None
) -> DataFrame:
    """``{column: function}`` per group; null keys form their own group."""
    keys = list(keys)
    if not keys:
        raise ValueError("group_by needs at least one column")
    require(df, [*keys, *metrics])
    for column, function in metrics.items():
        if function not in FUNCTIONS:
            raise ValueError(f"unsupported aggregate: {function}")
        if function in NEEDS_NUMBER and not is_number(dtype(df, column)):
            raise ValueError(f"{function} needs a numeric column, got {column}")
    if any(column in keys for column in metrics):
        raise ValueError("a group key cannot be aggregated")
    plain = [named_aggregate(df, f, c, order_by).alias(c) for c, f in metrics.items() if f != "median"]
    medians = [c for c, f in metrics.items() if f == "median"]
    result = df.groupBy(*keys).agg(*plain) if plain else df.select(*keys).distinct()
    for column in medians:
        values = df.select(*keys, as_double(df, column).alias(column))
        middle = exact_quantiles(values, keys, column, {"_median": 0.5}).select(
            *[F.col(key).alias(f"_{key}") for key in keys], F.col("_median").alias(column)
        )
        match = reduce(Column.__and__, [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in keys])
        result = result.join(middle, match, "left").drop(*[f"_{key}" for key in keys])
    return result.select(*keys, *metrics)
