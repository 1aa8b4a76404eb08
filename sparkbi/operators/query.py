"""Structured group / filter / aggregate queries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from sparkbi.functions.columns import (
    compare,
    differs,
    dtype,
    equals,
    is_number,
    is_time,
    member,
    number,
    require,
    sum0,
)

AGGREGATIONS = ("sum", "mean", "count", "min", "max")
OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "in")
MAX_FILTERS, MAX_LIMIT = 20, 1000


@dataclass(frozen=True)
class Filter:
    column: str
    operator: str = "eq"
    value: Any = None

    def __post_init__(self) -> None:
        if self.operator not in OPERATORS:
            raise ValueError(f"unsupported filter operator: {self.operator}")


@dataclass(frozen=True)
class Query:
    dimension: str | None = None
    series: str | None = None
    measure: str | None = None
    aggregation: str = "sum"
    filters: Sequence[Filter] = field(default_factory=tuple)
    limit: int = 100

    def __post_init__(self) -> None:
        if self.aggregation not in AGGREGATIONS:
            raise ValueError(f"unsupported aggregation: {self.aggregation}")
        if not 1 <= self.limit <= MAX_LIMIT:
            raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
        if len(self.filters) > MAX_FILTERS:
            raise ValueError(f"at most {MAX_FILTERS} filters")


def condition(df: DataFrame, item: Filter) -> Column:
    if item.operator == "eq":
        return equals(df, item.column, item.value)
    if item.operator == "ne":
        return differs(df, item.column, item.value)
    if item.operator == "in":
        values = item.value if isinstance(item.value, (list, tuple, set)) else [item.value]
        return member(df, item.column, list(values))
    return compare(df, item.column, item.operator, item.value)


def apply_filters(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    require(df, [item.column for item in filters])
    for item in filters:
        df = df.where(condition(df, item))
    return df


def aggregate_column(df: DataFrame, aggregation: str, measure: str | None) -> Column:
    """The aggregate expression shared by queries, metrics and dashboards."""
    if aggregation == "count":
        return F.count(F.col(measure)) if measure else F.count(F.lit(1))
    if not measure:
        raise ValueError(f"{aggregation} needs a measure column")
    if aggregation in ("min", "max"):
        return (F.min if aggregation == "min" else F.max)(F.col(measure))
    if not is_number(dtype(df, measure)):
        raise ValueError(f"{aggregation} needs a numeric column, got {measure}")
    return sum0(number(df, measure)) if aggregation == "sum" else F.avg(number(df, measure))


def is_ordered(df: DataFrame, dimension: str) -> bool:
    """Numeric and time dimensions read left to right; other categories by size."""
    kind = dtype(df, dimension)
    return is_number(kind) or is_time(kind)


def query(df: DataFrame, request: Query) -> DataFrame:
    """Run a structured query.

    Returns ``value`` alone, ``category, value`` or ``category, series, value``. An ordered
    dimension sorts by category, any other by value descending; keys break ties.
    """
    require(df, [request.dimension, request.series, request.measure, *[item.column for item in request.filters]])
    value = aggregate_column(df, request.aggregation, request.measure).alias("value")
    rows = apply_filters(df, request.filters)
    if not request.dimension:
        return rows.agg(value)
    keys = [F.col(request.dimension).alias("category")]
    if request.series:
        keys.append(F.col(request.series).alias("series"))
    names = ["category", "series"][: len(keys)]
    order = [F.col(name).asc_nulls_last() for name in names]
    if not is_ordered(df, request.dimension):
        order.insert(0, F.col("value").desc_nulls_last())
    return rows.groupBy(*keys).agg(value).orderBy(*order).limit(request.limit)
