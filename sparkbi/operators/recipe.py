"""Ordered cleaning steps folded into one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from sparkbi.functions.columns import (
    as_double,
    clean_nan,
    compare,
    differs,
    dtype,
    equals,
    is_number,
    is_time,
    member,
    number,
    parse_timestamp,
    require,
    row_order,
    typed_literal,
)
from sparkbi.operators.aggregates import group_aggregate
from sparkbi.operators.heavy import heavy_keys, join_split
from sparkbi.operators.quantiles import exact_quantiles

MAX_STEPS = 50
VALIDATIONS = {
    None: (False, False),
    "one_to_one": (True, True),
    "one_to_many": (True, False),
    "many_to_one": (False, True),
    "many_to_many": (False, False),
}


@dataclass(frozen=True)
class Step:
    operation: str
    config: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Context:
    """What a step may need besides its input: a row order and other datasets."""

    order_by: Sequence[str] | None = None
    lookup: Callable[[str], DataFrame] | None = None


def select(df: DataFrame, config: dict, _: Context) -> DataFrame:
    columns = list(config.get("columns", []))
    require(df, columns)
    return df.select(*columns)


def rename(df: DataFrame, config: dict, _: Context) -> DataFrame:
    mapping = dict(config.get("mapping", {}))
    require(df, mapping)
    return df.withColumnsRenamed(mapping)


def cast(df: DataFrame, config: dict, _: Context) -> DataFrame:
    column, target = config["column"], config["dtype"]
    require(df, [column])
    kind = dtype(df, column)
    value = F.col(column)
    if target == "number":
        result = value if is_number(kind) else value.try_cast("double")
    elif target == "datetime":
        if is_time(kind):
            result = value
        elif is_number(kind):
            # a bare number counts nanoseconds from the epoch
            result = F.timestamp_micros(F.floor(value / 1000).cast("long"))
        else:
            result = parse_timestamp(value)
    elif target in ("string", "category"):
        result = value.cast("string")
    else:
        raise ValueError(f"unsupported cast: {target}")
    return clean_nan(df.withColumn(column, result))


def fill_missing(df: DataFrame, config: dict, _: Context) -> DataFrame:
    column, method = config["column"], config.get("method", "value")
    require(df, [column])
    if method in ("mean", "median"):
        if not is_number(dtype(df, column)):
            raise ValueError(f"{method} needs a numeric column, got {column}")
        values = df.select(as_double(df, column).alias("v"))
        if method == "mean":
            stand_in = values.agg(F.avg("v"))
        else:
            stand_in = exact_quantiles(values, [], "v", {"median": 0.5})
        return df.withColumn(column, F.coalesce(F.col(column).cast("double"), stand_in.scalar()))
    if method == "mode":
        # Counting per value first keeps the work spread out; the top row is the smallest of the ties.
        counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
        top = counted.orderBy(F.col("_n").desc(), F.col(column).asc()).limit(1).select(column)
        return df.withColumn(column, F.coalesce(F.col(column), top.scalar()))
    value = config.get("value")
    if value is None:
        raise ValueError("a constant fill needs a value")
    literal = typed_literal(dtype(df, column), value)
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value) if literal is None else literal))


def drop_missing(df: DataFrame, config: dict, _: Context) -> DataFrame:
    columns = list(config.get("columns", []))
    require(df, columns)
    return df.na.drop("any", subset=columns or df.columns)


def drop_duplicates(df: DataFrame, config: dict, context: Context) -> DataFrame:
    keys = list(config.get("columns", [])) or list(df.columns)
    keep = config.get("keep", "first")
    require(df, keys)
    if keep in (False, "none"):
        rest = [name for name in df.columns if name not in keys]
        # A group of one has one possible "first" row, so no order is involved.
        row = [F.first(F.struct(*rest)).alias("_row")] if rest else []
        alone = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *row).where(F.col("_n") == 1)
        return alone.select(*keys, *(["_row.*"] if rest else [])).select(*df.columns)
    if keep not in ("first", "last"):
        raise ValueError(f"unsupported keep: {keep}")
    if set(keys) == set(df.columns):
        return df.dropDuplicates()
    order = row_order(df, context.order_by, descending=keep == "last")
    # Filtering on row number 1 lets every task drop its surplus copies before the shuffle.
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def filter_rows(df: DataFrame, config: dict, _: Context) -> DataFrame:
    column, operator, value = config["column"], config["operator"], config.get("value")
    require(df, [column])
    if operator == "contains":
        return df.where(F.col(column).cast("string").contains(F.lit(str(value))))
    if operator == "in":
        if not isinstance(value, (list, tuple, set)):
            raise ValueError("the in filter needs a list of values")
        return df.where(member(df, column, list(value)))
    if operator == "eq":
        return df.where(equals(df, column, value) if value is not None else F.lit(False))
    if operator == "ne":
        return df.where(differs(df, column, value) if value is not None else F.lit(True))
    if operator in ("gt", "gte", "lt", "lte") and isinstance(dtype(df, column), T.StringType):
        text, bound = F.col(column), F.lit(str(value))
        at_least, at_most = text >= bound, text <= bound
        return df.where({"gt": ~at_most, "gte": at_least, "lt": ~at_least, "lte": at_most}[operator])
    return df.where(compare(df, column, operator, value))


def calculate(df: DataFrame, config: dict, _: Context) -> DataFrame:
    left, right, operator, target = config["left"], config["right"], config["operator"], config["target"]
    require(df, [left, right if isinstance(right, str) else None])
    kinds = [dtype(df, left), *([dtype(df, right)] if isinstance(right, str) else [])]
    if operator == "add" and all(isinstance(kind, T.StringType) for kind in kinds) and len(kinds) == 2:
        return df.withColumn(target, F.concat(F.col(left), F.col(right)))
    a = number(df, left) if is_number(kinds[0]) else F.col(left)
    b = (number(df, right) if is_number(kinds[1]) else F.col(right)) if len(kinds) == 2 else F.lit(right)
    if operator == "divide":
        return df.withColumn(target, F.try_divide(a.cast("double"), b.cast("double")))
    if operator == "add":
        result = F.try_add(a, b)
    elif operator == "subtract":
        result = F.try_subtract(a, b)
    elif operator == "multiply":
        result = F.try_multiply(a, b)
    else:
        raise ValueError(f"unsupported calculation: {operator}")
    return df.withColumn(target, result)


def aggregate(df: DataFrame, config: dict, context: Context) -> DataFrame:
    keys = list(config.get("group_by", []))
    table = group_aggregate(df, keys, dict(config.get("metrics", {})), context.order_by)
    return table.orderBy(*[F.col(key).asc_nulls_last() for key in keys])


def pivot(df: DataFrame, config: dict, context: Context) -> DataFrame:
    """One row per index value and one column per key; null indexes and keys drop out."""
    index, columns, values = config["index"], config["columns"], config["values"]
    require(df, [index, columns, values])
    present = df.where(F.col(index).isNotNull() & F.col(columns).isNotNull())
    cells = group_aggregate(present, [index, columns], {values: config.get("aggfunc", "sum")}, context.order_by)
    known = config.get("pivot_values")
    cells = cells.where(F.col(values).isNotNull())
    table = cells.groupBy(index).pivot(columns, list(known) if known else None).agg(F.max(values))
    fill = config.get("fill_value", 0)
    if fill is not None:
        made = [name for name in table.columns if name != index]
        table = table.select(index, *[F.coalesce(F.col(f"`{name}`"), F.lit(fill)).alias(name) for name in made])
    return table.orderBy(index)


def _check_unique(df: DataFrame, keys: Sequence[str], side: str) -> None:
    doubled = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    if not doubled.isEmpty():
        raise ValueError(f"join keys are not unique on the {side} side")


def join(df: DataFrame, config: dict, context: Context) -> DataFrame:
    """Left or inner join on key pairs; null keys match, name clashes get ``_right``.

    ``split_heavy`` looks for keys with a large share of the left rows first and splits these over tasks.
    """
    left_on = list(config.get("left_on", []))
    right_on = list(config.get("right_on", left_on))
    how, validate = config.get("how", "left"), config.get("validate")
    if not left_on or len(left_on) != len(right_on):
        raise ValueError("join needs the same number of keys on both sides")
    if how not in ("left", "inner"):
        raise ValueError("only left and inner joins are supported")
    if validate not in VALIDATIONS:
        raise ValueError(f"unsupported join validation: {validate}")
    if context.lookup is None:
        raise ValueError("a join step needs a dataset lookup")
    require(df, left_on)
    right = context.lookup(str(config["right_dataset_id"]))
    require(right, right_on)
    for side, frame, keys, needed in zip(("left", "right"), (df, right), (left_on, right_on), VALIDATIONS[validate]):
        if needed:
            _check_unique(frame, keys, side)

    merged = {r for l, r in zip(left_on, right_on) if l == r}
    final = {name: f"{name}_right" if name in df.columns and name not in merged else name for name in right.columns}
    clash = [new for name, new in final.items() if name not in merged and new != name and new in {*df.columns, *right.columns}]
    if clash:
        raise ValueError(f"columns would appear twice: {', '.join(clash)}")
    # Unique temporary names keep both sides addressable while joining.
    moved = right.select(*[F.col(f"`{name}`").alias(f"_r_{name}") for name in right.columns])
    kept = [F.col(f"`_r_{name}`").alias(new) for name, new in final.items() if name not in merged]
    heavy = heavy_keys(df, left_on) if config.get("split_heavy") else {}
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = join_split(df, moved, left_on, [f"_r_{name}" for name in right_on], how, heavy, tasks)
    return joined.select(*[F.col(f"`{name}`") for name in df.columns], *kept)


OPERATIONS: dict[str, Callable[[DataFrame, dict, Context], DataFrame]] = {
    "select": select,
    "rename": rename,
    "cast": cast,
    "fill_missing": fill_missing,
    "drop_missing": drop_missing,
    "drop_duplicates": drop_duplicates,
    "filter": filter_rows,
    "calculate": calculate,
    "aggregate": aggregate,
    "pivot": pivot,
    "join": join,
}


def apply_step(
    df: DataFrame,
    operation: str,
    config: dict[str, Any],
    order_by: Sequence[str] | None = None,
    lookup: Callable[[str], DataFrame] | None = None,
) -> DataFrame:
    if operation not in OPERATIONS:
        raise ValueError(f"unsupported step: {operation}")
    return OPERATIONS[operation](df, config, Context(order_by, lookup))


def build_recipe(
    df: DataFrame,
    steps: Sequence[Step],
    order_by: Sequence[str] | None = None,
    lookup: Callable[[str], DataFrame] | None = None,
) -> DataFrame:
    """Fold 1 to 50 steps into one plan. ``order_by`` applies while its columns exist."""
    if not 1 <= len(steps) <= MAX_STEPS:
        raise ValueError(f"a recipe has 1 to {MAX_STEPS} steps")
    for step in steps:
        order = [entry for entry in order_by or [] if entry.partition(" ")[0] in df.columns]
        df = df.transform(apply_step, step.operation, step.config, order, lookup)
    return df
