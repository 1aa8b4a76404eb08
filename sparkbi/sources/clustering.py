"""Placing rows so that files cover small ranges of several columns, and leaving out files that a filter cannot match."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sparkbi.functions.columns import compare, is_number, is_time, require, typed_literal
from sparkbi.operators.query import Filter

#: Every column is cut into 2 ** BITS ranges of about equal size; the bits of all columns take turns in the place of a row.
BITS = 6
#: Bytes of a text that count for its place.
TEXT_BYTES = 6


def _as_double(column: Column, kind: T.DataType) -> Column:
    """A number in the order of the column's values; texts by their first bytes."""
    if is_number(kind):
        return column.cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if is_time(kind):
        return column.cast("timestamp").cast("double")
    digits = F.rpad(F.substring(F.hex(F.encode(column.cast("string"), "UTF-8")), 1, 2 * TEXT_BYTES), 2 * TEXT_BYTES, "0")
    return F.conv(digits, 16, 10).cast("double")


def z_place(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, str]:
    """``df`` with a number along a Z-order curve over ``columns`` and that column's name; nulls come first.

    The ranges come from one pass of approximate percentiles; the driver gets 2 ** BITS numbers per column.
    """
    require(df, columns)
    if not 1 <= len(columns) <= 63 // BITS:
        raise ValueError(f"cluster by 1 to {63 // BITS} columns")
    shares = F.array(*[F.lit(step / 2**BITS) for step in range(1, 2**BITS)])
    numbers = {f"_v{at}": _as_double(F.col(f"`{name}`"), df.schema[name].dataType) for at, name in enumerate(columns)}
    bounds = df.select(*[column.alias(name) for name, column in numbers.items()]).agg(*[F.percentile_approx(name, shares, 10_000).alias(name) for name in numbers]).first()
    placed = df.withColumns(numbers | {f"_r{at}": F.lit(0) for at in range(len(columns))})
    for bit in reversed(range(BITS)):  # binary search for the number of bounds below the value
        steps = {}
        for at in range(len(columns)):
            known = bounds[f"_v{at}"]
            if known:
                beyond = F.coalesce(F.col(f"_v{at}") > F.get(F.array(*[F.lit(x) for x in known]), F.col(f"_r{at}") + (2**bit - 1)), F.lit(False))
                steps[f"_r{at}"] = F.col(f"_r{at}") + F.when(beyond, 2**bit).otherwise(0)
        placed = placed.withColumns(steps) if steps else placed
    bits = [
        F.shiftleft(F.shiftright(F.col(f"_r{at}"), bit).bitwiseAND(F.lit(1)).cast("long"), bit * len(columns) + at) for bit in range(BITS) for at in range(len(columns))
    ]
    return placed.withColumn("_z", reduce(Column.bitwiseOR, bits)).drop(*numbers, *[f"_r{at}" for at in range(len(columns))]), "_z"


def clustered(df: DataFrame, columns: Sequence[str], files: int | None = None) -> DataFrame:
    """Rows in ranges of their place, sorted within; the number of files is left to adaptive execution unless given."""
    placed, z = z_place(df, columns)
    ranged = placed.repartitionByRange(files, z) if files else placed.repartitionByRange(z)
    return ranged.sortWithinPartitions(z).drop(z)


def _bound(column: Column, kind: T.DataType) -> Column:
    """A minimum or maximum as text that no session setting changes."""
    return (F.unix_micros(column) if isinstance(kind, T.TimestampType) else column).cast("string")


def _typed(column: Column, kind: T.DataType) -> Column:
    return F.timestamp_micros(column.cast("long")) if isinstance(kind, T.TimestampType) else column.cast(kind)


def file_ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, list]]:
    """Per file of ``df`` and column: minimum, maximum (as text) and number of nulls; a row per file reaches the driver."""
    facts = []
    for at, name in enumerate(columns):
        column, kind = F.col(f"`{name}`"), df.schema[name].dataType
        facts += [_bound(F.min(column), kind).alias(f"low{at}"), _bound(F.max(column), kind).alias(f"high{at}"), F.count_if(column.isNull()).alias(f"nulls{at}")]
    rows = df.groupBy(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file")).agg(*facts).collect()
    return {row["file"]: {name: [row[f"low{at}"], row[f"high{at}"], row[f"nulls{at}"]] for at, name in enumerate(columns)} for row in rows}


def _may_match(schema: T.StructType, item: Filter, lows: DataFrame, highs: DataFrame, nulls: Column) -> tuple[DataFrame, Column]:
    """A frame of files and the condition under which one may hold a row that passes ``item``."""
    name, kind = item.column, schema[item.column].dataType
    if item.operator in ("gt", "gte"):
        return highs, compare(highs, name, item.operator, item.value)
    if item.operator in ("lt", "lte"):
        return lows, compare(lows, name, item.operator, item.value)
    if item.operator == "ne":
        return lows, F.lit(True)
    values = item.value if item.operator == "in" and isinstance(item.value, (list, tuple, set)) else [item.value]
    found = F.lit(False)
    for value in values:
        literal = None if value is None else typed_literal(kind, value)
        if value is None:
            found = found | (nulls > 0)
        elif literal is not None:
            found = found | ((F.col(f"`{name}`") <= literal) & (F.col("_high") >= literal))
    return lows, found


def files_for(spark: SparkSession, schema: T.StructType, files: Iterable[dict[str, Any]], filters: Sequence[Filter]) -> list[str]:
    """Paths of the files that may hold rows passing all ``filters``; files without ranges of a column stay."""
    files = list(files)
    kept = {item["path"] for item in files}
    for item in filters:
        known = [(entry["path"], *entry["ranges"][item.column]) for entry in files if item.column in entry.get("ranges", {})]
        if not known:
            continue
        kind, column = schema[item.column].dataType, f"`{item.column}`"
        texts = spark.createDataFrame(known, "_path string, _low string, _high_text string, _nulls long")
        ranged = texts.select("_path", "_nulls", _typed(F.col("_high_text"), kind).alias("_high"), _typed(F.col("_low"), kind).alias("_lowest"))
        lows, highs = ranged.withColumn(item.column, F.col("_lowest")), ranged.withColumn(item.column, F.col("_high"))
        frame, condition = _may_match(schema, item, lows, highs, F.col("_nulls"))
        passing = {row["_path"] for row in frame.where(F.coalesce(condition, F.lit(False))).select("_path").collect()}
        kept -= {entry[0] for entry in known} - passing
    return sorted(kept)
