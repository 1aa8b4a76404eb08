"""Null, type and order rules used by every operator.

The rules: a float NaN counts as null, sums over nothing are 0, nulls sort last in
both directions, ``ne`` keeps nulls, failed casts give null instead of an error, and
anything that depends on row order takes an explicit order.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Text layouts accepted besides the ISO forms Spark parses by itself.
TIMESTAMP_LAYOUTS = (
    "yyyy/MM/dd",
    "yyyy/MM/dd HH:mm",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy.MM.dd",
    "yyyy.MM.dd HH:mm:ss",
    "MM/dd/yyyy",
    "MM/dd/yyyy HH:mm:ss",
)

ORDER_SUFFIXES = ("asc", "desc")


def require(df: DataFrame, columns: Iterable[str | None]) -> None:
    """Raise ``ValueError`` naming every requested column that ``df`` lacks."""
    missing = sorted({name for name in columns if name and name not in df.columns})
    if missing:
        raise ValueError(f"unknown columns: {', '.join(missing)}")


def dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_number(kind: T.DataType) -> bool:
    """Booleans count as numbers, as they do in the data model."""
    return isinstance(kind, (T.NumericType, T.BooleanType))


def is_time(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))


def clean_nan(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every float column, so no later step has to care."""
    floats = {
        field.name: F.nanvl(F.col(f"`{field.name}`"), F.lit(None).cast(field.dataType))
        for field in df.schema.fields
        if isinstance(field.dataType, (T.FloatType, T.DoubleType))
    }
    return df.withColumns(floats) if floats else df


def number(df: DataFrame, name: str) -> Column:
    """A column usable in arithmetic: booleans become 0/1, text is tried as a double."""
    kind = dtype(df, name)
    if isinstance(kind, T.BooleanType):
        return F.col(name).cast("int")
    if isinstance(kind, T.NumericType):
        return F.col(name)
    return F.col(name).try_cast("double")


def as_double(df: DataFrame, name: str) -> Column:
    """``number`` widened to double, with negative zero folded into zero."""
    return number(df, name).cast("double") + F.lit(0.0)


def sum0(column: Column) -> Column:
    """Sum that is 0, not null, when there is nothing to add."""
    return F.coalesce(F.sum(column), F.lit(0))


def parse_timestamp(column: Column) -> Column:
    """Text to timestamp over the ISO forms and ``TIMESTAMP_LAYOUTS``; bad text is null."""
    return F.coalesce(
        F.try_to_timestamp(column),
        *[F.try_to_timestamp(column, F.lit(layout)) for layout in TIMESTAMP_LAYOUTS],
    )


def to_time(df: DataFrame, name: str) -> Column:
    return F.col(name) if is_time(dtype(df, name)) else parse_timestamp(F.col(name).cast("string"))


def typed_literal(kind: T.DataType, value: Any) -> Column | None:
    """``value`` as a literal of the column's own type, or ``None`` if it has no such form.

    Casting the literal rather than the column keeps the predicate pushable to Parquet.
    """
    if isinstance(kind, T.StringType):
        return F.lit(str(value))
    if isinstance(kind, T.BooleanType):
        known = {True: True, False: False, "True": True, "False": False}
        return F.lit(known[value]) if value in known else None
    if isinstance(kind, T.NumericType):
        return _number_literal(kind, value)
    if is_time(kind):
        try:
            moment = value if isinstance(value, (date, datetime)) else datetime.fromisoformat(str(value))
        except ValueError:
            return None
        return F.lit(moment.isoformat()).cast(kind)
    return F.lit(value).cast(kind)


def _number_literal(kind: T.DataType, value: Any) -> Column | None:
    if isinstance(value, bool):
        value = int(value)
    try:
        parsed = value if isinstance(value, int) else float(value)
    except (TypeError, ValueError):
        return None
    if isinstance(parsed, float) and not math.isfinite(parsed):
        return None
    if isinstance(kind, T.IntegralType):
        if parsed != int(parsed):
            return None
        return F.lit(int(parsed)).cast("long") if abs(int(parsed)) < 2**63 else None
    if isinstance(kind, T.DecimalType):
        return F.lit(str(value)).cast(kind)
    return F.lit(float(parsed))


def equals(df: DataFrame, name: str, value: Any) -> Column:
    """Typed equality that is never null; a null ``value`` matches null cells."""
    if value is None:
        return F.col(name).isNull()
    literal = typed_literal(dtype(df, name), value)
    return F.lit(False) if literal is None else F.col(name) == literal


def differs(df: DataFrame, name: str, value: Any) -> Column:
    """Complement of ``equals``: null cells differ from every non-null value."""
    if value is None:
        return F.col(name).isNotNull()
    literal = typed_literal(dtype(df, name), value)
    return F.lit(True) if literal is None else ~F.col(name).eqNullSafe(literal)


def member(df: DataFrame, name: str, values: Sequence[Any]) -> Column:
    """Typed ``IN``; a null in the list matches null cells."""
    kind = dtype(df, name)
    literals = [typed_literal(kind, value) for value in values if value is not None]
    known = [literal for literal in literals if literal is not None]
    hit = F.col(name).isin(known) if known else F.lit(False)
    return hit | F.col(name).isNull() if any(value is None for value in values) else hit


def compare(df: DataFrame, name: str, operator: str, value: Any) -> Column:
    """``gt``/``gte``/``lt``/``lte`` against a literal; null cells never pass."""
    kind = dtype(df, name)
    column = F.col(name)
    if is_time(kind):
        bound = typed_literal(kind, value)
        if bound is None:
            raise ValueError(f"{value!r} is not a time")
    elif isinstance(kind, T.IntegralType) and float(value) == int(float(value)):
        bound = F.lit(int(float(value)))
    else:
        column = number(df, name)
        bound = F.lit(float(value))
    return _order(column, operator, bound)


def _order(column: Column, operator: str, bound: Column) -> Column:
    if operator == "gt":
        return column > bound
    if operator == "gte":
        return column >= bound
    if operator == "lt":
        return column < bound
    if operator == "lte":
        return column <= bound
    raise ValueError(f"unsupported filter operator: {operator}")


def row_order(df: DataFrame, order_by: Sequence[str] | None = None, descending: bool = False) -> list[Column]:
    """A total order over rows: ``order_by`` first, then every other sortable column.

    Entries read ``"name"`` or ``"name desc"``; nulls come last. ``descending`` reverses
    the whole order, so "last" is the exact mirror of "first".
    """
    parts: list[tuple[str, bool]] = []
    for entry in order_by or []:
        name, _, suffix = entry.partition(" ")
        if suffix and suffix not in ORDER_SUFFIXES:
            raise ValueError(f"unknown sort direction: {suffix}")
        require(df, [name])
        parts.append((name, suffix == "desc"))
    named = {name for name, _ in parts}
    parts += [
        (field.name, False)
        for field in df.schema.fields
        if field.name not in named and not isinstance(field.dataType, (T.MapType, T.VariantType))
    ]
    result = []
    for name, is_desc in parts:
        column = F.col(f"`{name}`")
        forward = column.desc_nulls_last() if is_desc else column.asc_nulls_last()
        mirror = column.asc_nulls_first() if is_desc else column.desc_nulls_first()
        result.append(mirror if descending else forward)
    return result
