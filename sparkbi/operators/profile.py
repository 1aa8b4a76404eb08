"""Column profiles and semantic types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparkbi.functions.columns import is_number, is_time, number, parse_timestamp

# Name parts that mark a text column as a possible date.
DATE_WORDS = ("date", "time", "timestamp", "일자", "날짜")

IDENTIFIER_RATIO, PARSE_RATIO, TEXT_LENGTH = 0.98, 0.9, 80
LONG_VALUE = 64


def _text(field: T.StructField) -> Column:
    """A column as text; equal values give equal text, so distinct counts carry over."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return (column + F.lit(0.0).cast(field.dataType)).cast("string")
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.when(column.isNotNull(), F.to_json(F.struct(column)))
    return column.cast("string")


def _looks_dated(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.StringType) and any(word in field.name.lower() for word in DATE_WORDS)


def _column_summary(df: DataFrame, field: T.StructField) -> dict[str, Column]:
    """The aggregates one column needs; all columns share a single scan."""
    column, text = F.col(f"`{field.name}`"), _text(field)
    needed = {
        "present": F.count(column),
        # Repeatable samples whatever the row order: both ends and one picked by hash.
        "least": F.min(text),
        "most": F.max(text),
        "picked": F.min_by(text, F.when(column.isNotNull(), F.xxhash64(text))),
    }
    if isinstance(field.dataType, T.StringType):
        needed["length"] = F.avg(F.length(text))
    if _looks_dated(field):
        needed["parsed"] = F.avg(F.when(column.isNotNull(), parse_timestamp(column).isNotNull().cast("int")))
    if is_number(field.dataType):
        value = number(df, field.name).cast("double")
        needed |= {"low": F.min(value), "high": F.max(value), "mean": F.avg(value)}
    return needed


def _summaries(df: DataFrame) -> DataFrame:
    aggregates, rows = [F.count(F.lit(1)).alias("rows")], []
    for index, field in enumerate(df.schema.fields):
        needed = _column_summary(df, field)
        aggregates += [column.alias(f"{part}{index}") for part, column in needed.items()]
        known = lambda part, kind="double": F.col(f"{part}{index}") if part in needed else F.lit(None).cast(kind)
        samples = F.array(*[F.col(f"{part}{index}") for part in ("picked", "least", "most")])
        rows.append(
            F.struct(
                F.lit(index).alias("position"),
                F.lit(field.name).alias("name"),
                F.lit(field.dataType.simpleString()).alias("dtype"),
                F.lit(is_number(field.dataType)).alias("numeric"),
                F.lit(is_time(field.dataType)).alias("timed"),
                F.col("rows"),
                F.col(f"present{index}").alias("present"),
                *[known(part).alias(part) for part in ("length", "parsed", "low", "high", "mean")],
                F.col(f"least{index}").alias("early"),
                F.col(f"most{index}").alias("late"),
                F.array_compact(F.array_distinct(samples)).alias("samples"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def _distinct_counts(df: DataFrame, approximate: bool) -> DataFrame:
    """Exact distinct counts of every column in long form: one shuffle for all columns.

    Long texts are compared by SHA-256, so the shuffle carries digests, not documents.
    """
    fields = df.schema.fields
    if approximate:
        counted = df.agg(*[F.approx_count_distinct(_text(f)).alias(f"u{i}") for i, f in enumerate(fields)])
        rows = [F.struct(F.lit(i).alias("position"), F.col(f"u{i}").alias("unique")) for i in range(len(fields))]
        return counted.select(F.inline(F.array(*rows)))
    cells = F.array(*[F.struct(F.lit(i).alias("position"), _text(f).alias("value")) for i, f in enumerate(fields)])
    long = df.select(F.inline(cells)).where(F.col("value").isNotNull())
    compact = F.when(F.length("value") > LONG_VALUE, F.sha2("value", 256)).otherwise(F.col("value"))
    return long.select("position", compact.alias("value")).distinct().groupBy("position").agg(F.count(F.lit(1)).alias("unique"))


def _semantic() -> Column:
    """The type rules, first match wins."""
    name = F.lower("name")
    share = F.col("unique") / F.greatest(F.col("present"), F.lit(1))
    levels = F.least(F.lit(50), F.greatest(F.lit(10), F.floor(F.greatest(F.col("present"), F.lit(1)) * 0.2)))
    identifier = (name == "id") | name.endswith("_id") | ((share > IDENTIFIER_RATIO) & name.contains("id"))
    few_levels = (F.col("unique") <= levels) & (F.col("length") < TEXT_LENGTH)
    return (
        F.when(identifier, "identifier")
        .when(F.col("timed") | (F.col("parsed") >= PARSE_RATIO), "datetime")
        .when(F.col("numeric"), "numeric")
        .when(few_levels, "categorical")
        .otherwise("text")
    )


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: type, semantic type, nulls, distinct count, samples, range.

    ``minimum``, ``maximum`` and ``mean`` are filled for numeric columns, ``earliest`` and
    ``latest`` for datetime ones. ``approximate`` trades exact distinct counts for a sketch.
    """
    known = _summaries(df).join(_distinct_counts(df, approximate), "position", "left")
    typed = known.withColumn("unique", F.coalesce("unique", F.lit(0))).withColumn("semantic_type", _semantic())
    if_type = lambda kind, column: F.when(F.col("semantic_type") == kind, F.col(column))
    missing = F.col("rows") - F.col("present")
    return typed.select(
        "position",
        "name",
        "dtype",
        "semantic_type",
        F.col("rows").alias("row_count"),
        missing.alias("null_count"),
        F.round(F.coalesce(F.try_divide(missing.cast("double"), F.col("rows")), F.lit(0.0)), 6).alias("null_ratio"),
        F.col("unique").alias("unique_count"),
        F.col("samples").alias("sample_values"),
        if_type("numeric", "low").alias("minimum"),
        if_type("numeric", "high").alias("maximum"),
        if_type("numeric", "mean").alias("mean"),
        if_type("datetime", "early").alias("earliest"),
        if_type("datetime", "late").alias("latest"),
    ).orderBy("position")


def semantic_types(df: DataFrame) -> DataFrame:
    return profile(df).select("name", "semantic_type")
