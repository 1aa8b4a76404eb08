"""CSV and Parquet readers, datetime coercion, previews and unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sparkbi.functions.columns import clean_nan, is_time, parse_timestamp
from sparkbi.operators.profile import semantic_types
from sparkbi.operators.query import Filter, apply_filters

KOREAN_CODE_PAGE = "MS949"
MAX_PREVIEW = 1000


def _has_broken_text(spark: SparkSession, path: str) -> bool:
    """Whether some line of the file is not valid UTF-8."""
    return not spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty()


def read_csv(
    spark: SparkSession,
    path: str,
    encoding: str | None = None,
    schema: T.StructType | str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """CSV with a header; UTF-8 with or without BOM, otherwise the Korean code page.

    A file is split over many tasks; pass ``multi_line=True`` when quoted values hold line
    breaks, which keeps each file in one task. Give ``encoding`` and ``schema`` to read once:
    finding them out takes a pass each. The code page needs ``spark.sql.legacy.javaCharsets``.
    """
    if encoding is None:
        encoding = KOREAN_CODE_PAGE if _has_broken_text(spark, path) else "UTF-8"
    if encoding == KOREAN_CODE_PAGE and spark.conf.get("spark.sql.legacy.javaCharsets", "false") != "true":
        raise ValueError("set spark.sql.legacy.javaCharsets=true to read this code page")
    reader = spark.read.options(header=True, encoding=encoding, multiLine=multi_line, escape='"')
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return clean_nan(reader.csv(path))


def read_parquet(spark: SparkSession, *paths: str, filters: Sequence[Filter] = ()) -> DataFrame:
    """Parquet with NaN read as null; ``filters`` reach the scan.

    A comparison on a cleaned column cannot be pushed down, so each filter is applied to the raw
    column first, which Parquet can skip by, and again after cleaning. Filters that ask for nulls,
    which NaN becomes, wait for the cleaning.
    """
    raw = spark.read.parquet(*paths)
    pushed = [item for item in filters if item.operator in ("gt", "gte", "lt", "lte") or (item.operator == "eq" and item.value is not None)]
    return apply_filters(clean_nan(apply_filters(raw, pushed)), filters)


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """Read by file ending, refusing anything but CSV and Parquet."""
    if path.lower().endswith(".csv"):
        return read_csv(spark, path)
    if path.lower().endswith(".parquet"):
        return read_parquet(spark, path)
    raise ValueError("only CSV and Parquet files are supported")


def coerce_datetimes(df: DataFrame, max_columns: int | None = None) -> DataFrame:
    """Parse the text columns whose semantic type is datetime; bad values become null."""
    if max_columns and len(df.columns) > max_columns:
        raise ValueError(f"more than {max_columns} columns")
    # Only text can need parsing, so only text columns are profiled.
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return df
    kinds = semantic_types(df.select(*[F.col(f"`{name}`") for name in text]))
    text = [row["name"] for row in kinds.where("semantic_type = 'datetime'").collect()]
    return df.withColumns({name: parse_timestamp(F.col(name)) for name in text}) if text else df


def preview(df: DataFrame, limit: int = 100) -> DataFrame:
    """The first rows with timestamps in ISO text; the limit reaches the scan."""
    if not 1 <= limit <= MAX_PREVIEW:
        raise ValueError(f"a preview has 1 to {MAX_PREVIEW} rows")
    rows = df.limit(limit)
    iso = {
        f.name: F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS" if not isinstance(f.dataType, T.DateType) else "yyyy-MM-dd")
        for f in df.schema.fields
        if is_time(f.dataType)
    }
    return rows.withColumns(iso) if iso else rows


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns a frame lacks are null."""
    if not frames:
        raise ValueError("nothing to combine")
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), frames)
