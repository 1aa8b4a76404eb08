"""Catalog JSON documents read with their patch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkbi.operators.catalog import CHAMPION_SCHEMA, ITEM_SCHEMA, RUNE_SCHEMA


def _read(spark: SparkSession, path: str, schema: str, patch: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("patch", F.lit(patch))


def read_items(spark: SparkSession, path: str, patch: str) -> DataFrame:
    return _read(spark, path, ITEM_SCHEMA, patch)


def read_champions(spark: SparkSession, path: str, patch: str) -> DataFrame:
    return _read(spark, path, CHAMPION_SCHEMA, patch)


def read_runes(spark: SparkSession, path: str, patch: str) -> DataFrame:
    return _read(spark, path, RUNE_SCHEMA, patch)
