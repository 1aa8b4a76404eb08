"""Named queries over the sample tables, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class NamedQuery:
    build: Build
    sql: str | None


QUERIES: dict[str, NamedQuery] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def add(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = NamedQuery(build, sql)
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load() -> dict[str, NamedQuery]:
    """Every registered query; importing the modules fills the registry."""
    from sparkbi.plans import bi, documents, events, marts, publishing, recipes, relationships  # noqa: F401

    return QUERIES
