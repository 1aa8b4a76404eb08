"""Match and timeline JSON documents, two files per match directory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkbi.operators.documents import MATCH_SCHEMA, TIMELINE_SCHEMA


def _documents(spark: SparkSession, root: str, file_name: str, schema: str) -> DataFrame:
    rows = spark.read.schema(schema).json(f"{root}/*/{file_name}", multiLine=True)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return rows.select(F.url_decode(folder).alias("match_id"), "*")


def _found(spark: SparkSession, root: str, file_name: str) -> DataFrame:
    """Match ids that have the file; only paths are looked at."""
    files = spark.read.format("binaryFile").load(f"{root}/*/{file_name}")
    return files.select(F.url_decode(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).alias("match_id"))


def read_matches(spark: SparkSession, root: str, ids: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents under ``root/<match id>/match.json`` and ``timeline.json``.

    With ``ids``, only those matches are kept and a missing file is an error. The folder is
    listed once per file name and compared with the ids as tables.
    """
    documents = _documents(spark, root, "match.json", MATCH_SCHEMA), _documents(spark, root, "timeline.json", TIMELINE_SCHEMA)
    if ids is None:
        return documents
    wanted = spark.createDataFrame([(name,) for name in ids], "match_id string")
    both = _found(spark, root, "match.json").join(_found(spark, root, "timeline.json"), "match_id", "left_semi")
    lost = [row["match_id"] for row in wanted.join(both, "match_id", "left_anti").orderBy("match_id").limit(20).collect()]
    if lost:
        raise FileNotFoundError(f"matches not collected: {', '.join(lost)}")
    one, other = (rows.join(wanted.distinct(), "match_id", "left_semi") for rows in documents)
    return one, other
