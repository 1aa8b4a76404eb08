"""The event envelope: reading it from a stream and telling good events from bad ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkbi.functions.columns import parse_timestamp

# The required fields and the accepted major version.
FIELDS = ("event_id", "domain", "dataset", "schema_version", "event_time", "payload")
MAJOR_VERSION = "1"

BATCH_EVENTS, BATCH_SECONDS = 1000, 10
ENVELOPE = ", ".join(f"{name} string" for name in FIELDS)


def topic_stream(spark: SparkSession, broker: str, topic: str, max_events: int = BATCH_EVENTS) -> DataFrame:
    """Raw JSON values of a Kafka-compatible topic, from its beginning.

    Offsets live in the checkpoint of the query that consumes this; they advance only
    after the batch is written. Needs the Kafka connector on the session.
    """
    rows = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", broker)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", max_events)
        .load()
    )
    return rows.select(F.col("value").cast("string").alias("value"))


def file_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Raw JSON lines from files that keep arriving in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)


def validate(raw: DataFrame, strict: bool = False) -> DataFrame:
    """Envelope columns plus ``value`` and ``reason``, which is null for a valid event.

    A field that is present but null is not missing. ``strict`` fails the batch on the
    first bad event instead of marking it.
    """
    keys = F.json_object_keys("value")
    missing = F.sort_array(F.array_except(F.array(*[F.lit(name) for name in FIELDS]), keys))
    major = F.substring_index("schema_version", ".", 1)
    reason = (
        F.when(keys.isNull(), "not a JSON object")
        .when(F.size(missing) > 0, F.concat(F.lit("missing fields: "), F.array_join(missing, ", ")))
        .when(~major.eqNullSafe(F.lit(MAJOR_VERSION)), F.concat(F.lit("unsupported schema version: "), F.coalesce("schema_version", F.lit("null"))))
        .when(parse_timestamp(F.col("event_time")).isNull(), F.concat(F.lit("unreadable event time: "), F.coalesce("event_time", F.lit("null"))))
    )
    parsed = raw.select("value", F.json_tuple("value", *FIELDS).alias(*FIELDS)).withColumn("reason", reason)
    if strict:
        parsed = parsed.withColumn("reason", F.when(F.col("reason").isNotNull(), F.raise_error(F.col("reason")).cast("string")))
    return parsed


def accepted(events: DataFrame) -> DataFrame:
    """Valid events with the time parsed and the landing partition columns."""
    at = parse_timestamp(F.col("event_time"))
    return events.where(F.col("reason").isNull()).select(
        *FIELDS, F.date_format(at, "yyyy-MM-dd").alias("dt"), F.date_format(at, "HH").alias("hour")
    )


def rejected(events: DataFrame) -> DataFrame:
    return events.where(F.col("reason").isNotNull()).select("value", "reason")
