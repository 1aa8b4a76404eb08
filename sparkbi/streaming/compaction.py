"""Newest-wins compaction of landed events.

Silver holds one row per event in plain Parquet files by day and hour. A manifest lists the
folder that is valid for each day and hour; it is written last, so readers never see half a
run, and they need no deduplication of their own. Beside each folder the manifest names the hour's Bloom
filter of event ids, so a run finds the hours with older copies of its events without reading history.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkbi.functions.columns import is_time, parse_timestamp, row_order
from sparkbi.sources.published import Store
from sparkbi.streaming.envelope import ENVELOPE
from sparkbi.streaming.key_index import FILTER, build_filters, may_hold, sizes

QUERY_ID = "sql.streaming.queryId"
SILVER = ENVELOPE + ", event_at timestamp, dt string, hour string"
MANIFEST = re.compile(r"v(\d{9})\.json")
#: Filters of more runs than this are copied into one table by the next run.
MOST_FILTER_RUNS = 16


def event_moment(events: DataFrame, time: str) -> Column:
    """The event time as a moment: text in any accepted form and offset is parsed."""
    return F.col(time) if is_time(events.schema[time].dataType) else parse_timestamp(F.col(time))


def compact_batch(events: DataFrame, key: str = "event_id", time: str = "event_time", tie: Sequence[str] = ()) -> DataFrame:
    """The newest row of each event by the moment it names, unreadable times last.

    The time as written and the full content break ties, so reruns agree. Filtering on row
    number 1 makes every task keep one row per event before the shuffle, so an event copied
    millions of times costs no more than one per task.
    """
    timed = events.withColumn("_moment", event_moment(events, time))
    order = row_order(timed, ["_moment desc", f"{time} desc", *tie])
    place = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return timed.withColumn("_place", place).where(F.col("_place") == 1).drop("_place", "_moment")


def _current(store: Store, silver: str) -> tuple[int, dict[str, Any]]:
    numbers = sorted(int(found[1]) for found in map(MANIFEST.fullmatch, store.sizes(f"{silver}/manifests")) if found)
    if not numbers:
        return 0, {"run": None, "partitions": {}}
    return numbers[-1], json.loads(store.read(f"{silver}/manifests/v{numbers[-1]:09d}.json"))


def _hours(rows: DataFrame) -> set[str]:
    """Names of the days and hours in ``rows``; one per hour reaches the driver."""
    return {f"dt={row['dt']}/hour={row['hour']}" for row in rows.select("dt", "hour").distinct().collect()}


def _parts(name: str) -> tuple[str, str]:
    day, hour = name.split("/")
    return day.removeprefix("dt="), hour.removeprefix("hour=")


def _live_filters(spark: SparkSession, silver: str, filters: dict[str, list]) -> DataFrame:
    """The filters that ``filters`` (hour to run and size) names: rows of hours written again since are left out."""
    runs = sorted({run for run, _ in filters.values()})
    read = spark.read.schema(FILTER).parquet(*[f"{silver}/filters/{run}" for run in runs])
    at = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    live = spark.createDataFrame([(*_parts(name), run) for name, (run, _) in filters.items()], "dt string, hour string, run string")
    return read.withColumn("run", at).join(F.broadcast(live), ["dt", "hour", "run"]).drop("run")  # a row per hour


def _older_hours(spark: SparkSession, silver: str, fresh: DataFrame, sealed: dict[str, Any]) -> tuple[set[str], set[str]]:
    """Hours that had to be opened, and those that do hold an older copy of a fresh event."""
    partitions, filters = sealed["partitions"], sealed.get("filters", {})
    opened = set(partitions) - set(filters)  # written before there were filters
    if filters:
        used = sorted({size for _, size in filters.values()})
        opened |= _hours(may_hold(fresh.select("event_id"), _live_filters(spark, silver, filters), used))
    if not opened:
        return set(), set()
    held = spark.read.schema(SILVER).parquet(*[f"{silver}/{partitions[name]}" for name in sorted(opened)])
    return opened, _hours(held.select("event_id", "dt", "hour").join(fresh.select("event_id"), "event_id", "left_semi"))


def compact_into(batch: DataFrame, silver: str, run: str) -> dict[str, list[str]]:
    """Merge a batch into ``silver`` and seal the result; repeating the last ``run`` changes nothing.

    Only the days and hours that the batch names, or that hold an older copy of one of its events,
    are written again. The hours' filters say which may; only those are opened, for their ids.
    Returns the hours ``opened`` for that and those ``written``.
    """
    spark = batch.sparkSession
    store = Store(spark, silver)
    number, sealed = _current(store, silver)
    if sealed["run"] == run:
        return {"opened": [], "written": []}
    partitions: dict[str, str] = sealed["partitions"]
    incoming = f"{silver}/incoming/{run}"
    newest = compact_batch(batch).withColumn("event_at", event_moment(batch, "event_time"))
    newest.select(*[part.split()[0] for part in SILVER.split(", ")]).write.mode("overwrite").parquet(incoming)
    fresh = spark.read.schema(SILVER).parquet(incoming)
    touched, opened = _hours(fresh), set()
    if partitions and touched:
        opened, holding = _older_hours(spark, silver, fresh, sealed)
        touched |= holding
    merged = fresh
    old = [f"{silver}/{partitions[name]}" for name in sorted(touched & set(partitions))]
    if old:
        merged = compact_batch(fresh.unionByName(spark.read.schema(SILVER).parquet(*old)))
    target = f"data/{run}"
    # Adaptive execution splits a large hour over several files and joins small ones.
    placed = merged.withColumns({"_dt": F.col("dt"), "_hour": F.col("hour")}).hint("rebalance", "_dt", "_hour")
    placed.write.mode("overwrite").option("compression", "zstd").partitionBy("_dt", "_hour").parquet(f"{silver}/{target}")
    written = {
        f"dt={day.removeprefix('_dt=')}/hour={hour.removeprefix('_hour=')}": f"{target}/{day}/{hour}"
        for day in store.sizes(f"{silver}/{target}")
        if day.startswith("_dt=")
        for hour in store.sizes(f"{silver}/{target}/{day}")
        if hour.startswith("_hour=")
    }
    kept = {name: folder for name, folder in partitions.items() if name not in touched}
    filters = _write_filters(spark, silver, run, list(written.values()), {name: entry for name, entry in sealed.get("filters", {}).items() if name in kept})
    store.write(
        f"{silver}/manifests/v{number + 1:09d}.json", json.dumps({"run": run, "partitions": kept | written, "filters": filters}, sort_keys=True)
    )
    store.remove(incoming)
    return {"opened": sorted(opened), "written": sorted(written)}


def _write_filters(spark: SparkSession, silver: str, run: str, folders: list[str], kept: dict[str, list]) -> dict[str, list]:
    """Filters of the hours just written, with those of earlier runs once these are many; hour to (run, size)."""
    if not folders:
        return kept
    events = spark.read.schema(SILVER).parquet(*[f"{silver}/{folder}" for folder in folders]).select("event_id", "dt", "hour")
    chosen = sizes(events.groupBy("dt", "hour").agg(F.count(F.lit(1)).alias("events")))
    by_hour = F.element_at(F.create_map(*[F.lit(x) for (dt, hour), size in chosen.items() for x in (f"{dt}/{hour}", size)]), F.concat_ws("/", "dt", "hour"))
    made = build_filters(events, by_hour)
    own = {f"dt={dt}/hour={hour}": [run, size] for (dt, hour), size in chosen.items()}
    if len({name for name, _ in kept.values()}) >= MOST_FILTER_RUNS:
        made = made.unionByName(_live_filters(spark, silver, kept))
        kept = {name: [run, size] for name, (_, size) in kept.items()}
    made.hint("rebalance", "size", "block").sortWithinPartitions("size", "block").write.mode("overwrite").option("compression", "zstd").parquet(f"{silver}/filters/{run}")
    return kept | own


def compact_stream(spark: SparkSession, bronze: str, silver: str, checkpoint: str) -> StreamingQuery:
    """Compact everything landed since the last run and stop.

    A batch is named by query and number, so a repeated one is recognised. Inputs already done
    are known to the checkpoint.
    """
    landed = spark.readStream.schema(ENVELOPE + ", dt string, hour string").json(bronze)

    def write(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty(QUERY_ID)
        compact_into(batch, silver, f"{query}-{number}")

    stream = landed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).start()


def read_compacted(spark: SparkSession, silver: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """One row per event over all runs, from the files of the current manifest.

    ``since`` and ``until`` are days (``yyyy-MM-dd``, both included); other days are not opened.
    """
    partitions = _current(Store(spark, silver), silver)[1]["partitions"]
    days = {name: name.split("/")[0].removeprefix("dt=") for name in partitions}
    wanted = [name for name, day in days.items() if (since is None or day >= since) and (until is None or day <= until)]
    if not wanted:
        return spark.createDataFrame([], SILVER)
    return spark.read.schema(SILVER).parquet(*[f"{silver}/{partitions[name]}" for name in sorted(wanted)])


def first_wins(events: DataFrame, time: str, delay: str = "1 day", key: str = "event_id") -> DataFrame:
    """Streaming alternative: keep the first copy seen within the watermark delay; ``newest_wins`` keeps the newest."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
