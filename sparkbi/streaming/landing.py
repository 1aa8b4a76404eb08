"""Landing a stream as partitioned JSON lines, bad events beside it."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sparkbi.streaming.envelope import BATCH_SECONDS, accepted, rejected, validate


def _trigger(once: bool) -> dict[str, Any]:
    return {"availableNow": True} if once else {"processingTime": f"{BATCH_SECONDS} seconds"}


def write_bronze(raw: DataFrame, root: str, checkpoint: str, once: bool = False, strict: bool = False) -> StreamingQuery:
    """Write valid events to ``root`` by ``dt`` and ``hour`` of the event time.

    The file sink log and the checkpoint make each event appear once, also after a
    restart. Partitions follow the event time, so a replay lands in the same place.
    """
    events = accepted(validate(raw, strict))
    writer = events.writeStream.format("json").partitionBy("dt", "hour").option("checkpointLocation", checkpoint)
    return writer.trigger(**_trigger(once)).start(root)


def write_quarantine(raw: DataFrame, root: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write bad events with their reason, so that one of them cannot stop the stream."""
    writer = rejected(validate(raw)).writeStream.format("json").option("checkpointLocation", checkpoint)
    return writer.trigger(**_trigger(once)).start(root)
