"""Newest-wins inside a stream: the newest copy of every event, and a correction when a newer one comes.

The state of an event is the place of its newest copy in the order (moment, time as written, content hash), and how
often it was told. It is needed only until the watermark passes that moment: every copy that is
still accepted is newer then, so a timer drops the state without changing any result. Copies that
come later than ``delay`` are dropped by the watermark; batch compaction has no such limit.

Every call on the state or the timers goes to the JVM and back, and so does the answer of every key. So the key
of the state is a bucket of events by default: its places are read, compared and written together, in three calls
however many events the bucket holds. A bucket that is touched is written whole, which suits large batches;
with ``buckets=0`` each event has a state of its own.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkbi.functions.hashing import row_hash
from sparkbi.streaming.compaction import event_moment

PLACE = "micros long, written string, content long, revision int"
BUCKETS = 4096
BUCKET = "alarm long, places binary"
GRAIN_MS = 60_000  # places of a bucket go together, when the watermark has passed their minute
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class NewestCopy(StatefulProcessor):
    """Per event: tell a copy when it is newer than all told before; ``names`` are the columns that go out."""

    def __init__(self, names: Sequence[str]) -> None:
        self.names = list(names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", PLACE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        best = max(rows, key=lambda row: (row["_micros"], row["_written"], row["_content"]))
        place = (best["_micros"], best["_written"], best["_content"])
        # every call goes to the JVM and back, so each key takes as few as it can
        known = self.newest.get()
        if known is not None and place <= tuple(known)[:3]:
            return
        revision = 1 if known is None else known[3] + 1
        self.newest.update((*place, revision))
        if known is not None:
            self.handle.deleteTimer(known[0] // 1000 + 1)  # the only one of the key
        self.handle.registerTimer(best["_micros"] // 1000 + 1)
        yield Row(**{name: best[name] for name in self.names}, revision=revision)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


class NewestCopies(StatefulProcessor):
    """Per bucket of events: tell the newest copy of each event that is newer than all told before; ``names`` go out."""

    def __init__(self, names: Sequence[str], key: str) -> None:
        self.names, self.key = list(names), key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", BUCKET)

    @staticmethod
    def _expiry(micros: int) -> int:
        return (micros // 1000 // GRAIN_MS + 1) * GRAIN_MS

    def _keep(self, alarm: int | None, places: dict) -> None:
        """Write the places of the bucket; its one timer is that of the earliest."""
        earliest = self._expiry(min(place[0] for place in places.values()))
        if alarm is None or earliest < alarm:
            if alarm is not None:
                self.handle.deleteTimer(alarm)
            self.handle.registerTimer(earliest)
            alarm = earliest
        self.bucket.update((alarm, pickle.dumps(places)))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        best: dict[Any, tuple[tuple, Row]] = {}
        for row in rows:
            place, event = (row["_micros"], row["_written"], row["_content"]), row[self.key]
            if event not in best or place > best[event][0]:
                best[event] = (place, row)
        known = self.bucket.get()
        alarm, places = (None, {}) if known is None else (known[0], pickle.loads(known[1]))
        told = []
        for event, (place, row) in best.items():
            before = places.get(event)
            if before is None or place > before[:3]:
                revision = 1 if before is None else before[3] + 1
                places[event] = (*place, revision)
                told.append(Row(**{name: row[name] for name in self.names}, revision=revision))
        if told:
            self._keep(alarm, places)
        return iter(told)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        watermark, known = timerValues.getCurrentWatermarkInMs(), self.bucket.get()
        places = {} if known is None else {event: place for event, place in pickle.loads(known[1]).items() if self._expiry(place[0]) > watermark}
        if places:
            self._keep(None, places)
        else:
            self.bucket.clear()
        return iter(())

    def close(self) -> None:
        pass


def newest_wins(events: DataFrame, time: str = "event_time", delay: str = "1 day", key: str = "event_id", buckets: int = BUCKETS) -> DataFrame:
    """A stream of events to a stream of their newest copies: the columns of ``events`` and ``revision``.

    The first copy of an event has revision 1, each newer one that comes later the next number; ``latest`` makes
    the table of it. Events without a readable time are left out (``envelope.rejected`` keeps them). The
    query must keep its state in RocksDB, see ``rocksdb_state``. ``buckets`` says in how many pieces the state is
    held, of which each is read and written whole; 0 keeps every event by itself. A checkpoint goes on with the
    number it began with.
    """
    names = events.columns
    moment = event_moment(events, time)
    placed = events.withColumns(
        {"_at": moment.cast("timestamp"), "_written": F.col(time).cast("string"), "_content": row_hash(events)}
    ).withColumn("_micros", F.unix_micros("_at"))
    timed = placed.where(F.col("_at").isNotNull()).withWatermark("_at", delay)
    out = T.StructType([*[T.StructField(field.name, field.dataType, True) for field in events.schema.fields], T.StructField("revision", T.IntegerType())])
    if not buckets:
        return timed.groupBy(key).transformWithState(NewestCopy(names), out, outputMode="Append", timeMode="EventTime")
    dealt = timed.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    return dealt.groupBy("_bucket").transformWithState(NewestCopies(names, key), out, outputMode="Append", timeMode="EventTime")


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def latest(told: DataFrame, time: str = "event_time", key: str = "event_id") -> DataFrame:
    """The table that the corrections add up to: of all copies told of an event the last one in the order of the stream."""
    names = [name for name in told.columns if name not in ("revision", key)]
    content = told.drop("revision")
    place = F.struct(F.unix_micros(event_moment(told, time).cast("timestamp")).alias("micros"), F.col(time).cast("string").alias("written"), row_hash(content).alias("content"))
    best = told.groupBy(key).agg(F.max_by(F.struct(*names), place).alias("_best"))
    return best.select(key, "_best.*")


# task code goes with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
