"""Inventory state folded from purchase, sale and undo events.

Removing the first copy of an item from a list that only grows at its end makes every item
a first-in-first-out queue. So the fold does not need to be sequential: the k-th effective
removal of an item always takes its k-th purchase. A removal is void when it finds the
queue empty, and the number of void removals so far is the highest lead the removals ever
had over the purchases. Running sums and a running peak therefore give the life span of
every copy, and any state is the set of copies alive at that moment, oldest first. A key
holding a third of all events is spread over as many tasks as its size needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sparkbi.functions.columns import require
from sparkbi.operators.running import running

# The event kinds that change an inventory.
PURCHASED, SOLD, DESTROYED, UNDO = "ITEM_PURCHASED", "ITEM_SOLD", "ITEM_DESTROYED", "ITEM_UNDO"
ITEM_PREFIX = "ITEM_"

KEYS = ("match_id", "participant_id")
ORDER = ("timestamp_ms", "frame_pos", "event_pos")
CHUNK = 256
REMOVE, ADD = 0, 1


def number_events(events: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """Add ``seq`` (1-based position in the key's history) and ``events`` (its length)."""
    one = F.lit(1).cast("long")
    return running(events, keys, order, sums={"seq": one}, totals={"events": one})


def _changes() -> Column:
    """The queue operations of one event; an undo first removes, then gives back."""
    kind = F.col("event_type")
    remove = lambda item: F.struct(F.lit(REMOVE).alias("op"), item.alias("item"))
    add = lambda item: F.struct(F.lit(ADD).alias("op"), item.alias("item"))
    item = F.coalesce(F.col("item_id"), F.lit(0)).cast("long")
    before = F.coalesce(F.col("before_id"), F.lit(0)).cast("long")
    after = F.coalesce(F.col("after_id"), F.lit(0)).cast("long")
    listed = (
        F.when(kind == PURCHASED, F.array(add(item)))
        .when(kind.isin(SOLD, DESTROYED), F.array(remove(item)))
        .when(kind == UNDO, F.array(remove(before), add(after)))
    )
    return F.filter(listed, lambda change: change["item"] != 0)


def life_spans(numbered: DataFrame, keys: Sequence[str] = KEYS, time: str = ORDER[0]) -> DataFrame:
    """One row per item copy: ``item_id, start_seq, start_time, end_seq, end_time, events``.

    ``end_*`` is null for a copy that is never removed.
    """
    moves = numbered.select(*keys, "seq", "events", F.col(time).alias("at"), F.inline(_changes()))
    added = (F.col("op") == ADD).cast("long")
    removed = (F.col("op") == REMOVE).cast("long")
    queued = running(
        moves,
        [*keys, "item"],
        ["seq", "op"],
        sums={"added": added, "removed": removed, "lead": removed - added},
        peaks={"void": "lead"},
    )
    effective = F.col("removed") - F.greatest(F.col("void"), F.lit(0))
    copy = F.when(F.col("op") == ADD, F.col("added")).otherwise(effective)
    moment = F.struct("seq", "at")
    return (
        queued.withColumn("copy", copy)
        .groupBy(*keys, "item", "copy")
        .agg(
            F.min(F.when(F.col("op") == ADD, moment)).alias("start"),
            # void removals repeat the number of the effective one before them, which comes first
            F.min(F.when(F.col("op") == REMOVE, moment)).alias("end"),
            F.max("events").alias("events"),
        )
        .where(F.col("start").isNotNull())
        .select(
            *keys,
            F.col("item").alias("item_id"),
            F.col("start.seq").alias("start_seq"),
            F.col("start.at").alias("start_time"),
            F.col("end.seq").alias("end_seq"),
            F.col("end.at").alias("end_time"),
            "events",
        )
    )


def _ordered_items() -> Column:
    """Item ids of one state, oldest copy first; the list is as long as the inventory itself."""
    copies = F.sort_array(F.collect_list(F.struct("start_seq", "item_id")))
    return F.transform(copies, lambda copy: copy["item_id"])


def fold_inventory(events: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """Every item event with the inventory before and after it, as ``array<long>`` columns.

    Events are cut into chunks of a fixed number per key. A copy is sent to each chunk it
    lives in, and each event picks the copies alive around it.
    """
    require(events, [*keys, *order, "event_type", "item_id", "before_id", "after_id"])
    keys = list(keys)
    numbered = number_events(events.where(F.col("event_type").startswith(ITEM_PREFIX)), keys, order)
    spans = life_spans(numbered, keys, order[0])
    chunk_of = lambda seq: F.floor(seq / CHUNK)
    last = F.coalesce(F.col("end_seq"), F.col("events"))
    placed = spans.select(
        *keys, "item_id", "start_seq", "end_seq", F.explode(F.sequence(chunk_of(F.col("start_seq")), chunk_of(last))).alias("_chunk")
    )
    # A chunk holds the copies carried into it plus at most CHUNK purchases.
    per_chunk = placed.groupBy(*keys, "_chunk").agg(
        F.sort_array(F.collect_list(F.struct("start_seq", "item_id", "end_seq"))).alias("_copies")
    )
    rows = numbered.withColumn("_chunk", chunk_of(F.col("seq"))).join(per_chunk, [*keys, "_chunk"], "left")
    seq = F.col("seq")
    ids = lambda alive: F.transform(F.filter("_copies", alive), lambda c: c["item_id"])
    before = ids(lambda c: (c["start_seq"] < seq) & (c["end_seq"].isNull() | (c["end_seq"] >= seq)))
    after = ids(lambda c: (c["start_seq"] <= seq) & (c["end_seq"].isNull() | (c["end_seq"] > seq)))
    empty = F.array().cast("array<bigint>")
    return rows.select(
        *keys,
        *order,
        "seq",
        "event_type",
        F.coalesce(F.col("item_id"), F.lit(0)).cast("long").alias("item_id"),
        F.coalesce(before, empty).alias("inventory_before"),
        F.coalesce(after, empty).alias("inventory_after"),
    )


def final_inventory(spans: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The state after the last event of each key that still holds something."""
    return spans.where(F.col("end_seq").isNull()).groupBy(*keys).agg(_ordered_items().alias("inventory"))


def inventory_at(spans: DataFrame, marks: Sequence[int], keys: Sequence[str] = KEYS, mark: str = "mark") -> DataFrame:
    """The state at each requested time, for keys that hold something then.

    ``marks`` are literal times of the request (a handful), so each copy is repeated at
    most once per mark it is alive at.
    """
    times = F.array(*[F.lit(value) for value in sorted(set(marks))])
    alive = F.filter(times, lambda t: (t >= F.col("start_time")) & (F.col("end_time").isNull() | (t < F.col("end_time"))))
    return (
        spans.select(*keys, "item_id", "start_seq", F.explode(alive).alias(mark))
        .groupBy(*keys, mark)
        .agg(_ordered_items().alias("inventory"))
    )


def joined_text(inventory: Column) -> Column:
    """The comma-joined spelling used on output."""
    return F.array_join(F.transform(inventory, lambda item: item.cast("string")), ",")
