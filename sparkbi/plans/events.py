"""State folding, as-of joins, pseudonyms, rates and stream queries on the events table."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, functions as F

from sparkbi.functions.hashing import hmac_sha256
from sparkbi.functions.text import text_stat
from sparkbi.operators.asof import attach_asof
from sparkbi.operators.inventory import final_inventory, fold_inventory, inventory_at, joined_text, life_spans, number_events
from sparkbi.operators.marts import item_event_mart
from sparkbi.operators.rates import normalize_rates
from sparkbi.plans.bi import rounded
from sparkbi.plans.registry import query, table
from sparkbi.session import checkpoint_dir
from sparkbi.streaming.compaction import compact_batch, compact_stream, read_compacted
from sparkbi.streaming.envelope import ENVELOPE, file_stream, validate
from sparkbi.streaming.landing import write_bronze, write_quarantine
from sparkbi.streaming.newest import latest, newest_wins, rocksdb_state

PEPPER = "sample-pepper"
KEYS, ORDER = ("user_id",), ("ts", "event_id")


def item_moves(spark, folder) -> DataFrame:
    """Events read as inventory moves: purchases add, errors sell, every ninth view undoes."""
    rows = table(spark, folder, "events")
    item = F.get_json_object("props", "$.k").cast("long") % 10 + 1
    kind = (
        F.when(F.col("event_type") == "purchase", "ITEM_PURCHASED")
        .when(F.col("event_type") == "error", "ITEM_SOLD")
        .when((F.col("event_type") == "view") & (F.col("event_id") % 9 == 0), "ITEM_UNDO")
    )
    moves = rows.select(
        "user_id", "ts", "event_id", kind.alias("event_type"), item.alias("item_id"), item.alias("before_id"), (item % 3).alias("after_id")
    )
    return moves.where(F.col("event_type").isNotNull())


# Each move becomes [item to remove, item to add]; 0 stands for nothing.
MOVES = """
    SELECT user_id, ts, event_id, CASE event_type WHEN 'purchase' THEN [0, k] WHEN 'error' THEN [k, 0] ELSE [k, k % 3] END AS op
    FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) % 10 + 1 AS k FROM events)
    WHERE event_type IN ('purchase', 'error') OR (event_type = 'view' AND event_id % 9 = 0)
"""
DROPPED = "CASE WHEN list_contains(a, b[1]) THEN a[:list_position(a, b[1]) - 1] || a[list_position(a, b[1]) + 1:] ELSE a END"
FOLD = f"list_reduce(ops, lambda a, b: ({DROPPED}) || (CASE WHEN b[2] > 0 THEN [b[2]] ELSE []::INTEGER[] END), []::INTEGER[])"


@query(
    "fold_state",
    f"""
    WITH m AS ({MOVES}),
    h AS (SELECT user_id, event_id, list(op) OVER w AS ops FROM m WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
    s AS (SELECT user_id, event_id, {FOLD} AS held, {FOLD.replace('list_reduce(ops', 'list_reduce(ops[:-2]')} AS earlier FROM h)
    SELECT user_id, event_id, array_to_string(earlier, ',') AS inventory_before, array_to_string(held, ',') AS inventory_after FROM s
    """,
)
def fold_state(spark, folder):
    folded = fold_inventory(item_moves(spark, folder), KEYS, ORDER)
    return folded.select(
        "user_id", "event_id", joined_text(F.col("inventory_before")).alias("inventory_before"), joined_text(F.col("inventory_after")).alias("inventory_after")
    )


@query(
    "final_state",
    f"""
    WITH h AS (SELECT user_id, list(op ORDER BY ts, event_id) AS ops FROM ({MOVES}) GROUP BY 1),
    s AS (SELECT user_id, {FOLD} AS held FROM h)
    SELECT user_id, array_to_string(held, ',') AS inventory FROM s WHERE len(held) > 0
    """,
)
def final_state(spark, folder):
    spans = life_spans(number_events(item_moves(spark, folder), KEYS, ORDER), KEYS, "ts")
    return final_inventory(spans, KEYS).select("user_id", joined_text(F.col("inventory")).alias("inventory"))


MARKS = {5: "2024-01-06", 15: "2024-01-16", 25: "2024-01-26"}


@query(
    "state_at_marks",
    f"""
    WITH k AS (SELECT unnest([5, 15, 25]) AS day),
    h AS (SELECT user_id, day, list(op ORDER BY ts, event_id) AS ops FROM ({MOVES}), k
          WHERE epoch_us(ts) // 1000 <= epoch_us(TIMESTAMP '2024-01-01') // 1000 + CAST(day AS BIGINT) * 86400000 GROUP BY 1, 2),
    s AS (SELECT user_id, day, {FOLD} AS held FROM h)
    SELECT user_id, day, array_to_string(held, ',') AS inventory FROM s WHERE len(held) > 0
    """,
)
def state_at_marks(spark, folder):
    start = F.unix_millis(F.lit("2024-01-01").cast("timestamp"))
    moves = item_moves(spark, folder).withColumn("at", F.unix_millis(F.col("ts").cast("timestamp")) - start)
    spans = life_spans(number_events(moves, KEYS, ("at", "ts", "event_id")), KEYS, "at")
    held = inventory_at(spans, [day * 86_400_000 for day in MARKS], KEYS)
    day = (F.col("mark") / 86_400_000).cast("int").alias("day")
    return held.select("user_id", day, joined_text(F.col("inventory")).alias("inventory"))


def _marks(spark, folder) -> DataFrame:
    users = table(spark, folder, "events").select("user_id").distinct()
    days = F.array(*[F.struct(F.lit(day).alias("day"), F.lit(text).cast("timestamp_ntz").alias("ts")) for day, text in MARKS.items()])
    return users.select("user_id", F.inline(days))


@query(
    "snapshot_asof",
    """
    WITH k AS (SELECT * FROM (VALUES (5, TIMESTAMP '2024-01-06'), (15, TIMESTAMP '2024-01-16'), (25, TIMESTAMP '2024-01-26')) t(day, ts)),
    m AS (SELECT user_id, day, k.ts FROM (SELECT DISTINCT user_id FROM events), k)
    SELECT m.user_id, m.day, m.ts, e.event_id FROM m ASOF LEFT JOIN events e ON m.user_id = e.user_id AND m.ts >= e.ts
    """,
)
def snapshot_asof(spark, folder):
    return attach_asof(_marks(spark, folder), table(spark, folder, "events"), ["user_id"], "ts", "event_id", ["event_id"])


@query(
    "asof_attach",
    """
    SELECT c.user_id, c.ts, c.event_id, p.value AS last_purchase
    FROM (SELECT * FROM events WHERE event_type = 'click') c
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND c.ts >= p.ts
    """,
)
def asof_attach(spark, folder):
    rows = table(spark, folder, "events")
    clicks = rows.where("event_type = 'click'").select("user_id", "ts", "event_id")
    bought = rows.where("event_type = 'purchase'").withColumnRenamed("event_id", "purchase_id")
    return attach_asof(clicks, bought, ["user_id"], "ts", "value", ["purchase_id"], "last_purchase")


@query(
    "completion_events",
    """
    SELECT event_id, round(epoch_us(ts) // 1000 / 60000.0, 6) AS minute, i.item_name, i.item_tier,
           event_type = 'purchase' AND coalesce(i.final, false) AS is_completion_event
    FROM events e LEFT JOIN (SELECT p_partkey AS item_id, p_name AS item_name, p_size AS item_tier, p_size > 25 AS final FROM part) i
      ON CAST(json_extract(props, '$.k') AS BIGINT) * 3 = i.item_id
    """,
)
def completion_events(spark, folder):
    rows = table(spark, folder, "events").select(
        "event_id",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"),
        F.when(F.col("event_type") == "purchase", "ITEM_PURCHASED").otherwise("ITEM_SOLD").alias("event_type"),
        (F.get_json_object("props", "$.k").cast("long") * 3).alias("item_id"),
    )
    items = table(spark, folder, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("item_name"),
        F.col("p_retailprice").alias("total_gold"),
        F.col("p_size").alias("item_tier"),
        (F.col("p_size") > 25).alias("is_final_item"),
    )
    mart = item_event_mart(rows, items).select("event_id", "minute", "item_name", "item_tier", "is_completion_event")
    return rounded(mart, 6, "minute")


def hmac_sql(message: str, key: str) -> str:
    """The same keyed hash in SQL, with both pads spelled out as blobs."""
    secret = key.encode()
    secret = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (f"unhex('{bytes(byte ^ mask for byte in secret).hex()}')" for mask in (0x36, 0x5C))
    return f"sha256({outer} || unhex(sha256({inner} || encode({message}))))"


@query("pseudonymize_users", f"SELECT event_id, {hmac_sql('CAST(user_id AS VARCHAR)', PEPPER)} AS pseudonym FROM events")
def pseudonymize_users(spark, folder):
    return table(spark, folder, "events").select("event_id", hmac_sha256(F.col("user_id").cast("string"), PEPPER).alias("pseudonym"))


@query(
    "text_number_extract",
    r"""
    SELECT page_id, coalesce(TRY_CAST(nullif(regexp_extract(regexp_replace(html, '<[^>]+>', ' ', 'g'), '(?i)track\(\s*\+?\s*(\d+(?:\.\d+)?)', 1), '') AS DOUBLE), 0) AS tracker
    FROM pages
    """,
)
def text_number_extract(spark, folder):
    return table(spark, folder, "pages").select("page_id", text_stat(F.col("html"), "track(").alias("tracker"))


@query(
    "normalize_rates",
    """
    WITH t AS (SELECT user_id, count(*) AS n, avg(CASE WHEN value > 20 THEN 1 ELSE 0 END) AS w, avg(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS p FROM events GROUP BY 1)
    SELECT '16.18' AS patch, CAST(user_id AS DOUBLE) AS champion_id, 'build' AS build_order, CAST(n AS DOUBLE) AS sample_games,
           round(p, 6) AS pick_rate, round(w, 6) AS win_rate, 'lol.ps-manual' AS benchmark_source, 'external-benchmark-only' AS usage_scope, n % 3 AS extra
    FROM t
    """,
)
def rates(spark, folder):
    counted = table(spark, folder, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("Games"),
        F.avg((F.col("value") > 20).cast("int")).alias("won"),
        F.avg((F.col("event_type") == "click").cast("int")).alias("picked"),
    )
    # Win rates as text percentages where that is unambiguous, pick rates as fractions.
    percent = F.when(F.col("won") > 0.02, (F.col("won") * 100).cast("string")).otherwise(F.col("won").cast("string"))
    raw = counted.select(
        F.lit("16.18").alias(" Version "),
        F.col("user_id").cast("string").alias("ChampionId"),
        F.lit("build").alias("build_order"),
        "Games",
        percent.alias("WinRate"),
        F.col("picked").alias("PickRate"),
        (F.col("Games") % 3).alias("Extra"),
    )
    return rounded(normalize_rates(raw), 6, "win_rate", "pick_rate")


def _copies(spark, folder) -> DataFrame:
    """Every event once, and a later copy with another value for every third one."""
    rows = table(spark, folder, "events").select("event_id", "ts", "user_id", "value")
    later = rows.where(F.col("event_id") % 3 == 0).select(
        "event_id", (F.col("ts") + F.expr("interval 1 hour")).alias("ts"), "user_id", (F.col("value") + 1000).alias("value")
    )
    return rows.unionByName(later)


NEWEST = """
    SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 HOUR ELSE ts END AS ts,
           round(CASE WHEN event_id % 3 = 0 THEN value + 1000 ELSE value END, 4) AS value FROM events
"""


@query("compact_newest", NEWEST)
def compact_newest(spark, folder):
    return rounded(compact_batch(_copies(spark, folder), time="ts"), 4, "value").select("event_id", "user_id", "ts", "value")


def _envelopes(rows: DataFrame) -> DataFrame:
    """Rows as JSON envelopes; some lack fields, have a null, an unknown version or no JSON."""
    body = F.to_json(
        F.struct(
            F.col("event_id").cast("string").alias("event_id"),
            F.lit("shop").alias("domain"),
            F.when(F.col("event_id") % 11 != 0, "events").alias("dataset"),
            F.when(F.col("event_id") % 7 == 0, "2.0.0").otherwise("1.0").alias("schema_version"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("event_time"),
            F.when(F.col("event_id") % 13 != 0, F.struct("user_id", "value")).alias("payload"),
        )
    )
    nullable = F.when(F.col("event_id") % 17 == 0, F.regexp_replace(body, "^\\{", '{"dataset":null,')).otherwise(body)
    return rows.select("event_id", F.when(F.col("event_id") % 101 == 0, "broken").otherwise(nullable).alias("value"))


@query(
    "stream_validate",
    """
    SELECT CASE WHEN event_id % 101 = 0 THEN 'not a JSON object'
                WHEN event_id % 11 = 0 AND event_id % 17 <> 0 AND event_id % 13 = 0 THEN 'missing fields: dataset, payload'
                WHEN event_id % 11 = 0 AND event_id % 17 <> 0 THEN 'missing fields: dataset'
                WHEN event_id % 13 = 0 THEN 'missing fields: payload'
                WHEN event_id % 7 = 0 THEN 'unsupported schema version: 2.0.0'
                ELSE 'valid' END AS outcome,
           count(*) AS events, CAST(sum(event_id) AS BIGINT) AS id_sum
    FROM events GROUP BY 1
    """,
)
def stream_validate(spark, folder):
    rows = _envelopes(table(spark, folder, "events"))
    checked = validate(rows.select("value")).select("value", "reason")
    ids = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))
    return (
        checked.dropDuplicates()
        .join(ids, "value")
        .groupBy(F.coalesce("reason", F.lit("valid")).alias("outcome"))
        .agg(F.sum("n").alias("events"), F.sum("ids").alias("id_sum"))
    )


@query("stream_compact", NEWEST)
def stream_compact(spark, folder):
    """Land the events and their later copies as JSON, then compact them as a stream in two runs."""
    root = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = _copies(spark, folder)
    payload = F.to_json(F.struct("user_id", "value"))
    landed = rows.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.lit("shop").alias("domain"),
        F.lit("events").alias("dataset"),
        F.lit("1.0.0").alias("schema_version"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("event_time"),
        payload.alias("payload"),
        F.date_format("ts", "yyyy-MM-dd").alias("dt"),
        # two landing hours a day, so some later copies lie in another hour or day than the copy they replace
        F.lpad((F.floor(F.hour("ts") / 12) * 12).cast("string"), 2, "0").alias("hour"),
        (F.col("value") >= 1000).alias("late"),
    )
    for late in (False, True):
        part = landed.where(F.col("late") == late).drop("late").hint("rebalance", "dt", "hour")
        part.write.mode("append").partitionBy("dt", "hour").json(f"{root}/bronze")
        compact_stream(spark, f"{root}/bronze", f"{root}/silver", f"{root}/offsets").awaitTermination()
    newest = read_compacted(spark, f"{root}/silver")
    return newest.select(
        F.col("event_id").cast("long").alias("event_id"),
        F.get_json_object("payload", "$.user_id").cast("long").alias("user_id"),
        F.col("event_time").cast("timestamp_ntz").alias("ts"),
        F.round(F.get_json_object("payload", "$.value").cast("double"), 4).alias("value"),
    )


@query("stream_newest", NEWEST)
def stream_newest(spark, folder):
    """The events and then their later copies through the stateful stream, in two runs; the corrections add up to the newest copies."""
    root = f"{checkpoint_dir(spark)}/newest-{uuid.uuid4().hex}"
    rows = _copies(spark, folder)
    fields = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in rows.schema)
    for late in (False, True):
        rows.where((F.col("value") >= 1000) == F.lit(late)).write.mode("append").parquet(f"{root}/inbox")
        told = newest_wins(spark.readStream.schema(fields).parquet(f"{root}/inbox"), time="ts", delay="60 days")
        with rocksdb_state(spark):
            told.writeStream.option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start(f"{root}/told").awaitTermination()
    newest = latest(spark.read.parquet(f"{root}/told"), time="ts")
    return rounded(newest, 4, "value").select("event_id", "user_id", "ts", "value")


@query("compact_mixed_offsets", NEWEST)
def compact_mixed_offsets(spark, folder):
    """Old copies are written with an offset that makes their text look later than the new copies in UTC."""
    rows = _copies(spark, folder)
    old = F.concat(F.date_format(F.col("ts") + F.expr("interval 9 hours"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+09:00"))
    new = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    spelled = rows.withColumn("event_time", F.when(F.col("value") < 1000, old).otherwise(new))
    return rounded(compact_batch(spelled), 4, "value").select("event_id", "user_id", "ts", "value")


@query(
    "stream_land",
    """
    SELECT dt, CASE WHEN dt IS NULL THEN 'quarantine' ELSE 'bronze' END AS landed, count(*) AS events FROM (
        SELECT CASE WHEN event_id % 101 = 0 OR event_id % 13 = 0 OR event_id % 7 = 0 OR (event_id % 11 = 0 AND event_id % 17 <> 0) THEN NULL
                    ELSE strftime(ts, '%Y-%m-%d') END AS dt FROM events)
    GROUP BY dt
    """,
)
def stream_land(spark, folder):
    """Good and bad events through both file sinks, the whole stream offered twice."""
    root = f"{checkpoint_dir(spark)}/land-{uuid.uuid4().hex}"
    _envelopes(table(spark, folder, "events")).select("value").write.text(f"{root}/inbox")
    for _ in range(2):  # the second run finds nothing new
        write_bronze(file_stream(spark, f"{root}/inbox"), f"{root}/bronze", f"{root}/offsets/good", once=True).awaitTermination()
        write_quarantine(file_stream(spark, f"{root}/inbox"), f"{root}/bad", f"{root}/offsets/bad", once=True).awaitTermination()
    good = spark.read.schema(ENVELOPE + ", dt string, hour string").json(f"{root}/bronze").select("dt", F.lit("bronze").alias("landed"))
    bad = spark.read.schema("value string, reason string").json(f"{root}/bad").select(F.lit(None).cast("string").alias("dt"), F.lit("quarantine").alias("landed"))
    return good.unionByName(bad).groupBy("dt", "landed").agg(F.count(F.lit(1)).alias("events"))
