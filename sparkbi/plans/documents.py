"""Nested documents built row by row from the sample tables, then flattened again."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkbi.operators.catalog import champion_catalog, efficiency, item_catalog, reference_prices, rune_catalog
from sparkbi.operators.documents import flatten_events, lacking_patches, match_item_events, participants, snapshots
from sparkbi.operators.inventory import joined_text
from sparkbi.operators.pricing import price_model
from sparkbi.plans.bi import rounded
from sparkbi.plans.events import PEPPER, hmac_sql
from sparkbi.plans.registry import query, table


def matches(spark, folder) -> DataFrame:
    """Each order as a match between its customer (team 100) and its clerk (team 200)."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")

    def player(number: int, team: int, name, role):
        return F.struct(
            F.lit(number).cast("long").alias("participantId"),
            name.alias("puuid"),
            (customer % 150).alias("championId"),
            F.concat(F.lit("champion "), customer % 150).alias("championName"),
            F.lit(team).cast("long").alias("teamId"),
            role.alias("teamPosition"),
            F.lit("SOLO").alias("individualPosition"),
            (F.col("o_orderstatus") == ("F" if number == 1 else "O")).alias("win"),
            (key % 12).alias("kills"),
            (key % 9).alias("deaths"),
            (key % 15).alias("assists"),
            F.floor("o_totalprice").alias("goldEarned"),
        )

    info = F.struct(
        F.concat(F.year("o_orderdate").cast("string"), F.lit("."), F.month("o_orderdate"), F.lit(".1")).alias("gameVersion"),
        F.lit(420).cast("long").alias("queueId"),
        (key % 3000).alias("gameDuration"),
        F.array(
            player(1, 100, F.concat(F.lit("buyer-"), customer), F.when(key % 4 == 0, "").otherwise("TOP")),
            player(2, 200, F.concat(F.lit("clerk-"), key % 10), F.col("o_orderpriority")),
        ).alias("participants"),
    )
    rows = table(spark, folder, "orders").select(F.concat(F.lit("M_"), key).alias("match_id"), info.alias("info"))
    return rows.repartition("match_id")  # spread as a landing table is; the table here is one file in one task


def timelines(spark, folder) -> DataFrame:
    """Frames at minutes 0, 5, 12 and 18; items bought, sold, undone and destroyed on the way."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")

    def event(kind: str, player: int, minute, item=None, before=None, after=None):
        nothing = F.lit(None).cast("long")
        return F.struct(
            F.lit(kind).alias("type"),
            F.lit(player).cast("long").alias("participantId"),
            (nothing if item is None else item).cast("long").alias("itemId"),
            (nothing if before is None else before).cast("long").alias("beforeId"),
            (nothing if after is None else after).cast("long").alias("afterId"),
            (minute * 60000).cast("long").alias("timestamp"),
        )

    def frame(minute: int, *events):
        def state(factor: int):
            return F.struct(
                F.floor(F.col("o_totalprice") * minute / factor).alias("totalGold"),
                (key % 500).alias("currentGold"),
                F.lit(minute).cast("long").alias("level"),
                (customer * minute).alias("xp"),
                (key % 7 * minute).alias("minionsKilled"),
                (customer % 5).alias("jungleMinionsKilled"),
                F.struct((key % 100).alias("x"), (customer % 100).alias("y")).alias("position"),
            )

        players = F.create_map(F.lit("1"), state(100), F.lit("2"), state(200), F.lit("3"), state(300))
        return F.struct((F.lit(minute) * 60000).cast("long").alias("timestamp"), players.alias("participantFrames"), F.array(*events).alias("events"))

    a, b = key % 20 + 1, customer % 20 + 1
    frames = F.array(
        frame(0, event("ITEM_PURCHASED", 1, F.lit(3), a), event("ITEM_PURCHASED", 1, F.lit(2), b)),
        frame(5, event("ITEM_SOLD", 1, F.lit(11), a), event("ITEM_PURCHASED", 2, F.lit(4), b), event("WARD_PLACED", 2, F.lit(4), a)),
        frame(12, event("ITEM_UNDO", 1, F.lit(14), None, b, a), event("ITEM_PURCHASED", 3, F.lit(15), a)),
        frame(18, event("ITEM_DESTROYED", 2, F.lit(16), a), event("ITEM_PURCHASED", 2, F.lit(16), a)),
    )
    rows = table(spark, folder, "orders").select(F.concat(F.lit("M_"), key).alias("match_id"), F.struct(frames.alias("frames")).alias("info"))
    return rows.repartition("match_id")


VERSION = "CAST(year(o_orderdate) AS VARCHAR) || '.' || month(o_orderdate) || '.1'"
PLAYERS = f"""
    SELECT o_orderkey, o_custkey, 'M_' || o_orderkey AS match_id, 1 AS participant_id, 'buyer-' || o_custkey AS puuid, 100 AS team_id,
           CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'TOP' END AS position, o_orderstatus = 'F' AS win, {VERSION} AS game_version, o_totalprice FROM orders
    UNION ALL
    SELECT o_orderkey, o_custkey, 'M_' || o_orderkey, 2, 'clerk-' || (o_orderkey % 10), 200, o_orderpriority, o_orderstatus = 'O', {VERSION}, o_totalprice FROM orders
"""


@query(
    "doc_participants",
    f"""
    SELECT match_id || ':' || participant_id AS match_participant_key, {hmac_sql('puuid', PEPPER)} AS puuid_hash, game_version,
           o_custkey % 150 AS champion_id, coalesce(nullif(position, ''), 'SOLO') AS role, win, o_orderkey % 12 AS kills,
           CAST(floor(o_totalprice) AS BIGINT) AS gold_earned, o_orderkey % 3000 AS game_duration_s
    FROM ({PLAYERS})
    """,
)
def doc_participants(spark, folder):
    return participants(matches(spark, folder), PEPPER).select(
        "match_participant_key", "puuid_hash", "game_version", "champion_id", "role", "win", "kills", "gold_earned", "game_duration_s"
    )


@query(
    "doc_events",
    """
    WITH e AS (SELECT 'M_' || o_orderkey AS match_id, o_orderkey % 20 + 1 AS a, o_custkey % 20 + 1 AS b FROM orders)
    SELECT match_id, t.* FROM e, LATERAL (VALUES
      (1, 3, 0, 0, 'ITEM_PURCHASED', a, 0, 0), (1, 2, 0, 1, 'ITEM_PURCHASED', b, 0, 0), (1, 11, 1, 0, 'ITEM_SOLD', a, 0, 0),
      (2, 4, 1, 1, 'ITEM_PURCHASED', b, 0, 0), (2, 4, 1, 2, 'WARD_PLACED', a, 0, 0), (1, 14, 2, 0, 'ITEM_UNDO', 0, b, a),
      (3, 15, 2, 1, 'ITEM_PURCHASED', a, 0, 0), (2, 16, 3, 0, 'ITEM_DESTROYED', a, 0, 0), (2, 16, 3, 1, 'ITEM_PURCHASED', a, 0, 0)
    ) t(participant_id, minute, frame_pos, event_pos, event_type, item_id, before_id, after_id)
    """,
)
def doc_events(spark, folder):
    rows = flatten_events(timelines(spark, folder))
    minute = (F.col("timestamp_ms") / 60000).cast("int").alias("minute")
    return rows.select(
        "match_id", F.col("participant_id").cast("int").alias("participant_id"), minute, "frame_pos", "event_pos", "event_type", "item_id", "before_id", "after_id"
    )


@query(
    "doc_snapshots",
    f"""
    WITH p AS ({PLAYERS}),
    f AS (SELECT * FROM (VALUES (10, 5), (15, 12), (20, 18)) t(minute, frame)),
    s AS (SELECT o_orderkey, o_custkey, o_totalprice, 'M_' || o_orderkey AS match_id, {VERSION} AS game_version, n AS participant_id, minute, frame,
                 o_orderkey % 20 + 1 AS a, o_custkey % 20 + 1 AS b FROM orders, f, (SELECT unnest([1, 2, 3]) AS n))
    SELECT s.match_id || ':' || s.participant_id AS match_participant_key, s.minute, s.game_version, p.team_id, p.position AS role, coalesce(p.win, false) AS win,
           CAST(floor(s.o_totalprice * frame / (s.participant_id * 100)) AS BIGINT) AS total_gold, s.o_orderkey % 7 * frame AS cs, s.o_custkey % 100 AS position_y,
           CASE WHEN s.participant_id = 1 AND minute = 10 THEN b || ',' || a
                WHEN s.participant_id = 1 AND minute = 15 THEN CAST(a AS VARCHAR)
                WHEN s.participant_id = 1 THEN CAST(a AS VARCHAR)
                WHEN s.participant_id = 2 AND minute < 20 THEN CAST(b AS VARCHAR)
                WHEN s.participant_id = 2 THEN CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE b || ',' || a END
                ELSE '' END AS inventory
    FROM s LEFT JOIN p ON s.match_id = p.match_id AND s.participant_id = p.participant_id
    """,
)
def doc_snapshots(spark, folder):
    rows = snapshots(matches(spark, folder), timelines(spark, folder))
    return rows.select(
        "match_participant_key", "minute", "game_version", F.col("team_id").cast("int").alias("team_id"), "role", "win", "total_gold", "cs", "position_y",
        joined_text(F.col("inventory")).alias("inventory"),
    )


def _item_documents(spark, folder) -> DataFrame:
    """Each part as a catalog document with one item."""
    size = F.col("p_size").cast("double")
    brand = F.concat(F.lit("<b>"), F.col("p_brand"), F.lit("</b>"))
    # The number before the label, after it, and a tag between the words, which is no match.
    described = (
        F.when(F.col("p_size") % 4 == 0, F.concat(brand, F.lit("<br>"), F.col("p_size"), F.lit(" ability haste")))
        .when(F.col("p_size") % 4 == 1, F.concat(F.lit("Ability Haste <i>+"), F.col("p_size"), F.lit(".5</i>"), brand))
        .otherwise(F.concat(brand, F.lit("<br>"), F.col("p_size"), F.lit(" <i>Ability</i> Haste")))
    )
    item = F.struct(
        F.col("p_name").alias("name"),
        described.alias("description"),
        F.when(F.col("p_size") % 4 != 0, F.col("p_size") % 4).cast("long").alias("depth"),
        F.array("p_type", "p_brand").alias("tags"),
        F.when(F.col("p_size") % 2 == 0, F.array(F.lit("next"))).alias("into"),
        F.struct((F.col("p_size") % 5 != 0).alias("purchasable"), F.col("p_retailprice").alias("total")).alias("gold"),
        F.create_map(F.lit("11"), F.col("p_size") % 3 != 0, F.lit("12"), F.lit(True)).alias("maps"),
        F.create_map(F.lit("FlatPhysicalDamageMod"), size, F.lit("FlatHPPoolMod"), size * 10).alias("stats"),
    )
    return table(spark, folder, "part").select(F.lit("16.18").alias("patch"), F.create_map(F.col("p_partkey").cast("string"), item).alias("data"))


@query(
    "catalog_items",
    """
    SELECT p_partkey AS item_id, p_name AS item_name, p_retailprice AS total_gold, p_type || ',' || p_brand AS tags,
           CAST(CASE WHEN p_size % 4 = 0 THEN 1 ELSE p_size % 4 END AS INTEGER) AS item_tier, p_size % 2 <> 0 AS is_final_item,
           CAST(p_size AS DOUBLE) AS ad, CAST(p_size * 10 AS DOUBLE) AS hp, 0::DOUBLE AS ap,
           CAST(CASE p_size % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size + 0.5 ELSE 0 END AS DOUBLE) AS ability_haste
    FROM part WHERE p_size % 5 <> 0 AND p_size % 3 <> 0
    """,
)
def catalog_items(spark, folder):
    rows = item_catalog(_item_documents(spark, folder))
    return rows.select("item_id", "item_name", "total_gold", "tags", "item_tier", "is_final_item", "ad", "hp", "ap", "ability_haste")


@query(
    "catalog_champions",
    """
    SELECT s_suppkey AS champion_id, 'key' || s_suppkey AS champion_key, s_name AS champion_name, 'Mage,Tank' AS tags, s_acctbal AS base_hp,
           CASE WHEN s_nationkey % 2 = 0 THEN CAST(s_nationkey AS DOUBLE) END AS base_armor FROM supplier
    """,
)
def catalog_champions(spark, folder):
    hp, armor = F.col("s_acctbal"), F.col("s_nationkey").cast("double")
    stats = F.when(F.col("s_nationkey") % 2 == 0, F.create_map(F.lit("hp"), hp, F.lit("armor"), armor)).otherwise(F.create_map(F.lit("hp"), hp))
    body = F.struct(
        F.col("s_suppkey").cast("string").alias("key"),
        F.concat(F.lit("key"), F.col("s_suppkey")).alias("id"),
        F.col("s_name").alias("name"),
        F.array(F.lit("Mage"), F.lit("Tank")).alias("tags"),
        stats.alias("stats"),
    )
    documents = table(spark, folder, "supplier").select(F.lit("16.18").alias("patch"), F.create_map(F.col("s_name"), body).alias("data"))
    return champion_catalog(documents).select("champion_id", "champion_key", "champion_name", "tags", "base_hp", "base_armor")


@query(
    "catalog_runes",
    """
    SELECT p_partkey AS tree_id, p_brand AS tree_name, CAST(slot AS INTEGER) AS slot, p_partkey * 10 + slot AS rune_id,
           CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END AS description
    FROM part, (SELECT unnest([0, 1]) AS slot)
    """,
)
def catalog_runes(spark, folder):
    def slot(number: int):
        rune = F.struct(
            (F.col("p_partkey") * 10 + number).alias("id"),
            F.col("p_name").alias("key"),
            F.col("p_name").alias("name"),
            F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("").alias("longDesc"),
            F.col("p_type").alias("shortDesc"),
        )
        return F.struct(F.array(rune).alias("runes"))

    trees = table(spark, folder, "part").select(
        F.lit("16.18").alias("patch"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.array(slot(0), slot(1)).alias("slots")
    )
    return rune_catalog(trees).select("tree_id", "tree_name", "slot", "rune_id", "description")


PAIRS = {"ad": "small ring", "ap": "hot plate", "mana": "no such part"}


def priced_items(spark, folder) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("item_name"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("total_gold"),
        F.col("p_size").cast("double").alias("ad"),
        (F.col("p_size") % 9).cast("double").alias("ap"),
        F.lit(1.0).alias("mana"),
    )


ITEMS = "(SELECT p_partkey AS item_id, p_name AS item_name, p_brand AS brand, p_retailprice AS total_gold, CAST(p_size AS DOUBLE) AS ad, CAST(p_size % 9 AS DOUBLE) AS ap FROM part)"


@query(
    "reference_price",
    f"""
    WITH f AS (SELECT brand, 'ad' AS stat, arg_min(total_gold, item_id) AS g, arg_min(ad, item_id) AS v FROM {ITEMS} WHERE item_name = 'small ring' GROUP BY 1
               UNION ALL SELECT brand, 'ap', arg_min(total_gold, item_id), arg_min(ap, item_id) FROM {ITEMS} WHERE item_name = 'hot plate' GROUP BY 1)
    SELECT brand, stat, round(g / v, 6) AS reference_gold_per_unit FROM f WHERE v > 0
    """,
)
def reference_price(spark, folder):
    return rounded(reference_prices(priced_items(spark, folder), PAIRS, ["brand"]), 6, "reference_gold_per_unit")


@query(
    "efficiency",
    f"""
    WITH a AS (SELECT total_gold / ad AS price FROM {ITEMS} WHERE item_name = 'small ring' ORDER BY item_id LIMIT 1),
    p AS (SELECT CASE WHEN ap > 0 THEN total_gold / ap END AS price FROM {ITEMS} WHERE item_name = 'hot plate' ORDER BY item_id LIMIT 1),
    v AS (SELECT i.*, ad * a.price + ap * coalesce(p.price, 0) AS worth FROM {ITEMS} i, a, p)
    SELECT item_id, round(worth, 4) AS estimated_stat_value, round(worth / total_gold * 100, 4) AS gold_efficiency_percent, round(total_gold - worth, 4) AS passive_shadow_price FROM v
    """,
)
def efficiency_query(spark, folder):
    items = priced_items(spark, folder)
    rows = efficiency(items, reference_prices(items, PAIRS), tuple(PAIRS))
    return rounded(rows, 4, "estimated_stat_value", "gold_efficiency_percent", "passive_shadow_price").select(
        "item_id", "estimated_stat_value", "gold_efficiency_percent", "passive_shadow_price"
    )


@query("price_model")
def price_model_query(spark, folder):
    items = priced_items(spark, folder)
    return price_model(items, ["ad", "ap"], row_key=["item_id"], references=reference_prices(items, PAIRS))


@query(
    "price_model_point",
    """
    WITH t AS (SELECT CAST(p_size AS DOUBLE) AS a, CAST(p_size % 9 AS DOUBLE) AS b, 30 * p_size + 70 * (p_size % 9) + p_retailprice AS y FROM part),
    m AS (SELECT count(*) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_,
                 count(*) * var_pop(a) + 10 AS caa, count(*) * covar_pop(a, b) AS cab, count(*) * var_pop(b) + 10 AS cbb,
                 count(*) * covar_pop(a, y) AS cay, count(*) * covar_pop(b, y) AS cby FROM t)
    SELECT 'ad' AS stat, round((cay * cbb - cby * cab) / (caa * cbb - cab * cab), 4) AS ridge_gold_per_unit, round((ay * bb - by_ * ab) / (aa * bb - ab * ab), 4) AS nnls_gold_per_unit, n AS sample_items FROM m
    UNION ALL
    SELECT 'ap', round((cby * caa - cay * cab) / (caa * cbb - cab * cab), 4), round((by_ * aa - ay * ab) / (aa * bb - ab * ab), 4), n FROM m
    """,
)
def price_model_point(spark, folder):
    """Both price estimates where no bound is active, so the normal equations give them."""
    items = priced_items(spark, folder).withColumn("total_gold", 30 * F.col("ad") + 70 * F.col("ap") + F.col("total_gold"))
    found = price_model(items, ["ad", "ap"], row_key=["item_id"], bootstrap=20)
    return rounded(found.select("stat", "ridge_gold_per_unit", "nnls_gold_per_unit", "sample_items"), 4, "ridge_gold_per_unit", "nnls_gold_per_unit")


@query(
    "doc_item_events",
    """
    WITH e AS (SELECT 'M_' || o_orderkey AS match_id, o_orderkey % 20 + 1 AS a, o_custkey % 20 + 1 AS b FROM orders)
    SELECT match_id, t.* FROM e, LATERAL (VALUES
      (1, 3, 'ITEM_PURCHASED', a, b || '', b || ',' || a), (1, 2, 'ITEM_PURCHASED', b, '', b || ''),
      (1, 11, 'ITEM_SOLD', a, b || ',' || a, CASE WHEN a = b THEN a || '' ELSE b || '' END),
      (2, 4, 'ITEM_PURCHASED', b, '', b || ''), (1, 14, 'ITEM_UNDO', 0, CASE WHEN a = b THEN a || '' ELSE b || '' END, a || ''),
      (2, 16, 'ITEM_DESTROYED', a, b || '', CASE WHEN a = b THEN '' ELSE b || '' END),
      (2, 16, 'ITEM_PURCHASED', a, CASE WHEN a = b THEN '' ELSE b || '' END, CASE WHEN a = b THEN a || '' ELSE b || ',' || a END)
    ) t(participant_id, minute, event_type, item_id, inventory_before, inventory_after)
    """,
)
def doc_item_events(spark, folder):
    rows = match_item_events(matches(spark, folder), timelines(spark, folder))
    return rows.select(
        "match_id", F.col("participant_id").cast("int").alias("participant_id"), (F.col("timestamp_ms") / 60000).cast("int").alias("minute"), "event_type", "item_id",
        joined_text(F.col("inventory_before")).alias("inventory_before"), joined_text(F.col("inventory_after")).alias("inventory_after"),
    )


@query(
    "price_model_interval",
    """
    SELECT stat, true AS ordered, true AS holds_point, true AS repeatable, (SELECT count(*) FROM part WHERE p_retailprice > 0) AS sample_items
    FROM (SELECT unnest(['ad', 'ap']) AS stat)
    """,
)
def price_model_interval(spark, folder):
    """The bootstrap interval is ordered, holds the point estimate, and is the same for rows in another order."""
    items = priced_items(spark, folder).withColumn("total_gold", 40 + 7 * F.col("ad") + 3 * F.col("ap") + F.col("item_id") % 13)
    one = price_model(items, ["ad", "ap"], row_key=["item_id"], bootstrap=60)
    two = price_model(items.repartition(7, "brand"), ["ad", "ap"], row_key=["item_id"], bootstrap=60)
    again = two.select("stat", F.col("ci95_low").alias("low"), F.col("ci95_high").alias("high"))
    point = F.col("ridge_gold_per_unit")
    same = (F.abs(F.col("low") - F.col("ci95_low")) < 1e-6) & (F.abs(F.col("high") - F.col("ci95_high")) < 1e-6)
    return one.join(again, "stat").select(
        "stat",
        ((F.col("ci95_low") >= 0) & (F.col("ci95_low") < F.col("ci95_high"))).alias("ordered"),
        ((F.col("ci95_low") <= point) & (point <= F.col("ci95_high"))).alias("holds_point"),
        same.alias("repeatable"),
        "sample_items",
    )


@query(
    "price_model_bound",
    """
    WITH i AS (SELECT CAST(p_size AS DOUBLE) AS ad, 100 - 2.0 * p_size AS g, CAST(p_size % 9 AS DOUBLE) AS ap FROM part),
    k AS (SELECT ad, ap, 1000 + g + 5 * ap AS y FROM i),
    c AS (SELECT sum((ap - m) * (y - n)) AS xy, sum((ap - m) * (ap - m)) AS xx FROM k, (SELECT avg(ap) AS m, avg(y) AS n FROM k))
    SELECT stat, CASE stat WHEN 'ad' THEN 0.0 ELSE (SELECT round(xy / (xx + 10), 4) FROM c) END AS ridge_gold_per_unit FROM (SELECT unnest(['ad', 'ap']) AS stat)
    """,
)
def price_model_bound(spark, folder):
    """A feature that lowers the price is held at zero; the other is then solved alone."""
    items = priced_items(spark, folder).withColumn("total_gold", 1000 + (100 - 2.0 * F.col("ad")) + 5 * F.col("ap"))
    found = price_model(items, ["ad", "ap"], row_key=["item_id"], bootstrap=20)
    return rounded(found.select("stat", "ridge_gold_per_unit"), 4, "ridge_gold_per_unit")


@query(
    "patch_refusals",
    "SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR) || '.' || month(o_orderdate) AS patch FROM orders WHERE month(o_orderdate) > 6",
)
def patch_refusals(spark, folder):
    """Patches played in the second half of each year, for which a catalog made of the first half has no items."""
    states = participants(matches(spark, folder), PEPPER).select("game_version")
    known = table(spark, folder, "orders").where(F.month("o_orderdate") <= 6)
    items = known.select(F.concat(F.year("o_orderdate").cast("string"), F.lit("."), F.month("o_orderdate"), F.lit(".1")).alias("patch"))
    return lacking_patches(states, items)
