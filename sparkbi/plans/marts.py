"""Marts over order lines read as player snapshots, with parts as items."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from sparkbi.functions.text import patch_key
from sparkbi.operators import marts
from sparkbi.plans.bi import rounded
from sparkbi.plans.match_marts import run_workflow
from sparkbi.plans.registry import query, table
from sparkbi.session import checkpoint_dir
from sparkbi.sources.published import read_current

STATS = ("ad", "ap")


def states(spark, folder) -> DataFrame:
    """Each order line as one snapshot: year as match, line number as minute, status as team,
    return flag as lane, and three item ids as its inventory, the last often unknown."""
    rows = table(spark, folder, "lineitem")
    parts = F.array("l_partkey", "l_suppkey", F.col("l_orderkey") + 1000)
    held = F.when(F.col("l_quantity") < 10, F.array().cast("array<bigint>")).otherwise(parts)
    return rows.select(
        F.year("l_shipdate").cast("string").alias("match_id"),
        F.col("l_orderkey").alias("participant_id"),
        F.col("l_linenumber").alias("minute"),
        F.concat(F.year("l_shipdate").cast("string"), F.lit("."), F.month("l_shipdate"), F.lit(".1")).alias("game_version"),
        F.col("l_linestatus").alias("team_id"),
        (F.col("l_partkey") % 40).alias("champion_id"),
        F.nullif("l_returnflag", F.lit("A")).alias("role"),
        (F.col("l_tax") > 0.04).alias("win"),
        F.floor("l_extendedprice").alias("total_gold"),
        held.alias("inventory"),
    )


def items(spark, folder) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("item_name"),
        F.floor("p_retailprice").alias("total_gold"),
        F.col("p_size").cast("double").alias("ad"),
        (F.col("p_size") % 9).cast("double").alias("ap"),
    )


STATES = """
    s AS (SELECT row_number() OVER () AS rid, CAST(year(l_shipdate) AS VARCHAR) AS match_id, l_orderkey AS participant_id, l_linenumber AS minute,
                 CAST(year(l_shipdate) AS VARCHAR) || '.' || month(l_shipdate) || '.1' AS game_version, l_linestatus AS team_id, l_partkey % 40 AS champion_id,
                 nullif(l_returnflag, 'A') AS role, l_tax > 0.04 AS win, CAST(floor(l_extendedprice) AS BIGINT) AS total_gold,
                 CASE WHEN l_quantity < 10 THEN [] ELSE [l_partkey, l_suppkey, l_orderkey + 1000] END AS inventory FROM lineitem)
"""
STOCK = """
    u AS (SELECT rid, unnest(inventory) AS item_id, generate_subscripts(inventory, 1) AS pos FROM s),
    v AS (SELECT rid, CAST(sum(floor(p_retailprice)) AS DOUBLE) AS cost, string_agg(coalesce(p_name, CAST(item_id AS VARCHAR)), ', ' ORDER BY pos) AS names,
                 sum(p_size) AS ad, sum(p_size % 9) AS ap FROM u LEFT JOIN part ON p_partkey = item_id GROUP BY 1),
    i AS (SELECT s.*, coalesce(cost, 0) AS inventory_cost, coalesce(names, '') AS item_names, CAST(coalesce(ad, 0) AS DOUBLE) AS inventory_ad,
                 CAST(coalesce(ap, 0) AS DOUBLE) AS inventory_ap FROM s LEFT JOIN v USING (rid))
"""
TEAMS = """
    t AS (SELECT match_id, minute, team_id, CAST(sum(total_gold) AS BIGINT) AS g FROM s GROUP BY ALL),
    td AS (SELECT a.match_id, a.minute, a.team_id, a.g AS team_total_gold, b.g AS team_total_gold_opponent, a.g - b.g AS team_gold_diff
           FROM t a LEFT JOIN t b ON a.match_id = b.match_id AND a.minute = b.minute AND a.team_id <> b.team_id)
"""
LANES = """
    l1 AS (SELECT match_id, minute, team_id, role, total_gold FROM
             (SELECT *, row_number() OVER (PARTITION BY match_id, minute, team_id, role ORDER BY participant_id, total_gold) AS rn FROM s)
           WHERE rn = 1),
    ld AS (SELECT a.match_id, a.minute, a.team_id, a.role, b.total_gold AS total_gold_opponent
           FROM l1 a LEFT JOIN l1 b ON a.match_id = b.match_id AND a.minute = b.minute AND a.role IS NOT DISTINCT FROM b.role AND a.team_id <> b.team_id)
"""
CONTEXT = """
    c AS (SELECT i.*, team_total_gold, team_gold_diff, total_gold_opponent, total_gold - total_gold_opponent AS lane_gold_diff, CAST(win AS INTEGER) AS observed_win
          FROM i JOIN td USING (match_id, minute, team_id)
          JOIN ld ON i.match_id = ld.match_id AND i.minute = ld.minute AND i.team_id = ld.team_id AND i.role IS NOT DISTINCT FROM ld.role)
"""
ALL_PARTS = f"WITH {STATES}, {STOCK}, {TEAMS}, {LANES}, {CONTEXT}"

COHORT = "count(participant_id) AS sample_players, count(DISTINCT match_id) AS sample_matches, round(avg(observed_win), 6) AS observed_win_rate"
MEANS = """round(avg(inventory_cost), 6) AS average_inventory_cost, round(avg(team_gold_diff), 6) AS average_team_gold_diff,
           round(avg(lane_gold_diff), 6) AS average_lane_gold_diff"""
STOCK_MEANS = "round(avg(inventory_ad), 6) AS average_inventory_ad, round(avg(inventory_ap), 6) AS average_inventory_ap"


def _rounded(df: DataFrame) -> DataFrame:
    digits = {
        "observed_win_rate": 6,
        "average_total_gold": 6,
        "average_inventory_cost": 6,
        "average_team_gold_diff": 6,
        "average_lane_gold_diff": 6,
        "average_inventory_ad": 6,
        "average_inventory_ap": 6,
        "inventory_missing_ratio": 6,
    }
    return df.withColumns({name: F.round(name, places) for name, places in digits.items() if name in df.columns})


def context(spark, folder) -> DataFrame:
    return marts.context_mart(states(spark, folder), items(spark, folder), STATS)


@query(
    "inventory_cost",
    f"WITH {STATES}, {STOCK} SELECT participant_id, minute, total_gold, round(inventory_cost, 2) AS inventory_cost, item_names, inventory_ad, inventory_ap FROM i",
)
def inventory_cost(spark, folder):
    rows = marts.inventory_stats(states(spark, folder), items(spark, folder), STATS)
    return rounded(rows.select("participant_id", "minute", "total_gold", "inventory_cost", "item_names", "inventory_ad", "inventory_ap"), 2, "inventory_cost")


def _scaled(spark, folder, factor: int) -> DataFrame:
    """The inventory query over ids ``factor`` times as large: the answer must not depend on it."""
    larger = states(spark, folder).withColumn("inventory", F.transform("inventory", lambda item: item * factor))
    catalog = items(spark, folder).withColumn("item_id", F.col("item_id") * factor)
    rows = marts.inventory_stats(larger, catalog, STATS)
    return rounded(rows.select("participant_id", "minute", "total_gold", "inventory_cost", "item_names", "inventory_ad", "inventory_ap"), 2, "inventory_cost")


@query(
    "inventory_large_ids",
    f"""
    WITH {STATES}, {STOCK.replace("CAST(item_id AS VARCHAR)", "CAST(item_id * 100000 AS VARCHAR)")}
    SELECT participant_id, minute, total_gold, round(inventory_cost, 2) AS inventory_cost, item_names, inventory_ad, inventory_ap FROM i
    """,
)
def inventory_large_ids(spark, folder):
    return _scaled(spark, folder, 100_000)


@query(
    "inventory_duplicates",
    f"""
    WITH {STATES}, {STOCK.replace("FROM s)", "FROM (SELECT * REPLACE (list_concat(inventory, inventory[1:1]) AS inventory) FROM s))", 1)},
    d AS (SELECT participant_id, minute, total_gold, inventory_cost, item_names, inventory_ad FROM i, (SELECT unnest([1, 2])))
    SELECT participant_id, minute, total_gold, round(inventory_cost, 2) AS inventory_cost, item_names, inventory_ad FROM d
    """,
)
def inventory_duplicates(spark, folder):
    """Each snapshot twice, its first item held twice, and every catalog entry listed twice."""
    doubled = states(spark, folder).withColumn("inventory", F.concat("inventory", F.slice("inventory", 1, 1)))
    rows = marts.inventory_stats(doubled.unionByName(doubled), items(spark, folder).unionByName(items(spark, folder)), STATS)
    return rounded(rows.select("participant_id", "minute", "total_gold", "inventory_cost", "item_names", "inventory_ad"), 2, "inventory_cost")


@query(
    "context_mart",
    f"""
    {ALL_PARTS}
    SELECT match_id, minute, team_id, role, participant_id, total_gold, round(inventory_cost, 2) AS inventory_cost, item_names, team_total_gold, team_gold_diff,
           total_gold_opponent, lane_gold_diff, observed_win, 'parts' AS catalog_version FROM c
    """,
)
def context_mart(spark, folder):
    rows = marts.context_mart(states(spark, folder), items(spark, folder), STATS, catalog_version="parts")
    names = ["match_id", "minute", "team_id", "role", "participant_id", "total_gold", "inventory_cost", "item_names", "team_total_gold", "team_gold_diff"]
    return rounded(rows.select(*names, "total_gold_opponent", "lane_gold_diff", "observed_win", "catalog_version"), 2, "inventory_cost")


@query(
    "inventory_by_patch",
    f"""
    WITH {STATES},
    k AS (SELECT CAST(y AS VARCHAR) || '.' || m AS patch, p_partkey AS item_id, floor(p_retailprice) + y % 5 + m AS price FROM part, (SELECT unnest(range(1995, 1999)) AS y), (SELECT unnest([1, 6]) AS m)),
    u AS (SELECT rid, unnest(inventory) AS item_id FROM s)
    SELECT participant_id, minute, total_gold, round(coalesce(sum(price), 0), 2) AS inventory_cost
    FROM s LEFT JOIN u USING (rid) LEFT JOIN k ON k.item_id = u.item_id AND k.patch = split_part(game_version, '.', 1) || '.' || split_part(game_version, '.', 2)
    GROUP BY rid, participant_id, minute, total_gold
    """,
)
def inventory_by_patch(spark, folder):
    years, months = F.array(*[F.lit(y) for y in range(1995, 1999)]), F.array(F.lit(1), F.lit(6))
    catalog = items(spark, folder).withColumn("y", F.explode(years)).withColumn("m", F.explode(months))
    catalog = catalog.withColumn("patch", F.concat_ws(".", "y", "m", F.lit("1"))).withColumn("total_gold", F.col("total_gold") + F.col("y") % 5 + F.col("m"))
    rows = marts.inventory_stats(states(spark, folder), catalog, STATS, by_patch=True)
    return rounded(rows.select("participant_id", "minute", "total_gold", "inventory_cost"), 2, "inventory_cost")


@query(
    "team_diff",
    f"WITH {STATES}, {TEAMS} SELECT match_id, minute, team_id, team_total_gold, team_total_gold_opponent, team_gold_diff FROM td",
)
def team_diff(spark, folder):
    return marts.team_diff(states(spark, folder))


@query(
    "lane_diff",
    f"""
    WITH {STATES}, {LANES}
    SELECT participant_id, s.minute, total_gold, total_gold_opponent, total_gold - total_gold_opponent AS lane_gold_diff FROM s
    JOIN ld ON s.match_id = ld.match_id AND s.minute = ld.minute AND s.team_id = ld.team_id AND s.role IS NOT DISTINCT FROM ld.role
    """,
)
def lane_diff(spark, folder):
    rows = marts.lane_diff(states(spark, folder))
    return rows.select("participant_id", "minute", "total_gold", "total_gold_opponent", "lane_gold_diff")


@query(
    "bucket_cohorts",
    f"""
    {ALL_PARTS}
    SELECT game_version, minute, role, CAST(floor(total_gold / 5000) * 5000 AS BIGINT) AS gold_bucket_start, CAST(floor(total_gold / 5000) * 5000 + 4999 AS BIGINT) AS gold_bucket_end,
           {COHORT}, round(avg(total_gold), 6) AS average_total_gold, {MEANS}, {STOCK_MEANS} FROM c GROUP BY 1, 2, 3, 4, 5
    """,
)
def bucket_cohorts(spark, folder):
    return _rounded(marts.bucket_cohorts(context(spark, folder), 5000))


PATCH = "split_part(game_version, '.', 1) || '.' || split_part(game_version, '.', 2) AS patch"


@query(
    "trend_by_period",
    f"{ALL_PARTS} SELECT {PATCH}, minute, {COHORT}, round(avg(total_gold), 6) AS average_total_gold, {MEANS}, {STOCK_MEANS} FROM c GROUP BY 1, 2",
)
def trend_by_period(spark, folder):
    return _rounded(marts.patch_trend(context(spark, folder)))


@query(
    "coverage",
    f"""
    {ALL_PARTS} SELECT {PATCH}, minute, role, {COHORT}, count(DISTINCT champion_id) AS sample_champions, round(avg(total_gold), 6) AS average_total_gold,
           round(avg(CASE WHEN len(inventory) = 0 THEN 1 ELSE 0 END), 6) AS inventory_missing_ratio FROM c GROUP BY 1, 2, 3
    """,
)
def coverage(spark, folder):
    return _rounded(marts.coverage(context(spark, folder)))


@query(
    "cohort_summary",
    f"{ALL_PARTS} SELECT game_version, minute, champion_id, role, item_names, {COHORT}, {MEANS} FROM c GROUP BY 1, 2, 3, 4, 5",
)
def cohort_summary(spark, folder):
    return _rounded(marts.win_summary(context(spark, folder)))


@query(
    "match_workflow",
    f"""
    {ALL_PARTS}
    SELECT {PATCH}, minute, {COHORT}, round(avg(total_gold), 6) AS average_total_gold, {MEANS}, {STOCK_MEANS} FROM c GROUP BY 1, 2
    """,
)
def match_workflow(spark, folder):
    """Snapshots of all patches published, priced by the catalog of their patch, and the trend read from its published files."""
    root = f"{checkpoint_dir(spark)}/workflow-{uuid.uuid4().hex}"
    rows = states(spark, folder)
    # One catalog per patch that occurs, as a game has them; a few dozen months here. The entries are the same in all of them.
    patches = [row["patch"] for row in rows.select(patch_key(F.col("game_version")).alias("patch")).distinct().orderBy("patch").collect()]
    catalog = items(spark, folder).withColumn("patch", F.array(*[F.lit(f"{patch}.1") for patch in patches]))
    run_workflow({"player_states": rows}, catalog, root, "parts", with_profile=False)
    return _rounded(read_current(spark, root, "patch_stat_trend"))
