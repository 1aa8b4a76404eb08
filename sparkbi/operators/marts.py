"""Context, cohort, trend and event marts over player snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sparkbi.functions.columns import require, sum0
from sparkbi.functions.text import patch_key
from sparkbi.operators.aggregates import position
from sparkbi.operators.catalog import REFERENCE_ITEMS, for_each_patch, lists_patches
from sparkbi.session import cut_lineage

MINUTE_MS = 60_000
BUCKET = 500
SMALL_CATALOG = 20_000  # entries; some MB
FEW_LANES = 50_000  # lanes of a match, minute and team; some MB
FEW_SETS = 200_000  # groups of an item set that hold more than one snapshot; some MB of hashes
TEAM = ("match_id", "minute", "team_id")
LANE = (*TEAM, "role")


def _attach(rows: DataFrame, facts: DataFrame, keys: Sequence[str], few: bool = False) -> DataFrame:
    moved = facts.withColumnsRenamed({key: f"_k_{key}" for key in keys})
    moved = F.broadcast(moved) if few else moved
    match = reduce(Column.__and__, [F.col(key).eqNullSafe(F.col(f"_k_{key}")) for key in keys])
    return rows.join(moved, match, "left").drop(*[f"_k_{key}" for key in keys])


def _catalog(items: DataFrame, stats: Sequence[str], by_patch: bool) -> DataFrame:
    """One row per item id (and patch, or list of patches): of repeated ids the largest name, then cost, then stats."""
    facts = F.struct(
        F.col("item_name").cast("string").alias("name"),
        F.col("total_gold").cast("double").alias("cost"),
        *[F.col(stat).cast("double").alias(f"inventory_{stat}") for stat in stats],
    )
    patch = F.transform("patch", patch_key).alias("_patches") if by_patch and lists_patches(items) else patch_key(F.col("patch")).alias("_of_patch") if by_patch else None
    keys = [F.col("item_id").cast("long").alias("_item_id"), *([] if patch is None else [patch])]
    return items.groupBy(*keys).agg(F.max(facts).alias("_facts"))


def inventory_stats(
    states: DataFrame, items: DataFrame, stats: Sequence[str] = tuple(REFERENCE_ITEMS), by_patch: bool = False
) -> DataFrame:
    """Add ``inventory_cost``, ``item_names`` and one ``inventory_<stat>`` sum per stat.

    An unknown item costs nothing and shows its id; a repeated item counts each time; a
    repeated id in the catalog counts once. With ``by_patch`` each state uses the catalog of
    its own patch, so mixed batches need no loop; ``patch`` of the catalog may be a list, so an entry that holds for
    many patches is one row and moves once.

    What a state holds travels as one number hashed from its inventory (and patch): the known items of
    each number are gathered once and come back to the states, and each state looks up its own
    items among them. So two inventories with the same number only widen that list, no result depends on
    the hash, and rows are neither merged nor numbered. Looking up takes an inventory's length times
    its distinct items.
    """
    known = [stat for stat in stats if stat in items.columns]
    sums = ["cost", *[f"inventory_{stat}" for stat in known]]
    patch = [F.coalesce(patch_key(F.col("game_version")), F.lit(""))] if by_patch else []
    held = F.col("inventory").cast("array<long>")
    number = F.when(F.size("inventory") > 0, F.xxhash64(held, *patch))
    keys = ["_item_id", *(["_of_patch"] if by_patch else [])]
    ids = items.agg(F.min(F.col("item_id").cast("long")).alias("least"), F.max(F.col("item_id").cast("long")).alias("most")).first()
    known_range = F.filter(F.array_distinct(held), lambda item: item.between(F.lit(ids.least), F.lit(ids.most)))  # no other item can be known
    opened = states.select(number.alias("_number"), F.explode(known_range).alias("_item_id"), *[of.alias("_of_patch") for of in patch])
    # Sizes estimated from compressed files say little about either table: only a catalog with few entries goes to every task.
    few = items.limit(SMALL_CATALOG + 1).count() <= SMALL_CATALOG
    catalog = _catalog(items, known, by_patch).hint("broadcast" if few else "merge")
    entry = F.struct(*keys, "_facts.*")  # flat, as most of the bytes that are sorted and shuffled are these
    if by_patch and lists_patches(items):
        listed = catalog.withColumnRenamed("_item_id", "_listed_id")
        met = opened.join(listed.hint("broadcast" if few else "merge"), (F.col("_item_id") == F.col("_listed_id")) & F.array_contains("_patches", F.col("_of_patch")))
    else:
        met = opened.join(catalog, keys)
    priced = met.groupBy("_number").agg(F.collect_set(entry).alias("_entries"))
    same = lambda entry, item: reduce(Column.__and__, [entry["_item_id"] == item, *[entry["_of_patch"] == of for of in patch]])
    # overlapping lists of patches may give an item more than one entry: the largest, as among repeated ids
    found = lambda item: F.array_max(F.filter("_entries", lambda entry: same(entry, item)))

    def total(name: str) -> Column:
        return F.coalesce(F.aggregate(held, F.lit(0.0), lambda so_far, item: so_far + F.coalesce(found(item)[name], F.lit(0.0))), F.lit(0.0))

    names = F.array_join(F.transform(held, lambda item: F.coalesce(found(item)["name"], item.cast("string"))), ", ")
    # The number of a state follows from its inventory: it is not carried through the shuffle.
    return states.join(priced.hint("merge"), number == F.col("_number"), "left").select(
        *states.columns,
        total("cost").alias("inventory_cost"),
        F.coalesce(names, F.lit("")).alias("item_names"),
        *[total(name).alias(name) for name in sums[1:]],
    )


def _facing(own: DataFrame) -> DataFrame:
    """Team totals beside those of the other team of the match and minute."""
    other = own.select(
        F.col("match_id").alias("_m"), F.col("minute").alias("_t"), F.col("team_id").alias("_o"), F.col("team_total_gold").alias("team_total_gold_opponent")
    )
    facing = (
        F.col("match_id").eqNullSafe(F.col("_m")) & F.col("minute").eqNullSafe(F.col("_t")) & (F.col("team_id") != F.col("_o"))
    )
    return (
        own.join(other, facing, "left")
        .drop("_m", "_t", "_o")
        .withColumn("team_gold_diff", F.col("team_total_gold") - F.col("team_total_gold_opponent"))
    )


def team_diff(states: DataFrame) -> DataFrame:
    """Team total, opponent total and difference per match, minute and team.

    Totals are aggregated first, so the self-join sees one row per team; two teams per
    match and minute are assumed, as in the data model.
    """
    return _facing(states.groupBy(*TEAM).agg(sum0(F.col("total_gold")).alias("team_total_gold")))


def _lane_order(states: DataFrame, order_by: Sequence[str] = ("participant_id",)) -> list[str]:
    return [name for name in order_by if name in states.columns]


def _rivals(first: DataFrame) -> DataFrame:
    """Per team and lane the gold of the earliest first member (``_first``) among the other teams."""
    lane = W.partitionBy("match_id", "minute", "role").orderBy("_first")
    whole = lane.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rival = F.when(F.row_number().over(lane) == 1, F.nth_value("_first", 2).over(whole)).otherwise(F.first("_first").over(whole))
    return first.withColumn("_rival", rival).select(*LANE, F.col("_rival.total_gold").alias("total_gold_opponent"))


def lane_opponents(states: DataFrame, order_by: Sequence[str] = ("participant_id",)) -> DataFrame:
    """The first opponent's gold for each match, minute, team and role.

    The first member of every team is found by aggregation; within a lane a team then faces
    the earliest of the others, so no pair of players is ever formed.
    """
    order = _lane_order(states, order_by)
    return _rivals(states.groupBy(*LANE).agg(F.min(position(states, order, "total_gold")).alias("_first")))


def _few_lanes(states: DataFrame) -> bool:
    """Whether a row per lane fits into every task, from an estimate in one pass that shuffles a sketch.

    Left to Spark, the join of the snapshots with their lanes would move all snapshots as soon as the input is large.
    """
    return states.agg(F.approx_count_distinct(F.xxhash64(*LANE))).first()[0] <= FEW_LANES


def lane_diff(states: DataFrame, order_by: Sequence[str] = ("participant_id",)) -> DataFrame:
    """States with ``total_gold_opponent`` and ``lane_gold_diff``."""
    rows = _attach(states, lane_opponents(states, order_by), LANE, _few_lanes(states))
    return rows.withColumn("lane_gold_diff", F.col("total_gold") - F.col("total_gold_opponent"))


def context_mart(
    states: DataFrame,
    items: DataFrame,
    stats: Sequence[str] = tuple(REFERENCE_ITEMS),
    by_patch: bool = False,
    catalog_version: str | None = None,
) -> DataFrame:
    """Snapshots with inventory value, team and lane difference and the outcome as 0/1.

    ``catalog_version`` is stamped on every row when given. Team totals and the first player of
    every lane come from one aggregate; they meet as small tables, so the snapshots are joined
    to them once: without moving the snapshots where there are few lanes.
    """
    require(states, [*LANE, "total_gold", "inventory", "win"])
    priced = inventory_stats(states, items, stats, by_patch)
    first = F.min(position(states, _lane_order(states), "total_gold")).alias("_first")
    lanes = states.groupBy(*LANE).agg(sum0(F.col("total_gold")).alias("_gold"), first)
    teams = _facing(lanes.groupBy(*TEAM).agg(sum0(F.col("_gold")).alias("team_total_gold")))
    facts = _attach(_rivals(lanes), teams, TEAM)
    made = _attach(priced, facts, LANE, _few_lanes(states)).withColumns(
        {"lane_gold_diff": F.col("total_gold") - F.col("total_gold_opponent"), "observed_win": F.col("win").cast("int")}
    )
    return made if catalog_version is None else made.withColumn("catalog_version", F.lit(catalog_version))


def _cohort(context: DataFrame) -> list[Column]:
    return [
        F.count("participant_id").alias("sample_players"),
        F.count_distinct("match_id").alias("sample_matches"),
        F.avg("observed_win").alias("observed_win_rate"),
    ]


def _differences() -> list[Column]:
    return [
        F.avg("inventory_cost").alias("average_inventory_cost"),
        F.avg("team_gold_diff").alias("average_team_gold_diff"),
        F.avg("lane_gold_diff").alias("average_lane_gold_diff"),
    ]


def _inventory_averages(context: DataFrame) -> list[Column]:
    names = [name for name in context.columns if name.startswith("inventory_") and name != "inventory_cost"]
    return [F.avg(name).alias(f"average_{name}") for name in names]


def bucket_cohorts(context: DataFrame, size: int = BUCKET) -> DataFrame:
    """Win rate and means by version, minute, role and fixed-width gold bucket."""
    if size <= 0:
        raise ValueError("the gold bucket size must be above 0")
    start = (F.floor(F.coalesce(F.col("total_gold"), F.lit(0)) / size) * size).cast("long")
    rows = context.withColumn("gold_bucket_start", start).withColumn("gold_bucket_end", start + (size - 1))
    keys = ["game_version", "minute", "role", "gold_bucket_start", "gold_bucket_end"]
    return rows.groupBy(*keys).agg(
        *_cohort(context), F.avg("total_gold").alias("average_total_gold"), *_differences(), *_inventory_averages(context)
    )


def _with_patch(context: DataFrame) -> DataFrame:
    return context.withColumn("patch", patch_key(F.col("game_version").cast("string")))


def patch_trend(context: DataFrame) -> DataFrame:
    """The same means by patch and minute."""
    return (
        _with_patch(context)
        .groupBy("patch", "minute")
        .agg(*_cohort(context), F.avg("total_gold").alias("average_total_gold"), *_differences(), *_inventory_averages(context))
    )


def coverage(context: DataFrame) -> DataFrame:
    """Sample size and completeness by patch, minute and role."""
    empty = F.coalesce(F.size("inventory") <= 0, F.lit(True)).cast("int")
    return (
        _with_patch(context)
        .groupBy("patch", "minute", "role")
        .agg(
            *_cohort(context),
            F.count_distinct("champion_id").alias("sample_champions"),
            F.avg("total_gold").alias("average_total_gold"),
            F.avg(empty).alias("inventory_missing_ratio"),
        )
    )


def _alone(rows: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``summary`` for snapshots that are the only ones of their group: no shuffle."""
    counts = {"sample_players": F.col("participant_id").isNotNull(), "sample_matches": F.col("match_id").isNotNull()}
    values = {name: counts.get(name, F.col(name.removeprefix("average_"))) for name in summary.columns if name not in keys}
    values["observed_win_rate"] = F.col("observed_win")
    return rows.select(*keys, *[value.cast(summary.schema[name].dataType).alias(name) for name, value in values.items()])


def win_summary(context: DataFrame, published: bool = False) -> DataFrame:
    """Observed outcomes by version, minute, champion, role and item set.

    There are nearly as many groups as snapshots, so sums before the shuffle would save little and counting distinct
    matches would move the item names twice: the snapshots are brought together by group once, and all is counted there.

    A ``published`` context is cheap to read again: then the hashes of the groups are counted first, and only snapshots whose
    hash occurs more than once are moved, if these are few hashes. All others are alone in their group. Two groups with the
    same hash only move for nothing.
    """
    keys = ["game_version", "minute", "champion_id", "role", "item_names"]
    together = lambda rows: rows.repartition(*keys).groupBy(*keys).agg(*_cohort(rows), *_differences())
    if not published:
        return together(context)
    group = F.xxhash64(*keys)
    shared = cut_lineage(context.groupBy(group.alias("_group")).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select("_group"))
    if shared.count() > FEW_SETS:
        return together(context)
    is_shared = group == F.col("_group")
    summary = together(context.join(F.broadcast(shared), is_shared, "left_semi"))
    return summary.unionByName(_alone(context.join(F.broadcast(shared), is_shared, "left_anti"), summary, keys))


def item_event_mart(events: DataFrame, items: DataFrame, by_patch: bool = False) -> DataFrame:
    """Item events with item facts, fractional minute and a completion flag.

    With ``by_patch`` an event takes the facts of its own ``game_version``'s patch.
    """
    wanted = ["item_name", "total_gold", "item_tier", "is_final_item"]
    facts = [name for name in wanted if name in items.columns]
    keys = ["item_id", *(["_patch"] if by_patch else [])]
    catalog, rows = items, events
    if by_patch:
        catalog = for_each_patch(items).withColumn("_patch", patch_key(F.col("patch")))
        rows = events.withColumn("_patch", patch_key(F.col("game_version")))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*facts))
    unique = catalog.select(*keys, *facts).withColumn("_place", place).where(F.col("_place") == 1).drop("_place")
    final = F.coalesce(F.col("is_final_item"), F.lit(False)) if "is_final_item" in facts else F.lit(False)
    bought = F.coalesce(F.col("event_type") == "ITEM_PURCHASED", F.lit(False))
    return (
        rows.join(unique, keys, "left")
        .drop("_patch")
        .withColumn("minute", F.col("timestamp_ms") / MINUTE_MS)
        .withColumn("is_completion_event", bought & final)
    )
